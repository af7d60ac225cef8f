"""Specifications as tables: suggestions read, checked, fingerprinted and reused."""

from __future__ import annotations

from pyspark.sql import functions as F

from rinse.functions import masks
from rinse.functions.text import fingerprint, samples_text, squeeze
from rinse.operators.lookup import lookup
from rinse.plans.answers import AnswerStore
from rinse.plans.audit import audit_patterns
from rinse.plans.reuse import answer_known, still_unknown, well_formed
from rinse.plans.suggestions import read_classifications, read_normalizations, read_patterns
from rinse.plans.validation import (
    MAX_DATE_FORMATS,
    MAX_FORMAT_LENGTH,
    MAX_REPLACEMENT_LENGTH,
    date_problem,
    replacement_problem,
)
from rinse.queries.registry import query, quoted
from rinse.session import scratch


def _case(key, options: list) -> F.Column:
    """One of the options by the key's remainder."""
    return F.get(F.array(*map(F.lit, options)), F.pmod(key, F.lit(len(options))).cast("int"))


def _case_sql(key: str, options: list) -> str:
    lines = " ".join(
        f"WHEN {at} THEN {'NULL' if one is None else quoted(one)}" for at, one in enumerate(options)
    )
    return f"CASE {key} % {len(options)} {lines} END"


# --- classifications and normalizations -------------------------------------------------


@query(f"""
    WITH seen AS (
        SELECT doc_id, doc_id % 11 = 0 AS broken, regexp_matches(text, {quoted(masks.EMAIL)}) AS email,
               regexp_matches(text, {quoted(masks.PHONE)}) AS phone FROM documents)
    SELECT doc_id, CASE WHEN broken THEN 'malformed' ELSE 'ok' END AS status,
           CASE WHEN broken OR NOT (email OR phone) THEN '' WHEN email AND phone
               THEN 'text=email+phone' WHEN email THEN 'text=email' ELSE 'text=phone' END
           || CASE WHEN broken OR doc_id % 2 = 1 THEN ''
               ELSE ';source=identifier' END AS spec
    FROM seen""")
def classifications_of_documents(t):
    def kinds(seen, kind):
        none = F.array(F.lit("none"))
        return F.when(seen, F.array(F.lit(kind), F.lit("none"))).otherwise(none)

    def entry(column, pii_types):
        return F.struct(F.lit(column).alias("column"), pii_types.alias("pii_types"))

    source = F.when(F.col("doc_id") % 2 == 0, "identifier").otherwise("none")
    entries = F.array(
        entry("lang", F.array(F.lit("none"))),
        entry("text", kinds(masks.has_phone(F.col("text")), "phone")),
        entry("made up", F.array(F.lit("email"))),
        entry("text", kinds(masks.has_email(F.col("text")), "email")),
        entry("source", F.array(source)),
    )
    whole = F.to_json(F.struct(entries.alias("columns"), F.lit("found").alias("explanation")))
    broken = F.when(F.col("doc_id") % 22 == 0, '{"columns": 3').otherwise('{"columns": [{}]}')
    table = t.documents.select(
        "doc_id", F.when(F.col("doc_id") % 11 == 0, broken).otherwise(whole).alias("suggestion")
    )
    allowed = F.array(F.lit("lang"), F.lit("source"), F.lit("text"))
    parts = F.transform(
        "spec", lambda one: F.concat(one["column"], F.lit("="), F.array_join(one["kinds"], "+"))
    )
    text = F.filter(parts, lambda one: one.startswith("text"))
    rest = F.filter(parts, lambda one: ~one.startswith("text"))
    shown = F.concat(
        F.array_join(text, ";"),
        F.array_join(F.transform(rest, lambda one: F.concat(F.lit(";"), one)), ""),
    )
    return read_classifications(table, allowed).select(
        "doc_id", "status", F.coalesce(shown, F.lit("")).alias("spec")
    )


_REST = '"explanation": "why"}'
_DATES = '{"feasible": true, "kind": "date", "rules": [], "input_formats": '
_RULES = '{"feasible": true, "kind": "rules", "input_formats": [], "output_format": "", "rules": '
# Suggestion, then what is expected of it: status, code, kind, content.
_NORMALIZATIONS = [
    (_DATES + '["yyyy-MM-dd", "dd/MM/yyyy", "yyyy-MM-dd"], "output_format": "d MMM yyyy", ' + _REST,
     "ok", None, "date", "yyyy-MM-dd|dd/MM/yyyy>d MMM yyyy"),
    (_DATES + '["QQ yyyy"], "output_format": "MM", ' + _REST, "invalid", "INVALID_SPEC", None, None),
    (_DATES + '["EEEE dd.MM.yy"], "output_format": "MM", ' + _REST,
     "invalid", "INVALID_SPEC", None, None),
    (_DATES + '[], "output_format": "yyyy", ' + _REST, "invalid", "INVALID_SPEC", None, None),
    (_RULES + r'[{"pattern": "^(\\d{3}) (\\d+)$", "replacement": "$1-$2"}], ' + _REST,
     "ok", None, "rules", r"^(\d{3}) (\d+)$>$1-$2"),
    (_RULES + '[{"pattern": "([kl]+){2,}m", "replacement": ""}], ' + _REST,
     "invalid", "INVALID_PATTERN", None, None),
    (_RULES + '[{"pattern": "(k)(l)m", "replacement": "$4"}], ' + _REST,
     "invalid", "INVALID_SPEC", None, None),
    ('{"feasible": false, "kind": "rules", "input_formats": [], "output_format": "", "rules": [], '
     + _REST, "infeasible", None, None, None),
    ('{"kind": "date"}', "malformed", None, None, None),
    ('{"feasible": tr', "malformed", None, None, None),
    (None, "malformed", None, None, None),
]


@query(f"""
    SELECT o_orderkey, {_case_sql("o_orderkey", [one[1] for one in _NORMALIZATIONS])} AS status,
           {_case_sql("o_orderkey", [one[2] for one in _NORMALIZATIONS])} AS code,
           {_case_sql("o_orderkey", [one[3] for one in _NORMALIZATIONS])} AS kind,
           {_case_sql("o_orderkey", [one[4] for one in _NORMALIZATIONS])} AS content
    FROM orders""")
def normalizations_of_orders(t):
    suggestion = _case(F.col("o_orderkey"), [one[0] for one in _NORMALIZATIONS])
    read = read_normalizations(t.orders.select("o_orderkey", suggestion.alias("suggestion")))
    dates = F.concat(F.array_join("input_formats", "|"), F.lit(">"), "output_format")
    rules = F.transform("rules", lambda r: F.concat(r["pattern"], F.lit(">"), r["replacement"]))
    content = F.coalesce(dates, F.array_join(rules, "|"))
    return read.select("o_orderkey", "status", "code", "kind", content.alias("content"))


@query(r"""
    SELECT event_id, CASE WHEN event_id % 9 = 0 THEN 'malformed' WHEN value < 5 THEN 'infeasible'
               WHEN user_id % 6 = 0 THEN 'invalid' ELSE 'ok' END AS status,
           CASE WHEN event_id % 9 <> 0 AND value >= 5 AND user_id % 6 <> 0 THEN
               CASE user_id % 4 WHEN 0 THEN '' WHEN 1 THEN '(?i)' WHEN 2 THEN '(?m)' ELSE '(?im)' END
               || '\b' || event_type || ' #' || (user_id % 100) || '\b' END AS pattern FROM events""")
def suggested_patterns_of_events(t):
    # The suggestion is written from the event's own columns: a word, its number, two flags.
    word = F.concat(F.lit(r"\b"), "event_type", F.lit(" #"), (F.col("user_id") % 100).cast("string"), F.lit(r"\b"))
    pattern = F.when(F.col("user_id") % 6 == 0, F.concat(F.lit("("), word)).otherwise(word)
    entry = F.struct(
        (F.col("value") >= 5).alias("feasible"), pattern.alias("pattern"),
        (F.col("user_id") % 2 == 1).alias("case_insensitive"), (F.col("user_id") % 4 >= 2).alias("multiline"),
        F.lit(False).alias("dotall"), F.when(F.col("event_id") % 9 != 0, F.col("props")).alias("explanation"),
    )
    read = read_patterns(t.events.select("event_id", F.to_json(entry).alias("suggestion")))
    return read.select("event_id", "status", "pattern")


# --- checks -----------------------------------------------------------------------------

@query(f"""
    SELECT o_orderkey, CASE WHEN o_orderkey % 13 = 0 OR o_orderkey % 13 > {MAX_DATE_FORMATS}
        OR 3 * (o_custkey % 16) + 4 > {MAX_FORMAT_LENGTH} OR o_orderkey % 3 <> 0
        THEN 'INVALID_SPEC' END AS code FROM orders""")
def checked_date_specs_of_orders(t):
    # Lists of 0 to 12 formats, each as long as the customer's number says. The status of an order is
    # no letter of a format; its priority is text in quotes.
    one = F.concat(F.repeat(F.lit("MM/"), (F.col("o_custkey") % 16).cast("int")), F.lit("yyyy"))
    formats = F.array_repeat(one, (F.col("o_orderkey") % 13).cast("int"))
    quoted_text = F.concat(F.lit("d '"), "o_orderpriority", F.lit("' yy"))
    output = F.when(F.col("o_orderkey") % 3 == 0, quoted_text).otherwise(F.concat(F.lit("yy"), "o_orderstatus"))
    return t.orders.select("o_orderkey", date_problem(formats, output)["code"].alias("code"))


@query(f"""
    SELECT l_orderkey, l_linenumber, CASE
        WHEN l_orderkey % 10 > l_linenumber OR l_partkey % 5 IN (0, 1) THEN 'INVALID_SPEC'
        WHEN l_partkey % 5 = 2 AND 183 + l_suppkey % 30 > {MAX_REPLACEMENT_LENGTH} THEN 'INVALID_SPEC' END AS code
    FROM lineitem""")
def checked_replacements_of_lineitems(t):
    # A pattern with as many groups as the line's number, and a reference to the group that the order names;
    # behind it the return flag, and then a backslash, a lone $, a long text, or nothing.
    pattern = F.repeat(F.lit("(x)"), F.col("l_linenumber"))
    case = F.col("l_partkey") % 5
    end = F.when(case == 0, "\\").when(case == 1, " $")
    end = end.when(case == 2, F.repeat(F.lit("-"), (180 + F.col("l_suppkey") % 30).cast("int"))).otherwise("")
    text = F.concat(F.lit("$"), (F.col("l_orderkey") % 10).cast("string"), "l_returnflag", end)
    code = replacement_problem(pattern, text)["code"]
    return t.lineitem.select("l_orderkey", "l_linenumber", code.alias("code"))


_AUDIT_SQL = """CASE doc_id % 5 WHEN 0 THEN false WHEN 1 THEN true WHEN 2 THEN false
        WHEN 3 THEN n_chars % 300 BETWEEN 1 AND 250 ELSE true END"""


@query(f"""
    SELECT doc_id, {_AUDIT_SQL} AS ok, CASE WHEN NOT {_AUDIT_SQL} THEN 'INVALID_PATTERN' END AS code
    FROM documents""")
def audited_patterns_of_documents(t):
    # Patterns of the document's own language and source: a repeat inside a repeat, one behind the other, a
    # parenthesis that stays open, a text of any length, and alternatives.
    case = F.col("doc_id") % 5
    pattern = (
        F.when(case == 0, F.concat(F.lit("([a-z]"), F.lit("+"), "lang", F.lit("?)+;")))
        .when(case == 1, F.concat("lang", F.lit("+ "), "source", F.lit("+")))
        .when(case == 2, F.concat(F.lit("("), "source"))
        .when(case == 3, F.repeat("lang", (F.col("n_chars") % 300).cast("int")))
        .otherwise(F.concat(F.lit("(?:"), "lang", F.lit("|"), "source", F.lit(")!")))
    )
    return audit_patterns(t.documents.select("doc_id", pattern.alias("pattern"))).select("doc_id", "ok", "code")


@query()
def audited_texts_of_conversations(t):
    """Would the text of each turn, taken as a pattern, be safe to run?"""
    pattern = F.translate("text", ".,", "+*").alias("pattern")
    audited = audit_patterns(t.conversations.select("conv_id", "turn", pattern))
    return audited.select("conv_id", "turn", "ok", "code", "message")


# --- fingerprints and reuse -------------------------------------------------------------

_SQUEEZED = r"trim(regexp_replace(text, '[\s\x0b\x1c-\x1f\x85\pZ]+', ' ', 'g'))"
_FINGERPRINT = f"'replace:' || sha256(concat_ws(chr(31), 'v1', role, {_SQUEEZED}))"


def _requests(t):
    key = fingerprint("replace", F.lit("v1"), F.col("role"), squeeze(F.col("text")))
    return t.conversations.select("conv_id", "turn", "role", key.alias("fingerprint"))


@query(f"SELECT conv_id, turn, {_FINGERPRINT} AS fingerprint FROM conversations")
def fingerprints_of_conversations(t):
    return _requests(t).select("conv_id", "turn", "fingerprint")


@query("""
    SELECT 'normalize:' || sha256('v1' || chr(31) || 'ISO ' || lang || chr(31)
        || '[{"column":"source","values":["' || source || '"]},{"column":"tone","values":["x","y"]}]')
        AS fingerprint, doc_id FROM documents""")
def fingerprints_with_samples(t):
    samples = F.array(
        F.struct(F.lit("tone").alias("column"), F.array(F.lit("x"), F.lit("y")).alias("values")),
        F.struct(F.lit("source").alias("column"), F.array("source").alias("values")),
    )
    request = squeeze(F.concat(F.lit("  ISO \t "), "lang", F.lit(" ")))
    key = fingerprint("normalize", F.lit("v1"), request, samples_text(samples))
    return t.documents.select("doc_id", key.alias("fingerprint"))


_KNOWN_SQL = f"""
    requests AS (SELECT conv_id, turn, {_FINGERPRINT} AS fingerprint FROM conversations),
    known AS (SELECT fingerprint, min(conv_id * 1000 + turn) AS answer FROM requests
              WHERE turn = 0 GROUP BY 1)"""


def _known(t):
    """Answers given before: to everything a conversation began with."""
    asked = _requests(t).where(F.col("turn") == 0)
    answer = F.min(F.col("conv_id") * 1000 + F.col("turn")).alias("answer")
    return asked.groupBy("fingerprint").agg(answer)


@query(f"""
    WITH {_KNOWN_SQL}
    SELECT conv_id, turn, answer, answer IS NOT NULL AS cached
    FROM requests LEFT JOIN known USING (fingerprint)""")
def requests_answered_from_known(t):
    answered = answer_known(_requests(t), _known(t))
    return answered.select("conv_id", "turn", "answer", "cached")


@query(f"""
    WITH {_KNOWN_SQL}
    SELECT conv_id, turn, answer, answer IS NOT NULL AS cached
    FROM requests LEFT JOIN known USING (fingerprint)""")
def requests_answered_without_broadcast(t):
    answered = answer_known(_requests(t), _known(t), limit=0)
    return answered.select("conv_id", "turn", "answer", "cached")


@query(f"""
    WITH {_KNOWN_SQL}
    SELECT fingerprint, count(*) AS requests FROM requests ANTI JOIN known USING (fingerprint)
    GROUP BY 1""")
def requests_still_unknown(t):
    return still_unknown(_requests(t), _known(t))


@query(f"""
    WITH {_KNOWN_SQL}, judged AS (
        SELECT fingerprint, {_case_sql("answer", [one[1] for one in _NORMALIZATIONS])} AS status
        FROM known)
    SELECT conv_id, turn, status, status IS NOT NULL AS cached
    FROM requests LEFT JOIN (SELECT * FROM judged WHERE status <> 'malformed') USING (fingerprint)""")
def stored_suggestions_checked_on_use(t):
    suggestion = _case(F.col("answer"), [one[0] for one in _NORMALIZATIONS])
    known = _known(t).select("fingerprint", suggestion.alias("suggestion"))
    usable = well_formed(read_normalizations(known)).select("fingerprint", "status")
    return answer_known(_requests(t), usable).select("conv_id", "turn", "status", "cached")


_ENTRIES_SQL = f"""
    requests AS (SELECT conv_id, turn, {_FINGERPRINT} AS fingerprint FROM conversations),
    entries AS (
        SELECT fingerprint, 1 AS version, 'old' AS answer, 'good' AS state FROM requests WHERE turn = 1
        UNION ALL SELECT fingerprint, 2, min(conv_id)::VARCHAR, 'good' FROM requests WHERE turn = 0 GROUP BY 1
        UNION ALL SELECT fingerprint, 3, 'new ' || min(conv_id), CASE WHEN min(conv_id) % 4 = 0 THEN 'bad' ELSE 'good' END
                  FROM requests WHERE turn = 0 AND conv_id % 2 = 0 GROUP BY 1),
    latest AS (SELECT fingerprint, max(version) AS version, arg_max(answer, version) AS answer FROM entries
               WHERE version >= 2 AND state = 'good' GROUP BY 1)"""


def _store(t) -> AnswerStore:
    """Three batches of answers: too old ones, first answers, and newer ones of which some are unfit."""
    requests = _requests(t)
    first = F.min("conv_id").alias("first")
    store = AnswerStore(t.spark, scratch(t.spark, "answers"), ["answer", "state"], buckets=8)
    good = F.lit("good").alias("state")
    store.append(requests.where("turn = 1").select("fingerprint", F.lit("old").alias("answer"), good), 1)
    asked = store.unknown(requests.where("turn = 0"), oldest=2).select("fingerprint")
    begun = requests.where("turn = 0").groupBy("fingerprint").agg(first)
    store.append(asked.join(begun, "fingerprint").select("fingerprint", F.col("first").alias("answer"), good), 2)
    even = requests.where("turn = 0 and conv_id % 2 = 0").groupBy("fingerprint").agg(first)
    state = F.when(F.col("first") % 4 == 0, "bad").otherwise("good").alias("state")
    store.append(even.select("fingerprint", F.concat(F.lit("new "), "first").alias("answer"), state), 3)
    return store


@query(f"""
    WITH {_ENTRIES_SQL}
    SELECT conv_id, turn, version, answer, answer IS NOT NULL AS cached
    FROM requests LEFT JOIN latest USING (fingerprint)""")
def requests_answered_from_a_store(t):
    answered = _store(t).answer(_requests(t), oldest=2, fit=F.col("state") == "good")
    return answered.select("conv_id", "turn", "version", "answer", "cached")


@query(f"""
    WITH {_ENTRIES_SQL}
    SELECT fingerprint, count(*) AS requests FROM requests ANTI JOIN latest USING (fingerprint) GROUP BY 1""")
def requests_that_the_store_cannot_answer(t):
    return _store(t).unknown(_requests(t), oldest=2, fit=F.col("state") == "good")


@query("""
    WITH asked AS (SELECT l_orderkey, l_linenumber, CASE WHEN l_orderkey % 5 < 3 THEN 'common' ELSE 'order ' || l_orderkey END AS k
                   FROM lineitem),
    known AS (SELECT 'order ' || o_orderkey AS k, o_orderpriority AS answer FROM orders UNION ALL SELECT 'common', 'all')
    SELECT l_orderkey, l_linenumber, answer FROM asked LEFT JOIN known USING (k)""")
def one_key_on_most_lineitems(t):
    # A sketch finds the key that over half of the rows share; its rows are dealt out over many tasks.
    key = F.when(F.col("l_orderkey") % 5 < 3, "common").otherwise(F.concat(F.lit("order "), "l_orderkey"))
    asked = t.lineitem.select("l_orderkey", "l_linenumber", key.alias("k"))
    known = t.orders.select(F.concat(F.lit("order "), "o_orderkey").alias("k"), F.col("o_orderpriority").alias("answer"))
    known = known.unionByName(t.spark.range(1).select(F.lit("common").alias("k"), F.lit("all").alias("answer")))
    return lookup(asked, known, "k", limit=0, per_task=10_000).drop("k")
