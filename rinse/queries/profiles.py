"""Profiles of whole columns."""

from __future__ import annotations

from pyspark.sql import functions as F

from rinse.functions import masks
from rinse.functions.patterns import NAMED_PATTERNS, word
from rinse.operators.mask import mask
from rinse.operators.profile import (
    DETECTORS,
    classify_columns,
    date_masks,
    infer_date_formats,
    kinds_by_column,
    pattern_counts,
    pattern_examples,
    profile_kinds,
)
from rinse.operators.reformat import reformat
from rinse.plans.specs import Dates
from rinse.queries.registry import query, quoted
from rinse.queries.transforms import DATE_FORMATS, MIXED_DATES_SQL, mixed_dates

_NO_CARDS = f"regexp_replace(v, {quoted(masks.CARD)}, '**** **** **** \\1', 'g')"
_PERSON_SQL = r"""'^\p{Lu}[\pL''’-]+(?: \p{Lu}[\pL''’.-]*){1,3}$'"""
_IDENTIFIER_SQL = r"'^(?:[A-Z]{1,2}\d{6,9}|\d{3}-\d{2}-\d{4}|[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7})$'"
_STREET_SQL = (
    r"'^\d{1,5} (?:\p{Lu}[\pL''.-]* ){1,4}"
    r"(?:Street|St|Avenue|Ave|Road|Rd|Lane|Ln|Drive|Dr|Boulevard|Blvd|Way|Court|Ct|Square|Sq)\b'"
)
_TESTS = {
    "email": f"regexp_matches(v, {quoted(masks.EMAIL)})",
    "phone": f"regexp_matches({_NO_CARDS}, {quoted(masks.PHONE)})",
    "person_name": f"regexp_matches(v, {_PERSON_SQL})",
    "credit_card": f"regexp_matches(v, {quoted(masks.CARD)})",
    "identifier": f"regexp_matches(v, {_IDENTIFIER_SQL})",
    "address": f"regexp_matches(v, {_STREET_SQL})",
}


def _profile_sql(source: str) -> str:
    return " UNION ALL ".join(
        f"""SELECT name AS "column", '{kind}' AS kind, count(v) AS non_null,
                count(*) FILTER (WHERE {test}) AS hits,
                coalesce(count(*) FILTER (WHERE {test}) / nullif(count(v), 0), 0.0) AS rate
            FROM ({source}) GROUP BY name"""
        for kind, test in _TESTS.items()
    )


_DOCUMENT_CELLS = """
    SELECT 'text' AS name, text AS v FROM documents
    UNION ALL SELECT 'source', source FROM documents
    UNION ALL SELECT 'lang', lang FROM documents"""


@query(_profile_sql(_DOCUMENT_CELLS))
def profile_of_documents(t):
    return profile_kinds(t.documents, ["text", "source", "lang"])


# People and cards made from the customers' keys: words of the letters a to j.
def _people(t):
    key = F.col("c_custkey")
    letters = F.translate(key.cast("string"), "0123456789", "abcdefghij")
    name = F.concat(F.lit("Jo"), letters, F.lit(" Van D'"), letters)
    line = F.when(key % 4 == 0, F.concat(F.lit("write to "), letters, F.lit("@example.org"))).when(
        key % 4 == 1, F.format_string("paid with 4111 1111 1111 %d", 1000 + key % 9000)
    )
    passport = F.format_string("P%d", 1000000 + key)
    street = F.when(key % 5 != 0, F.format_string("%d Long Hill Road", key % 900 + 1))
    return t.customer.select(
        key,
        name.alias("name"),
        line.alias("notes"),
        passport.alias("passport"),
        street.alias("street"),
        F.col("c_mktsegment").alias("segment"),
    )


_LETTERS_SQL = "translate(c_custkey::VARCHAR, '0123456789', 'abcdefghij')"
_PEOPLE_SQL = f"""(
    SELECT c_custkey, 'Jo' || {_LETTERS_SQL} || ' Van D''' || {_LETTERS_SQL} AS name,
           CASE c_custkey % 4 WHEN 0 THEN 'write to ' || {_LETTERS_SQL} || '@example.org'
               WHEN 1 THEN 'paid with 4111 1111 1111 ' || (1000 + c_custkey % 9000) END AS notes,
           'P' || (1000000 + c_custkey) AS passport,
           CASE WHEN c_custkey % 5 <> 0 THEN (c_custkey % 900 + 1) || ' Long Hill Road' END AS street,
           c_mktsegment AS segment FROM customer)"""
_PEOPLE_COLUMNS = ["name", "notes", "passport", "street", "segment"]


@query(
    _profile_sql(
        " UNION ALL ".join(f"SELECT '{c}' AS name, {c} AS v FROM {_PEOPLE_SQL}" for c in _PEOPLE_COLUMNS)
    )
)
def profile_of_people(t):
    return profile_kinds(_people(t), _PEOPLE_COLUMNS)


@query("""
    SELECT * FROM (VALUES ('name', 'person_name'), ('notes', 'credit_card,email'),
        ('passport', 'identifier'), ('street', 'address'), ('segment', 'none'))
        AS found("column", pii_types) WHERE (SELECT count(*) FROM customer) > 0""")
def classification_of_people(t):
    found = classify_columns(_people(t), _PEOPLE_COLUMNS)
    return found.select("column", F.array_join("pii_types", ",").alias("pii_types"))


@query(f"""
    SELECT c_custkey, 'J. V. D.' AS name,
           CASE c_custkey % 4 WHEN 0 THEN 'write to ' || {_LETTERS_SQL}[1] || '***@example.org'
               WHEN 1 THEN 'paid with **** **** **** ' || (1000 + c_custkey % 9000) END AS notes,
           '[REDACTED]' AS passport, CASE WHEN c_custkey % 5 <> 0 THEN '[REDACTED]' END AS street,
           c_mktsegment AS segment, true AS __matched
    FROM customer""")
def people_masked_as_classified(t):
    people = _people(t)
    found = kinds_by_column(classify_columns(people, _PEOPLE_COLUMNS))
    return mask(people, found)


_CANDIDATES = ["MM.dd.yyyy", "yyyy-MM-dd", "dd.MM.yyyy", "d MMM yyyy", "yyyyMMdd"]
_MASKS_SQL = f"""
    SELECT CASE WHEN c = 0 THEN 2 WHEN c = 1 THEN 4 + (day(day) <= 12)::INT
                WHEN c IN (2, 3) THEN 8 ELSE 0 END AS mask, count(*) AS "values"
    FROM {MIXED_DATES_SQL} WHERE placed IS NOT NULL GROUP BY 1"""


@query(_MASKS_SQL)
def date_masks_of_orders(t):
    return date_masks(mixed_dates(t), "placed", _CANDIDATES)


@query(f"""
    WITH seen AS ({_MASKS_SQL}),
    gains AS (
        SELECT 'yyyy-MM-dd' AS f, 1 AS nr, sum("values") FILTER (WHERE mask & 2 > 0) AS n FROM seen
        UNION ALL SELECT 'dd.MM.yyyy', 2, sum("values") FILTER (WHERE mask & 4 > 0) FROM seen
        UNION ALL SELECT 'd MMM yyyy', 3, sum("values") FILTER (WHERE mask & 8 > 0) FROM seen)
    SELECT (SELECT string_agg(f, '|' ORDER BY n DESC, nr) FROM gains WHERE n > 0) AS input_formats,
           sum("values")::BIGINT AS "values",
           (sum("values") FILTER (WHERE mask > 0))::BIGINT AS recognised,
           coalesce(sum("values") FILTER (WHERE bit_count(mask) > 1), 0)::BIGINT AS ambiguous,
           sum("values") FILTER (WHERE mask > 0) / sum("values") AS coverage
    FROM seen""")
def date_formats_of_orders(t):
    found = infer_date_formats(mixed_dates(t), "placed", _CANDIDATES)
    return found.withColumn("input_formats", F.array_join("input_formats", "|"))


# Eight digits that fit two of three formats (four orders in ten each way), or one of two (one in ten each).
_DIGITS_SQL = """
    SELECT o_orderkey % 10 AS g, CASE WHEN o_orderkey % 10 < 4 THEN 3 WHEN o_orderkey % 10 < 8 THEN 5
        WHEN o_orderkey % 10 = 8 THEN 2 ELSE 4 END AS mask FROM orders"""


@query(f"""
    WITH seen AS (SELECT mask, count(*) AS n FROM ({_DIGITS_SQL}) GROUP BY 1),
    sets AS (SELECT s FROM range(1, 8) AS t(s) WHERE (SELECT bool_and(mask & s <> 0) FROM seen)),
    chosen AS (SELECT s FROM sets ORDER BY bit_count(s), s LIMIT 1),
    formats AS (SELECT * FROM (VALUES ('ddMMyyyy', 1), ('yyyyMMdd', 2), ('MMddyyyy', 4)) AS f(name, bit)),
    listed AS (SELECT name, bit, (SELECT sum(n) FROM seen WHERE mask & bit <> 0) AS n FROM formats, chosen WHERE s & bit <> 0)
    SELECT (SELECT string_agg(name, '|' ORDER BY n DESC, bit) FROM listed) AS input_formats, sum(n)::BIGINT AS "values",
           (sum(n) FILTER (WHERE bit_count(mask) > 1))::BIGINT AS ambiguous FROM seen""")
def fewest_date_formats_of_orders(t):
    # The format that reads most is not needed: two others read everything.
    key, group = F.col("o_orderkey"), F.col("o_orderkey") % 10
    month, other = (F.lpad((1 + F.floor(key / by) % 12).cast("string"), 2, "0") for by in (1, 7))
    late = (13 + key % 16).cast("string")
    text = (
        F.when(group < 4, F.concat(F.lit("2010"), month, F.lit("12")))
        .when(group < 8, F.concat(month, other, F.lit("2013")))
        .when(group == 8, F.concat(F.lit("1999"), month, F.lit("10")))
        .otherwise(F.concat(F.lit("12"), late, F.lit("2013")))
    )
    found = infer_date_formats(t.orders.select(text.alias("d")), "d", ["ddMMyyyy", "yyyyMMdd", "MMddyyyy"])
    return found.select(F.array_join("input_formats", "|").alias("input_formats"), "values", "ambiguous")


@query(f"""
    SELECT o_orderkey, CASE WHEN c < 4 THEN strftime(day, '%Y-%m-%d') ELSE placed END AS placed,
           c < 4 AS __matched
    FROM {MIXED_DATES_SQL}""")
def order_dates_normalized_as_inferred(t):
    orders = mixed_dates(t)
    found = infer_date_formats(orders, "placed", _CANDIDATES).first()
    return reformat(orders, ["placed"], Dates(tuple(found["input_formats"]), "yyyy-MM-dd"))


_REPORTED = {
    **{name: NAMED_PATTERNS[name] for name in ("email", "us_phone", "iso_date", "url", "ipv4")},
    "word": word("the"),
}


def _counts_sql(column: str) -> str:
    return " UNION ALL ".join(
        f"""SELECT '{column}' AS "column", '{name}' AS pattern,
                count(*) FILTER (WHERE regexp_matches({column}, {quoted(one)})) AS rows_matched,
                sum(len(regexp_extract_all({column}, {quoted(one)})))::BIGINT AS matches
            FROM documents"""
        for name, one in _REPORTED.items()
    )


@query(_counts_sql("text") + " UNION ALL " + _counts_sql("source"))
def pattern_counts_of_documents(t):
    return pattern_counts(t.documents, ["text", "source"], _REPORTED)


@query(
    " UNION ALL ".join(
        f"""SELECT 'text' AS "column", '{name}' AS pattern, rank, example FROM (
            SELECT row_number() OVER (ORDER BY doc_id)::INT AS rank,
                   regexp_extract(text, {quoted(one)}) AS example
            FROM documents WHERE regexp_matches(text, {quoted(one)})) WHERE rank <= 3"""
        for name, one in _REPORTED.items()
    )
)
def pattern_examples_of_documents(t):
    return pattern_examples(t.documents, ["text"], _REPORTED, key="doc_id")


assert set(_TESTS) == set(DETECTORS)
assert set(DATE_FORMATS) < set(_CANDIDATES)
