"""Find and replace, reformatting and masking over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from rinse.functions import masks
from rinse.functions.patterns import pattern, word
from rinse.operators.cells import MATCHED, clean, user_columns
from rinse.operators.find_replace import find_replace, replacing
from rinse.operators.mask import mask, masking
from rinse.operators.reformat import reformat
from rinse.plans.specs import Dates, Rules
from rinse.queries.registry import query, quoted

EMAIL = r"[\w.+-]+@(?:[\w-]+\.)+[A-Za-z]{2,}"
DATE_FORMATS = ("yyyy-MM-dd", "dd.MM.yyyy", "d MMM yyyy")
# ten digits in three blocks, behind an optional country code, with up to two signs between them
PHONE_RULE = (r"^(?:\+1 )?\D?([0-9]{3})\D{1,2}([0-9]{3})\D([0-9]{4})$", "$1-$2-$3")


# --- find and replace -------------------------------------------------------------------


@query(f"""
    SELECT doc_id, lang, regexp_replace(text, '{EMAIL}', 'REDACTED', 'g') AS text,
           regexp_matches(text, '{EMAIL}') AS __matched
    FROM documents""")
def replace_emails_in_documents(t):
    return find_replace(t.documents.select("doc_id", "lang", "text"), ["text"], EMAIL, "REDACTED")


@query(r"""
    SELECT page_id, regexp_replace(url, 'https?://', '$1 \\', 'g') AS url,
           regexp_replace(html, 'https?://', '$1 \\', 'g') AS html,
           regexp_matches(url, 'https?://') OR regexp_matches(html, 'https?://') AS __matched
    FROM pages""")
def replace_in_two_columns_of_pages(t):
    # The replacement is literal: neither a group reference nor an escape.
    return find_replace(t.pages, ["url", "html", "url"], "https?://", "$1 \\")


@query(r"""
    SELECT conv_id, turn, role, regexp_replace(text, '(?i)\bthe\b', '', 'g') AS text,
           regexp_matches(text, '(?i)\bthe\b') AS __matched
    FROM conversations""")
def delete_word_in_conversations(t):
    return find_replace(t.conversations, ["text"], word("the"), "")


@query(r"""
    SELECT regexp_replace(o_orderkey::VARCHAR, '7+', '<7>', 'g') AS o_orderkey,
           regexp_replace(o_orderpriority, '7+', '<7>', 'g') AS o_orderpriority, o_orderstatus,
           regexp_matches(o_orderkey::VARCHAR, '7+') OR regexp_matches(o_orderpriority, '7+')
               AS __matched
    FROM orders""")
def replace_digits_in_numbers(t):
    orders = t.orders.select("o_orderkey", "o_orderpriority", "o_orderstatus")
    return find_replace(orders, ["o_orderkey", "o_orderpriority"], "7+", "<7>")


@query("""
    SELECT c_custkey, replace(c_name, 'Customer', 'Client') AS c_name,
           contains(c_name, 'Customer') AS __matched
    FROM customer""")
def replace_in_oddly_named_column(t):
    odd = t.customer.select("c_custkey", F.col("c_name").alias("c.na`me"))
    return find_replace(odd, ["c.na`me"], "Customer", "Client").toDF("c_custkey", "c_name", MATCHED)


@query("SELECT c_custkey, c_name, false AS __matched FROM customer")
def clean_no_columns(t):
    return clean(t.customer.select("c_custkey", "c_name"), {})


@query(f"""
    SELECT CASE WHEN p_key % 3 = 0 THEN NULL ELSE replace(text, 'a', 'aa') END AS text,
           p_key % 3 <> 0 AND contains(text, 'a') AS __matched
    FROM (SELECT doc_id AS p_key, source AS text FROM documents
          UNION ALL SELECT doc_id, lang FROM documents)""")
def replace_keeps_nulls(t):
    parts = t.documents.select("doc_id", F.col("source").alias("text")).unionAll(
        t.documents.select("doc_id", F.col("lang").alias("text"))
    )
    holes = parts.select(F.when(F.col("doc_id") % 3 != 0, F.col("text")).alias("text"))
    return find_replace(holes, ["text"], "a", "aa")


@query(f"""
    SELECT page_id, regexp_replace(url, 'page=[0-9]+', 'page=N', 'g') AS url,
           regexp_replace(regexp_replace(html, {quoted(masks.PHONE)}, '***-***-\\1', 'g'),
               {quoted(masks.EMAIL)}, '\\1***\\2', 'g') AS html
    FROM pages""")
def different_rules_per_column_of_pages(t):
    rules = {"url": replacing("page=[0-9]+", "page=N"), "html": masking(["phone", "email"])}
    return user_columns(clean(t.pages, rules))


@query(f"""
    SELECT doc_id, regexp_replace(text, {quoted(pattern("iso_date"))}, '<date>', 'g') AS text,
           regexp_matches(text, {quoted(pattern("iso_date"))}) AS __matched
    FROM documents""")
def replace_named_pattern_in_documents(t):
    return find_replace(t.documents.select("doc_id", "text"), ["text"], pattern("iso_date"), "<date>")


# --- masking ----------------------------------------------------------------------------


def _sql_mask(value: str, expression: str, replacement: str) -> str:
    return f"regexp_replace({value}, {quoted(expression)}, '{replacement}', 'g')"


def _card_sql(value: str) -> str:
    return _sql_mask(value, masks.CARD, r"**** **** **** \1")


def _phone_sql(value: str) -> str:
    return _sql_mask(value, masks.PHONE, r"***-***-\1")


def _email_sql(value: str) -> str:
    return _sql_mask(value, masks.EMAIL, r"\1***\2")


def _name_sql(value: str) -> str:
    return _sql_mask(value, r"(\pL)[\pL'’-]*", r"\1.")


def _masked_documents(expression: str) -> str:
    return f"""
        SELECT doc_id, masked AS text, masked <> text AS __matched
        FROM (SELECT doc_id, text, {expression} AS masked FROM documents)"""


def _documents(t):
    return t.documents.select("doc_id", "text")


@query(_masked_documents(_email_sql("text")))
def mask_emails_in_documents(t):
    return mask(_documents(t), {"text": ["email"]})


@query(_masked_documents(_phone_sql("text")))
def mask_phones_in_documents(t):
    return mask(_documents(t), {"text": ["phone"]})


@query(_masked_documents(_card_sql("text")))
def mask_cards_in_documents(t):
    return mask(_documents(t), {"text": ["credit_card"]})


@query(_masked_documents(_email_sql(_phone_sql(_card_sql("text")))))
def mask_all_kinds_in_documents(t):
    return mask(_documents(t), {"text": ["email", "phone", "credit_card"]})


@query(_masked_documents(_name_sql("text")))
def mask_names_in_documents(t):
    return mask(_documents(t), {"text": ["person_name"]})


@query(f"""
    SELECT c_custkey, {_name_sql("c_name")} AS c_name,
           CASE WHEN c_custkey % 4 <> 0 THEN '[REDACTED]' END AS c_mktsegment,
           true AS __matched
    FROM customer""")
def mask_customers_by_precedence(t):
    holes = F.when(F.col("c_custkey") % 4 != 0, F.col("c_mktsegment"))
    table = t.customer.select("c_custkey", "c_name", holes.alias("c_mktsegment"))
    kinds = {"c_name": ["email", "person_name"], "c_mktsegment": ["person_name", "identifier"]}
    return mask(table, kinds)


@query("""
    SELECT c_custkey, '[REDACTED]' AS value, c_custkey % 3 <> 0 AS __matched FROM customer""")
def redact_is_no_hit_twice(t):
    value = F.when(F.col("c_custkey") % 3 == 0, masks.REDACTED).when(
        F.col("c_custkey") % 3 == 1, ""
    )
    table = t.customer.select("c_custkey", value.otherwise(F.col("c_name")).alias("value"))
    return mask(table, {"value": ["other"]})


@query(f"""
    SELECT page_id, masked AS html, masked <> html AS __matched
    FROM (SELECT page_id, html, {_phone_sql("html")} AS masked FROM pages)""")
def mask_phones_in_pages(t):
    return mask(t.pages.select("page_id", "html"), {"html": ["phone"]})


# --- reformatting -----------------------------------------------------------------------


def mixed_dates(t):
    """Order dates in three styles, some with spaces around, some no dates, some null."""
    day, case = F.col("o_orderdate"), F.col("o_orderkey") % 7
    text = (
        F.when(case == 0, F.date_format(day, "yyyy-MM-dd"))
        .when(case == 1, F.date_format(day, "dd.MM.yyyy"))
        .when(case == 2, F.date_format(day, "d MMM yyyy"))
        .when(case == 3, F.concat(F.lit("  "), F.date_format(day, "d MMM yyyy"), F.lit(" ")))
        .when(case == 4, F.date_format(day, "yyyy-13-dd"))
        .when(case == 5, F.concat(F.lit("due "), F.date_format(day, "yyyy-MM-dd")))
    )
    return t.orders.select("o_orderkey", text.alias("placed"))


# The same table for DuckDB.
MIXED_DATES_SQL = """(
    SELECT o_orderkey, o_orderdate AS day, o_orderkey % 7 AS c, CASE o_orderkey % 7
        WHEN 0 THEN strftime(o_orderdate, '%Y-%m-%d')
        WHEN 1 THEN strftime(o_orderdate, '%d.%m.%Y')
        WHEN 2 THEN strftime(o_orderdate, '%-d %b %Y')
        WHEN 3 THEN '  ' || strftime(o_orderdate, '%-d %b %Y') || ' '
        WHEN 4 THEN strftime(o_orderdate, '%Y-13-%d')
        WHEN 5 THEN 'due ' || strftime(o_orderdate, '%Y-%m-%d') END AS placed FROM orders)"""


@query(f"""
    SELECT o_orderkey, CASE WHEN c < 4 THEN strftime(day, '%Y-%m-%d') ELSE placed END AS placed,
           c < 4 AS __matched
    FROM {MIXED_DATES_SQL}""")
def normalize_mixed_order_dates(t):
    return reformat(mixed_dates(t), ["placed"], Dates(DATE_FORMATS, "yyyy-MM-dd"))


@query(f"""
    SELECT o_orderkey,
           CASE WHEN c < 4 THEN strftime(day, '%a, %-d %B %Y') ELSE placed END AS placed,
           c < 4 AS __matched
    FROM {MIXED_DATES_SQL}""")
def spell_out_order_dates(t):
    return reformat(mixed_dates(t), ["placed"], Dates(DATE_FORMATS, "EEE, d MMMM yyyy"))


@query("""
    SELECT l_orderkey, strftime(l_shipdate, '%d.%m.%Y') AS l_shipdate, true AS __matched
    FROM lineitem""")
def rewrite_ship_dates(t):
    shipped = F.date_format("l_shipdate", "yyyy-MM-dd").alias("l_shipdate")
    table = t.lineitem.select("l_orderkey", shipped)
    return reformat(table, ["l_shipdate"], Dates(("yyyy-MM-dd",), "dd.MM.yyyy"))


@query("""
    SELECT c_custkey, CASE WHEN c < 3 THEN format('{}-{}-{}', a, b, d) WHEN c = 3 THEN 'no phone' END
               AS phone, c < 3 AS __matched
    FROM (SELECT c_custkey, c_custkey % 5 AS c, 200 + c_custkey % 800 AS a,
                 200 + (c_custkey * 7) % 800 AS b, 1000 + (c_custkey * 13) % 9000 AS d
          FROM customer)""")
def normalize_customer_phones(t):
    key, case = F.col("c_custkey"), F.col("c_custkey") % 5
    digits = 200 + key % 800, 200 + (key * 7) % 800, 1000 + (key * 13) % 9000
    phone = (
        F.when(case == 0, F.format_string("+1 (%d) %d-%d", *digits))
        .when(case == 1, F.format_string("%d-%d-%d", *digits))
        .when(case == 2, F.format_string("%d.%d.%d", *digits))
        .when(case == 3, "no phone")
    )
    return reformat(t.customer.select(key, phone.alias("phone")), ["phone"], Rules((PHONE_RULE,)))


@query(r"""
    SELECT o_orderkey, CASE
               WHEN regexp_matches(o_orderpriority, '^[12]-')
                   THEN regexp_replace(o_orderpriority, '^([12])-(.*)$', 'soon \1 \2')
               WHEN regexp_matches(o_orderpriority, '[A-Z]+ [A-Z]+')
                   THEN regexp_replace(o_orderpriority, '([A-Z]+) ([A-Z]+)', '\2 \1', 'g')
               ELSE o_orderpriority END AS o_orderpriority,
           regexp_matches(o_orderpriority, '^[12]-|[A-Z]+ [A-Z]+') AS __matched
    FROM orders""")
def first_matching_rule_for_priorities(t):
    rules = Rules((("^([12])-(.*)$", "soon $1 $2"), ("([A-Z]+) ([A-Z]+)", "$2 $1"), ("^[12]", "x")))
    return reformat(t.orders.select("o_orderkey", "o_orderpriority"), ["o_orderpriority"], rules)


@query(f"""
    SELECT count(*) AS rows, count(*) FILTER (WHERE regexp_matches(text, '{EMAIL}')) AS matched
    FROM documents""")
def count_matching_documents(t):
    flagged = find_replace(t.documents.select("text"), ["text"], EMAIL, "")
    return flagged.agg(F.count(F.lit(1)).alias("rows"), F.count_if(MATCHED).alias("matched"))
