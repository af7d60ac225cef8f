"""Runs, row numbers, pages and samples over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from rinse.operators.cells import MATCHED, ROW_ID, with_row_id
from rinse.operators.find_replace import find_replace
from rinse.operators.paging import id_range, number_rows, number_rows_by, page_index, read_page, read_page_of
from rinse.operators.sampling import sample_values
from rinse.plans.run import count_result, write_counted
from rinse.queries.registry import query
from rinse.queries.transforms import EMAIL
from rinse.session import scratch, stored

LINE_KEYS = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_returnflag"]


def result_of_orders(t):
    """A result as a run leaves it: orders by key, with row ids and match flags."""
    ordered = t.plain("orders").select("o_orderkey", "o_custkey", "o_orderpriority")
    ordered = ordered.orderBy("o_orderkey")
    return stored(find_replace(with_row_id(ordered), ["o_orderpriority"], "URGENT", "now"), "result")


@query(f"""
    SELECT count(*) AS row_count, count(*) FILTER (WHERE regexp_matches(text, '{EMAIL}'))
               AS matched_count,
           count(*) AS rows_seen, count(*) FILTER (WHERE regexp_matches(text, '{EMAIL}')) AS hits_seen
    FROM documents""")
def run_counts_of_documents(t):
    path = scratch(t.spark, "run")
    table = with_row_id(t.documents.select("doc_id", "text"))
    seen = write_counted(find_replace(table, ["text"], EMAIL, "REDACTED"), path)
    return count_result(t.spark, path).withColumns(
        {"rows_seen": F.lit(seen.row_count), "hits_seen": F.lit(seen.matched_count)}
    )


@query(f"""
    SELECT row_number() OVER (ORDER BY {", ".join(LINE_KEYS)}) AS row_number, {", ".join(LINE_KEYS)}
    FROM lineitem""")
def row_numbers_of_lineitems(t):
    return number_rows_by(t.plain("lineitem").select(*LINE_KEYS), LINE_KEYS)


@query("""
    SELECT row_number() OVER (ORDER BY o_orderkey) AS row_number, o_orderkey, o_custkey
    FROM orders WHERE o_orderpriority <> '1-URGENT'""")
def row_numbers_after_a_filter(t):
    # The ids have gaps now, so numbers come from ranks inside buckets of ids.
    kept = result_of_orders(t).where(~F.col(MATCHED))
    return number_rows(stored(kept, "kept")).select("row_number", "o_orderkey", "o_custkey")


@query("""
    SELECT row_number, o_orderpriority = '1-URGENT' AS __matched, o_orderkey, o_custkey,
           replace(o_orderpriority, 'URGENT', 'now') AS o_orderpriority,
           ceil(total / 100)::BIGINT AS pages
    FROM (SELECT *, row_number() OVER (ORDER BY o_orderkey) AS row_number,
                 count(*) OVER () AS total FROM orders)
    WHERE row_number BETWEEN 601 AND 700""")
def seventh_page_of_orders(t):
    page = read_page(result_of_orders(t), 7, 100)
    return page.rows.withColumn("pages", F.lit(page.total_pages).cast("long"))


@query("""
    SELECT row_number, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_returnflag
    FROM (SELECT *, row_number() OVER (
              ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_returnflag) AS row_number,
              count(*) OVER () AS total FROM lineitem)
    WHERE row_number > (total - 1) // 50 * 50""")
def last_page_of_lineitems(t):
    lines = t.plain("lineitem").select(*LINE_KEYS).orderBy(*LINE_KEYS)
    result = stored(with_row_id(lines), "result")
    pages = read_page(result, 1, 50).total_pages
    return read_page(result, pages, 50).rows


@query("""
    SELECT row_number, contains(old, 'URGENT') AS __matched, o_orderkey, o_orderpriority, pages
    FROM (SELECT o_orderkey, replace(o_orderpriority, 'URGENT', 'now') AS o_orderpriority,
                 o_orderpriority AS old, row_number() OVER (ORDER BY o_orderkey) AS row_number,
                 ceil(count(*) OVER () / 60)::BIGINT AS pages FROM orders)
    WHERE row_number > (pages - 2) * 60""")
def last_pages_by_kept_offsets(t):
    # The run leaves the offsets of its pages beside the result; no page looks at other rows.
    path = scratch(t.spark, "result")
    ordered = t.plain("orders").select("o_orderkey", "o_orderpriority").orderBy("o_orderkey")
    write_counted(find_replace(with_row_id(ordered), ["o_orderpriority"], "URGENT", "now"), path)
    last = read_page_of(t.spark, path, 1, 60).total_pages
    rows = read_page_of(t.spark, path, last, 60).rows.unionByName(read_page_of(t.spark, path, last - 1, 60).rows)
    return rows.withColumn("pages", F.lit(last).cast("long"))


@query("""
    SELECT (n - 1) // 250 + 1 AS page, count(*) AS rows,
           min(o_orderkey) AS first_key, max(o_orderkey) AS last_key
    FROM (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) AS n FROM orders) GROUP BY 1""")
def page_index_of_orders(t):
    result = result_of_orders(t)
    index = page_index(result, 250)
    first = result.select(F.col(ROW_ID).alias("first_id"), F.col("o_orderkey").alias("first_key"))
    last = result.select(F.col(ROW_ID).alias("last_id"), F.col("o_orderkey").alias("last_key"))
    joined = index.join(first, "first_id").join(last, "last_id")
    return joined.select("page", "rows", "first_key", "last_key")


@query("""
    SELECT (n - 1) // 40 + 1 AS page, count(*) AS rows
    FROM (SELECT row_number() OVER (ORDER BY o_orderkey) AS n
          FROM orders WHERE o_orderpriority = '1-URGENT') GROUP BY 1""")
def page_index_of_matches(t):
    matches = result_of_orders(t).where(F.col(MATCHED))
    return page_index(stored(matches, "matches"), 40).select("page", "rows")


@query("""
    SELECT o_orderkey, o_custkey FROM orders
    WHERE o_orderkey BETWEEN
        (SELECT min(o_orderkey) FROM orders WHERE o_custkey = (SELECT max(o_custkey) FROM orders))
        AND (SELECT max(o_orderkey) FROM orders
             WHERE o_custkey = (SELECT max(o_custkey) FROM orders))""")
def orders_in_an_id_range(t):
    # Ids stand for the order of the keys; the filter reaches the Parquet row groups.
    result = result_of_orders(t)
    last_customer = result.agg(F.max("o_custkey")).first()[0]
    theirs = result.where(F.col("o_custkey") == last_customer)
    low, high = theirs.agg(F.min(ROW_ID), F.max(ROW_ID)).first()
    return id_range(result, low, high).select("o_orderkey", "o_custkey")


_SAMPLE_SQL = """
    SELECT '{0}' AS "column", value, rank FROM (
        SELECT value, row_number() OVER (ORDER BY min(nr)) AS rank FROM (
            SELECT substring(trim({0}, E' \\t\\n\\r'), 1, 200) AS value, nr FROM first)
        WHERE value <> '' GROUP BY value) WHERE rank <= 20"""


@query(
    "WITH first AS (SELECT *, doc_id AS nr FROM documents ORDER BY doc_id LIMIT 1000)"
    + " UNION ALL ".join(_SAMPLE_SQL.format(name) for name in ("source", "lang", "text"))
)
def sample_of_documents(t):
    sample = sample_values(t.plain("documents"), ["source", "lang", "text"], order_by="doc_id")
    values = sample.select("column", F.posexplode("values").alias("rank", "value"))
    return values.withColumn("rank", (F.col("rank") + 1).cast("long"))
