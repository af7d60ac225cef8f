"""Sources, sinks and streams: tables written to files and read back."""

from __future__ import annotations

import io
import zipfile
from xml.sax.saxutils import escape

import pandas as pd
from pyspark.sql import functions as F

from rinse.operators.cells import user_columns
from rinse.operators.find_replace import find_replace
from rinse.operators.mask import mask
from rinse.operators.paging import number_rows_of_files
from rinse.operators.reformat import reformat
from rinse.plans.run import round_trip, run_replace
from rinse.plans.specs import Dates, Replace
from rinse.queries.registry import query
from rinse.queries.transforms import DATE_FORMATS, MIXED_DATES_SQL, mixed_dates
from rinse.session import scratch
from rinse.sources.catalogue import list_files, preview_folder
from rinse.sources.customers import customers
from rinse.sources.tables import file_type_of, read_csv, read_folder
from rinse.sources.workbooks import read_workbooks
from rinse.streaming.streams import (
    clean_stream,
    clean_stream_counted,
    csv_stream,
    keep_windows,
    kept_windows,
    stream_stats,
    windowed_matches,
)


def _as_csv(df, label: str, **options) -> str:
    path = scratch(df.sparkSession, label)
    df.write.options(header=True, quote='"', escape='"', **options).csv(path)
    return path


# --- CSV and Parquet --------------------------------------------------------------------


@query(r"""
    SELECT c_custkey::VARCHAR AS c_custkey, regexp_replace(c_name, '#0+', ' No. ', 'g') AS c_name,
           c_mktsegment, regexp_matches(c_name, '#0+') AS __matched FROM customer""")
def replace_in_customer_file(t):
    source = _as_csv(t.customer.select("c_custkey", "c_name", "c_mktsegment"), "customers-csv")
    spec = Replace(source, ("c_name",), "#0+", " No. ", scratch(t.spark, "result"), "csv")
    run_replace(t.spark, spec)
    return t.spark.read.parquet(spec.output).drop("__row_id")


@query("""
    SELECT doc_id::VARCHAR AS doc_id, text, source FROM documents""")
def documents_through_csv(t):
    # Texts have line breaks, commas and quotes inside.
    path = _as_csv(t.documents.select("doc_id", "text", "source"), "documents-csv")
    return read_csv(t.spark, path, multi_line=True)


@query("""
    SELECT 'customer' AS name, 3 AS columns, count(*) AS source_rows, count(*) AS parquet_rows
    FROM customer
    UNION ALL SELECT 'orders', 6, count(*), count(*) FROM orders""")
def round_trips(t):
    csv = read_csv(t.spark, _as_csv(t.orders, "orders-csv"))
    tables = {"customer": t.customer.select("c_custkey", "c_name", "c_nationkey"), "orders": csv}
    audit = round_trip(t.spark, tables, scratch(t.spark, "round-trip"))
    return audit.select("name", F.size("columns").alias("columns"), "source_rows", "parquet_rows")


@query("""
    SELECT c_custkey::VARCHAR AS c_custkey, c_name, c_mktsegment FROM customer
    UNION ALL BY NAME SELECT c_custkey::VARCHAR AS c_custkey, c_name, c_mktsegment FROM customer""")
def folders_as_one_table(t):
    # Two CSV folders below one; files that are not CSV do not count.
    columns = ["c_custkey", "c_name", "c_mktsegment"]
    root = scratch(t.spark, "mixed")
    rows = t.customer.select(*columns)
    for part in ("first", "second"):
        rows.write.options(header=True, escape='"').csv(f"{root}/{part}")
    rows.write.parquet(f"{root}/other")
    return read_folder(t.spark, root, kinds=("csv",))


_PARTS_OF_ORDERS = {
    0: ["o_orderkey", "o_custkey", "o_orderpriority"],
    1: ["o_orderpriority", "o_orderkey"],
    2: ["o_orderstatus", "o_custkey", "o_orderkey"],
}


def _files_of_orders(t) -> str:
    """Orders in CSV files of three headers, with other columns in another order."""
    root = scratch(t.spark, "headers")
    for part, columns in _PARTS_OF_ORDERS.items():
        rows = t.orders.where(F.col("o_orderkey") % 3 == part).select(*columns)
        rows.write.options(header=True, escape='"').csv(f"{root}/part={part}")
    return root


@query("""
    SELECT o_orderkey::VARCHAR AS o_orderkey,
           CASE WHEN o_orderkey % 3 <> 1 THEN o_custkey::VARCHAR END AS o_custkey,
           CASE WHEN o_orderkey % 3 <> 2 THEN o_orderpriority END AS o_orderpriority,
           CASE WHEN o_orderkey % 3 = 2 THEN o_orderstatus END AS o_orderstatus FROM orders""")
def folder_of_three_headers(t):
    return read_folder(t.spark, _files_of_orders(t), kinds=("csv",))


@query("""
    SELECT row_number() OVER (ORDER BY o_orderkey) AS row_number, o_orderkey::VARCHAR AS o_orderkey,
           o_orderpriority FROM orders""")
def row_numbers_across_files(t):
    # The parts of a sorted table are files named in the order of the keys.
    orders = t.plain("orders").select("o_orderkey", "o_orderpriority").orderBy("o_orderkey")
    return number_rows_of_files(read_csv(t.spark, _as_csv(orders, "orders-csv")))


@query(r"""
    SELECT page_id, CASE page_id % 6 WHEN 0 THEN 'csv' WHEN 1 THEN 'csv' WHEN 2 THEN 'xlsx' END
        AS file_type FROM pages""")
def file_types_of_paths(t):
    endings = [".csv", ".CSV", ".tar.Xlsx", ".txt", "csv", ".csv.gz"]
    ending = F.get(F.array(*map(F.lit, endings)), (F.col("page_id") % 6).cast("int"))
    path = F.concat(F.regexp_replace("url", r"\.", "_"), F.lit("/file"), ending)
    return t.pages.select("page_id", file_type_of(path).alias("file_type"))


_CHUNK = 1000
_FILES_PER_TASK = 100


def _by_chunk(t, size: int):
    """Customers with the chunk of ``size`` keys they belong to, a task for a hundred chunks or fewer.

    Each chunk becomes a file, which takes its time however short it is, and without a number of
    tasks AQE makes one task of many short chunks.
    """
    chunk = F.floor(F.col("c_custkey") / size).cast("long")
    tasks = max(t.spark.sparkContext.defaultParallelism, -(-t.customer.count() // (size * _FILES_PER_TASK)))
    rows = t.customer.withColumn("chunk", chunk).repartition(tasks, "chunk")
    return rows.sortWithinPartitions("chunk", "c_custkey")


def _chunk_files(t) -> str:
    """Customers in files of at most a thousand, in the order of their keys."""
    path = scratch(t.spark, "chunks")
    rows = _by_chunk(t, _CHUNK).select("chunk", "c_custkey", "c_name")
    rows.write.partitionBy("chunk").options(header=True).csv(path)
    return path


@query(f"SELECT DISTINCT 'chunk=' || c_custkey // {_CHUNK} AS folder, 'csv' AS file_type FROM customer")
def file_catalogue(t):
    listed = list_files(t.spark, _chunk_files(t))
    folder = F.split_part("key", F.lit("/"), F.lit(1))
    return listed.select(folder.alias("folder"), "file_type").distinct()


@query(f"""
    SELECT row, c_custkey::VARCHAR AS c_custkey, c_name FROM (
        SELECT *, row_number() OVER (PARTITION BY c_custkey // {_CHUNK} ORDER BY c_custkey)::INT AS row
        FROM customer) WHERE row <= 10""")
def previews_of_files(t):
    return preview_folder(t.spark, _chunk_files(t)).select("row", "c_custkey", "c_name")


_SMALL = 60


@query(f"""
    SELECT row, c_custkey::VARCHAR AS c_custkey, c_name,
           CASE WHEN c_custkey // {_SMALL} % 2 = 1 THEN c_mktsegment END AS c_mktsegment FROM (
        SELECT *, row_number() OVER (PARTITION BY c_custkey // {_SMALL} ORDER BY c_custkey)::INT AS row
        FROM customer) WHERE row <= 10""")
def previews_of_differing_files(t):
    # Every other file has a column more, and another order of columns.
    root = scratch(t.spark, "differing")
    rows = _by_chunk(t, _SMALL)
    for odd, columns in ((0, ["c_custkey", "c_name"]), (1, ["c_mktsegment", "c_name", "c_custkey"])):
        part = rows.where(F.col("chunk") % 2 == odd).select("chunk", *columns)
        part.write.partitionBy("chunk").options(header=True).csv(f"{root}/{odd}")
    return preview_folder(t.spark, root).drop("file")


# --- workbooks --------------------------------------------------------------------------


def workbook(header: list[str], rows: list[list]) -> bytes:
    """A small workbook with shared text, plain numbers and gaps for nulls."""
    texts: dict[str, int] = {}

    def cell(at: int, line: int, value) -> str:
        place = f"{chr(65 + at)}{line}"
        if value is None:
            return ""
        if isinstance(value, str):
            number = texts.setdefault(value, len(texts))
            return f'<c r="{place}" t="s"><v>{number}</v></c>'
        return f'<c r="{place}"><v>{value}</v></c>'

    lines = [
        f'<row r="{line}">' + "".join(cell(at, line, v) for at, v in enumerate(row)) + "</row>"
        for line, row in enumerate([header, *rows], 1)
    ]
    main = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
    office = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    links = "http://schemas.openxmlformats.org/package/2006/relationships"
    parts = {
        "xl/workbook.xml": f'<workbook xmlns="{main}" xmlns:r="{office}"><sheets>'
        '<sheet name="Sheet" sheetId="1" r:id="rId1"/></sheets></workbook>',
        "xl/_rels/workbook.xml.rels": f'<Relationships xmlns="{links}">'
        f'<Relationship Id="rId1" Type="{office}/worksheet" Target="worksheets/sheet1.xml"/>'
        "</Relationships>",
        "xl/worksheets/sheet1.xml": f'<worksheet xmlns="{main}"><sheetData>'
        + "".join(lines)
        + "</sheetData></worksheet>",
        "xl/sharedStrings.xml": f'<sst xmlns="{main}">'
        + "".join(f'<si><t xml:space="preserve">{escape(text)}</t></si>' for text in texts)
        + "</sst>",
    }
    packed = io.BytesIO()
    with zipfile.ZipFile(packed, "w", zipfile.ZIP_DEFLATED) as archive:
        for name, content in parts.items():
            archive.writestr(name, content)
    return packed.getvalue()


def _workbook_of(rows: pd.DataFrame) -> pd.DataFrame:
    rows = rows.sort_values("c_custkey")
    shown = rows[["c_custkey", "c_name", "c_mktsegment"]].astype(object)
    values = shown.where(shown.notna(), None).values.tolist()
    content = workbook(["ID", "Name", "Segment"], values)
    return pd.DataFrame({"path": [f"{rows['chunk'].iloc[0]}.xlsx"], "content": [content]})


@query("""
    SELECT c_custkey::VARCHAR AS "ID", c_name AS "Name",
           CASE WHEN c_custkey % 5 <> 0 THEN c_mktsegment END AS "Segment" FROM customer""")
def customers_from_workbooks(t):
    # One workbook per thousand customers, so neither a group nor a file can grow.
    rows = t.customer.select(
        F.floor(F.col("c_custkey") / _CHUNK).alias("chunk"),
        "c_custkey",
        "c_name",
        F.when(F.col("c_custkey") % 5 != 0, F.col("c_mktsegment")).alias("c_mktsegment"),
    )
    books = rows.groupBy("chunk").applyInPandas(_workbook_of, "path string, content binary")
    return read_workbooks(books)


# --- made-up customers ------------------------------------------------------------------


@query()
def made_up_customers(t):
    """A made-up customer for every real one; values follow from the key alone."""
    return customers(t.customer, "c_custkey")


@query("""
    SELECT c_custkey::VARCHAR AS "ID", true AS name, true AS email, true AS phone, true AS signup,
           true AS notes FROM customer""")
def made_up_customers_have_the_right_form(t):
    date = r"^(?:20(?:1[89]|2[0-5])-\d\d-\d\d|\d\d/\d\d/20\d\d|[A-Z][a-z]{2} \d{1,2}, 20\d\d)$"
    notes = F.col("Notes").isin("", "VIP customer", "Prefers phone")
    backup = F.col("Notes") == F.concat(F.lit("Contact backup at "), "Email")
    call = F.col("Notes") == F.concat(F.lit("Call "), "Phone")
    return customers(t.customer, "c_custkey").select(
        "ID",
        F.col("Name").rlike(r"^[A-Z][a-z]+ [A-Z][a-z]+$").alias("name"),
        F.col("Email").rlike(r"^[a-z]+[._][a-z]+\d*@[a-z.]+$").alias("email"),
        F.col("Phone").rlike(r"^(?:\+1 \(\d{3}\) |\d{3}[-.])\d{3}[-.]\d{4}$").alias("phone"),
        F.col("SignupDate").rlike(date).alias("signup"),
        (notes | backup | call).alias("notes"),
    )


# --- streams ----------------------------------------------------------------------------


def _finished(t, stream, build):
    """Run a stream over the files there are, and read what it wrote."""
    output = scratch(t.spark, "stream")
    query = clean_stream(stream, build, output, scratch(t.spark, "checkpoint"))
    query.awaitTermination()
    return t.spark.read.parquet(output)


@query("""
    SELECT c_custkey::VARCHAR AS c_custkey, replace(c_name, 'Customer', 'Client') AS c_name,
           contains(c_name, 'Customer') AS __matched FROM customer""")
def replace_on_a_stream(t):
    folder = _as_csv(t.customer.select("c_custkey", "c_name"), "stream-csv")
    stream = csv_stream(t.spark, folder, ["c_custkey", "c_name"])
    return _finished(t, stream, lambda df: find_replace(df, ["c_name"], "Customer", "Client"))


@query(f"""
    SELECT o_orderkey::VARCHAR AS o_orderkey,
           CASE WHEN c < 4 THEN strftime(day, '%Y-%m-%d') ELSE placed END AS placed
    FROM {MIXED_DATES_SQL}""")
def normalize_on_a_stream(t):
    spaces = {"ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}
    folder = _as_csv(mixed_dates(t), "stream-csv", **spaces)
    stream = csv_stream(t.spark, folder, ["o_orderkey", "placed"])
    spec = Dates(DATE_FORMATS, "yyyy-MM-dd")
    return user_columns(_finished(t, stream, lambda df: reformat(df, ["placed"], spec)))


@query(r"""
    SELECT c_custkey::VARCHAR AS c_custkey, 'C.#' || substr(c_name, 10) AS c_name,
           true AS __matched FROM customer""")
def mask_on_a_stream(t):
    folder = _as_csv(t.customer.select("c_custkey", "c_name"), "stream-csv")
    stream = csv_stream(t.spark, folder, ["c_custkey", "c_name"])
    return _finished(t, stream, lambda df: mask(df, {"c_name": ["person_name"]}))


_DAILY = r"""
    SELECT strftime(date_trunc('day', ts), '%Y-%m-%d') AS day, count(*) AS rows,
           count(*) FILTER (WHERE regexp_matches(props, '"k": [0-9]?7\b')) AS matched
    FROM events GROUP BY 1"""


def _hit():
    return F.col("props").rlike(r'"k": [0-9]?7\b')


def _by_day(counted):
    return counted.select(F.date_format("start", "yyyy-MM-dd").alias("day"), "rows", "matched")


@query(_DAILY)
def daily_matches_of_events(t):
    return _by_day(windowed_matches(t.events, "ts", _hit(), "1 day"))


@query(_DAILY)
def daily_matches_on_a_stream(t):
    # A stream gives out a window when the watermark has passed it; an event far in the future
    # at the end of the input passes them all.
    folder = scratch(t.spark, "events")
    events = t.events.select(F.col("ts").cast("timestamp").alias("ts"), "props")
    events.write.parquet(f"{folder}/a")
    latest = events.agg(F.max("ts").alias("ts"))
    later = (F.col("ts") + F.expr("INTERVAL 60 DAYS")).alias("ts")
    closing = latest.select(later, F.lit("").alias("props"))
    closing.write.parquet(f"{folder}/b")
    stream = (
        t.spark.readStream.schema(events.schema)
        .options(recursiveFileLookup=True, maxFilesPerTrigger=1)
        .parquet(folder)
    )
    counted = windowed_matches(stream, "ts", _hit(), "1 day", lateness="40 days")
    return _by_day(_finished(t, counted, lambda df: df))


@query("""
    SELECT CASE WHEN c_custkey % 3 = 0 THEN 1 ELSE 0 END AS batch, count(*) AS row_count,
           count(*) FILTER (WHERE c_mktsegment = 'BUILDING') AS matched_count FROM customer GROUP BY 1""")
def counts_of_a_restarted_stream(t):
    # Two thirds of the customers come first; the query ends, is started again, and finds the rest.
    folder, places = scratch(t.spark, "stream-csv"), [scratch(t.spark, name) for name in ("stream", "stats", "checkpoint")]
    for late in (False, True, None):
        if late is not None:
            rows = t.customer.where((F.col("c_custkey") % 3 == 0) == late).select("c_custkey", "c_mktsegment")
            rows.write.mode("append").options(header=True, escape='"').csv(folder)
        stream = csv_stream(t.spark, folder, ["c_custkey", "c_mktsegment"])
        build = lambda df: find_replace(df, ["c_mktsegment"], "BUILDING", "house")
        clean_stream_counted(stream, build, *places).awaitTermination()
    return stream_stats(t.spark, places[1])


@query(r"""
    WITH days AS (SELECT *, date_trunc('day', ts) AS day FROM events),
    early AS (SELECT max(ts) - INTERVAL 2 DAYS AS passed FROM days WHERE event_id % 7 <> 0)
    SELECT strftime(day, '%Y-%m-%d') AS day, count(*) AS rows,
           count(*) FILTER (WHERE regexp_matches(props, '"k": [0-9]?7\b')) AS matched,
           (SELECT count(*) FROM days, early WHERE event_id % 7 = 0 AND day + INTERVAL 1 DAY <= passed) AS late
    FROM days, early WHERE event_id % 7 <> 0 OR day + INTERVAL 1 DAY > passed GROUP BY 1""")
def daily_matches_with_late_rows(t):
    # A seventh of the events comes after the others; what is within two days still counts.
    folder, output, checkpoint = (scratch(t.spark, name) for name in ("events", "windows", "checkpoint"))
    events = t.events.select("event_id", F.col("ts").cast("timestamp").alias("ts"), "props")
    for last in (False, True):
        events.where((F.col("event_id") % 7 == 0) == last).write.mode("append").parquet(folder)
        stream = t.spark.readStream.schema(events.schema).parquet(folder)
        counted = windowed_matches(stream, "ts", _hit(), "1 day", lateness="2 days")
        keep_windows(counted, output, checkpoint).awaitTermination()
    windows = kept_windows(t.spark, output)
    late = events.count() - windows.agg(F.sum("rows")).first()[0]
    return _by_day(windows).withColumn("late", F.lit(late).cast("long"))
