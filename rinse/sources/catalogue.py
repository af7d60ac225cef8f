"""Which files there are, and what the first rows of one look like."""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rinse.errors import INVALID_SPEC, PREVIEW_UNAVAILABLE, RinseError
from rinse.session import stored
from rinse.sources.beginnings import beginnings, in_reach
from rinse.sources.tables import (
    ANY_CASE,
    CSV,
    CSV_OPTIONS,
    XLSX,
    file_type,
    file_type_of,
    files_below,
    headers,
    read_source,
    string_schema,
    unreadable,
)

# Sizes of a listing and of a preview.
MAX_LISTED = 1000
PREVIEW_ROWS = 10
LARGEST_WORKBOOK = 50 * 1024 * 1024


def list_files(spark: SparkSession, root: str) -> DataFrame:
    """``(key, size, last_modified, file_type)`` of all supported files below the folder.

    Only metadata is read, no content. The key is the path below the folder. Spark's listing
    leaves out empty files and names that start with ``_`` or a dot.
    """
    scheme = re.match(r"[A-Za-z][A-Za-z0-9+.-]*:", root)
    if not scheme and not root.startswith("/"):
        raise RinseError(INVALID_SPEC, f"Give the whole path of the folder, not {root!r}")
    found = (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", True)
        .option("pathGlobFilter", "{" + ",".join(ANY_CASE.values()) + "}")
        .load(root)
    )
    # Spark adds the scheme and host that the folder was written without.
    lead = r"^[A-Za-z][A-Za-z0-9+.-]*:" + ("" if scheme else r"(?://[^/]*)?") + "/*"
    base = re.sub(lead, "", root).strip("/")
    key = F.substr(F.regexp_replace("path", lead, ""), F.lit(len(base) + 2 if base else 1))
    listed = found.select(
        key.alias("key"),
        F.col("length").alias("size"),
        F.col("modificationTime").alias("last_modified"),
    )
    return listed.withColumn("file_type", file_type_of(F.col("key")))


@dataclass(frozen=True)
class FilePage:
    files: list
    next_cursor: str | None


def file_page(
    spark: SparkSession, root: str, prefix: str = "", cursor: str | None = None,
    page_size: int = 100,
) -> FilePage:
    """The next files by key after the cursor, and the cursor of the page after them."""
    if not 1 <= page_size <= MAX_LISTED:
        raise RinseError(INVALID_SPEC, f"A page has 1 to {MAX_LISTED} files")
    files = list_files(spark, root).where(F.col("key").startswith(prefix))
    if cursor:
        files = files.where(F.col("key") > cursor)
    rows = files.orderBy("key").limit(page_size + 1).collect()
    more = len(rows) > page_size
    return FilePage(rows[:page_size], rows[page_size - 1]["key"] if more else None)


def preview(spark: SparkSession, path: str) -> DataFrame:
    """The first rows of a file. Spark reads no more of a CSV file than these need."""
    if file_type(path) == XLSX:
        files = spark.read.format("binaryFile")
        try:
            [size] = files.load(path).select("length").first()
        except PySparkException as error:
            raise unreadable(path, error) from error
        if size > LARGEST_WORKBOOK:
            raise RinseError(PREVIEW_UNAVAILABLE, f"The workbook is too large to show: {path}")
    return read_source(spark, path).limit(PREVIEW_ROWS)


def preview_folder(spark: SparkSession, root: str, rows: int = PREVIEW_ROWS) -> DataFrame:
    """The first rows of every CSV file below a folder: ``file``, ``row``, then the columns.

    Of each file the first 256 KiB are read, whatever its size (``file_beginnings`` says how much);
    rows that do not end in them are not shown. Files may differ in their columns. A value with
    line breaks ends at the first one.
    """
    lines = stored(file_beginnings(spark, root, rows + 1).where(F.size("lines") > 0), "beginnings")
    tables = []
    for names, spelled in headers(lines.select(F.col("lines")[0].alias("line"))).items():
        own = lines.where(F.col("lines")[0].isin(spelled))
        shown = own.select(F.col("path").alias("file"), F.posexplode(F.slice("lines", 2, rows)).alias("row", "line"))
        options = {"quote": CSV_OPTIONS["quote"], "escape": CSV_OPTIONS["escape"], "mode": "PERMISSIVE"}
        values = F.from_csv("line", string_schema(list(names)), options)
        columns = (values[name].alias(name) for name in names)
        tables.append(shown.select("file", (F.col("row") + 1).alias("row"), *columns))
    if not tables:
        raise RinseError(PREVIEW_UNAVAILABLE, f"No CSV file with a header in {root}")
    return reduce(lambda whole, table: whole.unionByName(table, allowMissingColumns=True), tables)


def file_beginnings(spark: SparkSession, root: str, lines: int) -> DataFrame:
    """``path, length, bytes_read, lines``: the first lines of every CSV file below a folder."""
    files = files_below(spark, root, ANY_CASE[CSV])
    one = files.select("path").first()
    if one and not in_reach(one["path"]):
        raise RinseError(PREVIEW_UNAVAILABLE, f"Only Spark's readers reach {root}; preview its files one by one")
    return beginnings(files, lines)
