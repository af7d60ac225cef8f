"""CSV and workbooks in, Parquet out. Every source column is a string."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rinse.errors import SOURCE_READ_ERROR, STORAGE_UNAVAILABLE, UNSUPPORTED_FILE_TYPE, RinseError, first_line
from rinse.operators.cells import MATCHED
from rinse.session import stored
from rinse.sources.beginnings import column_names, glob_escaped, header_lines
from rinse.sources.workbooks import read_xlsx

CSV = "csv"
XLSX = "xlsx"
# The same as a glob, so that other files are not even listed.
ANY_CASE = {CSV: "*.[cC][sS][vV]", XLSX: "*.[xX][lL][sS][xX]"}

# A quote inside a quoted value is written twice, as spreadsheets do. Files of one folder must
# agree in their header; without the check Spark would go by position and mix columns up.
CSV_OPTIONS = {
    "header": True,
    "inferSchema": False,
    "mode": "PERMISSIVE",
    "encoding": "UTF-8",
    "quote": '"',
    "escape": '"',
    "enforceSchema": False,
}


def file_type(path: str) -> str | None:
    """``csv`` or ``xlsx`` by the extension in any case, otherwise None."""
    found = re.search(r"[^/]\.([^./]+)$", path)
    kind = found.group(1).lower() if found else None
    return kind if kind in ANY_CASE else None


def file_type_of(path: Column) -> Column:
    """The same for a column of paths."""
    kind = F.lower(F.regexp_extract(path, r"[^/]\.([^./]+)$", 1))
    return F.when(kind.isin(*ANY_CASE), kind)


def read_csv(spark: SparkSession, path: str, *, multi_line: bool = False, **options) -> DataFrame:
    """A file or folder with headers, nothing inferred.

    ``multi_line`` allows line breaks inside values; such files cannot be split.
    """
    options = {**CSV_OPTIONS, "multiLine": multi_line, **options}
    try:
        return spark.read.options(**options).csv(path)
    except PySparkException as error:
        raise unreadable(path, error) from error


# What the errors of a storage that does not answer say; such a run may be tried again.
_OUTAGE = re.compile(
    r"UnknownHost|ConnectException|Connection (?:refused|reset|timed out)|SocketTimeout|NoRouteToHost"
    r"|NoHttpResponse|ServiceUnavailable|Service Unavailable|Status Code: 50[0234]|SlowDown"
)


def unreadable(path: str, error: BaseException) -> RinseError:
    if _OUTAGE.search(str(error)):
        return RinseError(STORAGE_UNAVAILABLE, f"The storage of {path} does not answer: {first_line(error)}")
    return RinseError(SOURCE_READ_ERROR, f"Cannot read {path}: {first_line(error)}")


def read_source(spark: SparkSession, path: str, kind: str | None = None) -> DataFrame:
    """Read one file, or a folder of one kind, by its type."""
    kind = kind or file_type(path)
    if kind == CSV:
        return read_csv(spark, path)
    if kind == XLSX:
        return read_xlsx(spark, path)
    raise RinseError(UNSUPPORTED_FILE_TYPE, f"Only .csv and .xlsx files can be read: {path}")


def files_below(spark: SparkSession, root: str, pattern: str) -> DataFrame:
    """``path, length, modificationTime`` of the files whose names fit; no content is read."""
    found = spark.read.format("binaryFile").options(recursiveFileLookup=True, pathGlobFilter=pattern)
    try:
        return found.load(root).select("path", "length", "modificationTime")
    except PySparkException as error:
        raise unreadable(root, error) from error


def string_schema(names: list[str]) -> str:
    """A schema of strings with these names."""
    return ", ".join(f"`{name.replace('`', '``')}` string" for name in names)


def headers(lines: DataFrame) -> dict[tuple[str, ...], list[str]]:
    """The distinct headers among the first lines (``line``) of CSV files, each with the lines that spell it."""
    found: dict[tuple[str, ...], list[str]] = {}
    for row in lines.select("line").distinct().orderBy("line").collect():
        found.setdefault(tuple(column_names(row["line"])), []).append(row["line"])
    return found


def read_csv_folder(spark: SparkSession, path: str, *, multi_line: bool = False) -> DataFrame:
    """All CSV files below a folder as one table, by the names in their headers.

    The first line of every file is read, a task taking many files. Files with one header are one
    scan, and the scans are put together by name: a column that a file does not have is null, and
    the order of columns does not matter. Names that differ in case are one column.
    """
    only = {"pathGlobFilter": ANY_CASE[CSV], "recursiveFileLookup": True}
    lines = stored(header_lines(spark, files_below(spark, path, ANY_CASE[CSV])), "headers")
    found = headers(lines)
    if len(found) < 2:
        return read_csv(spark, path, multi_line=multi_line, **only)
    tables = []
    for names, spelled in found.items():
        paths = lines.where(F.col("line").isin(spelled)).select("path").orderBy("path")
        # the names of files, which the scan keeps in the driver anyway
        own = [glob_escaped(row["path"]) for row in paths.toLocalIterator()]
        options = {**CSV_OPTIONS, **only, "multiLine": multi_line}
        tables.append(spark.read.schema(string_schema(list(names))).options(**options).csv(own))
    return reduce(lambda whole, table: whole.unionByName(table, allowMissingColumns=True), tables)


def read_folder(spark: SparkSession, path: str, kinds: tuple[str, ...] = (CSV, XLSX)) -> DataFrame:
    """All CSV files and workbooks below a folder as one table; absent columns are null."""
    tables = []
    if CSV in kinds:
        tables.append(read_csv_folder(spark, path))
    if XLSX in kinds:
        tables.append(read_xlsx(spark, path, recursive=True))
    filled = [table for table in tables if table.columns]
    if not filled:
        raise RinseError(SOURCE_READ_ERROR, f"Nothing to read in {path}")
    whole = filled[0]
    for table in filled[1:]:
        whole = whole.unionByName(table, allowMissingColumns=True)
    return whole


def write_parquet(df: DataFrame, path: str) -> None:
    """Replace whatever an earlier run left at the path."""
    df.write.mode("overwrite").parquet(path)


def read_flags(spark: SparkSession, path: str) -> DataFrame:
    """Only the match flags of a result; Parquet reads no other column."""
    return spark.read.parquet(path).select(MATCHED)
