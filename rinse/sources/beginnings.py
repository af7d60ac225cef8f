"""The first lines of files, read as one range of bytes per file however long the files are."""

from __future__ import annotations

import csv
import re
from collections import Counter
from collections.abc import Iterator
from contextlib import contextmanager
from urllib.parse import unquote, urlparse

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BYTES = 256 * 1024
FILES_PER_TASK = 200
_LINE_END = re.compile(rb"\r\n|\n|\r")
# Stores that pyarrow reads, by the schemes that Hadoop and pyarrow use for them.
_STORES = {"s3": "s3", "s3a": "s3", "s3n": "s3", "gs": "gs", "hdfs": "hdfs", "abfs": "abfs", "abfss": "abfss"}


def in_reach(path: str) -> bool:
    """Whether tasks can open the file without Spark's readers."""
    scheme = urlparse(path).scheme
    return scheme in ("", "file") or scheme in _STORES


@contextmanager
def opened(path: str):
    """A file for reading at any place, named as Spark names it."""
    parts = urlparse(path)
    if parts.scheme in ("", "file"):
        name = path.split(":", 1)[1] if parts.scheme else path
        with open("/" + name.lstrip("/"), "rb") as source:
            yield source
        return
    from pyarrow import fs

    uri = _STORES.get(parts.scheme, parts.scheme) + path[len(parts.scheme) :]
    system, place = fs.FileSystem.from_uri(uri)
    with system.open_input_file(place) as source:
        yield source


def first_lines(source, length: int, most: int, size: int) -> tuple[list[str], int]:
    """At most ``most`` whole lines of the first ``size`` bytes, and how many bytes were read.

    Blank lines do not count, as in Spark's reader. More is read only where not even one line is
    whole by then.
    """
    data = b""
    while True:
        data += source.read(size - len(data))
        lines = _LINE_END.split(data)
        if len(data) < length:
            lines.pop()
        found = [line.decode("utf-8", "replace") for line in lines if line.strip()]
        if found or len(data) >= length or len(data) < size:
            break
        size *= 2
    if found and found[0].startswith("﻿"):
        found[0] = found[0][1:]
    return found[:most], len(data)


_SCHEMA = "path string, length long, bytes_read long, lines array<string>"


def beginnings(files: DataFrame, most: int, size: int = BYTES) -> DataFrame:
    """The first lines of each file of ``files`` (path, length): ``path, length, bytes_read, lines``.

    Tasks take files by number, not by size, and read one range of each.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for path, length in zip(batch.column("path").to_pylist(), batch.column("length").to_pylist(), strict=True):
                with opened(path) as source:
                    lines, used = first_lines(source, length, most, size)
                rows.append({"path": path, "length": length, "bytes_read": used, "lines": lines})
                if len(rows) == 16:
                    yield pa.RecordBatch.from_pylist(rows, schema=_ROWS)
                    rows = []
            if rows:
                yield pa.RecordBatch.from_pylist(rows, schema=_ROWS)

    many, cores = files.count(), files.sparkSession.sparkContext.defaultParallelism
    tasks = max(-(-many // FILES_PER_TASK), min(cores, many), 1)
    return files.select("path", "length").repartition(tasks, "path").mapInArrow(read, _SCHEMA)


_ROWS = pa.schema([("path", pa.string()), ("length", pa.int64()), ("bytes_read", pa.int64()), ("lines", pa.list_(pa.string()))])


def header_lines(spark: SparkSession, files: DataFrame) -> DataFrame:
    """``(path, line)``: the first line of each CSV file of ``files`` that has one.

    Files in stores that only Spark reads are read by Spark, whole.
    """
    one = files.select("path").first()
    if one is None or in_reach(one["path"]):
        heads = beginnings(files, 1)
        return heads.where(F.size("lines") > 0).select("path", F.col("lines")[0].alias("line"))
    # the list is what the scan is planned from as well
    paths = [glob_escaped(row["path"]) for row in files.select("path").toLocalIterator()]
    lines = spark.read.text(paths).where(F.trim("value") != "")
    place = F.struct(F.col("_metadata.file_block_start"), F.monotonically_increasing_id())
    lines = lines.select(F.col("_metadata.file_path").alias("path"), "value", place.alias("place"))
    lines = lines.groupBy("path").agg(F.min_by("value", "place").alias("line"))
    return lines.select(F.url_decode(F.replace("path", F.lit("+"), F.lit("%2B"))).alias("path"), F.ltrim("line", F.lit("﻿")).alias("line"))


def glob_escaped(path: str) -> str:
    """A path that Spark does not take for a pattern."""
    return re.sub(r"([\[\]{}*?\\])", r"\\\1", path)


def column_names(line: str) -> list[str]:
    """The columns that Spark's reader makes of a header line: none empty, none twice."""
    cells = next(csv.reader([line]), [])
    times = Counter(cell.lower() for cell in cells)
    return [
        f"_c{at}" if not cell else f"{cell}{at}" if times[cell.lower()] > 1 else cell
        for at, cell in enumerate(cells)
    ]
