"""Whole runs: read a source, transform it, write the result once, and count on the way."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from typing import NamedTuple

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from rinse.operators.cells import MATCHED, ROW_ID, named, with_row_id
from rinse.operators.find_replace import find_replace
from rinse.operators.footers import write_offsets
from rinse.plans.specs import Replace
from rinse.sources.tables import read_flags, read_source, unreadable, write_parquet


class Stats(NamedTuple):
    row_count: int
    matched_count: int


def counts() -> list[Column]:
    """What is counted of a result: rows and matches."""
    return [
        F.count(F.lit(1)).alias("row_count"),
        F.count_if(named(MATCHED)).alias("matched_count"),
    ]


def write_counted(result: DataFrame, path: str) -> Stats:
    """Write the result and count rows and matches in the same pass.

    A result with row ids gets the offsets of its pages beside it, from the footers of its files.
    """
    seen = Observation()
    write_parquet(result.observe(seen, *counts()), path)
    stats = Stats(**seen.get)
    if ROW_ID in result.columns:
        write_offsets(result.sparkSession, path, result.schema)
    return stats


def count_result(spark: SparkSession, path: str) -> DataFrame:
    """The same counts, from a result that is already written: one row."""
    return read_flags(spark, path).agg(*counts())


def run(
    spark: SparkSession,
    source: str,
    output: str,
    build: Callable[[DataFrame], DataFrame],
    file_type: str | None = None,
) -> Stats:
    """Read a file with row ids, apply ``build``, write Parquet; a rerun replaces the output.

    Much of what is wrong with a source shows only while it is read; this too is a ``RinseError``.
    """
    result = build(with_row_id(read_source(spark, source, file_type)))
    try:
        return write_counted(result, output)
    except (PySparkException, Py4JJavaError) as error:
        raise unreadable(source, error) from error


def run_replace(spark: SparkSession, spec: Replace) -> Stats:
    def build(table: DataFrame) -> DataFrame:
        return find_replace(table, spec.columns, spec.pattern, spec.replacement)

    return run(spark, spec.source, spec.output, build, spec.file_type)


def round_trip(spark: SparkSession, tables: Mapping[str, DataFrame], folder: str) -> DataFrame:
    """Write each table to Parquet below the folder and compare what comes back.

    One row per table: ``name, columns, source_rows, parquet_rows, partitions``. The rows are
    counted while they are written.
    """
    audit = None
    for name, table in tables.items():
        path = f"{folder.rstrip('/')}/{name}"
        seen = Observation()
        counted = table.observe(
            seen,
            F.count(F.lit(1)).alias("rows"),
            F.max(F.spark_partition_id()).alias("last_partition"),
        )
        write_parquet(counted, path)
        stats = seen.get
        last = stats["last_partition"]
        one = spark.read.parquet(path).agg(F.count(F.lit(1)).alias("parquet_rows")).select(
            F.lit(name).alias("name"),
            F.array(*map(F.lit, table.columns)).cast("array<string>").alias("columns"),
            F.lit(stats["rows"]).cast("long").alias("source_rows"),
            "parquet_rows",
            F.lit(0 if last is None else last + 1).alias("partitions"),
        )
        audit = one if audit is None else audit.unionByName(one)
    return audit
