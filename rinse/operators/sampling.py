"""A few values per column, to look at or to build a specification from."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rinse.functions.text import strip
from rinse.operators.cells import named, present

# How much a sample takes unless told otherwise.
SAMPLE_ROWS = 1000
MAX_VALUES = 20
MAX_LENGTH = 200

# Tasks whose first rows are merged in one step.
_FAN_IN = 512


def first_rows(df: DataFrame, count: int, order_by: str | None) -> DataFrame:
    """The first rows of the table, numbered by ``__at``.

    In reading order Spark starts with one task and stops as soon as it has enough. By a key,
    every task keeps its ``count`` smallest, and groups of tasks merge theirs before the end.
    """
    at = F.monotonically_increasing_id()
    if order_by is None:
        return df.limit(count).withColumn("__at", at)
    key = named(order_by)
    group = F.floor(F.spark_partition_id() / _FAN_IN)
    rank = F.row_number().over(Window.partitionBy("__group").orderBy(key))
    merged = df.withColumn("__group", group).withColumn("__rank", rank)
    merged = merged.where(F.col("__rank") <= count).drop("__group", "__rank")
    rows = merged.orderBy(key).limit(count)
    return rows.withColumn("__at", F.row_number().over(Window.orderBy(key)))


def sample_values(
    df: DataFrame,
    columns: Iterable[str],
    max_values: int = MAX_VALUES,
    sample_rows: int = SAMPLE_ROWS,
    order_by: str | None = None,
) -> DataFrame:
    """``(column, values)`` in the order asked for: distinct values of the first rows.

    Values are stripped, cut, and dropped if blank; they stand in the order first seen.
    """
    names = present(df, columns)
    key = [named(order_by).alias("__key")] if order_by else []
    cut = [F.substring(strip(named(n).cast("string")), 1, MAX_LENGTH) for n in names]
    # No column needs more than MAX_LENGTH characters of a value, so cut before rows move.
    slim = df.select(*key, *(text.alias(f"c{i}") for i, text in enumerate(cut)))
    rows = first_rows(slim, sample_rows, "__key" if order_by else None)
    fields = [f"c{i}" for i in range(len(names))]
    seen = rows.agg(F.array_sort(F.collect_list(F.struct("__at", *fields))).alias("seen"))
    samples = [
        F.struct(
            F.lit(name).alias("column"),
            F.slice(_distinct(F.col("seen")[field]), 1, max_values).alias("values"),
        )
        for name, field in zip(names, fields, strict=True)
    ]
    return seen.select(F.inline(F.array(*samples)))


def _distinct(values: Column) -> Column:
    """Non-blank values, each where it first occurs."""
    return F.array_distinct(F.filter(values, lambda value: value != ""))
