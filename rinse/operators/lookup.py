"""Joining a large table to a table of answers with one row per key."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, IntegerType, StringType, StructField, StructType

from rinse.operators.cells import named

BROADCAST_BYTES = 64 * 1024 * 1024
# Rows of one key that a task should get at most; a key with more is dealt out over several.
ROWS_PER_TASK = 1_000_000
# Of so many frequent keys the counts are tracked, and so many are looked at.
TRACKED, HOTTEST = 10_000, 1000

# Type names whose values take at most 16 bytes.
_FIXED = {
    "boolean", "byte", "short", "integer", "long", "float", "double", "decimal", "date",
    "timestamp", "timestamp_ntz",
}


def fits_broadcast(df: DataFrame, limit: int = BROADCAST_BYTES) -> bool:
    """Measure the table; one aggregate over it."""
    width = F.lit(16 * len(df.columns))
    for field in df.schema:
        if isinstance(field.dataType, (StringType, BinaryType)):
            width = width + F.coalesce(F.octet_length(named(field.name)), F.lit(0))
        elif field.dataType.typeName() not in _FIXED:
            width = width + F.coalesce(F.octet_length(F.to_json(F.struct(named(field.name)))), F.lit(0))
    size = df.agg(F.coalesce(F.sum(width.cast("long")), F.lit(0)).alias("size")).first()["size"]
    return size <= limit


def hot_keys(rows: DataFrame, key: str, per_task: int) -> dict:
    """Keys with more than ``per_task`` rows, and over how many tasks each should be dealt.

    A sketch of the most frequent keys: tasks pass on at most ``TRACKED`` counts each, and one
    row comes back. Counts of keys with less than about a ``TRACKED``-th of all rows may be off,
    which changes only how rows are dealt.
    """
    sketch = F.expr(f"approx_top_k(`{key.replace('`', '``')}`, {HOTTEST}, {TRACKED})")
    found = rows.where(named(key).isNotNull()).agg(sketch.alias("top")).first()["top"] or []
    return {one["item"]: -(-one["count"] // per_task) for one in found if one["count"] > per_task}


def lookup(
    rows: DataFrame,
    answers: DataFrame,
    key: str,
    limit: int = BROADCAST_BYTES,
    size: int | None = None,
    per_task: int = ROWS_PER_TASK,
) -> DataFrame:
    """All rows with the answer's columns, null where there is none.

    Answers are broadcast if they take at most ``limit`` bytes; ``size`` is for callers who
    have measured them. Otherwise both sides are shuffled by the key. Rows of a key that has more
    than ``per_task`` are then dealt out over as many tasks as that takes, each with a copy of the
    key's answer.
    """
    if fits_broadcast(answers, limit) if size is None else size <= limit:
        return rows.join(F.broadcast(answers), key, "left")
    salt, tasks = "__salt", "__tasks"
    found = hot_keys(rows, key, per_task)
    if not found:  # nulls, which find nothing, are dealt out by AQE if they are many
        return rows.join(answers, key, "left")
    schema = StructType([StructField(key, rows.schema[key].dataType), StructField(tasks, IntegerType())])
    hot = F.broadcast(rows.sparkSession.createDataFrame(list(found.items()), schema))  # HOTTEST rows at most
    # The salt follows from the row and the task that holds it, so a repeated task gives the
    # same one, and equal rows from different tasks still part ways.
    dealt = F.xxhash64(F.spark_partition_id(), *map(named, rows.columns))
    salted = rows.withColumn(salt, dealt).join(hot, key, "left")
    # Rows without a key find nothing, wherever they go, so they are dealt out as well.
    dealt = F.when(named(key).isNull(), F.col(salt)).otherwise(F.pmod(salt, F.coalesce(tasks, F.lit(1))))
    salted = salted.withColumn(salt, dealt).drop(tasks)
    copies = F.sequence(F.lit(0), F.coalesce(tasks, F.lit(1)) - 1).cast("array<bigint>")
    copied = answers.join(hot, key, "left").withColumn(salt, F.explode(copies))
    return salted.join(copied.drop(tasks), [key, salt], "left").drop(salt)
