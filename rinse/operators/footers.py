"""Row ranges of a written result, taken from the footers of its Parquet files.

A row group's footer says how many rows it has and between which ids, so pages can be found
without a look at any row. The ranges are kept in a small table inside the result's folder.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from rinse.operators.cells import ROW_ID
from rinse.sources.beginnings import FILES_PER_TASK, in_reach, opened
from rinse.sources.tables import files_below

# The name starts with an underscore, so Spark leaves the folder out when it reads the result.
FOLDER = "_offsets"
SCHEMA = "path string, rows long, low long, high long, before long, fit boolean, columns string"
# Ids of 1024 tasks form a block; ranges are added up within blocks, then the blocks.
BLOCK_BITS = 43


def row_groups(spark: SparkSession, path: str) -> DataFrame:
    """``path, rows, low, high`` of every row group with rows; low and high are null without statistics."""
    files = files_below(spark, path, "*.parquet")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name in batch.column("path").to_pylist():
                rows = []
                with opened(name) as source:
                    footer = pq.ParquetFile(source).metadata
                for at in range(footer.num_row_groups):
                    group = footer.row_group(at)
                    columns = (group.column(place) for place in range(group.num_columns))
                    ids = next((column.statistics for column in columns if column.path_in_schema == ROW_ID), None)
                    ends = (ids.min, ids.max) if ids is not None and ids.has_min_max else (None, None)
                    if group.num_rows:
                        rows.append({"path": name, "rows": group.num_rows, "low": ends[0], "high": ends[1]})
                yield pa.RecordBatch.from_pylist(rows, schema=_ROWS)

    many, cores = files.count(), spark.sparkContext.defaultParallelism
    tasks = max(-(-many // FILES_PER_TASK), min(cores, many), 1)
    return files.select("path").repartition(tasks, "path").mapInArrow(read, "path string, rows long, low long, high long")


_ROWS = pa.schema([("path", pa.string()), ("rows", pa.int64()), ("low", pa.int64()), ("high", pa.int64())])


def with_rows_before(ranges: DataFrame) -> DataFrame:
    """Add how many rows come ``before`` each range, and the ``last`` id before it."""
    ranges = ranges.withColumn("block", F.coalesce(F.shiftright("low", BLOCK_BITS), F.lit(-1)))
    earlier = Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = ranges.groupBy("block").agg(F.sum("rows").alias("block_rows"), F.max("high").alias("block_high"))
    blocks = blocks.select(
        "block", F.coalesce(F.sum("block_rows").over(earlier), F.lit(0)).alias("base"), F.max("block_high").over(earlier).alias("reached")
    )
    inside = Window.partitionBy("block").orderBy("low", "high").rowsBetween(Window.unboundedPreceding, -1)
    local, last = F.coalesce(F.sum("rows").over(inside), F.lit(0)), F.max("high").over(inside)
    ranges = ranges.withColumns({"local": local, "last": last}).join(F.broadcast(blocks), "block")
    return ranges.select(
        "path", "rows", "low", "high", (F.col("base") + F.col("local")).alias("before"), F.greatest("last", "reached").alias("last")
    )


def write_offsets(spark: SparkSession, path: str, schema: StructType | None = None) -> None:
    """Keep the ranges of the result at ``path`` in a table inside its folder, with whether they ``fit``.

    The result's schema stands beside them, so that a page can be read without a look for it.
    A range does not fit where a file has no statistics, or where it overlaps another one, as after
    a shuffle of the rows. Where tasks cannot open the files, nothing is kept.
    """
    if in_reach(path):
        fit = F.col("low").isNotNull() & (F.col("last").isNull() | (F.col("last") < F.col("low")))
        columns = F.lit((schema or spark.read.parquet(path).schema).json())
        found = with_rows_before(row_groups(spark, path)).withColumns({"fit": fit, "columns": columns}).drop("last")
        found.write.mode("overwrite").parquet(f"{path.rstrip('/')}/{FOLDER}")


def read_offsets(spark: SparkSession, path: str) -> DataFrame | None:
    """The ranges kept inside the folder of a result; None where there are none."""
    try:
        return spark.read.schema(SCHEMA).parquet(f"{path.rstrip('/')}/{FOLDER}")
    except PySparkException:
        return None
