"""The same transforms on streams of files, and match counts over time."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from rinse.errors import RESERVED_COLUMN, RinseError
from rinse.operators.cells import MATCHED, ROW_ID
from rinse.plans.run import counts
from rinse.sources.tables import ANY_CASE, CSV, CSV_OPTIONS


def csv_stream(
    spark: SparkSession, folder: str, columns: Sequence[str], max_files: int | None = None
) -> DataFrame:
    """New CSV files of a folder as they come, all columns strings. There is no row id."""
    schema = ", ".join(f"`{name.replace('`', '``')}` string" for name in columns)
    reader = spark.readStream.schema(schema).options(**CSV_OPTIONS, pathGlobFilter=ANY_CASE[CSV])
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.csv(folder)


def clean_stream(
    stream: DataFrame,
    build: Callable[[DataFrame], DataFrame],
    output: str,
    checkpoint: str,
    *,
    available_now: bool = True,
) -> StreamingQuery:
    """Append cleaned rows to a Parquet folder. Rows are independent, so no state is kept.

    The checkpoint makes a restarted query go on where it stopped, each file exactly once. The
    progress of every batch carries its counts as the observed metric ``counts``.
    """
    if ROW_ID in stream.columns:
        raise RinseError(RESERVED_COLUMN, "Row ids cannot be assigned on a stream", [ROW_ID])
    cleaned = build(stream)
    if MATCHED in cleaned.columns:
        cleaned = cleaned.observe("counts", *counts())
    writer = cleaned.writeStream.format("parquet").outputMode("append")
    writer = writer.option("checkpointLocation", checkpoint).option("path", output)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def windowed_matches(
    events: DataFrame, time: str, hit: Column, window: str, lateness: str | None = None
) -> DataFrame:
    """Rows and matching rows per tumbling window: ``start, rows, matched``.

    The same for a batch and a stream. On a stream ``lateness`` bounds how long a window stays
    open, and with it the state: one row per open window and key of the aggregation.
    """
    moment = F.col(time).cast("timestamp")
    marked = events.select(moment.alias("at"), F.coalesce(hit, F.lit(False)).alias("hit"))
    if lateness and events.isStreaming:
        marked = marked.withWatermark("at", lateness)
    counted = marked.groupBy(F.window("at", window).alias("span")).agg(
        F.count(F.lit(1)).alias("rows"), F.count_if("hit").alias("matched")
    )
    return counted.select(F.col("span.start").alias("start"), "rows", "matched")


def clean_stream_counted(
    stream: DataFrame,
    build: Callable[[DataFrame], DataFrame],
    output: str,
    stats: str,
    checkpoint: str,
    *,
    available_now: bool = True,
) -> StreamingQuery:
    """As ``clean_stream``, and keep rows and matches of each batch in a table at ``stats``.

    A batch writes its rows and its counts below its number. One that is repeated after a failure
    takes the same input and replaces both, so nothing counts twice. The rows are read with
    ``cleaned_rows``, the counts with ``stream_stats``.
    """
    if ROW_ID in stream.columns:
        raise RinseError(RESERVED_COLUMN, "Row ids cannot be assigned on a stream", [ROW_ID])

    def write(batch: DataFrame, number: int) -> None:
        seen = Observation()
        build(batch).observe(seen, *counts()).write.mode("overwrite").parquet(f"{output}/{BATCH}={number}")
        found = batch.sparkSession.createDataFrame([tuple(seen.get[name] for name in _COUNTS)], "row_count long, matched_count long")
        found.coalesce(1).write.mode("overwrite").parquet(f"{stats}/{BATCH}={number}")

    writer = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


BATCH = "__batch"
_COUNTS = ("row_count", "matched_count")


def cleaned_rows(spark: SparkSession, output: str) -> DataFrame:
    """What ``clean_stream_counted`` has written."""
    return spark.read.parquet(output).drop(BATCH)


def stream_stats(spark: SparkSession, stats: str) -> DataFrame:
    """``batch, row_count, matched_count`` of each batch."""
    found = spark.read.parquet(stats)
    return found.select(F.col(BATCH).cast("long").alias("batch"), *_COUNTS)


def keep_windows(
    counted: DataFrame, output: str, checkpoint: str, *, available_now: bool = True
) -> StreamingQuery:
    """Keep the windows of ``windowed_matches`` on a stream as they grow; read them with ``kept_windows``.

    Every batch writes the windows that it has changed, below its number, so a window can be read
    before the watermark has passed it. Rows whose window it has passed are dropped; the
    progress of the batch says how many groups of them (``dropped_groups``).
    """

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{output}/{BATCH}={number}")

    writer = counted.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def kept_windows(spark: SparkSession, output: str) -> DataFrame:
    """``start, rows, matched`` of each window, as its last batch has left it."""
    latest = F.max_by(F.struct("rows", "matched"), F.col(BATCH).cast("long")).alias("last")
    return spark.read.parquet(output).groupBy("start").agg(latest).select("start", "last.*")


def dropped_groups(query: StreamingQuery) -> int:
    """How many groups of late rows the batches of a query have dropped: one for each window and task."""
    return sum(
        operator.numRowsDroppedByWatermark for progress in query.recentProgress for operator in progress.stateOperators
    )
