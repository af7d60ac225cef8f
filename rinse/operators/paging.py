"""Dense row numbers and pages over a result ordered by its row id.

Row ids increase but have gaps, because each task counts in a range of its own. Instead of
sorting the rows, the id space is cut into buckets of 2**20 ids. A bucket holds at most that
many rows however the data is skewed; counting the rows per bucket and adding the counts up
gives the number of the first row of every bucket.
"""

from __future__ import annotations

import json
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from rinse.operators.cells import MATCHED, ROW_ID, named, with_row_id
from rinse.operators.footers import read_offsets, row_groups, with_rows_before
from rinse.operators.lookup import lookup
from rinse.session import stored
from rinse.sources.beginnings import glob_escaped, in_reach

ROW_NUMBER = "row_number"
MAX_PAGE_SIZE = 500

BUCKET_BITS = 20
# Spark's ids have the task in front of these bits, and count its rows from 0 in them.
_TASK_BITS = 33
# Buckets are added up in blocks of this many bits' worth, then the blocks.
BLOCK_BITS = 16
# An offset takes three numbers, so up to four million buckets are broadcast.
_OFFSET_BYTES = 48
_OFFSETS_LIMIT = 192 * 1024 * 1024


def _bucket() -> Column:
    return F.shiftright(named(ROW_ID), BUCKET_BITS)


def bucket_counts(result: DataFrame) -> DataFrame:
    """Per bucket of ids its ``rows`` and its ``low``est and ``high``est id, kept in a table.

    The only look at the result, and only at its id column.
    """
    counts = result.groupBy(_bucket().alias("bucket")).agg(
        F.count(F.lit(1)).alias("rows"),
        F.min(named(ROW_ID)).alias("low"),
        F.max(named(ROW_ID)).alias("high"),
    )
    return stored(counts, "buckets")


def bucket_offsets(counts: DataFrame) -> DataFrame:
    """Add to the counts how many rows come ``before`` each bucket.

    Counts are added up within blocks of buckets and over blocks, so no task sees more than
    2**16 buckets or one row per block.
    """
    counts = counts.withColumn("block", F.shiftright("bucket", BLOCK_BITS))
    earlier = Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = (
        counts.groupBy("block")
        .agg(F.sum("rows").alias("block_rows"))
        .select("block", F.coalesce(F.sum("block_rows").over(earlier), F.lit(0)).alias("base"))
    )
    inside = Window.partitionBy("block").orderBy("bucket")
    inside = inside.rowsBetween(Window.unboundedPreceding, -1)
    local = F.coalesce(F.sum("rows").over(inside), F.lit(0))
    return counts.withColumn("local", local).join(blocks, "block").select(
        "bucket", "rows", "low", "high", (F.col("base") + F.col("local")).alias("before")
    )


def offsets_of(result: DataFrame) -> DataFrame:
    """The offsets of a result in a table, for reading many pages of it."""
    return stored(bucket_offsets(bucket_counts(result)), "offsets")


def _gapless() -> Column:
    """Whether the ids of a bucket follow each other, so that numbers are arithmetic."""
    return F.col("high") - F.col("low") + 1 == F.col("rows")


def _measure(counts: DataFrame) -> tuple[bool, int]:
    """Whether no bucket has gaps, and the number of buckets."""
    dense = F.coalesce(F.bool_and(_gapless()), F.lit(True))
    return tuple(counts.agg(dense, F.count(F.lit(1))).first())


def number_rows(result: DataFrame) -> DataFrame:
    """Put the dense ``row_number`` (from 1, in id order) in front.

    With ids as Spark assigns them the rows are not shuffled at all. Where ids were removed
    since, rows are ranked inside their bucket, which bounds every group. The result must be a
    table that was written, so that its ids are the same each time it is read.
    """
    counts = bucket_counts(result)
    dense, buckets = _measure(counts)
    rows = result.withColumn("bucket", _bucket())
    if dense:
        position = named(ROW_ID) - F.col("low") + 1
    else:
        rank = F.row_number().over(Window.partitionBy("bucket").orderBy(named(ROW_ID)))
        rows, position = rows.withColumn("__rank", rank), F.col("__rank")
    offsets = bucket_offsets(counts).select("bucket", "before", "low")
    joined = lookup(rows, offsets, "bucket", _OFFSETS_LIMIT, buckets * _OFFSET_BYTES)
    return joined.select(
        (F.col("before") + position).cast("long").alias(ROW_NUMBER), *map(named, result.columns)
    )


def number_rows_by(df: DataFrame, keys: Sequence[str | Column]) -> DataFrame:
    """Number the rows in the order of the keys: a range sort, then as ``number_rows``.

    Rows that agree in all keys keep the order they were read in. That makes every row's place
    unique, so the ranges of the sort are even, however many rows share a key. The sorted rows
    are written to the shared folder, since a repeated sort may cut its ranges elsewhere. How many
    rows each task has written, the footers of its file say.
    """
    tie = "__tie"
    ordered = df.withColumn(tie, F.monotonically_increasing_id()).orderBy(*keys, tie).drop(tie)
    ordered = stored(with_row_id(ordered), "ordered")
    files = ordered.inputFiles()
    if not files or not in_reach(files[0]):
        return number_rows(ordered).drop(ROW_ID)
    task, groups = F.shiftright("low", _TASK_BITS), row_groups(df.sparkSession, files[0].rpartition("/")[0])
    firsts = with_rows_before(groups).groupBy(task.alias("__task")).agg(F.min("before").alias("__before"))
    rows = ordered.withColumn("__task", F.shiftright(named(ROW_ID), _TASK_BITS))
    joined = lookup(rows, firsts, "__task", _OFFSETS_LIMIT, len(files) * _OFFSET_BYTES)
    place = F.col("__before") + named(ROW_ID).bitwiseAND(F.lit((1 << _TASK_BITS) - 1)) + 1
    return joined.select(place.cast("long").alias(ROW_NUMBER), *map(named, df.columns))


def number_rows_of_files(df: DataFrame) -> DataFrame:
    """Number the rows of a table just read from files: file by file, as they stand in them.

    Row ids alone do not tell, since Spark packs the splits of several files by size.
    """
    keys = {"__file": "_metadata.file_path", "__start": "_metadata.file_block_start"}
    placed = df.select("*", *(F.col(source).alias(name) for name, source in keys.items()))
    return number_rows_by(placed, list(keys)).drop(*keys)


def page_index(result: DataFrame, page_size: int) -> DataFrame:
    """One row ``(page, first_id, last_id, rows)`` per page, to serve any page by id range."""
    offsets, size = offsets_of(result), clamp_page_size(page_size)
    if not _measure(offsets)[0]:
        page = F.expr(f"({ROW_NUMBER} - 1) div {size} + 1")
        return (
            number_rows(result.select(named(ROW_ID)))
            .groupBy(page.alias("page"))
            .agg(
                F.min(ROW_ID).alias("first_id"),
                F.max(ROW_ID).alias("last_id"),
                F.count(F.lit(1)).alias("rows"),
            )
        )
    # Each bucket lists the pages it holds rows of; the rows themselves play no role.
    at = F.expr(f"explode(sequence(before div {size}, (before + rows - 1) div {size}))")
    parts = offsets.withColumn("at", at)
    from_row = F.greatest(F.col("at") * size, F.col("before"))
    to_row = F.least(F.col("at") * size + size, F.col("before") + F.col("rows")) - 1
    parts = parts.select(
        (F.col("at") + 1).alias("page"),
        (F.col("low") + from_row - F.col("before")).alias("first_id"),
        (F.col("low") + to_row - F.col("before")).alias("last_id"),
        (to_row - from_row + 1).alias("rows"),
    )
    # Nearly all pages lie in one bucket; only those across two are put together by a shuffle.
    across = parts.where(F.col("rows") < size).groupBy("page")
    joined = across.agg(
        F.min("first_id").alias("first_id"),
        F.max("last_id").alias("last_id"),
        F.sum("rows").alias("rows"),
    )
    return parts.where(F.col("rows") == size).unionByName(joined)


def id_range(result: DataFrame, low: int, high: int) -> DataFrame:
    """The rows with ids from low to high; Parquet skips the row groups outside."""
    return result.where(named(ROW_ID).between(low, high))


def clamp_page_size(page_size: int) -> int:
    return min(max(page_size, 1), MAX_PAGE_SIZE)


def total_pages(total_rows: int, page_size: int) -> int:
    return max(1, -(-total_rows // clamp_page_size(page_size)))


@dataclass(frozen=True)
class Page:
    """``rows`` has row_number, the match flag if there is one, and the user's columns."""

    rows: DataFrame
    columns: list[str]
    page: int
    page_size: int
    total_rows: int

    @property
    def total_pages(self) -> int:
        return total_pages(self.total_rows, self.page_size)


def locate(result: DataFrame, start: int, count: int, offsets: DataFrame) -> tuple:
    """``(total rows, lowest id, highest id)`` of the rows start+1 … start+count.

    Arithmetic on the buckets the rows fall into; if those have gaps, their ids are read and
    ranked, which are two buckets' worth at most. Ids are None if there are no such rows.
    """
    inside = (F.col("before") < start + count) & (F.col("before") + F.col("rows") > start)
    skipped = F.greatest(F.lit(start) - F.col("before"), F.lit(0))
    taken = F.least(F.lit(start + count) - F.col("before"), F.col("rows"))
    found = offsets.agg(
        F.coalesce(F.sum("rows"), F.lit(0)).alias("total"),
        F.min(F.when(inside, F.col("low") + skipped)).alias("first"),
        F.max(F.when(inside, F.col("low") + taken - 1)).alias("last"),
        F.coalesce(F.bool_and(F.when(inside, _gapless())), F.lit(True)).alias("dense"),
        F.min(F.when(inside, F.col("low"))).alias("low"),
        F.max(F.when(inside, F.col("high"))).alias("high"),
        F.min(F.when(inside, F.col("before"))).alias("before"),
    ).first()
    if found["dense"]:
        return found["total"], found["first"], found["last"]
    ids = id_range(result.select(named(ROW_ID).alias("id")), found["low"], found["high"])
    ids = ids.orderBy("id").offset(start - found["before"]).limit(count)
    ends = ids.agg(F.min("id").alias("first"), F.max("id").alias("last")).first()
    return found["total"], ends["first"], ends["last"]


def read_page(
    result: DataFrame, page: int, page_size: int, offsets: DataFrame | None = None
) -> Page:
    """One page in id order. Past the end it has no rows but all columns.

    Pass ``offsets_of`` the result to read many pages of it without counting again.
    """
    page, page_size = max(page, 1), clamp_page_size(page_size)
    start = (page - 1) * page_size
    offsets = bucket_offsets(bucket_counts(result)) if offsets is None else offsets
    total, first, last = locate(result, start, page_size, offsets)
    rows = result.limit(0) if first is None else id_range(result, first, last)
    columns = [name for name in result.columns if name not in (ROW_ID, MATCHED)]
    flag = [named(MATCHED)] if MATCHED in result.columns else []
    # The window sees one page of rows, never the table.
    number = F.row_number().over(Window.orderBy(named(ROW_ID))) + F.lit(start)
    shown = rows.select(number.cast("long").alias(ROW_NUMBER), *flag, *map(named, columns))
    return Page(shown.orderBy(ROW_NUMBER), columns, page, page_size, total)


def read_page_of(spark: SparkSession, path: str, page: int, page_size: int) -> Page:
    """One page of the result written to ``path``, found by the offsets that its run has left there.

    No row outside of the page's files and row groups is looked at: one job reads the ranges that the
    page touches, one the page. Results without offsets, or with ids that have gaps or overlap, are
    paged by ``read_page``.
    """
    offsets = read_offsets(spark, path)
    if offsets is None:
        return read_page(spark.read.parquet(path), page, page_size)
    page, page_size = max(page, 1), clamp_page_size(page_size)
    start = (page - 1) * page_size
    inside = (F.col("before") < start + page_size) & (F.col("before") + F.col("rows") > start)
    touched = F.struct("before", "low", "high", "rows", "path")
    found = offsets.agg(
        F.coalesce(F.sum("rows"), F.lit(0)).alias("total"),
        F.coalesce(F.bool_and("fit"), F.lit(True)).alias("fit"),
        F.coalesce(F.bool_and(F.when(inside, _gapless())), F.lit(True)).alias("dense"),
        F.sort_array(F.collect_list(F.when(inside, touched))).alias("ranges"),
        F.first("columns").alias("columns"),
    ).first()
    if not (found["fit"] and found["dense"]):
        return read_page(spark.read.parquet(path), page, page_size)
    ranges = found["ranges"]
    if ranges:
        files = sorted({glob_escaped(one["path"]) for one in ranges})
        rows = spark.read.schema(StructType.fromJson(json.loads(found["columns"]))).parquet(*files)
    else:
        rows = spark.read.parquet(path).limit(0)
    columns = [name for name in rows.columns if name not in (ROW_ID, MATCHED)]
    flag = [named(MATCHED)] if MATCHED in rows.columns else []
    number = F.lit(None).cast("long")
    if ranges:
        ids = [one["low"] + max(start - one["before"], 0) for one in ranges]
        last = min(start + page_size - ranges[-1]["before"], ranges[-1]["rows"]) + ranges[-1]["low"] - 1
        rows = id_range(rows, ids[0], last)
        number = F.coalesce(*(
            F.when(named(ROW_ID).between(one["low"], one["high"]), named(ROW_ID) + (one["before"] - one["low"] + 1))
            for one in ranges
        ))
    shown = rows.select(number.cast("long").alias(ROW_NUMBER), *flag, *map(named, columns))
    # a page of rows: one task puts them in order
    return Page(shown.coalesce(1).sortWithinPartitions(ROW_NUMBER), columns, page, page_size, found["total"])
