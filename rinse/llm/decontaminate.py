"""Documents that hold passages of benchmark items, found by winnowing.

Of the hashes of all runs of ``GRAM`` words, winnowing keeps the smallest in every window of
``WINDOW`` words. Two texts that share a window share its smallest hash, so joining the kept hashes
finds every shared window. Hits are then extended: the windows with that hash are compared word
by word. Items shorter than a window are one window of their own length, compared by its hash.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rinse.llm.names import free_names
from rinse.llm.sizes import broadcast_if_small, is_small
from rinse.session import stored

WINDOW = 13
GRAM = 8
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"  # before lower-casing


def _lowered(word: Column) -> Column:
    """A-Z in lower case, other letters as they are; quick for plain ASCII."""
    plain = F.octet_length(word) == F.length(word)
    return F.when(plain, F.lower(word)).otherwise(F.translate(word, _UPPER, _LOWER))


def words(text: Column) -> Column:
    found = F.regexp_extract_all(F.coalesce(text.cast("string"), F.lit("")), F.lit(_WORD), F.lit(0))
    return F.transform(found, _lowered)


def _slid(table: DataFrame, name: str, span: int, join: Callable[[Column, Column], Column]) -> DataFrame:
    """Replace an array by the joined values of every ``span`` neighbours, by doubling the span."""
    have = 1
    while have < span:
        step = min(have, span - have)
        rest = F.greatest(F.size(name) - step, F.lit(0))
        left, right = F.slice(name, F.lit(1), rest), F.slice(name, F.lit(1 + step), rest)
        table = table.withColumn(name, F.zip_with(left, right, join))
        have += step
    return table


def _winnowed(table: DataFrame, window: int, gram: int) -> DataFrame:
    """Adds ``least`` to a table with ``words``: the smallest hash in each window of words."""
    table = table.withColumn("least", F.transform("words", lambda word: F.xxhash64(word)))
    table = _slid(table, "least", gram, lambda one, other: F.xxhash64(one, other))
    return _slid(table, "least", window - gram + 1, lambda one, other: F.least(one, other))


def _whole(words_: Column, length: int) -> Column:
    """Hashes of all runs of ``length`` words."""
    starts = F.sequence(F.lit(1), F.size(words_) - length + 1)
    hashed = F.transform(
        starts, lambda at: F.xxhash64(F.lit(length), F.array_join(F.slice(words_, at, F.lit(length)), " "))
    )
    return F.when(F.size(words_) >= length, hashed).otherwise(F.array().cast("array<bigint>"))


def benchmark_windows(benchmark: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """Distinct windows of the items: hash, n (words), passage, items (their ids as strings)."""
    table = benchmark.select(F.col("item_id").cast("string"), words(F.col("text")).alias("words"))
    table = _winnowed(table.where(F.size("words") > 0), window, gram)
    size = F.size("words")
    long = F.transform(
        F.col("least"),
        lambda least, at: F.struct(
            least.alias("hash"), F.lit(window).alias("n"),
            F.array_join(F.slice("words", at + 1, F.lit(window)), " ").alias("passage"),
        ),
    )
    passage = F.array_join("words", " ")
    short = F.array(F.struct(F.xxhash64(size, passage).alias("hash"), size.alias("n"), passage.alias("passage")))
    table = table.select("item_id", F.explode(F.when(size < window, short).otherwise(long)).alias("w"))
    return table.groupBy("w.hash", "w.n", "w.passage").agg(F.collect_set("item_id").alias("items"))


def _keyed(docs: DataFrame) -> DataFrame:
    """doc_id and text with a key that differs where one of them does."""
    docs = docs.select(F.col("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return docs.withColumn("key", _key())


def _key() -> Column:
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return F.sha2(F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("-")), text), 256)


def _shared_runs(n: int, hashes: Column) -> Column:
    """Runs of n words whose hashes are in ``shared``: where they start, n, and the words."""
    placed = F.transform(hashes, lambda one, at: F.struct(one.alias("hash"), at.alias("at")))
    return F.transform(
        F.filter(placed, lambda one: F.array_contains("shared", one["hash"])),
        lambda one: F.struct(
            one["at"].alias("at"), F.lit(n).alias("n"),
            F.array_join(F.slice("words", one["at"] + 1, F.lit(n)), " ").alias("passage"),
        ),
    )


def _judged(docs: DataFrame, benchmark: DataFrame, window: int, gram: int) -> DataFrame:
    """A row for each distinct key, with the number of rows that have it as ``copies``."""
    windows = stored(benchmark_windows(benchmark, window, gram), "windows")
    # at most ``window`` - 1 rows
    short = sorted(row["n"] for row in windows.where(F.col("n") < window).select("n").distinct().collect())
    hashes = windows.select("hash").distinct().withColumn("known", F.lit(True))
    if is_small(windows):
        windows, hashes = F.broadcast(windows), F.broadcast(hashes)

    table = _winnowed(_keyed(docs).withColumn("words", words(F.col("text"))), window, gram)
    every = F.array_distinct(F.concat("least", *(_whole(F.col("words"), n) for n in short)))
    table = table.select("key", "doc_id", F.size("words").alias("n_words"), F.posexplode_outer(every).alias("at", "hash"))
    table = table.join(hashes, "hash", "left")
    marker = F.coalesce(F.col("at"), F.lit(0)) == 0
    found = table.where(F.col("known") | marker).groupBy("key").agg(
        F.first("doc_id").alias("doc_id"),
        F.max("n_words").cast("long").alias("n_words"),
        F.sum(marker.cast("long")).alias("copies"),
        F.collect_set(F.when(F.col("known"), F.col("hash"))).alias("shared"),
    )
    found = stored(found, "winnowed")

    suspects = stored(found.where(F.size("shared") > 0).select("key", "shared"), "suspects")
    table = _keyed(docs).join(broadcast_if_small(suspects), "key")
    table = _winnowed(table.withColumn("words", words(F.col("text"))), window, gram)
    runs = [_shared_runs(window, F.col("least")), *(_shared_runs(n, _whole(F.col("words"), n)) for n in short)]
    runs = table.select("key", F.explode(F.concat(*runs)).alias("run")).select("key", "run.*")
    hits = runs.join(windows.drop("hash"), ["n", "passage"]).groupBy("key").agg(
        F.collect_set(F.struct("at", "n")).alias("runs"),
        F.sort_array(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"),
    )
    covered = F.flatten(F.transform("runs", lambda run: F.sequence(run["at"], run["at"] + run["n"] - 1)))
    hits = hits.select("key", F.size(F.array_distinct(covered)).cast("long").alias("n_hit"), "items")
    items = F.coalesce("items", F.array().cast("array<string>"))
    n_hit = F.coalesce("n_hit", F.lit(0).cast("long"))
    return found.drop("shared").join(hits, "key", "left").select(
        "key", "doc_id", "n_words", n_hit.alias("n_hit"), items.alias("items"), "copies",
        ((n_hit > 0) & (20 * n_hit >= F.col("n_words"))).alias("contaminated"),
    )


def contamination(
    docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, gram: int = GRAM
) -> DataFrame:
    """How much of each document lies in windows of benchmark items.

    ``docs`` has doc_id and text, ``benchmark`` item_id and text; other columns are not read.
    Returns per row of ``docs``: doc_id, n_words, n_hit (words inside occurring windows), n_items,
    items (ids as sorted strings), items_sha256 (of the ids joined by commas), contaminated (at
    least a twentieth of the words are hit). Null and empty texts have no words and are never
    hit; items without words never occur; windows of items without item_id hit but are not listed.
    Repeated rows are judged once and returned as often as they are there.
    """
    judged = _judged(docs, benchmark, window, gram)
    return judged.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), "items",
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated",
        F.explode(F.sequence(F.lit(1).cast("long"), "copies")).alias("copy"),
    ).drop("copy")


def decontaminate(
    docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, gram: int = GRAM
) -> DataFrame:
    """``docs`` with all their columns, without the rows that ``contamination`` finds contaminated."""
    (name,) = free_names(docs, "key")
    bad = _judged(docs, benchmark, window, gram).where("contaminated").select(F.col("key").alias(name))
    bad = broadcast_if_small(stored(bad, "contaminated"))
    return docs.join(bad, _key() == F.col(name), "left_anti")
