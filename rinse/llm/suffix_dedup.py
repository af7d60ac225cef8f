"""Removal of byte strings that occur more than once, by suffix arrays.

The question for every string of ``length`` bytes is whether it starts anywhere else.

1. Anchors. Of the hashes of all runs of ``GRAM`` bytes in a string the smallest is its anchor; equal
   strings have equal anchors at equal places, the leftmost of equal hashes. A string is repeated only if its anchor is.
2. Contexts. All strings of an anchor lie in its context, from the first byte of the first to the
   last of the last: neighbours with smaller hashes have the others. Where a context occurs twice, all its strings do; these are removed without looking
   further, so copies cost nothing. Of each context one occurrence goes on, if its anchor occurs
   in other contexts too.
3. Suffix arrays. These contexts are dealt over shards by anchor. In each, the suffix array, sorted
   by as many bytes as a string has, says which strings two contexts share.
4. Merging. Anchors with many contexts are dealt over several shards. Each sends the sorted
   digests of its distinct strings, cut into ranges, and the ranges of all shards are merged by
   binary search; strings in two shards are repeated.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from rinse.llm.memory import giving_back
from rinse.llm.names import free_names
from rinse.llm.sizes import broadcast_if_small
from rinse.llm.suffix_arrays import Suffixes
from rinse.llm.tokens import pieces_of
from rinse.operators.lookup import hot_keys
from rinse.session import stored

LENGTH = 400
GRAM = 128
CONTEXTS_PER_SHARD = 256
CONTEXTS_PER_ANCHOR = 1024  # in one shard
STRINGS_PER_RANGE = 1 << 20
HOT_ROWS = 1 << 17  # of an anchor, whose rows then don't meet in one task
SMALL = 1 << 18  # bytes of a table that is broadcast
_CHUNK = 1 << 17  # bytes of text hashed at once, so that the arrays stay in the cache
_MOST = np.uint64(np.iinfo(np.uint64).max)
_BYTES = np.random.default_rng(4).integers(1, 1 << 63, 256, dtype=np.uint64)
_FACTOR = np.uint64(0x9E3779B97F4A7C15)


def _slid(values: np.ndarray, span: int, join) -> np.ndarray:
    """Join every ``span`` neighbours, by doubling the span."""
    have = 1
    while have < span:
        step = min(have, span - have)
        values = join(values[:-step], values[step:])
        have += step
    return values


def _hashed(one: np.ndarray, other: np.ndarray) -> np.ndarray:
    mixed = one * _FACTOR + other
    return mixed ^ (mixed >> np.uint64(29))


def anchors(data: np.ndarray, ends: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, ...]:
    """Anchors in texts that lie one after another and stop at ``ends``: hashes, and starts of their strings.

    The anchor of a string is its run of ``gram`` bytes with the smallest hash, the leftmost of equal ones.
    Returns the place and the hash of each anchor, and where its first and its last string start.
    """
    n = len(data)
    if n < length:
        return np.empty(0, np.int64), np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64)
    hashes = _slid(_BYTES[data], gram, _hashed)
    span, have = length - gram + 1, 1
    least, at = hashes, np.arange(len(hashes), dtype=np.int32 if n < 1 << 31 else np.int64)
    while have < span:
        step = min(have, span - have)
        later = least[step:] < least[:-step]
        least, at = np.where(later, least[step:], least[:-step]), np.where(later, at[step:], at[:-step])
        have += step
    starts = np.arange(len(at))
    text = np.searchsorted(ends, starts, side="right")
    starts = np.flatnonzero(starts + length <= ends[text])
    if not len(starts):
        return np.empty(0, np.int64), np.empty(0, np.uint64), starts, starts
    places = at[starts].astype(np.int64)
    begins = np.flatnonzero(np.diff(places, prepend=-1))
    places = places[begins]
    return places, hashes[places], starts[begins], starts[np.append(begins[1:], len(starts)) - 1]


def _text() -> Column:
    return F.coalesce(F.col("text").cast("string"), F.lit(""))


def _named(docs: DataFrame) -> DataFrame:
    """doc_id, text, and two hashes of the text as its name."""
    table = docs.select(F.col("doc_id").cast("long"), _text().alias("text"))
    return table.withColumn("u1", F.xxhash64("text")).withColumn("u2", F.xxhash64(F.lit(7), "text"))


def _texts(docs: DataFrame, length: int, gram: int) -> DataFrame:
    """Each distinct text with its smallest doc_id, its copies, and its anchors: v, context, place.

    The place of a context is its start in the text times 2 ``length``, and its bytes, which are fewer.
    """

    @giving_back
    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces_of(batch, _CHUNK):
                texts = part.column("text").cast(pa.large_string())
                offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
                data = np.frombuffer(texts.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
                starts, ends = offsets[:-1] - offsets[0], offsets[1:] - offsets[0]
                raw = data.tobytes()
                places, hashes, low, high = anchors(data, ends, length, gram)
                owner = np.searchsorted(ends, places, side="right")
                high = high + length
                own = (low - starts[owner]) * (2 * length) + (high - low)
                contexts = np.fromiter(
                    (
                        xxhash.xxh3_64_intdigest(raw[a:b], left)
                        for a, b, left in zip(low.tolist(), high.tolist(), (places - low).tolist(), strict=True)
                    ),
                    np.uint64, len(places),
                )
                cuts = pa.array(np.searchsorted(owner, np.arange(len(ends) + 1)), pa.int32())
                lists = [
                    pa.ListArray.from_arrays(cuts, pa.array(values))
                    for values in (hashes.view(np.int64), contexts.view(np.int64), own)
                ]
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(name) for name in ("doc_id", "u1", "u2")), *lists],
                    names=["doc_id", "u1", "u2", "v", "context", "place"],
                )

    schema = "doc_id long, u1 long, u2 long, v array<long>, context array<long>, place array<long>"
    found = _named(docs).where(F.octet_length("text") >= length).mapInArrow(find, schema)
    firsts = [F.first(name).alias(name) for name in ("v", "context", "place")]
    return found.groupBy("u1", "u2").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies"), *firsts)


def _counted(found: DataFrame, hot_rows: int) -> DataFrame:
    """Rows of repeated anchors, with their ``contexts``, and ``n`` and the ``first`` tag of their own context.

    All rows of an anchor meet in one task, after one shuffle. Anchors with more than ``hot_rows``
    rows, which a sketch names, are counted by partial sums instead and joined.
    """
    hot = list(hot_keys(found, "v", hot_rows))
    is_hot = F.col("v").isin(hot)
    anchor, context = Window.partitionBy("v"), Window.partitionBy("v", "context")
    cold = found.where(~is_hot) if hot else found
    cold = cold.withColumn("total", F.sum("copies").over(anchor)).where("total > 1")
    cold = cold.withColumn("tag", F.xxhash64("u1", "u2", "place"))
    cold = cold.withColumn("n", F.sum("copies").over(context)).withColumn("first", F.min("tag").over(context))
    cold = cold.withColumn("contexts", F.sum((F.col("tag") == F.col("first")).cast("long")).over(anchor))
    names = ["u1", "u2", "v", "place", "tag", "n", "first", "contexts"]
    cold = cold.select(*names)
    if not hot:
        return cold
    rows = found.where(is_hot).withColumn("tag", F.xxhash64("u1", "u2", "place"))
    counts = rows.groupBy("v", "context").agg(F.sum("copies").alias("n"), F.min("tag").alias("first"))
    counts = stored(counts, "contexts")
    repeated = F.broadcast(counts.groupBy("v").agg(F.count("*").alias("contexts")))
    return cold.union(rows.join(counts.join(repeated, "v"), ["v", "context"]).select(*names))


def _marked(texts: DataFrame, per_shard: int) -> DataFrame:
    """Per text the places whose contexts are repeated, and the contexts to be compared."""
    zipped = F.explode(F.arrays_zip("v", "context", "place")).alias("one")
    found = texts.select("u1", "u2", "copies", zipped).select("u1", "u2", "copies", "one.*")
    found = _counted(found, HOT_ROWS)
    compared = (F.col("contexts") > 1) & (F.col("tag") == F.col("first"))
    found = found.where((F.col("n") > 1) | compared)
    parts = F.ceil(F.col("contexts") / per_shard)
    return found.groupBy("u1", "u2").agg(
        F.collect_list(F.when(F.col("n") > 1, F.col("place"))).alias("repeated"),
        F.collect_list(F.when(compared, F.struct("place", "v", (F.col("n") > 1).alias("known"), parts.alias("parts"))))
        .alias("compared"),
    )


_CONTEXT = "shard long, hot boolean, known boolean, u1 long, u2 long, start long, bytes binary"


def _contexts(docs: DataFrame, wanted: DataFrame, shards: int, length: int) -> DataFrame:
    """The bytes of the contexts to be compared, each with its shard."""

    @giving_back
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text, u1, u2, compared in zip(*(batch.column(name).to_pylist() for name in
                                                ("text", "u1", "u2", "compared")), strict=True):
                data = text.encode("utf-8", "surrogatepass")
                for one in compared:
                    start, size = divmod(one["place"], 2 * length)
                    deal = hash((u1, one["place"])) % one["parts"]
                    rows.append({
                        "shard": hash((one["v"], deal)) % shards, "hot": one["parts"] > 1, "known": one["known"],
                        "u1": u1, "u2": u2, "start": start, "bytes": data[start : start + size],
                    })
                    if len(rows) == 4096:
                        yield pa.RecordBatch.from_pylist(rows, schema=_CONTEXTS)
                        rows = []
            if rows:
                yield pa.RecordBatch.from_pylist(rows, schema=_CONTEXTS)

    small = broadcast_if_small(wanted, SMALL).alias("w")
    texts = _named(docs).where(F.octet_length("text") >= length).alias("d")
    same = (F.col("d.u1") == F.col("w.u1")) & (F.col("d.u2") == F.col("w.u2"))
    texts = texts.join(small, same & F.col("d.doc_id").eqNullSafe(F.col("w.doc_id")))
    return texts.select("d.text", "d.u1", "d.u2", "w.compared").mapInArrow(cut, _CONTEXT)


_CONTEXTS = pa.schema([
    ("shard", pa.int64()), ("hot", pa.bool_()), ("known", pa.bool_()), ("u1", pa.int64()), ("u2", pa.int64()),
    ("start", pa.int64()), ("bytes", pa.binary()),
])
# a found span, or for a range the strings of hot anchors that other shards may have
_LISTS = ("digests", "checks", "firsts", "seconds", "starts", "states")
_FOUND = "u1 long, u2 long, start long, stop long, range long, " + ", ".join(f"{name} array<long>" for name in _LISTS)
_FOUND_ARROW = pa.schema([
    *((name, pa.int64()) for name in ("u1", "u2", "start", "stop", "range")),
    *((name, pa.list_(pa.int64())) for name in _LISTS),
])
_WANTED, _KNOWN, _TWICE = 0, 1, 2  # states of a string: to be found out, of a repeated context, repeated
_CHECKS = np.random.default_rng(5).integers(1, 1 << 63, 256, dtype=np.uint64)


def _identity(u1: np.ndarray, u2: np.ndarray, start: np.ndarray) -> np.ndarray:
    """A number for the place in its text where a string starts."""
    return (u1 ^ (u2 * np.int64(31))) + start * np.int64(0x9E3779B97F4A7C15 - (1 << 64))


def _each_run(begins: np.ndarray, values: np.ndarray, pick) -> np.ndarray:
    """For each element what ``pick`` gives for its run."""
    at = np.flatnonzero(begins)
    return np.repeat(pick.reduceat(values, at), np.diff(np.append(at, len(values))))


def _comparing(length: int, ranges: int):
    """The function that compares the contexts of a shard."""

    def compare(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        hot, known, u1, u2, begin = (table[name].to_numpy() for name in ("hot", "known", "u1", "u2", "start"))
        contexts = table["bytes"].to_pylist()
        lengths = np.fromiter(map(len, contexts), np.int64, len(contexts))
        data = np.frombuffer(b"".join(contexts), np.uint8)
        suffixes = Suffixes(data, lengths, length)
        owner = np.searchsorted(suffixes.starts, suffixes.order, side="right") - 1
        place = suffixes.order - suffixes.starts[owner]
        whole = place + length <= lengths[owner]
        # equal strings are neighbours in the suffix array; a shorter suffix equals no other
        begins = suffixes.first
        owner, place, begins = owner[whole], place[whole], begins[whole]
        start = begin[owner] + place
        identity = _identity(u1[owner], u2[owner], start)
        twice = _each_run(begins, identity, np.minimum) != _each_run(begins, identity, np.maximum)

        low = np.full(len(contexts), np.iinfo(np.int64).max)
        high = np.full(len(contexts), -1)
        new = twice & ~known[owner]
        np.minimum.at(low, owner[new], start[new])
        np.maximum.at(high, owner[new], start[new])
        found = np.flatnonzero(high >= 0)
        rows = [
            pa.RecordBatch.from_arrays(
                [pa.array(u1[found]), pa.array(u2[found]), pa.array(low[found]), pa.array(high[found] + length),
                 pa.nulls(len(found), pa.int64()), *(pa.nulls(len(found), pa.list_(pa.int64())) for _ in _LISTS)],
                schema=_FOUND_ARROW,
            )
        ]
        # of a repeated run one is enough, but one of a hot anchor: only that anchor's shards may hold others
        sent = np.flatnonzero(hot[owner])
        run = np.cumsum(begins)[sent]
        sent = sent[(np.diff(run, prepend=0) > 0) | ~twice[sent]]
        if len(sent):
            rows.append(_sent(data, lengths, owner[sent], place[sent], u1, u2, start[sent],
                              np.where(twice[sent], _TWICE, np.where(known[owner[sent]], _KNOWN, _WANTED)), length, ranges))
        return pa.Table.from_batches(rows)

    return compare


def _sent(data, lengths, owner, place, u1, u2, start, state, length, ranges) -> pa.RecordBatch:
    """The strings of a shard by the range of their digests, each range in order."""
    at = np.cumsum(lengths)[owner] - lengths[owner] + place
    digests = _slid(_BYTES[data], length, _hashed)[at]
    checks = _slid(_CHECKS[data], length, _hashed)[at]
    turn = np.argsort(digests)
    digests = digests[turn]
    borders = np.array([-(-(part << 64) // ranges) for part in range(1, ranges)], np.uint64)
    cuts = np.concatenate([[0], np.searchsorted(digests, borders), [len(digests)]])
    full = np.flatnonzero(np.diff(cuts))
    offsets = pa.array(np.append(cuts[full], len(digests)), pa.int32())
    values = (digests.view(np.int64), checks[turn].view(np.int64), u1[owner][turn], u2[owner][turn], start[turn],
              state[turn].astype(np.int64))
    lists = [pa.ListArray.from_arrays(offsets, pa.array(one)) for one in values]
    nothing = pa.nulls(len(full), pa.int64())
    return pa.RecordBatch.from_arrays([*[nothing] * 4, pa.array(full), *lists], schema=_FOUND_ARROW)


def _merging(length: int):
    """The function that merges one range of digests of all shards."""

    def merge(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        digests, checks, u1, u2, start, state = (pc.list_flatten(table[name]).to_numpy() for name in _LISTS)
        shard_ends = np.cumsum(pc.list_value_length(table["digests"]).to_numpy())
        merged = np.sort(digests)
        identity = _identity(u1, u2, start)
        low, high = np.full(len(merged), np.iinfo(np.int64).max), np.full(len(merged), np.iinfo(np.int64).min)
        low_check, high_check, twice = low.copy(), high.copy(), np.zeros(len(merged), bool)
        slots = np.empty(len(merged), np.int64)
        for first, last in zip([0, *shard_ends[:-1]], shard_ends, strict=True):
            own = slice(first, last)
            slots[own] = slot = np.searchsorted(merged, digests[own])
            np.minimum.at(low, slot, identity[own])
            np.maximum.at(high, slot, identity[own])
            np.minimum.at(low_check, slot, checks[own])
            np.maximum.at(high_check, slot, checks[own])
            np.logical_or.at(twice, slot, state[own] == _TWICE)
        repeated = (low_check == high_check) & (twice | (low != high))
        found = (state == _WANTED) & repeated[slots]
        columns = [u1[found], u2[found], start[found], start[found] + length]
        return pa.table([pa.array(one) for one in columns], names=["u1", "u2", "start", "stop"])

    return merge


def repeated_spans(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """Per distinct text (u1, u2) the spans of bytes that repeated strings cover; spans may overlap."""
    texts = stored(_texts(docs, length, gram), "anchors")
    marked = stored(_marked(texts, CONTEXTS_PER_ANCHOR), "marked")
    wanted = marked.where(F.size("compared") > 0).join(texts.select("u1", "u2", "doc_id"), ["u1", "u2"])
    wanted = stored(wanted.select("u1", "u2", "doc_id", "compared"), "wanted")
    hot = F.size(F.filter("compared", lambda one: one["parts"] > 1))
    many = wanted.agg(F.sum(F.size("compared")).alias("all"), F.sum(hot).alias("hot")).first()
    start = F.floor(F.col("place") / (2 * length))
    known = marked.select("u1", "u2", F.explode("repeated").alias("place")).select(
        "u1", "u2", start.alias("start"), (start + F.col("place") % (2 * length)).alias("stop")
    )
    spans = known
    if many["all"]:
        shards = -(-many["all"] // CONTEXTS_PER_SHARD)
        ranges = -(-many["hot"] * (length - gram + 1) // STRINGS_PER_RANGE) or 1
        contexts = _contexts(docs, wanted, shards, length)
        compared = contexts.groupBy("shard").applyInArrow(_comparing(length, ranges), _FOUND)
        compared = stored(compared, "compared")
        spans = spans.union(compared.where("range is null").select("u1", "u2", "start", "stop"))
        if many["hot"]:
            sent = compared.where("range is not null").select("range", *_LISTS)
            merged = sent.groupBy("range").applyInArrow(_merging(length), "u1 long, u2 long, start long, stop long")
            spans = spans.union(merged)
    return spans.groupBy("u1", "u2").agg(F.collect_list(F.struct("start", "stop")).alias("spans"))


def _decoded(parts: list[bytes]) -> str:
    """What is left of a text, each part read by itself: halves of two characters make no third one."""
    return "".join([part.decode("utf-8", "ignore") for part in parts])


def remove_repeats(
    docs: DataFrame, length: int = LENGTH, gram: int = GRAM, with_bytes: bool = False, with_text: bool = False
) -> DataFrame:
    """Remove every byte that lies in a string of ``length`` bytes which starts anywhere else too.

    ``docs`` has doc_id and text, read as UTF-8 (null counts as empty); other columns are not read.
    Strings do not reach over the end of a text, and all are judged on the input. Returns per row
    doc_id, n_bytes, n_removed, n_spans (runs of removed bytes), kept_sha256 (of the bytes that
    stay) and, if asked for, kept, those bytes, and text, which they spell without characters of
    which only a part stays. Texts shorter than ``length`` stay as they are; of texts that occur
    twice nothing stays. Rows may repeat a doc_id or have none.
    """
    spans = stored(repeated_spans(docs, length, gram), "spans")

    @giving_back
    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text, found in zip(batch.column("text").to_pylist(), batch.column("spans").to_pylist(), strict=True):
                data, parts, at, runs = text.encode("utf-8", "surrogatepass"), [], 0, 0
                for span in sorted((one["start"], one["stop"]) for one in found or ()):
                    start, stop = span[0], min(span[1], len(data))
                    if start > at or not runs:
                        parts.append(data[at:start])
                        runs += 1
                    at = max(at, stop)
                parts.append(data[at:])
                kept = b"".join(parts)
                row = [len(data), len(data) - len(kept), runs, hashlib.sha256(kept).hexdigest()]
                if with_bytes:
                    row.append(kept)
                if with_text:
                    row.append(_decoded(parts) if runs else text)
                rows.append(row)
            arrays = [pa.array(one, kind) for one, kind in zip(zip(*rows, strict=True), kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *arrays], names=["doc_id", *names])

    names = [name for name in _RESULT if {"kept": with_bytes, "text": with_text}.get(name, True)]
    kinds = [_RESULT[name] for name in names]
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
    schema += ", kept binary" * with_bytes + ", text string" * with_text
    texts = _named(docs).join(broadcast_if_small(spans, SMALL), ["u1", "u2"], "left")
    return texts.select("doc_id", "text", "spans").mapInArrow(remove, schema)


_RESULT = {
    "n_bytes": pa.int64(), "n_removed": pa.int64(), "n_spans": pa.int64(), "kept_sha256": pa.string(),
    "kept": pa.binary(), "text": pa.string(),
}


def without_repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """``docs`` with all their columns; ``text`` has only the bytes that ``remove_repeats`` leaves.

    Characters of which only a part is left go too. Texts without repeats, nulls included, stay.
    """
    spans = stored(repeated_spans(docs, length, gram), "spans")
    u1, u2, found = free_names(docs, "u1", "u2", "spans")
    text = _text()
    named = docs.withColumns({u1: F.xxhash64(text), u2: F.xxhash64(F.lit(7), text)})
    spans = spans.select(F.col("u1").alias(u1), F.col("u2").alias(u2), F.col("spans").alias(found))
    joined = named.join(broadcast_if_small(spans, SMALL), [u1, u2], "left")
    # only texts with spans go to Python
    cut = F.when(F.col(found).isNotNull(), _cut(F.struct(F.when(F.col(found).isNotNull(), F.col("text")).alias("text"), F.col(found).alias("spans"))))
    cut = F.coalesce(cut, F.col("text").cast("string"))
    kept = (cut.alias(name) if name == "text" else F.col(f"`{name}`") for name in docs.columns)
    return joined.select(*kept)


@F.arrow_udf(StringType())
@giving_back
def _cut(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """Texts without their spans of bytes; characters of which only a part is left go too."""
    for rows in batches:
        texts = []
        for text, spans in zip(rows.field("text").to_pylist(), rows.field("spans").to_pylist(), strict=True):
            if text is not None and spans:
                data, parts, at = text.encode("utf-8", "surrogatepass"), [], 0
                for start, stop in sorted((one["start"], one["stop"]) for one in spans):
                    parts.append(data[at : max(at, start)])
                    at = max(at, stop)
                text = _decoded([*parts, data[at:]])
            texts.append(text)
        yield pa.array(texts, pa.string())
