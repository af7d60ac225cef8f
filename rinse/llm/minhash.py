"""Near-duplicates by MinHash signatures and a multi-index Hamming join.

A signature has ``CHUNKS`` chunks of ``CHUNK`` symbols of 16 bits. Two signatures that differ in
fewer than ``2 * CHUNKS`` symbols have a chunk with at most one error (pigeonhole), so they agree in
one of the keys that leave out one symbol of a chunk: all such pairs meet under a key. At a
similarity of 0.8 a pair that differs in more symbols still has such a chunk but for about one in
three million.

Pairs that meet are filtered by parities: each set has a bitmap of 4 to 8 bits a shingle, up to
``LARGEST`` bits, and each shingle flips one of them. Two bitmaps differ in no more bits than their
sets differ in shingles, so the filter loses no link. What passes is confirmed on the full sets.

Not all pairs under a key are formed. First one pivot under each key is compared with the others.
Most keys are done then, because all their members are connected. Under the others, the largest
component is the main one, and each member outside of it (asking) is compared with all members of
other components, ``MEMBERS`` by ``MEMBERS`` in a task: first linked to the ``NEAREST`` ones, which
connects most, then to all that pass the filter. Two members of different components are never both
in the main one, so no link between components is lost. Texts with equal sets are one node from
the start.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rinse.llm.components import connected_components
from rinse.llm.memory import giving_back
from rinse.llm.sizes import broadcast_if_small
from rinse.llm.tokens import pieces_of
from rinse.session import stored

WORDS = 5
SIMILARITY = 0.8
CHUNKS, CHUNK = 14, 6
SYMBOLS = CHUNKS * CHUNK
MEMBERS = 1024
NEAREST = 2
SMALLEST, LARGEST = 512, 8192  # bits of a bitmap of parities
_ONE, _TWO = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
_RANDOM = np.random.default_rng(20)
_FACTORS = _RANDOM.integers(0, 1 << 63, SYMBOLS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_MASKS = _RANDOM.integers(0, 1 << 63, SYMBOLS, dtype=np.uint64)
_PLACES = _RANDOM.integers(0, 1 << 63, (CHUNKS, CHUNK), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SALTS = _RANDOM.integers(0, 1 << 63, (CHUNKS, CHUNK), dtype=np.uint64)


def _mixed(values: np.ndarray) -> np.ndarray:
    values = (values ^ (values >> np.uint64(33))) * _TWO
    return values ^ (values >> np.uint64(29))


class Shingles:
    """Sets of hashed shingles; words are hashed once while they are remembered."""

    def __init__(self, words: int, memory: int = 300_000) -> None:
        self._words, self._memory = words, memory
        self._known: dict[str, int] = {}

    def _hashes(self, words: list[str]) -> np.ndarray:
        if len(self._known) > self._memory:
            self._known.clear()
        known = self._known
        for word in words:
            if word not in known:
                known[word] = xxhash.xxh64_intdigest(word.encode("utf-8", "surrogatepass"))
        return np.fromiter((known[word] for word in words), np.uint64, len(words))

    def sets(self, texts: pa.Array) -> Iterator[np.ndarray]:
        """The sorted distinct shingles of each text; a text with fewer words is one shingle."""
        lowered = pc.ascii_lower(pc.fill_null(texts.cast(pa.large_string()), ""))
        split = pc.ascii_split_whitespace(lowered)
        flat = split.flatten()
        real = pc.greater(pc.binary_length(flat), 0).to_numpy(zero_copy_only=False)
        sizes = pc.list_value_length(split).to_numpy(zero_copy_only=False).astype(np.int64)
        before = np.concatenate([[0], np.cumsum(real)])
        ends = before[np.concatenate([[0], np.cumsum(sizes)])]
        coded = flat.filter(pa.array(real)).dictionary_encode()
        hashes = self._hashes(coded.dictionary.to_pylist())[coded.indices.to_numpy(zero_copy_only=False)]
        many = max(0, len(hashes) - self._words + 1)
        shingles = hashes[:many]
        for step in range(1, self._words):
            shingles = (shingles ^ (shingles >> np.uint64(31))) * _ONE + hashes[step : step + many]
        shingles = _mixed(shingles)
        for start, stop in zip(ends[:-1], ends[1:], strict=True):
            if stop - start >= self._words:
                yield np.unique(shingles[start : stop - self._words + 1])
            elif stop > start:
                whole = np.array([stop - start], np.uint64)
                for one in hashes[start:stop]:
                    whole = (whole ^ (whole >> np.uint64(31))) * _ONE + one
                yield _mixed(whole)
            else:
                yield hashes[:0]


def signature(shingles: np.ndarray) -> np.ndarray:
    """Symbols of 16 bits, each from the smallest of the shingles' hashes under one function."""
    least = np.full(SYMBOLS, np.iinfo(np.uint64).max, np.uint64)
    for start in range(0, len(shingles), 2048):
        hashed = (shingles[start : start + 2048, None] ^ _MASKS) * _FACTORS
        np.minimum(least, hashed.min(axis=0), out=least)
    return (_mixed(least) >> np.uint64(48)).astype("<u2")


def parities(shingles: np.ndarray) -> bytes:
    """A bitmap in which each shingle flips one bit; its size is a power of two."""
    bits = min(LARGEST, max(SMALLEST, 1 << (4 * len(shingles) - 1).bit_length())) if len(shingles) else SMALLEST
    flips = np.bincount((shingles & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(flips.astype(np.uint8), bitorder="little").tobytes()


def _bitmaps(column: pa.Array) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each size of bitmap in the column: the rows that have it, and a matrix of their words."""
    words = pc.binary_length(column).to_numpy(zero_copy_only=False) // 8
    found = []
    for size in np.unique(words):
        rows = np.flatnonzero(words == size)
        raw = b"".join(column.take(pa.array(rows)).to_pylist())
        found.append((rows, np.frombuffer(raw, "<u8").reshape(len(rows), size)))
    return found


def _folded(bitmaps: np.ndarray, words: int) -> np.ndarray:
    """The bitmaps the same sets would have with fewer words."""
    if bitmaps.shape[1] == words:
        return bitmaps
    return np.bitwise_xor.reduce(bitmaps.reshape(len(bitmaps), -1, words), axis=1)


def keys(signatures: np.ndarray) -> np.ndarray:
    """For each signature the keys of its chunks with one symbol left out."""
    parts = signatures.reshape(-1, CHUNKS, CHUNK).astype(np.uint64) * _PLACES
    return _mixed(parts.sum(axis=2, keepdims=True) - parts + _SALTS).reshape(-1, SYMBOLS)


def _text() -> Column:
    return F.coalesce(F.col("text").cast("string"), F.lit(""))


def _sketches(docs: DataFrame, words: int) -> DataFrame:
    """doc_id, hash (of the text), n (distinct shingles), content (hash of the set), signature, parities."""

    @giving_back
    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles = Shingles(words)
        for batch in batches:
            for part in pieces_of(batch):
                coded = part.column("text").dictionary_encode()
                sizes, contents, signatures, bitmaps = [], [], [], []
                for one in shingles.sets(coded.dictionary):
                    sizes.append(len(one))
                    contents.append(xxhash.xxh3_128_digest(one.tobytes()))
                    signatures.append(signature(one).tobytes())
                    bitmaps.append(parities(one))
                columns = [pa.array(sizes, pa.int64()), *(pa.array(one, pa.binary()) for one in (contents, signatures, bitmaps))]
                columns = [part.column("doc_id"), part.column("hash"), *(one.take(coded.indices) for one in columns)]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "hash", "n", "content", "signature", "parities"])

    docs = docs.select(F.col("doc_id").cast("long"), F.xxhash64(_text()).alias("hash"), _text().alias("text"))
    return docs.mapInArrow(sketch, "doc_id long, hash long, n long, content binary, signature binary, parities binary")


def _under_keys(nodes: DataFrame) -> DataFrame:
    """A row (key, node) for each key of each node."""

    @giving_back
    def explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 1024):
                part = batch.slice(start, 1024)
                raw = np.frombuffer(b"".join(part.column("signature").to_pylist()), "<u2")
                found = keys(raw).view(np.int64).ravel()
                owners = np.repeat(part.column("node").to_numpy(), SYMBOLS)
                yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(owners)], names=["key", "node"])

    return nodes.select("node", "signature").mapInArrow(explode, "key long, node long")


def _possible(apart: np.ndarray, one: np.ndarray, other: np.ndarray, share: Fraction) -> np.ndarray:
    """Whether sets of these sizes that differ in at least ``apart`` shingles can be similar."""
    every, apart = one + other, np.maximum(apart, abs(one - other))
    return apart * (share.denominator + share.numerator) <= every * (share.denominator - share.numerator)


def _alike(pairs: DataFrame, nodes: DataFrame, share: Fraction) -> DataFrame:
    """The pairs (a, b) that the bitmaps do not rule out."""

    @giving_back
    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.zeros(batch.num_rows, bool)
            sizes = [batch.column(name).to_numpy() for name in ("a_n", "b_n")]
            for rows, ones in _bitmaps(batch.column("a_parities")):
                for part, others in _bitmaps(batch.column("b_parities").take(pa.array(rows))):
                    words, at = min(ones.shape[1], others.shape[1]), rows[part]
                    apart = np.bitwise_count(_folded(ones[part], words) ^ _folded(others, words)).sum(axis=1, dtype=np.int64)
                    found[at] = _possible(apart, sizes[0][at], sizes[1][at], share)
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], names=["a", "b"]).filter(pa.array(found))

    for name in ("a", "b"):
        own = nodes.select(F.col("node").alias(name), F.col("n").alias(f"{name}_n"), F.col("parities").alias(f"{name}_parities"))
        pairs = pairs.join(own, name)
    return pairs.select("a", "b", "a_n", "b_n", "a_parities", "b_parities").mapInArrow(near, "a long, b long")


def _confirmed(pairs: DataFrame, nodes: DataFrame, docs: DataFrame, words: int, share: Fraction) -> DataFrame:
    """Pairs (a, b) whose full sets of shingles are similar."""

    @giving_back
    def confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles = Shingles(words)
        for batch in batches:
            coded = [batch.column(name).dictionary_encode() for name in ("one", "other")]
            left, right = (list(shingles.sets(one.dictionary)) for one in coded)
            linked = []
            for i, j in zip(coded[0].indices.to_pylist(), coded[1].indices.to_pylist(), strict=True):
                both = len(np.intersect1d(left[i], right[j], assume_unique=True))
                every = len(left[i]) + len(right[j]) - both
                linked.append(share.denominator * both >= share.numerator * every)
            found = pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], names=["a", "b"])
            yield found.filter(pa.array(linked, pa.bool_()))

    involved = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
    involved = stored(involved.join(nodes.select("node", "doc_id", "hash"), "node"), "involved")
    texts = docs.select(F.col("doc_id").cast("long"), F.xxhash64(_text()).alias("hash"), _text().alias("text")).alias("d")
    small = broadcast_if_small(involved).alias("i")
    same = F.col("d.doc_id").eqNullSafe(F.col("i.doc_id")) & (F.col("d.hash") == F.col("i.hash"))
    texts = stored(texts.join(small, same).select("i.node", "d.text"), "texts")
    pairs = pairs.join(texts.select(F.col("node").alias("b"), F.col("text").alias("other")), "b")
    pairs = pairs.join(texts.select(F.col("node").alias("a"), F.col("text").alias("one")), "a")
    return pairs.select("a", "b", "one", "other").mapInArrow(confirm, "a long, b long")


def _across(named: DataFrame, nodes: DataFrame, share: Fraction, nearest: int | None) -> DataFrame:
    """Pairs (a, b) under one key, of different roots, that the bitmaps do not rule out.

    ``named`` has key, node, root, main (a root of the key), blocks and askers: into how many parts
    all members and those outside of the main root are dealt. Each part of the askers meets each
    part of the members in one task; of each asker the ``nearest`` or all pairs leave it.
    """

    @giving_back
    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            held.append(batch)
            table = pa.Table.from_batches(held).combine_chunks()
            cuts = ends(table)[:-1]  # the last group may go on
            if cuts:
                yield from pairs(table.slice(0, cuts[-1]), cuts)
                table = table.slice(cuts[-1])
            held = table.to_batches()
        if held:
            table = pa.Table.from_batches(held).combine_chunks()
            yield from pairs(table, ends(table))

    def ends(table: pa.Table) -> list[int]:
        new = np.zeros(max(0, table.num_rows - 1), bool)
        for name in ("key", "asked", "block"):
            new |= np.diff(table[name].to_numpy()) != 0
        return [*(np.flatnonzero(new) + 1).tolist(), table.num_rows]

    def pairs(table: pa.Table, cuts: list[int]) -> Iterator[pa.RecordBatch]:
        node, root, n, asks = (table[name].to_numpy() for name in ("node", "root", "n", "asks"))
        bitmaps, found = table["parities"].combine_chunks(), []
        for start, stop in zip([0, *cuts], cuts, strict=False):
            asking, asked = (start + np.flatnonzero(asks[start:stop] == one) for one in (True, False))
            if not len(asking) or not len(asked):
                continue
            theirs = _bitmaps(bitmaps.take(pa.array(asked)))
            for rows, ones in _bitmaps(bitmaps.take(pa.array(asking))):
                for part, others in theirs:
                    i, j = met(node, root, n, asking[rows], asked[part], ones, others)
                    found.append(np.column_stack([node[i], node[j]]))
        if found:
            both = np.unique(np.sort(np.concatenate(found), axis=1), axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(both[:, 0]), pa.array(both[:, 1])], names=["a", "b"])

    def met(node, root, n, asking, asked, ones, others) -> tuple[np.ndarray, np.ndarray]:
        words = min(ones.shape[1], others.shape[1])
        ones, others = _folded(ones, words), _folded(others, words)
        step = max(1, (1 << 21) // (len(asked) * words))
        left, right = [], []
        for start in range(0, len(asking), step):
            rows = asking[start : start + step]
            apart = np.bitwise_count(ones[start : start + step, None] ^ others).sum(axis=2, dtype=np.int64)
            fits = (root[rows][:, None] != root[asked]) & _possible(apart, n[rows][:, None], n[asked], share)
            if nearest is not None and len(asked) > nearest:
                order = np.where(fits, apart / (n[rows][:, None] + n[asked]), 2.0)
                best = np.argpartition(order, nearest, axis=1)[:, :nearest]
                few = np.zeros_like(fits)
                np.put_along_axis(few, best, True, axis=1)
                fits &= few
            i, j = np.nonzero(fits)
            left.append(rows[i])
            right.append(asked[j])
        return np.concatenate(left), np.concatenate(right)

    def part(many: str) -> Column:
        return F.pmod(F.xxhash64("node"), F.col(many))

    def each(many: str) -> Column:
        return F.explode(F.sequence(F.lit(0).cast("long"), F.col(many) - 1))

    askers = named.where("root <> main").withColumn("asks", F.lit(True))
    askers = askers.withColumn("asked", part("askers")).withColumn("block", each("blocks"))
    members = named.withColumn("asks", F.lit(False))
    members = members.withColumn("block", part("blocks")).withColumn("asked", each("askers"))
    rows = members.unionByName(askers).join(nodes.select("node", "n", "parities"), "node")
    rows = rows.select("key", "asked", "block", "asks", "node", "root", "n", "parities")
    rows = rows.repartition("key", "asked", "block").sortWithinPartitions("key", "asked", "block", "node")
    return rows.mapInArrow(compare, "a long, b long")


def _open(members: DataFrame, roots: DataFrame | None) -> DataFrame:
    """Of the keys whose members are not all connected: key, node, root, main, blocks, askers."""
    named = members.withColumn("root", F.col("node"))
    if roots is not None:
        named = members.join(roots, "node", "left").select("key", "node", F.coalesce("root", "node").alias("root"))
    sizes = named.groupBy("key", "root").agg(F.count("*").alias("size"))
    sizes = sizes.groupBy("key").agg(
        F.max(F.struct("size", "root")).alias("main"), F.sum("size").alias("n"), F.count("*").alias("roots")
    )
    sizes = sizes.where("roots > 1 and n > 2").select(
        "key", F.col("main.root").alias("main"), F.ceil(F.col("n") / MEMBERS).alias("blocks"),
        F.ceil((F.col("n") - F.col("main.size")) / MEMBERS).alias("askers"),
    )
    return stored(named.join(broadcast_if_small(stored(sizes, "open")), "key"), "named")


def _joined(
    pairs: DataFrame, roots: DataFrame | None, nodes: DataFrame, docs: DataFrame, words: int, share: Fraction
) -> DataFrame | None:
    """The roots (node, root) after those of ``pairs`` that are links are added."""
    pairs = stored(pairs, "pairs")
    if pairs.isEmpty():
        return roots
    links = stored(_confirmed(pairs, nodes, docs, words, share), "links")
    if links.isEmpty():
        return roots
    return connected_components(links if roots is None else links.union(roots.select("root", "node")))


def _links(nodes: DataFrame, docs: DataFrame, words: int, similarity: float) -> DataFrame | None:
    """The root of each linked node: node, root."""
    share = Fraction(similarity).limit_denominator(1000)
    members = _under_keys(nodes)
    pivots = members.groupBy("key").agg(F.min("node").alias("a"), F.count("*").alias("n")).where("n > 1")
    members = stored(members.join(pivots.drop("n"), "key"), "members")
    pairs = _alike(members.where("a <> node").select("a", F.col("node").alias("b")).distinct(), nodes, share)
    members, roots = members.select("key", "node"), None
    for nearest in (NEAREST, None):
        roots = _joined(pairs, roots, nodes, docs, words, share)
        members = _open(members, roots)
        pairs = _across(members, nodes, share, nearest).distinct()
        members = members.select("key", "node")
    return _joined(pairs, roots, nodes, docs, words, share)


def near_duplicates(docs: DataFrame, words: int = WORDS, similarity: float = SIMILARITY) -> DataFrame:
    """The component of near-duplicates that each document is in.

    ``docs`` has doc_id and text; other columns are not read. Words end at white space, A-Z count as
    lower case; the set of a text has its distinct runs of ``words`` words. Documents are linked
    if intersection / union of their sets is at least ``similarity``. Returns per row doc_id,
    n_shingles, component_id (the smallest doc_id that links lead to, itself included), kept
    (doc_id = component_id) and hash (of the text).

    Texts with fewer words are one shingle. Null texts and texts without words have no shingles
    and are linked with nothing. Rows without doc_id take part; a component of such rows alone has
    no component_id, and they are kept. Rows that repeat a doc_id are linked by their own texts.
    """
    sketches = stored(_sketches(docs, words), "sketches")
    # the row with the smallest doc_id stands for all texts with its set
    of_content = sketches.where("n > 0").groupBy("content").agg(
        F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "hash", "n", "signature", "parities")).alias("first"),
    )
    of_content = of_content.select("content", *(f"first.{name}" for name in ("doc_id", "hash", "n", "signature", "parities")))
    nodes = stored(of_content.withColumn("node", F.monotonically_increasing_id()), "nodes")
    roots = _links(nodes, docs, words, similarity)
    members = nodes.select("content", "node", "doc_id").withColumn("root", F.col("node"))
    if roots is not None:
        members = nodes.select("content", "node", "doc_id").join(roots, "node", "left")
        members = members.withColumn("root", F.coalesce("root", "node"))
    members = stored(members, "components")
    ids = members.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    ids = members.join(ids, "root").select("content", "component_id")
    ids = sketches.join(ids, "content", "left").withColumn("doc_id", F.col("doc_id"))
    component = F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    return ids.select(
        "doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"),
        F.col("doc_id").eqNullSafe(component).alias("kept"), "hash",
    )


def deduplicate(docs: DataFrame, words: int = WORDS, similarity: float = SIMILARITY) -> DataFrame:
    """``docs`` with all their columns, one row of each component: that with the smallest doc_id.

    Of repeated rows of one text under that doc_id the first found stays.
    """
    found = stored(near_duplicates(docs, words, similarity), "near")
    gone = stored(found.where("not kept").select("doc_id", "hash").distinct(), "gone")
    hashed = F.xxhash64(_text())
    same = docs["doc_id"].cast("long").eqNullSafe(gone["doc_id"]) & (hashed == gone["hash"])
    kept = docs.join(broadcast_if_small(gone), same, "left_anti")
    repeated = found.where("kept and n_shingles > 0").groupBy("component_id").count().where("count > 1")
    if repeated.isEmpty():
        return kept
    name = "hash"
    while name in kept.columns:
        name += "_"
    alone = kept.where(~F.coalesce(F.rlike("text", F.lit(r"[^\x20\x09-\x0D]")), F.lit(False)))
    worded = kept.where(F.coalesce(F.rlike("text", F.lit(r"[^\x20\x09-\x0D]")), F.lit(False)))
    return alone.unionByName(worded.withColumn(name, hashed).dropDuplicates(["doc_id", name]).drop(name))
