"""A trie of the beginnings of conversations, rolled up by centroid decomposition.

A node is a distinct sequence of first turns. It is named by its smallest conversation and its
depth, so every conversation's rows (``paths``) say which nodes lie above each of its nodes, and no
list of ancestors is ever built. Beginnings are told by 128 bits: the exclusive or of hashes
of (place, turn) pairs, which can be added up in chunks of a conversation.

Sums over subtrees come from a centroid decomposition. Components of more than ``TASK_NODES`` nodes are
split by joins, all of them at once in each round, and halve each time; smaller ones are
decomposed in tasks that each take many.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rinse.llm.centroids import subtree_sums
from rinse.llm.sizes import broadcast_if_small
from rinse.operators.paging import ROW_NUMBER, number_rows_by
from rinse.session import stored

TASK_NODES = 1 << 14
CHUNK = 1024  # turns of a conversation whose hashes are added up in one group
IDS = 512  # conv_ids joined in one row before they are hashed
FOLD, KEPT = 5, 9  # conversations that continue the first of five; of how many turns they take less


def numbered_turns(conversations: DataFrame) -> DataFrame:
    """Every turn as conv_id, place (from 1, by turn with null first), n_bytes and digest.

    Null role and text count as empty. Turns with one number are ordered by the digest of role
    and text; rows without conv_id are left out. Ranges of rows are numbered, however many turns
    one conversation has.
    """
    role, text = (F.coalesce(F.col(name).cast("string"), F.lit("")) for name in ("role", "text"))
    rows = conversations.where("conv_id is not null").select(
        F.col("conv_id").cast("long"), F.col("turn"), F.octet_length(text).cast("long").alias("n_bytes"),
        F.sha2(F.concat_ws(":", F.length(role).cast("string"), role, text), 256).alias("digest"),
    )
    rows = number_rows_by(rows, ["conv_id", F.asc_nulls_first("turn"), "digest"])
    rows = stored(rows.select("conv_id", ROW_NUMBER, "n_bytes", "digest"), "turns")
    first = rows.groupBy("conv_id").agg(F.min(ROW_NUMBER).alias("first"))
    return rows.join(first, "conv_id").select(
        "conv_id", (F.col(ROW_NUMBER) - F.col("first") + 1).alias("place"), "n_bytes", "digest"
    )


def continued(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Conversations rebuilt so that they share beginnings: their turns, and their lengths.

    ``turns`` as from ``numbered_turns``. Conversation c takes the first h turns of c - c % 5 (h is
    the CRC-32 of its decimal name modulo 9), then its own after the first h. Returns conv_id,
    place, n_bytes, digest of each turn and conv_id, n_turns of each conversation, 0 included.
    """
    conv = F.col("conv_id")
    sizes = stored(turns.groupBy("conv_id").agg(F.max("place").alias("own")), "sizes")
    sizes = sizes.select(
        "conv_id", "own", (conv - conv % FOLD).alias("base"),
        (F.crc32(conv.cast("string").cast("binary")) % KEPT).alias("kept"),
    )
    bases = sizes.select(conv.alias("base"), F.col("own").alias("base_own"))
    taken = F.least("kept", F.coalesce("base_own", F.lit(0))).alias("taken")
    sizes = stored(sizes.join(bases, "base", "left").select("conv_id", "base", "own", "kept", taken), "rebuilt")

    own = turns.join(sizes.select("conv_id", "kept", "taken"), "conv_id").where("place > kept").select(
        "conv_id", (F.col("place") - F.col("kept") + F.col("taken")).alias("place"), "n_bytes", "digest"
    )
    lead = turns.where((conv % FOLD == 0) & (F.col("place") < KEPT)).withColumnRenamed("conv_id", "base")
    lead = lead.join(sizes.select("conv_id", "base", "kept"), "base").where("place <= kept")
    lengths = sizes.select("conv_id", (F.col("taken") + F.greatest(F.col("own") - F.col("kept"), F.lit(0))).alias("n_turns"))
    return own.unionByName(lead.select("conv_id", "place", "n_bytes", "digest")), lengths


def prefixes(turns: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """Each turn as conv_id, depth, n_bytes, the name k1, k2 of the beginning up to it, and p1, p2 without it."""
    rows = turns.select(
        "conv_id", F.col("place").alias("depth"), "n_bytes",
        F.floor((F.col("place") - 1) / chunk).alias("chunk"),
        F.xxhash64("place", "digest").alias("h1"), F.xxhash64("digest", "place", F.lit("second")).alias("h2"),
    )
    inside = Window.partitionBy("conv_id", "chunk").orderBy("depth").rowsBetween(Window.unboundedPreceding, 0)
    names = [F.expr(f"bit_xor(h{n})").over(inside).alias(f"k{n}") for n in (1, 2)]
    rows = stored(rows.select("*", *names), "chunks")
    # where a conversation has several chunks, those before are added
    totals = rows.groupBy("conv_id", "chunk").agg(F.expr("bit_xor(h1)").alias("t1"), F.expr("bit_xor(h2)").alias("t2"))
    several = totals.join(rows.where("chunk > 0").select("conv_id").distinct(), "conv_id", "left_semi")
    before = Window.partitionBy("conv_id").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    several = stored(several.select(
        "conv_id", "chunk", *(F.coalesce(F.expr(f"bit_xor(t{n})").over(before), F.lit(0)).alias(f"b{n}") for n in (1, 2))
    ), "earlier")
    rows = rows.join(broadcast_if_small(several), ["conv_id", "chunk"], "left")
    k = [F.col(f"k{n}").bitwiseXOR(F.coalesce(f"b{n}", F.lit(0))) for n in (1, 2)]
    return rows.select(
        "conv_id", "depth", "n_bytes", k[0].alias("k1"), k[1].alias("k2"),
        k[0].bitwiseXOR(F.col("h1")).alias("p1"), k[1].bitwiseXOR(F.col("h2")).alias("p2"),
    )


def nodes_and_paths(turns: DataFrame, lengths: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The trie's nodes, and which of them each conversation passes.

    Nodes: m (smallest member), depth, parent (the parent's m), n_convs, n_children, n_bytes and
    size (nodes of the subtree). Paths: conv_id, depth, m, parent and whether it ends there.
    """
    rows = stored(prefixes(turns).join(lengths, "conv_id").withColumn("last", F.col("depth") == F.col("n_turns")), "prefixes")
    key = ["depth", "k1", "k2"]
    found = rows.groupBy(*key).agg(
        F.min("conv_id").alias("m"), F.count(F.lit(1)).alias("n_convs"), F.min("n_bytes").alias("n_bytes"),
        F.min("p1").alias("p1"), F.min("p2").alias("p2"),
    )
    zero = F.lit(0).cast("long")
    top = lengths.agg(F.min("conv_id").alias("m"), F.count(F.lit(1)).alias("n_convs")).where("n_convs > 0")
    top = top.select(zero.alias("depth"), zero.alias("k1"), zero.alias("k2"), "m", "n_convs", zero.alias("n_bytes"),
                     F.lit(None).cast("long").alias("p1"), F.lit(None).cast("long").alias("p2"))
    found = stored(found.select(*top.columns).unionByName(top), "nodes")
    children = found.where("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), F.col("p1").alias("k1"), F.col("p2").alias("k2"))
    children = children.agg(F.count(F.lit(1)).alias("n_children"))
    parents = found.select((F.col("depth") + 1).alias("depth"), F.col("k1").alias("p1"), F.col("k2").alias("p2"), F.col("m").alias("parent"))
    found = found.join(children, key, "left").join(parents, ["depth", "p1", "p2"], "left")
    found = stored(found.select(*key, "m", "parent", "n_convs", F.coalesce("n_children", zero).alias("n_children"), "n_bytes"), "named")

    paths = rows.join(found.select(*key, "m", "parent"), key).select("conv_id", "depth", *key[1:], "m", "parent", "last")
    start = lengths.select(
        "conv_id", zero.alias("depth"), zero.alias("k1"), zero.alias("k2"), F.lit(_root(found)).cast("long").alias("m"),
        F.lit(None).cast("long").alias("parent"), (F.col("n_turns") == 0).alias("last"),
    )
    paths = stored(paths.unionByName(start), "paths")

    # a conversation owns a run of its path, from where no smaller one goes along; of a node's members
    # all but the smallest own nodes below it only
    owned = found.groupBy("m").agg(F.count(F.lit(1)).alias("owned"), F.min("depth").alias("from"))
    sizes = paths.join(owned.select(F.col("m").alias("conv_id"), "owned"), "conv_id")
    sizes = sizes.groupBy("m", "depth").agg(F.sum("owned").alias("reached"))
    found = found.join(sizes, ["m", "depth"]).join(owned.select("m", "from"), "m")
    found = found.withColumn("size", F.col("reached") - (F.col("depth") - F.col("from")))
    return stored(found.drop("k1", "k2", "reached", "from"), "sized"), paths.drop("k1", "k2")


def _root(nodes: DataFrame) -> int | None:
    """The smallest conversation, after which the root is named; nothing without conversations."""
    row = nodes.where("depth = 0").select("m").first()
    return row.m if row else None


_COMPONENT = ["top", "top_depth"]
_SUMS = ["m", "depth", "n_leaves", "saved_tokens"]


def _decomposed(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[pa.RecordBatch]:
    """Sums over subtrees of whole components, which come in runs; at least so many nodes at once."""

    def done(table: pa.Table) -> pa.RecordBatch:
        top, top_depth, m, depth, parent, size, leaf, saved = (
            table.column(name).to_numpy().astype(np.int64)
            for name in (*_COMPONENT, "m", "depth", "parent", "size", "n_leaves", "saved_tokens")
        )
        _, place = np.unique(np.concatenate([m, parent]), return_inverse=True)
        name, above = place[: len(m)] * (depth.max() + 2) + depth, place[len(m) :] * (depth.max() + 2) + depth - 1
        order = np.argsort(name)
        at = order[np.minimum(np.searchsorted(name, above, sorter=order), len(m) - 1)]
        at = np.where((m == top) & (depth == top_depth), -1, at)
        sums = subtree_sums(at, depth, size, np.stack([leaf, saved], axis=1))
        return pa.RecordBatch.from_arrays([pa.array(one) for one in (m, depth, sums[:, 0], sums[:, 1])], names=_SUMS)

    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(one.num_rows for one in held) >= least:
            table = pa.Table.from_batches(held)
            top, top_depth = (table.column(name).to_numpy() for name in _COMPONENT)
            ends = np.flatnonzero((np.diff(top) != 0) | (np.diff(top_depth) != 0))
            if len(ends):  # the last component may go on in the next batch
                cut = int(ends[-1]) + 1
                yield done(table.slice(0, cut))
                held = table.slice(cut).to_batches()
    if held:
        yield done(pa.Table.from_batches(held))


def _split(state: DataFrame, tops: DataFrame, paths: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Split each component that ``tops`` names at its centroid: the components left, and what nodes gain."""
    whole = state.join(tops, _COMPONENT)
    centres = whole.where("2 * size >= total").groupBy(*_COMPONENT)
    centres = centres.agg(F.min_by(F.struct("m", "depth", "size"), "size").alias("c")).select(
        *_COMPONENT, F.col("c.m").alias("cm"), F.col("c.depth").alias("cd"), F.col("c.size").alias("cs")
    )
    centres = broadcast_if_small(stored(centres, "centroids"))

    # on the path of a node's own conversation: the node at the centroid's depth, and the one after it
    passed = paths.select(F.col("conv_id").alias("m"), (F.col("depth") - 1).alias("cd"), F.col("parent").alias("at"), F.col("m").alias("next"))
    marked = whole.join(centres, _COMPONENT)
    is_centre = (F.col("m") == F.col("cm")) & (F.col("depth") == F.col("cd"))
    deep = marked.where("depth > cd").join(passed, ["m", "cd"]).withColumn("below", F.col("at") == F.col("cm")).drop("at")
    flat = marked.where("depth <= cd").withColumn("next", F.lit(None).cast("long")).withColumn("below", is_centre)
    marked = stored(deep.unionByName(flat), "marked")

    sums = [F.sum(name).alias(name) for name in ("n_leaves", "saved_tokens")]
    parts = centres.join(marked.where("below").groupBy(*_COMPONENT).agg(*sums), _COMPONENT)
    parts = broadcast_if_small(stored(parts, "parts"))
    way = paths.select(F.col("conv_id").alias("cm"), "depth", "m").join(parts, "cm").where("depth between top_depth and cd")
    way = stored(way.select("cd", "cs", *_SUMS), "ways")

    less = broadcast_if_small(stored(way.where("depth < cd").select("m", "depth", F.col("cs").alias("less")), "less"))
    names = state.columns
    rest = marked.where("not below").join(less, ["m", "depth"], "left")
    rest = rest.withColumn("size", F.col("size") - F.coalesce("less", F.lit(0)))
    under = marked.where(F.col("below") & ~is_centre).withColumn("top", F.col("next")).withColumn("top_depth", F.col("cd") + 1)
    return stored(rest.select(*names).unionByName(under.select(*names)), "components"), way.select(*_SUMS)


def rolled_up(nodes: DataFrame, paths: DataFrame, task_nodes: int = TASK_NODES) -> DataFrame:
    """For each node n_leaves and saved_tokens, summed over its subtree; both from ``nodes_and_paths``."""
    state = nodes.select(
        F.lit(_root(nodes)).cast("long").alias("top"), F.lit(0).cast("long").alias("top_depth"),
        "m", "depth", F.coalesce("parent", F.lit(-1)).alias("parent"), "size",
        (F.col("n_children") == 0).cast("long").alias("n_leaves"),
        ((F.col("n_convs") - 1) * F.col("n_bytes")).alias("saved_tokens"),
    )
    state = stored(state, "components")
    small, gained = [], []
    while True:
        tops = state.where("m = top and depth = top_depth").where(F.col("size") > task_nodes)
        tops = stored(tops.select(*_COMPONENT, F.col("size").alias("total")), "large")
        if tops.isEmpty():
            break
        tops = broadcast_if_small(tops)
        small.append(state.join(tops, _COMPONENT, "left_anti"))
        state, gains = _split(state, tops, paths)
        gained.append(gains)
    rows = reduce(DataFrame.unionByName, [*small, state])
    rows = rows.repartition(*_COMPONENT).sortWithinPartitions(*_COMPONENT)
    schema = "m long, depth long, n_leaves long, saved_tokens long"
    sums = rows.mapInArrow(lambda batches: _decomposed(batches, task_nodes), schema)
    if not gained:
        return sums  # every node once
    every = reduce(DataFrame.unionByName, [*gained, sums])
    return every.groupBy("m", "depth").agg(F.sum("n_leaves").alias("n_leaves"), F.sum("saved_tokens").alias("saved_tokens"))


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of the texts of each (m, depth), whose rows follow each other, joined by commas."""
    state, current = None, None
    rows: list[tuple[int, int, str]] = []
    for batch in batches:
        for m, depth, text in zip(*(batch.column(name).to_pylist() for name in ("m", "depth", "text")), strict=True):
            if (m, depth) == current:
                state.update(b"," + text.encode())
                continue
            if current:
                rows.append((*current, state.hexdigest()))
            current, state = (m, depth), hashlib.sha256(text.encode())
        yield pa.RecordBatch.from_pylist([dict(zip(_ENDS.names, row, strict=True)) for row in rows], schema=_ENDS)
        rows = []
    if current:
        yield pa.RecordBatch.from_pylist([dict(zip(_ENDS.names, (*current, state.hexdigest()), strict=True))], schema=_ENDS)


_ENDS = pa.schema([("m", pa.int64()), ("depth", pa.int64()), ("ends_sha256", pa.string())])


def ends(paths: DataFrame, ids: int = IDS) -> DataFrame:
    """For each node where conversations end the SHA-256 of their ids, ascending and joined by commas.

    Ids are sorted and joined in groups of ``ids`` consecutive numbers, so no group grows with the
    copies of a conversation; the texts of these groups stream through the hash, which is all that
    has to see them in order.
    """
    block = F.floor(F.col("conv_id") / ids).alias("block")
    joined = F.array_join(F.transform(F.array_sort(F.collect_list("conv_id")), lambda one: one.cast("string")), ",")
    texts = paths.where("last").groupBy("m", "depth", block).agg(joined.alias("text"))
    texts = texts.repartition("m", "depth").sortWithinPartitions("m", "depth", "block")
    return texts.select("m", "depth", "text").mapInArrow(_hashed, "m long, depth long, ends_sha256 string")


def trie(turns: DataFrame, lengths: DataFrame, task_nodes: int = TASK_NODES) -> DataFrame:
    """The nodes of the trie of conversations, with what lies below them.

    ``turns`` (conv_id, place from 1, n_bytes, digest) and ``lengths`` (conv_id, n_turns, also of
    conversations without turns) as from ``continued``. Returns conv_id (the smallest member), depth,
    parent_conv_id, n_convs, n_children, n_leaves, saved_tokens and ends_sha256. Without conversations
    there is no node, not even the root.
    """
    nodes, paths = nodes_and_paths(turns, lengths)
    sums = rolled_up(nodes, paths, task_nodes)
    found = nodes.join(sums, ["m", "depth"]).join(ends(paths), ["m", "depth"], "left")
    nothing = F.lit(hashlib.sha256(b"").hexdigest())
    return found.select(
        F.col("m").alias("conv_id"), "depth", F.col("parent").alias("parent_conv_id"), "n_convs", "n_children",
        "n_leaves", "saved_tokens", F.coalesce("ends_sha256", nothing).alias("ends_sha256"),
    )


def conversation_trie(conversations: DataFrame, task_nodes: int = TASK_NODES) -> DataFrame:
    """The trie of ``conversations`` (conv_id, turn, role, text) after ``continued``; other columns are not read."""
    return trie(*continued(numbered_turns(conversations)), task_nodes)
