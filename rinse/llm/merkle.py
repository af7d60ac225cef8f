"""Fingerprints of documents: a Merkle tree over leaves, paragraphs and sections.

A paragraph is a line. Its leaves are runs of characters that end where the text says so: at a mark, or
at a blank behind one of six letters, so an edit moves only the borders next to it. A section ends
after a paragraph whose hash says so, on average every fourth. The root is the hash of the
sections' hashes, theirs of the paragraphs' hashes, theirs of the leaves' hashes. Equal roots
mean equal texts; where roots differ, the sections, then the paragraphs, then the leaves that differ
say where, and the share of leaves that both trees have says how alike two texts are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rinse.session import stored

LEAF = r"[^.,;:!?]{0,10}[.,;:!?]|[^.,;:!?]{11,47}?(?:[.,;:!?]|[dehnst] )|[^.,;:!?]{1,48}"
IDS_PER_PART = 20_000


def _text(text: Column) -> Column:
    return F.coalesce(text.cast("string"), F.lit(""))


def leaf_hashes(line: Column) -> Column:
    """The hashes of the leaves of a line, which make up all of it."""
    return F.transform(F.regexp_extract_all(line, F.lit(LEAF), F.lit(0)), lambda leaf: F.sha2(leaf, 256))


def paragraph_hash(leaves_: Column) -> Column:
    return F.sha2(F.array_join(leaves_, ","), 256)


def leaves_of_paragraphs(text: Column) -> Column:
    """For each paragraph the hashes of its leaves; null counts as an empty text."""
    return F.transform(F.split(_text(text), "\n", -1), leaf_hashes)


def paragraph_hashes(tree: Column) -> Column:
    """The paragraphs' hashes, from their leaves' hashes."""
    return F.transform(tree, paragraph_hash)


def section_members(paragraphs: Column) -> Column:
    """The paragraphs' hashes of each section, joined by commas."""
    joined = F.array_join(paragraphs, ",")
    return F.split(F.regexp_replace(joined, "([0-9a-f]{63}[0-3]),", "$1;"), ";", -1)


def section_hashes(paragraphs: Column) -> Column:
    return F.transform(section_members(paragraphs), lambda members: F.sha2(members, 256))


def root(tree: Column) -> Column:
    """The root of a tree, from ``leaves_of_paragraphs``."""
    return F.sha2(F.array_join(section_hashes(paragraph_hashes(tree)), ","), 256)


def leaves(tree: Column) -> Column:
    """The distinct leaves of a tree, by 32 bits of their hashes."""
    return F.array_distinct(F.transform(F.flatten(tree), lambda one: F.substring(one, 1, 8)))


def as_text(root_: Column, leaves_: Column) -> Column:
    """The fingerprint as a string: the root, then the leaves."""
    return F.concat(root_, F.lit(":"), F.array_join(leaves_, ","))


def fingerprint(text: Column) -> Column:
    tree = leaves_of_paragraphs(text)
    return as_text(root(tree), leaves(tree))


def likeness(root_: Column, leaves_: Column, other_root: Column, other_leaves: Column) -> Column:
    """The share of nodes, the root and the distinct leaves, that both trees have (Dice): 1 for equal roots only."""
    both = 2.0 * F.size(F.array_intersect(leaves_, other_leaves))
    return F.when(root_ == other_root, F.lit(1.0)).otherwise(both / (F.size(leaves_) + F.size(other_leaves) + 2))


def next_ids(ids: DataFrame, per_part: int) -> DataFrame:
    """Distinct (known, id) with the next ones in descending order; after the last, the first.

    Parts are ranges of ids. The last of a part is followed by the first of the next part, which a
    table with one row for each part says.
    """
    parts = -(-ids.count() // per_part) or 1
    here = F.struct("known", "id")
    ranged = ids.repartitionByRange(parts, F.desc("known"), F.desc("id"))
    ranged = stored(ranged.withColumn("part", F.spark_partition_id()), "ids")
    firsts = ranged.groupBy("part").agg(F.max(here).alias("first"))
    in_order = Window.orderBy("part")
    following = F.coalesce(
        F.lead("first").over(in_order),
        F.first("first").over(in_order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)),
    )
    firsts = firsts.select("part", following.alias("following"))
    within = F.lead(here).over(Window.partitionBy("part").orderBy(F.desc("known"), F.desc("id")))
    ranged = ranged.withColumn("next", within).join(F.broadcast(firsts), "part")
    return ranged.select("known", "id", F.coalesce("next", "following").alias("next"))


def edited_fingerprints(docs: DataFrame, per_part: int = IDS_PER_PART) -> DataFrame:
    """Fingerprints of all texts and of edited ones, and how alike they are.

    ``docs`` has doc_id (long) and text (null counts as empty); other columns are not read. The
    next document is the one with the next lower doc_id, that of the highest after the lowest;
    rows without doc_id stand below all others. The edited text has the last half of its
    characters (rounded down) replaced by as many first characters of the next document. Returns
    doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    Rows that share a doc_id have the same next document; if several rows are next, it is the one
    with the smallest text, whose beginnings are the smallest too. A table with one doc_id is its
    own next document.
    """
    base = docs.select(
        F.col("doc_id").isNotNull().alias("known"), F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias("id"),
        _text(F.col("text")).alias("text"),
    )
    half = F.floor(F.length("text") / 2).cast("int")
    halves = stored(base.select("known", "id", half.alias("half")), "halves")
    ids = halves.select("known", "id").distinct()
    following = stored(next_ids(ids, per_part), "next")
    repeated = halves.count() > following.count()

    wanted = halves.distinct().join(following, ["known", "id"]).select(
        F.col("known").alias("to_known"), F.col("id").alias("to_id"), "half",
        F.col("next.known").alias("known"), F.col("next.id").alias("id"),
    )
    following = base.groupBy("known", "id").agg(F.min("text").alias("text")) if repeated else base
    # trees are grown behind the join: their hashes are larger than the text
    heads = following.join(wanted, ["known", "id"]).withColumn("tree", leaves_of_paragraphs(F.col("text"))).select(
        F.col("to_known").alias("known"), F.col("to_id").alias("id"), "half",
        F.substring("text", F.lit(1), F.col("half")).alias("head"),
        root(F.col("tree")).alias("next_root"), F.unhex(F.array_join(leaves(F.col("tree")), "")).alias("next_leaves"),
    )
    # both joins deal the texts by the same columns, so these go through one shuffle only
    joined = base.withColumn("half", half).join(heads, ["known", "id", "half"]) if repeated else base.join(heads, ["known", "id"])
    # four bytes for each leaf take a sixth of an array's space in the shuffle
    joined = joined.withColumn("next_leaves", F.regexp_extract_all(F.lower(F.hex("next_leaves")), F.lit(".{8}"), F.lit(0)))

    kept = F.substring("text", F.lit(1), (F.length("text") - F.col("half")).cast("int"))
    table = joined.select(
        F.when(F.col("known"), F.col("id")).alias("doc_id"),
        F.length("text").cast("long").alias("n_chars"), leaves_of_paragraphs(F.col("text")).alias("tree"),
        F.concat(kept, F.col("head")).alias("edited"), "next_root", "next_leaves",
    ).withColumn("edited_tree", leaves_of_paragraphs(F.col("edited")))
    for name in ("", "edited_"):
        tree = F.col(f"{name}tree")
        table = table.withColumn(f"{name}root", root(tree)).withColumn(f"{name}leaves", leaves(tree))
    return table.select(
        "doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"),
        as_text(F.col("root"), F.col("leaves")).alias("fingerprint"),
        as_text(F.col("edited_root"), F.col("edited_leaves")).alias("edited_fingerprint"),
        likeness(F.col("root"), F.col("leaves"), F.col("edited_root"), F.col("edited_leaves")).alias("near_edited"),
        likeness(F.col("root"), F.col("leaves"), F.col("next_root"), F.col("next_leaves")).alias("near_next"),
    )


def changed_paragraphs(before: DataFrame, after: DataFrame) -> DataFrame:
    """Which paragraphs of ``after`` are not in ``before``: doc_id, paragraph (from 0), text.

    Both have doc_id and text. The trees are walked from the root: documents with equal roots are
    left, of the others only the sections that ``before`` lacks are opened, and of these the
    paragraphs that it lacks are returned. Documents that ``before`` lacks are new throughout;
    null texts count as empty; rows without doc_id are left out, repeated rows count once.
    """

    def tree(table: DataFrame) -> DataFrame:
        table = table.where("doc_id is not null").select("doc_id", _text(F.col("text")).alias("text")).distinct()
        return table.withColumn("tree", leaves_of_paragraphs(F.col("text"))).withColumn("root", root(F.col("tree")))

    def opened(table: DataFrame) -> DataFrame:
        members = section_members(paragraph_hashes(F.col("tree")))
        table = table.select("doc_id", "text", F.explode(members).alias("members"))
        return table.withColumn("section", F.sha2("members", 256))

    def hashes(table: DataFrame) -> DataFrame:
        return table.select("doc_id", F.explode(F.split("members", ",")).alias("hash")).distinct()

    old, new = tree(before), tree(after)
    new = new.join(old.select("doc_id", "root"), ["doc_id", "root"], "left_anti")
    old = old.join(new.select("doc_id").distinct(), "doc_id", "left_semi")
    old_sections = opened(old).drop("text")
    changed = opened(new).drop("text").join(old_sections.select("doc_id", "section"), ["doc_id", "section"], "left_anti")
    changed = hashes(changed).join(hashes(old_sections), ["doc_id", "hash"], "left_anti")
    lines = new.select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("paragraph", "text"))
    lines = lines.withColumn("hash", paragraph_hash(leaf_hashes(F.col("text"))))
    return lines.join(changed, ["doc_id", "hash"], "left_semi").drop("hash")
