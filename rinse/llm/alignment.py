"""Tokens of two tokenizers over one text, aligned by the bytes that they cover.

The ends of both token sequences, as byte offsets, are merged along a merge path: a binary search
on every ``PIECE``-th diagonal says how many ends of either side come before it, so the pieces
between two diagonals are equal work and need nothing of each other. Every piece is merged by
itself and emits the pairs of tokens that overlap and the places where both sides end; the groups
that cross a border between pieces are put together from the pieces' counts.

How many documents link an id pair is counted over the corpus. A task adds up what it has read, the
sums are shuffled, and the table of counts is written in sorted files. Links are never shuffled:
each task streams that table past blocks of its documents.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rinse.llm.memory import giving_back
from rinse.llm.shared_files import opened
from rinse.llm.tokens import pieces_of
from rinse.session import scratch

PIECE = 1024  # merged ends between two diagonals
_SLICE = 2 << 20  # bytes of text aligned at once
_MEMORY = 8 << 20  # bytes of words, and ids, that a worker remembers
_CODES = 4 << 20  # links held by a task that counts or looks up
_ROWS = 1 << 20  # rows of the table of counts in memory at once
_BETWEEN_WORDS = re.compile(r"(?<=\S) (?=\S)")
_SPACE = "▁"  # stands for a space in pieces


def _byte_of_letter() -> dict[str, int]:
    """Byte-level vocabularies write printable bytes as themselves, the others from U+0100 on."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    hidden = [byte for byte in range(256) if byte not in shown]
    return {chr(byte): byte for byte in shown} | {chr(256 + at): byte for at, byte in enumerate(hidden)}


class ByteLevel:
    """A byte-level tokenizer file of the ``tokenizers`` library; it gets a space before the text."""

    def __init__(self, path: str) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self._tokenizer = Tokenizer.from_file(path)
        self._tokenizer.encode_special_tokens = True
        with open(path, encoding="utf-8") as file:
            rules = json.load(file)
        before = rules.get("pre_tokenizer") or {}
        self.parted = before.get("type") == "ByteLevel" and before.get("use_regex", True) and not rules.get("normalizer")
        letters, special = _byte_of_letter(), {token["content"] for token in rules.get("added_tokens") or []}
        names = self._tokenizer.get_vocab(with_added_tokens=True)
        self.pieces = [b""] * (max(names.values(), default=-1) + 1)
        for name, number in names.items():
            plain = name in special or not all(letter in letters for letter in name)
            self.pieces[number] = name.encode() if plain else bytes(letters[letter] for letter in name)

    def encode(self, texts: list[str]) -> list[list[int]]:
        found = self._tokenizer.encode_batch_fast([f" {text}" for text in texts], add_special_tokens=False)
        return [one.ids for one in found]


class Pieces:
    """A model file of the ``sentencepiece`` library, which puts a space before the text itself."""

    def __init__(self, path: str) -> None:
        from sentencepiece import SentencePieceProcessor

        self._model = SentencePieceProcessor(model_file=path)
        names = [self._model.id_to_piece(number) for number in range(self._model.get_piece_size())]
        self.parted = not any(_SPACE in name.lstrip(_SPACE) for name in names)
        self.pieces = [
            bytes([int(name[3:-1], 16)]) if self._model.is_byte(number) else name.replace(_SPACE, " ").encode()
            for number, name in enumerate(names)
        ]

    def encode(self, texts: list[str]) -> list[list[int]]:
        return self._model.encode(texts, num_threads=1)


@lru_cache(maxsize=4)
def tokenizer(path: str) -> ByteLevel | Pieces:
    """The tokenizer of a file, loaded once in a Python worker; the ending of the name says its kind."""
    return ByteLevel(path) if path.endswith(".json") else Pieces(path)


class Words:
    """Ids of words by two tokenizers, each distinct word encoded once while it is remembered.

    Words are what stands between single spaces with no white space beside them. Where no token of
    either side can cross such a space (``apart``), the ids of a text are those of its words, each
    with the space before it; elsewhere a whole text is one word. Beyond ``most`` remembered
    characters and ids the memory starts anew.
    """

    def __init__(self, a: ByteLevel | Pieces, b: ByteLevel | Pieces, most: int = _MEMORY) -> None:
        self._sides, self._most, self._apart = (a, b), most, a.parted and b.parted
        self._forget()

    def _forget(self) -> None:
        self._known: dict[str, int] = {}
        self._ids = [np.empty(0, np.int32) for _ in self._sides]
        self._starts = [np.zeros(1, np.int64) for _ in self._sides]
        self._same = np.empty(0, bool)
        self._size = 0

    def _learn(self, words: list[str]) -> None:
        given = [f" {word}".encode() for word in words]
        same = np.ones(len(words), bool)
        for at, side in enumerate(self._sides):
            found, piece = side.encode(words), side.pieces.__getitem__
            lengths = np.fromiter(map(len, found), np.int64, len(found))
            ids = np.fromiter(chain.from_iterable(found), np.int32, int(lengths.sum()))
            same &= np.fromiter((b"".join(map(piece, one)) == word for one, word in zip(found, given, strict=True)), bool, len(words))
            self._starts[at] = np.concatenate([self._starts[at], len(self._ids[at]) + np.cumsum(lengths)])
            self._ids[at] = np.concatenate([self._ids[at], ids])
            self._size += len(ids)
        self._same = np.concatenate([self._same, same])
        self._size += sum(map(len, given))
        self._known.update(zip(words, range(len(self._known), len(self._known) + len(words)), strict=True))

    def encode(self, texts: list[str | None]) -> list[tuple[np.ndarray, np.ndarray]]:
        """Ids of both sides and how many each text has, none for texts that either doesn't give back."""
        if self._size > self._most:
            self._forget()
        split = _BETWEEN_WORDS.split if self._apart else lambda text: [text]
        words = [split(text) if text else [] for text in texts]
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        flat = pa.array(list(chain.from_iterable(words)), pa.large_string()).dictionary_encode()
        distinct = flat.dictionary.to_pylist()
        self._learn([word for word in distinct if word not in self._known])
        place = np.fromiter(map(self._known.__getitem__, distinct), np.int64, len(distinct))
        place = place[flat.indices.to_numpy(zero_copy_only=False)]
        owner = np.repeat(np.arange(len(texts)), sizes)
        kept = np.ones(len(texts), bool)
        kept[owner[~self._same[place]]] = False
        place, owner = place[kept[owner]], owner[kept[owner]]
        out = []
        for ids, starts in zip(self._ids, self._starts, strict=True):
            first, count = starts[place], starts[place + 1] - starts[place]
            stops = np.cumsum(count)
            at = np.repeat(first - (stops - count), count) + np.arange(stops[-1] if len(stops) else 0)
            out.append((ids[at].astype(np.int64), np.bincount(owner, count, minlength=len(texts)).astype(np.int64)))
        return out


@lru_cache(maxsize=1)
def words_of(path_a: str, path_b: str) -> Words:
    """The words that this Python worker remembers from one task to the next."""
    return Words(tokenizer(path_a), tokenizer(path_b))


def diagonals(a: np.ndarray, b: np.ndarray, work: int) -> tuple[np.ndarray, np.ndarray]:
    """For every ``work``-th diagonal, how many of ``a`` and of ``b`` come before; equal ones: ``a`` first."""
    total = len(a) + len(b)
    across = np.append(np.arange(0, total, work), total)
    low, high = np.maximum(0, across - len(b)), np.minimum(across, len(a))
    while (searched := low < high).any():
        middle = (low + high) // 2
        at = np.where(searched, middle, 0), np.where(searched, across - middle - 1, 0)
        before = a[at[0]] <= b[at[1]]
        low = np.where(searched & before, middle + 1, low)
        high = np.where(searched & ~before, middle, high)
    return low, across - low


@dataclass
class Merged:
    """Two sequences of ends, merged.

    ``link_a`` and ``link_b`` are the places of tokens that overlap, in text order; ``group_a`` and
    ``group_b`` say for each token in which group it is; ``groups`` is the number of groups.
    """

    link_a: np.ndarray
    link_b: np.ndarray
    group_a: np.ndarray
    group_b: np.ndarray
    groups: int


def merge(a: np.ndarray, b: np.ndarray, work: int = PIECE) -> Merged:
    """Merge ascending ends (both have the same last one) piece by piece."""
    if not len(a):
        none = np.empty(0, np.int64)
        return Merged(none, none, none, none, 0)
    before_a, before_b = diagonals(a, b, work)
    n_a, n = np.diff(before_a), np.diff(before_a + before_b)
    column = np.arange(work)
    filled, of_a = column < n[:, None], column < n_a[:, None]
    keys = np.full(filled.shape, np.iinfo(np.int64).max)
    keys[of_a], keys[filled & ~of_a] = 2 * a, 2 * b + 1
    keys.sort(axis=1)  # every piece by itself
    from_b = (keys & 1 == 1) & filled
    passed_b = np.cumsum(from_b, axis=1) - from_b
    at_b = before_b[:-1, None] + passed_b
    at_a = before_a[:-1, None] + column - passed_b
    # an end of b closes a group if the last end of a, perhaps of the piece before, is the same
    closes = from_b & (a[np.maximum(at_a - 1, 0) * filled] == keys >> 1) & (at_a > 0)
    closed = np.cumsum(closes, axis=1)
    whole = np.concatenate([[0], np.cumsum(closed[:, -1])])  # groups closed before each piece
    group = whole[:-1, None] + closed - closes
    links = filled & ~closes
    return Merged(at_a[links], at_b[links], group[filled & ~from_b], group[from_b], int(whole[-1]))


class Aligner:
    """Aligns slices of texts; what it returns is per document unless it says otherwise."""

    def __init__(self, path_a: str, path_b: str, work: int = PIECE) -> None:
        self.a, self.b, self._work = tokenizer(path_a), tokenizer(path_b), work
        self._words = words_of(path_a, path_b)
        self._size = [np.array([len(piece) for piece in side.pieces], np.int64) for side in (self.a, self.b)]
        # ids in decimals, behind which there is a place for what separates them
        names = [str(number).encode() for number in range(max(map(len, self._size)))]
        self._length = np.array([len(name) for name in names], np.int64)
        self._width = max(map(len, names)) + 1
        self._digits = np.frombuffer(b"".join(name.ljust(self._width, b"\0") for name in names), np.uint8)
        self._digits = self._digits.reshape(len(names), self._width)

    def align(self, texts: list[str | None]) -> dict:
        (ids_a, n_a), (ids_b, n_b) = self._words.encode(texts)
        # both sides cover the same bytes of every text, so the texts can stand one after another
        ends_a, ends_b = np.cumsum(self._size[0][ids_a]), np.cumsum(self._size[1][ids_b])
        found = merge(ends_a, ends_b, self._work)
        owner_a = np.repeat(np.arange(len(texts)), n_a)
        first = np.searchsorted(found.group_a, np.arange(found.groups))  # of each group, its first token of a
        return {
            "ids_a": ids_a, "ids_b": ids_b, "n_a": n_a, "n_b": n_b, "merged": found, "ends_a": ends_a,
            "link_text": owner_a[found.link_a], "group_text": owner_a[first], "group_first": first,
            "n_groups": np.bincount(owner_a[first], minlength=len(texts)),
            "n_links": np.bincount(owner_a[found.link_a], minlength=len(texts)),
        }

    def sums(self, found: dict) -> list[str]:
        """SHA-256 of ``a1,a2|b1;a3|b2,b3`` for each text; '' without tokens."""
        merged = found["merged"]
        in_a = np.bincount(merged.group_a, minlength=merged.groups)
        in_b = np.bincount(merged.group_b, minlength=merged.groups)
        at_a = np.arange(len(merged.group_a)) + (np.cumsum(in_b) - in_b)[merged.group_a]
        at_b = np.arange(len(merged.group_b)) + np.cumsum(in_a)[merged.group_b]
        ids = np.empty(len(at_a) + len(at_b), np.int64)
        ids[at_a], ids[at_b] = found["ids_a"], found["ids_b"]
        marks = np.full(len(ids), ord(","), np.uint8)
        marks[at_a[np.cumsum(in_a) - 1]] = ord("|")
        marks[at_b[np.cumsum(in_b) - 1]] = ord(";")
        rows = self._digits[ids]
        lengths = self._length[ids]
        rows[np.arange(len(ids)), lengths] = marks
        data = rows[np.arange(self._width) <= lengths[:, None]].tobytes()
        stops = np.concatenate([[0], np.cumsum(lengths + 1)])[np.cumsum(found["n_a"] + found["n_b"])]
        starts = [0, *stops[:-1]]
        return [hashlib.sha256(data[a : b - 1]).hexdigest() if b > a else "" for a, b in zip(starts, stops, strict=True)]

    def codes(self, found: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The distinct id pairs of each text as numbers, ascending; how often; how many each text has."""
        merged, texts = found["merged"], len(found["n_a"])
        pairs = found["ids_a"][merged.link_a] * len(self.b.pieces) + found["ids_b"][merged.link_b]
        most = len(self.a.pieces) * len(self.b.pieces)
        distinct, times = np.unique(found["link_text"] * most + pairs, return_counts=True)
        return distinct % most, times, np.bincount(distinct // most, minlength=texts)


def _binaries(values: np.ndarray, counts: np.ndarray) -> pa.Array:
    """Consecutive values as one binary for each count."""
    offsets = np.concatenate([[0], np.cumsum(counts) * values.itemsize]).astype(np.int32)
    return pa.BinaryArray.from_buffers(pa.binary(), len(counts), [None, pa.py_buffer(offsets), pa.py_buffer(values.tobytes())])


def _values(column: pa.Array, kind: str) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind)


_SCHEMA = "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string"


def _aligned(docs: DataFrame, path_a: str, path_b: str, work: int) -> DataFrame:
    """Each document with its figures, its distinct links and how often each occurs."""

    @giving_back
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = Aligner(path_a, path_b, work)
        for batch in batches:
            for piece in pieces_of(batch, _SLICE):
                found = aligner.align(piece.column("text").to_pylist())
                codes, times, counts = aligner.codes(found)
                figures = [pa.array(found[name], pa.int64()) for name in ("n_a", "n_b", "n_groups", "n_links")]
                yield pa.RecordBatch.from_arrays(
                    [piece.column("doc_id"), *figures, pa.array(aligner.sums(found), pa.string()),
                     _binaries(codes.astype("<u8"), counts), _binaries(times.astype("<u4"), counts)],
                    names=["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "codes", "times"],
                )

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return rows.mapInArrow(run, f"{_SCHEMA}, codes binary, times binary")


@giving_back
def _tallied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How many of the rows have each code, added up over as many rows as memory allows."""

    def added(held: list[np.ndarray]) -> pa.RecordBatch:
        codes, rows = np.unique(np.concatenate(held), return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(codes.astype(np.int64)), pa.array(rows.astype(np.int64))], names=["code", "docs"])

    held, size = [], 0
    for batch in batches:
        held.append(_values(batch.column("codes"), "<u8"))
        size += len(held[-1])
        if size >= _CODES:
            yield added(held)
            held, size = [], 0
    if size:
        yield added(held)


def link_counts(aligned: DataFrame, second: int) -> DataFrame:
    """For each code in how many documents it is, and whether no other code of its first id is in more."""
    counts = aligned.select("codes").mapInArrow(_tallied, "code long, docs long")
    counts = counts.groupBy("code").agg(F.sum("docs").alias("docs"))
    path = scratch(aligned.sparkSession, "link-counts")
    counts.write.parquet(path)
    counts = aligned.sparkSession.read.schema("code long, docs long").parquet(path)
    first = F.floor(F.col("code") / second)
    # one row for each id of the first vocabulary at most
    highest = counts.groupBy(first.alias("first")).agg(F.max("docs").alias("highest"))
    joined = counts.withColumn("first", first).join(F.broadcast(highest), "first")
    return joined.select("code", "docs", (F.col("docs") == F.col("highest")).alias("best"))


def _looked_up(files: list[str]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Adds up counts over the links of documents; files hold sorted codes, their rows and ``best``."""

    def found(blocks: list[pa.RecordBatch]) -> pa.RecordBatch:
        table = pa.Table.from_batches(blocks).combine_chunks()
        codes = _values(table.column("codes"), "<u8").astype(np.int64)
        times = _values(table.column("times"), "<u4").astype(np.int64)
        each = np.array([len(one) // 8 for one in table.column("codes").to_pylist()], np.int64)
        asked, place = np.unique(codes, return_inverse=True)
        docs, best = np.zeros(len(asked), np.int64), np.zeros(len(asked), np.int64)
        for name in files:
            with opened(name) as source:
                for batch in pq.ParquetFile(source).iter_batches(_ROWS):
                    known = batch.column("code").to_numpy()
                    at = np.minimum(np.searchsorted(known, asked), len(known) - 1)
                    hit = known[at] == asked
                    docs[hit] = batch.column("docs").to_numpy()[at[hit]]
                    best[hit] = batch.column("best").to_numpy(zero_copy_only=False)[at[hit]]
        stops = np.cumsum(each)

        def per_text(values: np.ndarray) -> pa.Array:
            sums = np.concatenate([[0], np.cumsum(values)])
            return pa.array(sums[stops] - sums[stops - each])

        out = table.drop_columns(["codes", "times"])
        out = out.append_column("n_best", per_text(times * best[place]))
        out = out.append_column("count_sum", per_text(times * docs[place]))
        return out.combine_chunks().to_batches()[0]

    @giving_back
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                held.append(batch.slice(start, 256))
                size += sum(map(len, held[-1].column("codes").to_pylist())) // 8
                if size >= _CODES:
                    yield found(held)
                    held, size = [], 0
        if held:
            yield found(held)

    return run


def align_documents(docs: DataFrame, path_a: str, path_b: str, work: int = PIECE) -> DataFrame:
    """How the tokens of two tokenizers lie over each other in every whole text of ``docs``.

    ``docs`` has doc_id and text; other columns are not read. ``path_a`` is a byte-level file of
    ``tokenizers``, which gets a space before the text, ``path_b`` a model of ``sentencepiece``,
    which adds that space. Special tokens' strings in texts are plain text. Returns doc_id, n_a and
    n_b (tokens), n_groups (between bytes where tokens of both end), n_links (pairs of tokens that
    share a byte), n_best (links whose id pair is in as many documents as any with its first id),
    count_sum (over the links, in how many documents their id pair is) and groups_sha256.

    Null and empty texts, and texts that a tokenizer does not give back byte by byte, have no
    tokens: zeros and ''. Every row counts as a document, also if doc_ids repeat or are null; an
    empty table gives no rows. Texts are encoded word by word, and whole if a vocabulary has
    tokens that cross words.
    """
    spark = docs.sparkSession
    path = scratch(spark, "aligned")
    rows = _aligned(docs, path_a, path_b, work)
    rows.write.option("compression", "zstd").parquet(path)
    rows = spark.read.schema(rows.schema).parquet(path)
    counts = link_counts(rows, len(tokenizer(path_b).pieces))
    table = scratch(spark, "link-table")
    counts.repartitionByRange("code").sortWithinPartitions("code").write.parquet(table)
    files = spark.read.schema(counts.schema).parquet(table).inputFiles()
    schema = f"{_SCHEMA}, n_best long, count_sum long"
    found = rows.mapInArrow(_looked_up(files), schema)
    return found.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def aligned_groups(docs: DataFrame, path_a: str, path_b: str, work: int = PIECE) -> DataFrame:
    """The groups themselves, in text order: doc_id, group (from 0), start (its first byte), ids_a, ids_b.

    Texts without tokens have no rows; otherwise as ``align_documents``.
    """

    @giving_back
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = Aligner(path_a, path_b, work)
        for batch in batches:
            for piece in pieces_of(batch, _SLICE):
                found = aligner.align(piece.column("text").to_pylist())
                merged, text, first = found["merged"], found["group_text"], found["group_first"]
                starts = np.concatenate([[0], found["ends_a"]])[first]
                of_text = np.concatenate([[0], np.cumsum(found["n_groups"])])[text]  # groups of texts before
                base = starts[of_text] if len(text) else starts

                def lists(ids: np.ndarray, group: np.ndarray) -> pa.Array:
                    stops = np.searchsorted(group, np.arange(merged.groups + 1))
                    return pa.ListArray.from_arrays(pa.array(stops, pa.int32()), pa.array(ids, pa.int32()))

                yield pa.RecordBatch.from_arrays(
                    [piece.column("doc_id").take(pa.array(text)), pa.array(np.arange(len(text)) - of_text, pa.int64()),
                     pa.array(starts - base, pa.int64()), lists(found["ids_a"], merged.group_a), lists(found["ids_b"], merged.group_b)],
                    names=["doc_id", "group", "start", "ids_a", "ids_b"],
                )

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return rows.mapInArrow(run, "doc_id long, group long, start long, ids_a array<int>, ids_b array<int>")
