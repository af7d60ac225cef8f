"""Token ids in binary files: patched frame-of-reference blocks behind an index of block starts.

A file holds whole documents. Their ids lie one after another in blocks of ``BLOCK`` ids. A block
keeps its smallest id, the differences to it in as many bits as a percentile of them needs, and a
list of the exceptions that need more. The index says where each block starts, so a range of ids
is read from the blocks that hold it.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rinse.llm.memory import giving_back
from rinse.llm.shared_files import opened, written
from rinse.llm.tokens import END_OF_DOCUMENT, encoder, pieces_of, word_tokenizer

MAGIC = b"PFOR0001"
BLOCK = 256
PERCENTILE = 90
IDS_PER_FILE = 1 << 22
_HEADER = struct.Struct("<8sQQQI")  # magic, documents, ids, blocks, ids per block
_CHUNK = 1024  # blocks packed or unpacked at once


def _widths(differences: np.ndarray, percentile: int) -> np.ndarray:
    """Bits per block that the given share of its differences fits in."""
    at = min(differences.shape[1] - 1, differences.shape[1] * percentile // 100)
    chosen = np.partition(differences, at, axis=1)[:, at]
    return np.frexp(chosen.astype(np.float64))[1].astype(np.uint8)


def _spans(width: int) -> Iterator[tuple[int, int, range]]:
    """Of eight numbers of ``width`` bits: which one, its first bit in its first byte, and its bytes."""
    for at in range(8):
        first, last = at * width, (at + 1) * width - 1
        yield at, first & 7, range(first >> 3, (last >> 3) + 1)


def _bits_of(rows: np.ndarray, width: int) -> np.ndarray:
    """The low ``width`` bits of the numbers, the lowest first, one row of bytes for each row."""
    n = rows.shape[1]
    rows = np.pad(rows, ((0, 0), (0, -n % 8)))
    numbers = rows.reshape(-1, 8).astype(np.uint64) & np.uint64((1 << width) - 1)
    packed = np.zeros((len(numbers), width), np.uint8)
    for at, shift, places in _spans(width):
        moved = numbers[:, at] << np.uint64(shift)
        for step, place in enumerate(places):
            packed[:, place] |= (moved >> np.uint64(8 * step)).astype(np.uint8)
    return packed.reshape(len(rows), -1)[:, : -(-n * width // 8)]


def _numbers_of(packed: np.ndarray, width: int) -> np.ndarray:
    """The numbers whose ``width`` bits each lie one after another in the bytes."""
    packed = packed.reshape(-1, width)
    numbers = np.empty((len(packed), 8), np.uint32)
    for at, shift, places in _spans(width):
        one = np.zeros(len(packed), np.uint64 if len(places) > 4 else np.uint32)
        for step, place in enumerate(places):
            one |= packed[:, place].astype(one.dtype) << one.dtype.type(8 * step)
        numbers[:, at] = one >> one.dtype.type(shift) & one.dtype.type((1 << width) - 1)
    return numbers.reshape(-1)


def pack(ids: np.ndarray, block: int = BLOCK, percentile: int = PERCENTILE) -> list[bytes]:
    """Blocks of the ids; the last one is filled up with its own last id."""
    packed: list[bytes] = []
    for start in range(0, len(ids), block * _CHUNK):
        part = ids[start : start + block * _CHUNK].astype(np.uint32)
        rows = np.pad(part, (0, -len(part) % block), mode="edge").reshape(-1, block)
        least = rows.min(axis=1)
        differences = rows - least[:, None]
        widths = _widths(differences, percentile)
        bodies: list[bytes] = [b""] * len(rows)
        for width in np.unique(widths):
            which = np.flatnonzero(widths == width)
            body = _bits_of(differences[which], int(width))
            for at, one in zip(which, body, strict=True):
                bodies[at] = one.tobytes()
        over = differences.astype(np.uint64) >> widths.astype(np.uint64)[:, None] > 0
        counts = over.sum(axis=1)
        places, values = np.nonzero(over)[1].astype("<u2"), differences[over].astype("<u4")
        stops = np.cumsum(counts)
        for at, stop in enumerate(stops):
            own = slice(stop - counts[at], stop)
            head = struct.pack("<IBH", least[at], widths[at], counts[at])
            packed.append(head + places[own].tobytes() + values[own].tobytes() + bodies[at])
    return packed


def unpack(blocks: list[bytes], block: int = BLOCK) -> np.ndarray:
    """The ids of whole blocks, filling included."""
    rows = np.zeros((len(blocks), block), np.uint32)
    by_width: dict[int, list[int]] = {}
    bodies, exceptions = [], []
    for at, data in enumerate(blocks):
        least, width, count = struct.unpack_from("<IBH", data)
        places = np.frombuffer(data, "<u2", count, 7)
        exceptions.append((places, np.frombuffer(data, "<u4", count, 7 + 2 * count), least))
        bodies.append(data[7 + 6 * count :])
        by_width.setdefault(width, []).append(at)
    for width, which in by_width.items():
        if width:
            raw = np.frombuffer(b"".join(bodies[at] for at in which), np.uint8)
            rows[which] = _numbers_of(raw, width).reshape(len(which), -1)[:, :block]
    for at, (places, values, least) in enumerate(exceptions):
        rows[at, places] = values
        rows[at] += np.uint32(least)
    return rows.reshape(-1)


def write_file(path: str, doc_ids: list[int | None], counts: np.ndarray, ids: np.ndarray) -> None:
    blocks = pack(ids)
    starts = np.cumsum([0, *map(len, blocks)]).astype("<u8")
    with written(path) as out:
        out.write(_HEADER.pack(MAGIC, len(doc_ids), len(ids), len(blocks), BLOCK))
        out.write(np.array([one is not None for one in doc_ids], np.uint8).tobytes())
        out.write(np.array([one or 0 for one in doc_ids], "<i8").tobytes())
        out.write(np.asarray(counts, "<u8").tobytes())
        out.write(starts.tobytes())
        for one in blocks:
            out.write(one)


class TokenFile:
    """A file opened for reading: its documents, and any range of its ids."""

    def __init__(self, path: str) -> None:
        self._file = opened(path)
        magic, documents, self.n_ids, blocks, self._block = _HEADER.unpack(
            self._file.read(_HEADER.size)
        )
        if magic != MAGIC:
            raise ValueError(f"{path} is no file of token ids")
        known = np.frombuffer(self._file.read(documents), np.uint8)
        ids = np.frombuffer(self._file.read(8 * documents), "<i8")
        self.doc_ids = [int(i) if one else None for i, one in zip(ids, known, strict=True)]
        self.counts = np.frombuffer(self._file.read(8 * documents), "<u8").astype(np.int64)
        self._starts = np.frombuffer(self._file.read(8 * (blocks + 1)), "<u8").astype(np.int64)
        self._data = _HEADER.size + documents * 17 + 8 * (blocks + 1)

    def ids(self, start: int, stop: int) -> np.ndarray:
        """Ids from ``start`` up to ``stop`` of this file, read from their blocks only."""
        first, last = start // self._block, -(-stop // self._block)
        self._file.seek(self._data + int(self._starts[first]))
        raw = self._file.read(int(self._starts[last] - self._starts[first]))
        cuts = self._starts[first : last + 1] - self._starts[first]
        blocks = [raw[cuts[at] : cuts[at + 1]] for at in range(len(cuts) - 1)]
        base = first * self._block
        return unpack(blocks, self._block)[start - base : stop - base]

    def documents(self, most: int = 1 << 20) -> Iterator[tuple[int, int, np.ndarray]]:
        """Place of the first document, place after the last, and their ids, in parts."""
        ends = np.cumsum(self.counts)
        first = 0
        while first < len(ends):
            start = int(ends[first] - self.counts[first])
            last = max(first + 1, int(np.searchsorted(ends, start + most, side="right")))
            yield first, last, self.ids(start, int(ends[last - 1]))
            first = last

    def close(self) -> None:
        self._file.close()


def write_tokens(
    docs: DataFrame,
    folder: str,
    tokenizer: str | None = None,
    end: int = END_OF_DOCUMENT,
    ids_per_file: int = IDS_PER_FILE,
) -> None:
    """Write the ids of ``docs`` (doc_id, text) in ascending doc_id order as files in ``folder``.

    Null texts count as empty; rows without doc_id come first; rows with one doc_id are ordered
    by their text. Other columns are not read. An empty table gives no files. Every task writes
    files of about ``ids_per_file`` ids (a document is never split); ``folder/manifest`` lists
    those that count, so files of attempts that failed do no harm.
    """
    path = tokenizer or word_tokenizer()

    @giving_back
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, part, number = encoder(path), TaskContext.get().partitionId(), 0
        ids, counts, names = [], [], []

        def flush() -> pa.RecordBatch:
            name = f"part-{part:06d}-{number:06d}-{uuid.uuid4().hex}.pfor"
            whole = np.concatenate(ids)
            write_file(f"{folder}/{name}", names, np.concatenate(counts), whole)
            row = ([part], [number], [name], [len(names)], [len(whole)])
            return pa.RecordBatch.from_arrays(
                [pa.array(v, t) for v, t in zip(row, _MANIFEST.types, strict=True)], schema=_MANIFEST
            )

        for batch in batches:
            for piece in pieces_of(batch):
                found, starts = words.encode(piece.column("text"), end)
                ids.append(found)
                counts.append(np.diff(starts))
                names.extend(piece.column("doc_id").to_pylist())
                if sum(map(len, ids)) >= ids_per_file:
                    yield flush()
                    ids, counts, names, number = [], [], [], number + 1
        if names:
            yield flush()

    ordered = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    ordered = ordered.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    schema = "part long, number long, name string, documents long, ids long"
    ordered.mapInArrow(write, schema).write.parquet(f"{folder}/manifest")


MOST_TASKS = 100_000
_MANIFEST = pa.schema(
    [("part", pa.int64()), ("number", pa.int64()), ("name", pa.string())]
    + [("documents", pa.int64()), ("ids", pa.int64())]
)


def read_tokens(spark: SparkSession, folder: str, with_ids: bool = True) -> DataFrame:
    """The documents of ``folder``: doc_id, start, n_tokens, ids_crc32 and, if asked for, ids.

    ``start`` counts the ids of all documents before. A task reads whole files.
    """
    files = spark.read.parquet(f"{folder}/manifest")
    before = Window.orderBy("part", "number").rowsBetween(Window.unboundedPreceding, -1)
    # one row for each file of millions of ids
    files = files.select("part", "name", F.coalesce(F.sum("ids").over(before), F.lit(0)).alias("start"))
    tasks = min(max(1, files.count()), MOST_TASKS)  # by number, or the short rows would share one task
    files = files.repartition(tasks, "name")
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long"
    schema += ", ids array<int>" if with_ids else ""

    @giving_back
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                source = TokenFile(f"{folder}/{row['name']}")
                start = row["start"]
                for first, last, ids in source.documents():
                    counts = source.counts[first:last]
                    cuts = np.concatenate([[0], np.cumsum(counts)])
                    data = ids.astype("<u4")
                    sums = [zlib.crc32(data[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]
                    columns = [
                        pa.array(source.doc_ids[first:last], pa.int64()),
                        pa.array(start + cuts[:-1], pa.int64()),
                        pa.array(counts, pa.int64()),
                        pa.array(sums, pa.int64()),
                    ]
                    if with_ids:
                        offsets = pa.array(cuts, pa.int32())
                        columns.append(pa.ListArray.from_arrays(offsets, pa.array(data.view("<i4"))))
                    names = ["doc_id", "start", "n_tokens", "ids_crc32", "ids"][: len(columns)]
                    yield pa.RecordBatch.from_arrays(columns, names=names)
                    start += int(cuts[-1])
                source.close()

    return files.select("name", "start").mapInArrow(read, schema)
