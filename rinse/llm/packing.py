"""Best-fit packing of tokenized documents into sequences, certified by lower bounds.

Pieces are dealt over partitions by hash, and each is packed best-fit decreasing. Lower bounds
from dual-feasible functions say how few sequences a partition's pieces need at least. Where a
partition reaches its bound all but its emptiest sequence stay; elsewhere all sequences with gaps
are taken apart. What was taken apart is exchanged between fewer partitions and packed again,
until the number of sequences equals the bound of all pieces, or one partition holds the rest.
From round ``ROUNDS`` on every partition gives only its emptiest sequence, so that tasks stay small.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from itertools import count

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rinse.llm.memory import giving_back
from rinse.llm.tokens import END_OF_SEQUENCE, encoder, pieces_of, word_tokenizer
from rinse.session import stored

CAPACITY = 4096
PIECES_PER_PARTITION = 8192
ROUNDS = 6


def lower_bound(counts: np.ndarray) -> int:
    """Sequences needed at least, where ``counts[n]`` pieces have n ids and the last n is the room.

    The best of these dual-feasible functions: for every threshold t, pieces over room - t count
    as a whole sequence and those under t as nothing; and for k up to 16, a piece x counts
    floor((k + 1) x) / k unless (k + 1) x is whole, then x (both as shares of the room).
    """
    room = len(counts) - 1
    if not counts.sum():
        return 0
    sizes = np.arange(room + 1)
    total = np.concatenate([[0], np.cumsum(counts)])
    weight = np.concatenate([[0], np.cumsum(counts * sizes)])
    low = np.arange(room // 2 + 1)
    whole = total[room + 1] - total[room - low + 1]
    best = int((whole - (-(weight[room - low + 1] - weight[low]) // room)).max())
    for k in range(1, 17):
        scaled = (k + 1) * sizes
        share = np.where(scaled % room == 0, k * sizes, scaled // room * room)  # times k * room
        best = max(best, -(-int((counts * share).sum()) // (k * room)))
    return best


def best_fit_decreasing(lengths: np.ndarray, room: int) -> tuple[np.ndarray, np.ndarray]:
    """Sequence and offset of each piece: longest first, into the fullest sequence with room."""
    sequence = np.empty(len(lengths), np.int64)
    offset = np.empty(len(lengths), np.int64)
    with_gap: list[list[int]] = [[] for _ in range(room + 1)]
    gaps = 0  # bit g is set where a sequence has a gap of g
    made = 0
    for at in np.argsort(-lengths, kind="stable"):
        need = int(lengths[at])
        fitting = gaps >> need
        if fitting:
            gap = need + (fitting & -fitting).bit_length() - 1
            one = with_gap[gap].pop()
            if not with_gap[gap]:
                gaps ^= 1 << gap
        else:
            gap, one, made = room, made, made + 1
        sequence[at], offset[at] = one, room - gap
        if gap > need:
            with_gap[gap - need].append(one)
            gaps |= 1 << gap - need
    return sequence, offset


def pieces(
    docs: DataFrame,
    tokenizer: str | None = None,
    room: int = CAPACITY,
    end: int = END_OF_SEQUENCE,
    with_ids: bool = False,
) -> DataFrame:
    """Documents (doc_id, text) as pieces of at most ``room`` ids.

    Columns: row (an arbitrary number of its own), doc_id, piece, start, length, ids_crc32 and, if
    asked for, ids. Null texts count as empty; ``end`` follows every text.
    """
    path = tokenizer or word_tokenizer()
    schema = "row long, doc_id long, piece int, start long, length long, ids_crc32 long"
    schema += ", ids array<int>" if with_ids else ""

    @giving_back
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, row = encoder(path), TaskContext.get().partitionId() << 40
        for batch in batches:
            for part in pieces_of(batch):
                ids, stops = words.encode(part.column("text"), end)
                data = ids.astype("<u4")
                counts = np.diff(stops)
                many = -(-counts // room)
                doc = np.repeat(np.arange(len(counts)), many)
                piece = np.arange(len(doc)) - np.repeat(np.cumsum(many) - many, many)
                first = stops[:-1][doc] + piece * room
                length = np.minimum(room, stops[1:][doc] - first)
                columns = [
                    pa.array(row + np.arange(len(doc)), pa.int64()),
                    part.column("doc_id").take(pa.array(doc)),
                    pa.array(piece, pa.int32()),
                    pa.array(piece * room, pa.int64()),
                    pa.array(length, pa.int64()),
                    pa.array(
                        [zlib.crc32(data[a : a + n]) for a, n in zip(first, length, strict=True)],
                        pa.int64(),
                    ),
                ]
                if with_ids:
                    offsets = pa.array(np.append(first, stops[-1]), pa.int32())
                    columns.append(pa.ListArray.from_arrays(offsets, pa.array(data.view("<i4"))))
                names = ["row", "doc_id", "piece", "start", "length", "ids_crc32", "ids"]
                yield pa.RecordBatch.from_arrays(columns, names=names[: len(columns)])
                row += len(doc)

    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return docs.mapInArrow(cut, schema)


def _packer(room: int, round_: int, alone: bool):
    def pack(frame: pd.DataFrame) -> pd.DataFrame:
        lengths = frame["length"].to_numpy()
        sequence, offset = best_fit_decreasing(lengths, room)
        gaps = room - np.bincount(sequence, weights=lengths).astype(np.int64)
        bound = lower_bound(np.bincount(lengths, minlength=room + 1))
        stays = np.ones(len(gaps), bool)
        if not alone:
            stays[gaps > 0] = len(gaps) == bound or round_ >= ROUNDS - 1
            stays[gaps.argmax()] &= gaps.max() == 0
        base = (round_ << 58) + (int(frame["part"].iat[0]) << 28)
        return pd.DataFrame(
            {
                "row": frame["row"],
                "length": lengths,
                "sequence_id": base + sequence,
                "offset": offset,
                "stays": stays[sequence],
            }
        )

    return pack


def place(found: DataFrame, room: int = CAPACITY, per_partition: int = PIECES_PER_PARTITION) -> DataFrame:
    """Row, sequence_id and offset for pieces (row, length), whose rows must be stored.

    ``per_partition`` is the number of pieces that a task packs; it doubles from round to round.
    """
    spark = found.sparkSession
    waiting = found.select("row", "length")
    # at most ``room`` rows come to the driver
    lengths = waiting.groupBy("length").count().collect()
    counts = np.bincount(
        [row["length"] for row in lengths], [row["count"] for row in lengths], minlength=room + 1
    ).astype(np.int64)
    bound, left, kept, done = lower_bound(counts), int(counts.sum()), 0, None
    schema = "row long, length long, sequence_id long, offset long, stays boolean"
    for round_ in count():
        parts = -(-left // (per_partition << round_)) or 1
        dealt = F.pmod(F.xxhash64("row", F.lit(round_)), F.lit(parts))
        grouped = waiting.withColumn("part", dealt).repartition(parts, "part").groupBy("part")
        packed = stored(grouped.applyInPandas(_packer(room, round_, parts == 1), schema), "packed")
        stays = packed.where("stays").select("row", "sequence_id", "offset")
        done = stays if done is None else done.unionByName(stays)
        made = packed.where("offset = 0").groupBy("stays").count().collect()
        made = {row["stays"]: row["count"] for row in made}
        kept += made.get(True, 0)
        if not made.get(False):
            break
        if kept + made[False] == bound:  # nothing to gain: the rest stays as it is
            done = done.unionByName(packed.where("not stays").select("row", "sequence_id", "offset"))
            break
        waiting = packed.where("not stays").select("row", "length")
        left = waiting.count()
    return spark.createDataFrame([], "row long, sequence_id long, offset long") if done is None else done


def pack_documents(
    docs: DataFrame,
    tokenizer: str | None = None,
    room: int = CAPACITY,
    end: int = END_OF_SEQUENCE,
) -> DataFrame:
    """Pack documents (doc_id, text) into as few sequences of ``room`` ids as best fit finds.

    Returns doc_id, piece, start, length, ids_crc32, sequence_id and offset for each piece.
    Documents over ``room`` ids are cut, others stay whole. Null texts count as empty (their only
    id is ``end``); rows with one doc_id or none are packed each for itself; other columns are not
    read; an empty table gives no rows.
    """
    found = stored(pieces(docs, tokenizer, room, end), "pieces")
    placed = place(found, room)
    return found.join(placed, "row").drop("row")


def sequences(docs: DataFrame, placed: DataFrame, tokenizer: str | None = None,
              room: int = CAPACITY, end: int = END_OF_SEQUENCE) -> DataFrame:
    """The packed sequences as text for a model: sequence_id, ids and the doc_ids they come from.

    Encodes the documents again, so that ids need not be kept while packing. A sequence has at most
    ``room`` ids. Rows that agree in doc_id and ids stand for each other.
    """
    keys = ["doc_id", "piece", "length", "ids_crc32"]
    ids = pieces(docs, tokenizer, room, end, with_ids=True).dropDuplicates(keys).alias("p")
    same = [F.col(f"p.{key}").eqNullSafe(F.col(f"s.{key}")) for key in keys]
    parts = placed.alias("s").join(ids, same).select("s.sequence_id", "s.offset", "s.doc_id", "p.ids")
    gathered = F.sort_array(F.collect_list(F.struct("offset", "doc_id", "ids")))
    return parts.groupBy("sequence_id").agg(gathered.alias("parts")).select(
        "sequence_id",
        F.flatten(F.col("parts.ids")).alias("ids"),
        F.col("parts.doc_id").alias("doc_ids"),
    )
