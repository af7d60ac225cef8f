"""Encoding, the token files and packing, against the tokenizer itself and brute force."""

import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from rinse.llm.packing import best_fit_decreasing, lower_bound, pack_documents, pieces, place, sequences
from rinse.llm.token_files import TokenFile, pack, read_tokens, unpack, write_file, write_tokens
from rinse.llm.tokens import Encoder, word_tokenizer
from rinse.session import scratch

PLAIN = Tokenizer.from_file(word_tokenizer())
ENCODER = Encoder(word_tokenizer(), memory=50)
ODD = ["", " ", "\x0b\x0c a　b", "it's I'LL x1y2", "é ́e", "<|endoftext|> a", "ß ΑΣ Σ İI"]


def ids_of(text):
    return PLAIN.encode(text or "", add_special_tokens=False).ids


@settings(max_examples=150, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(), st.text("aZ' \t\n\x0b\x85 é́<|>.1")), max_size=6))
def test_encoder_gives_the_ids_of_the_tokenizer(texts):
    ids, stops = ENCODER.encode(pa.array(texts + ODD, pa.string()), 7)
    for at, text in enumerate(texts + ODD):
        assert ids[stops[at] : stops[at + 1]].tolist() == [*ids_of(text), 7]


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 2**32 - 1), max_size=700), st.integers(0, 3))
def test_blocks_round_trip(values, shift):
    ids = np.array(values, np.uint32) >> (8 * shift)
    assert unpack(pack(ids))[: len(ids)].tolist() == ids.tolist()


def test_a_range_of_ids_is_read_from_its_blocks(tmp_path):
    ids = np.random.default_rng(1).integers(0, 49_000, 5000).astype(np.uint32)
    path = str(tmp_path / "a.pfor")
    write_file(path, [3, None, 9], np.array([1000, 0, 4000]), ids)
    source = TokenFile(path)
    assert source.doc_ids == [3, None, 9] and source.n_ids == 5000
    for start, stop in ((0, 5000), (255, 257), (256, 512), (1234, 1235), (4999, 5000), (7, 7)):
        assert source.ids(start, stop).tolist() == ids[start:stop].tolist()


def rows(spark, *pairs):
    schema = "doc_id long, text string, row string, part string, ids string"
    return spark.createDataFrame([(*pair, "x", "y", None) for pair in pairs], schema)


ODD_DOCS = [(5, "two words"), (2, None), (None, "no id"), (5, "two words"), (7, ""), (9, "long " * 30_000), (1, " ")]


def test_files_hold_the_ids_in_order(spark):
    folder = scratch(spark, "test")
    write_tokens(rows(spark, *ODD_DOCS), folder, ids_per_file=5)
    found = read_tokens(spark, folder).orderBy("start").collect()
    start = 0
    for row, (doc_id, text) in zip(found, sorted(ODD_DOCS, key=lambda x: (x[0] is not None, x[0])), strict=True):
        ids = [*ids_of(text), 2]
        crc = zlib.crc32(np.array(ids, "<u4").tobytes())
        assert (row.doc_id, row.start, row.n_tokens, row.ids_crc32, row.ids) == (doc_id, start, len(ids), crc, ids)
        start += len(ids)


def test_empty_tables(spark):
    folder = scratch(spark, "test")
    write_tokens(rows(spark), folder)
    assert read_tokens(spark, folder).count() == 0
    assert pack_documents(rows(spark)).count() == 0


def check_packing(placed, docs, room):
    """Every piece once, sequences without holes, at most ``room`` long."""
    wanted = []
    for doc_id, text in docs:
        ids = [*ids_of(text), 1]
        for piece, start in enumerate(range(0, len(ids), room)):
            part = ids[start : start + room]
            wanted.append((doc_id, piece, start, len(part), zlib.crc32(np.array(part, "<u4").tobytes())))
    assert sorted(wanted, key=repr) == sorted((tuple(row)[:5] for row in placed), key=repr)
    by_sequence = defaultdict(list)
    for row in placed:
        by_sequence[row.sequence_id].append((row.offset, row.length))
    for parts in by_sequence.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= room
    return len(by_sequence)


def test_packing_of_odd_documents(spark):
    docs = rows(spark, *ODD_DOCS)
    placed = pack_documents(docs, room=8)
    assert placed.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    check_packing(placed.collect(), ODD_DOCS, 8)


def test_packing_of_the_table(spark):
    table = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    docs = [(row.doc_id, row.text) for row in table.collect()]
    placed = pack_documents(table)
    made = check_packing(placed.collect(), docs, 4096)
    total = sum(row.length for row in placed.collect())
    assert made <= -(-total // 4096) + 1
    texts = {row.sequence_id: row.ids for row in sequences(table, placed).collect()}
    for row in placed.collect():
        part = texts[row.sequence_id][row.offset : row.offset + row.length]
        assert zlib.crc32(np.array(part, "<u4").tobytes()) == row.ids_crc32


def fewest(sizes, room):
    """Fewest sequences by trying everything."""
    best = [len(sizes)]

    def go(at, gaps):
        if len(gaps) >= best[0]:
            return
        if at == len(sizes):
            best[0] = len(gaps)
            return
        for i in {gap: i for i, gap in enumerate(gaps) if gap >= sizes[at]}.values():
            go(at + 1, [*gaps[:i], gaps[i] - sizes[at], *gaps[i + 1 :]])
        go(at + 1, [*gaps, room - sizes[at]])

    sizes = sorted(sizes, reverse=True)
    go(0, [])
    return best[0] if sizes else 0


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 20), max_size=9))
def test_bound_is_never_over_the_fewest(sizes):
    counts = np.bincount(sizes, minlength=21).astype(np.int64)
    best = fewest(sizes, 20)
    assert lower_bound(counts) <= best
    sequence, _ = best_fit_decreasing(np.array(sizes, np.int64), 20)
    assert len(set(sequence)) <= max(best, 11 * best / 9 + 1)


@pytest.mark.parametrize("low, high", [(1, 400), (1500, 3000), (2049, 4096), (4096, 4096)])
def test_rounds_reach_the_bound_or_nearly(spark, low, high):
    lengths = np.random.default_rng(low).integers(low, high + 1, 4000)
    table = spark.createDataFrame([(i, int(n)) for i, n in enumerate(lengths)], "row long, length long")
    placed = place(table, per_partition=300).join(table, "row").collect()
    used = defaultdict(int)
    for row in placed:
        used[row.sequence_id] += row.length
    assert len(placed) == 4000 and max(used.values()) <= 4096
    bound = lower_bound(np.bincount(lengths, minlength=4097).astype(np.int64))
    assert bound <= len(used) <= bound * 1.02 + 1


def test_pieces_are_numbered_apart(spark):
    found = pieces(rows(spark, *ODD_DOCS).repartition(3), room=100).collect()
    assert len({row.row for row in found}) == len(found)


def test_packing_goes_on_until_one_partition_holds_the_rest(spark):
    found = spark.createDataFrame([(row, 1) for row in range(300)], "row long, length long")
    placed = place(found, room=100, per_partition=1).collect()
    assert sorted(row.row for row in placed) == list(range(300))
    assert len({(row.sequence_id, row.offset) for row in placed}) == 300
    assert len({row.sequence_id for row in placed}) == 3


def test_blocks_are_unpacked_in_little_memory():
    import tracemalloc

    ids = np.random.default_rng(3).integers(0, 49_000, 1 << 18).astype(np.uint32)
    blocks = pack(ids)
    tracemalloc.start()
    found = unpack(blocks)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert (found == ids).all() and most < 40 * len(ids)  # 32 bytes for the bits alone before
