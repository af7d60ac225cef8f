"""Suffix arrays and the removal of repeats, against brute force."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from rinse.llm import suffix_dedup
from rinse.llm.suffix_arrays import Suffixes
from rinse.llm.suffix_dedup import remove_repeats, without_repeats


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text("ab\xff", max_size=40).map(lambda x: x.encode("latin-1")), min_size=1, max_size=8), st.integers(1, 6))
def test_suffix_array_and_prefixes(texts, times):
    texts = [text * times for text in texts]
    found = Suffixes(np.frombuffer(b"".join(texts), np.uint8), np.array([len(text) for text in texts]))
    symbols = []
    for at, text in enumerate(texts):
        symbols += [(1, byte) for byte in text] + [(0, at)]
    wanted = sorted(range(len(symbols)), key=lambda at: symbols[at:])
    assert found.order.tolist() == wanted
    for one, other, common in zip(wanted, wanted[1:], found.common[1:], strict=False):
        same = 0
        while symbols[one + same] == symbols[other + same]:
            same += 1
        assert common == same


def brute(docs, length):
    data = [(text or "").encode() for _, text in docs]
    seen = Counter(text[at : at + length] for text in data for at in range(len(text) - length + 1))
    rows = []
    for (doc_id, _), text in zip(docs, data, strict=True):
        gone = np.zeros(len(text) + 1, bool)
        for at in range(len(text) - length + 1):
            if seen[text[at : at + length]] > 1:
                gone[at : at + length] = True
        runs = int((gone[1:] & ~gone[:-1]).sum() + gone[0])
        kept = bytes(byte for byte, out in zip(text, gone, strict=False) if not out)
        rows.append((doc_id, len(text), int(gone.sum()), runs, hashlib.sha256(kept).hexdigest()))
    return sorted(rows, key=repr)


def frame(spark, docs):
    rows = [(doc_id, text, "x", None, "y", 1) for doc_id, text in docs]
    return spark.createDataFrame(rows, "doc_id long, text string, u1 string, spans string, v string, start long")


def check(spark, docs, length, gram):
    found = remove_repeats(frame(spark, docs), length, gram)
    assert found.columns == ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
    assert sorted((tuple(row) for row in found.collect()), key=repr) == brute(docs, length)


def made(seed, passages=6, docs=40):
    """Texts of rare words with passages of many lengths, copies and periodic parts."""
    pick = random.Random(seed)
    word = lambda: "".join(pick.choices("abcdefghij", k=pick.randint(1, 6)))
    shared = [" ".join(word() for _ in range(pick.randint(3, 25))) for _ in range(passages)]
    texts = []
    for _ in range(docs):
        parts = []
        for _ in range(pick.randint(0, 6)):
            parts.append(pick.choice([word(), pick.choice(shared), "ab" * pick.randint(1, 40), "é" * pick.randint(1, 30)]))
        texts.append(" ".join(parts))
    texts += [texts[0], texts[1][:-1] + "z", None, "", "x" * 20, "long word " * 300]
    return [(at if at % 7 else None, text) for at, text in enumerate(texts)] + [(3, texts[3])]


@pytest.mark.parametrize("seed, length, gram", [(1, 40, 16), (2, 40, 40), (3, 64, 20)])
def test_against_brute_force(spark, seed, length, gram):
    check(spark, made(seed), length, gram)


def test_anchors_with_many_contexts_are_merged_across_shards(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "CONTEXTS_PER_SHARD", 3)
    monkeypatch.setattr(suffix_dedup, "CONTEXTS_PER_ANCHOR", 3)
    monkeypatch.setattr(suffix_dedup, "STRINGS_PER_RANGE", 50)
    check(spark, made(5, passages=2, docs=60), 40, 16)


def in_three_texts(seeds):
    """For each seed passages around one common anchor and among rarer ones, each in just three texts."""
    texts = []
    for seed in range(seeds):
        pick = random.Random(seed)
        word = lambda n: "".join(pick.choices("abcdefghijklmnopqrstuvwxyz", k=n))
        words = [word(16) for _ in range(100)]
        gram = lambda one: suffix_dedup._slid(suffix_dedup._BYTES[list(one.encode())], 16, suffix_dedup._hashed)[0]
        common = min(words, key=gram)  # the smallest hash among its neighbours
        for _ in range(12):
            passage = word(pick.randint(12, 30)) + common + word(pick.randint(12, 30))
            texts += [word(pick.randint(0, 30)) + passage + word(pick.randint(0, 30)) for _ in range(3)]
    return list(enumerate(texts))


@pytest.mark.parametrize("per_shard", [400, 1000, 4000])
def test_strings_of_a_common_anchor_in_three_texts(spark, monkeypatch, per_shard):
    monkeypatch.setattr(suffix_dedup, "CONTEXTS_PER_SHARD", per_shard)
    monkeypatch.setattr(suffix_dedup, "CONTEXTS_PER_ANCHOR", 4)
    check(spark, in_three_texts(60), 40, 16)


def test_empty_table(spark):
    assert remove_repeats(frame(spark, []), 40, 16).count() == 0


def test_other_columns_stay(spark):
    docs = [(1, "a unique beginning " + "0123456789" * 5), (2, "0123456789" * 5 + " and an end"), (3, None), (4, "short")]
    found = without_repeats(frame(spark, docs), 40, 16)
    assert found.columns == ["doc_id", "text", "u1", "spans", "v", "start"]
    texts = {row.doc_id: row.text for row in found.collect()}
    assert texts[3] is None and texts[4] == "short"
    assert texts[1] == "a unique beginning " and texts[2] == " and an end"


def test_the_table(spark):
    table = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    docs = [(row.doc_id, row.text) for row in table.collect()]
    check(spark, docs, 400, 128)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text("ab", max_size=60), min_size=1, max_size=6), st.integers(1, 25))
def test_suffixes_sorted_by_a_depth(texts, depth):
    data = [text.encode() for text in texts]
    found = Suffixes(np.frombuffer(b"".join(data), np.uint8), np.array([len(one) for one in data]), depth)
    symbols = []
    for at, text in enumerate(data):
        symbols += [(1, byte) for byte in text] + [(0, at)]

    def beginning(at):
        end = next(place for place in range(at, len(symbols)) if symbols[place][0] == 0)
        return symbols[at : min(at + depth, end + 1)]

    kept = [beginning(at) for at in found.order]
    assert kept == sorted(kept)
    assert found.first.tolist() == [True, *(one != other for one, other in zip(kept, kept[1:], strict=False))]


def test_contexts_hold_each_string_once():
    text = np.random.default_rng(1).integers(97, 123, 20_000).astype(np.uint8)
    ends = np.array([3000, 3010, 12_000, 20_000])
    _, _, first, last = suffix_dedup.anchors(text, ends, 400, 128)
    held = np.concatenate([np.arange(one, other + 1) for one, other in zip(first, last, strict=True)])
    strings = [at for start, end in zip([0, *ends], ends, strict=False) for at in range(start, end - 399)]
    assert held.tolist() == strings


def test_anchors_of_many_rows_do_not_meet_in_one_task(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "HOT_ROWS", 3)
    check(spark, made(6, passages=2, docs=60), 40, 16)


# a repeated string from the second byte of a character to the first of another
HALVES = [(1, "\u00e9" + "0123456789" * 4 + "\u00fc."), (2, "\u00a9" + "0123456789" * 4 + "\u00e4!"), (3, "stays"), (4, None)]


def test_halves_of_two_characters_make_no_third(spark):
    found = without_repeats(frame(spark, HALVES), 40, 16)
    assert {row.doc_id: row.text for row in found.collect()} == {1: ".", 2: "!", 3: "stays", 4: None}


def test_the_text_that_stays(spark):
    found = remove_repeats(frame(spark, HALVES), 40, 16, with_bytes=True, with_text=True)
    assert found.columns[-3:] == ["kept_sha256", "kept", "text"]
    rows = {row.doc_id: (bytes(row.kept), row.text) for row in found.collect()}
    assert rows == {1: (b"\xc3\xbc.", "."), 2: (b"\xc2\xa4!", "!"), 3: (b"stays", "stays"), 4: (b"", "")}


def test_the_query_returns_the_text_that_stays(spark):
    from rinse.llm.queries import QUERIES

    found = QUERIES["op4_suffix_dedup"](spark, "/root/testdata/sf0.001").drop("has_repeats")
    assert found.columns == ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "text"]
    rows, table = found.collect(), spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()
    assert sorted((tuple(row)[:5] for row in rows), key=repr) == brute([(row.doc_id, row.text) for row in table], 400)
    whole = {row.doc_id: row.text or "" for row in table}
    for row in rows:
        assert (row.text == whole[row.doc_id]) == (row.n_removed == 0)
        # no text here is cut inside a character
        assert hashlib.sha256(row.text.encode()).hexdigest() == row.kept_sha256
