"""Aligned tokens against a plain merge of ends, and links against counts by hand."""

import hashlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest

from rinse.llm.alignment import Words, align_documents, aligned_groups, diagonals, merge, tokenizer

A, B = (public_tokenizers.path(name) for name in ("byte_bpe_50k.json", "piece_bpe_32k.model"))
TEXTS = [
    "Hello world, it's 1999!", "a  b\n\nc\t d ", " leading", "<|endoftext|> <s></s>", "é ü 漢字 🙂 x\u0000y", "▁ is no space", "", None, "same same same",
    "same same same", "word " * 400, "x" * 3000, "don't  stop " * 50 + "　wide", " ", "\n",
]


def plain(text):
    """The contract's figures of one text, token by token; None without tokens."""
    a, b = tokenizer(A), tokenizer(B)
    if not text:
        return None
    ids = a._tokenizer.encode(" " + text, add_special_tokens=False).ids, b._model.encode(text)
    pieces = [[side.pieces[i] for i in one] for side, one in zip((a, b), ids)]
    if any(b"".join(one) != (" " + text).encode() for one in pieces):
        return None
    spans = []
    for one in pieces:
        ends = np.cumsum([len(piece) for piece in one]).tolist()
        spans.append(list(zip([0, *ends[:-1]], ends)))
    links = [(x, y) for x, (s, e) in zip(ids[0], spans[0]) for y, (t, f) in zip(ids[1], spans[1]) if s < f and t < e]
    borders = sorted({e for _, e in spans[0]} & {e for _, e in spans[1]})
    groups = []
    for low, high in zip([0, *borders[:-1]], borders):
        groups.append([[x for x, (s, e) in zip(own, at) if low <= s and e <= high] for own, at in zip(ids, spans)])
    return ids, links, groups


def test_documents_against_tokens_one_by_one(spark):
    docs = spark.createDataFrame([(at % 13, text, "k", 1) for at, text in enumerate(TEXTS)], "doc_id long, text string, code string, n_a int")
    want = [plain(text) for text in TEXTS]
    counts = Counter(pair for one in want if one for pair in set(one[1]))
    best = Counter()
    for (x, _), count in counts.items():
        best[x] = max(best[x], count)
    rows = []
    for at, one in enumerate(want):
        if one is None:
            rows.append((at % 13, 0, 0, 0, 0, 0, 0, ""))
            continue
        (a, b), links, groups = one
        spelled = ";".join("|".join(",".join(map(str, side)) for side in group) for group in groups)
        rows.append((at % 13, len(a), len(b), len(groups), len(links), sum(counts[p] == best[p[0]] for p in links),
                     sum(counts[p] for p in links), hashlib.sha256(spelled.encode()).hexdigest()))
    for work in (3, 1024):
        found = align_documents(docs, A, B, work=work)
        assert sorted(map(tuple, found.collect())) == sorted(rows)
    found = aligned_groups(docs.where("doc_id in (2, 8)"), A, B, work=5).collect()
    for doc_id in (2, 8):
        own = sorted((row.group, row.start, row.ids_a, row.ids_b) for row in found if row.doc_id == doc_id)
        assert [list(row[2:]) for row in own] == want[doc_id][2]
        sizes = np.cumsum([0] + [sum(len(tokenizer(A).pieces[i]) for i in row[2]) for row in own])
        assert [row[1] for row in own] == sizes[:-1].tolist()
    assert sum(one is None for one in want) >= 3
    assert align_documents(docs.limit(0), A, B).count() == 0


@pytest.mark.parametrize("work", [1, 2, 3, 7, 64])
def test_pieces_of_any_size_merge_alike(work):
    rng = np.random.default_rng(work)
    for _ in range(50):
        last = rng.integers(1, 40)
        a, b = (np.unique(np.append(rng.integers(1, last + 1, rng.integers(0, 30)), last)) for _ in range(2))
        i, j = diagonals(a, b, work)
        assert (np.diff(i + j)[:-1] == work).all() and i[-1] == len(a) and j[-1] == len(b)
        found = merge(a, b, work)
        union, both = np.union1d(a, b), np.intersect1d(a, b)
        assert found.link_a.tolist() == np.searchsorted(a, union).tolist()
        assert found.link_b.tolist() == np.searchsorted(b, union).tolist()
        assert found.groups == len(both)
        assert found.group_a.tolist() == np.searchsorted(both, a).tolist()
        assert found.group_b.tolist() == np.searchsorted(both, b).tolist()


def test_words_that_are_forgotten_give_the_same_ids():
    kept, forgetful = (Words(tokenizer(A), tokenizer(B), most) for most in (1 << 20, 0))
    for _ in range(2):
        for (x, n), (y, m) in zip(kept.encode(TEXTS), forgetful.encode(TEXTS)):
            assert x.tolist() == y.tolist() and n.tolist() == m.tolist()


def test_vocabularies_whose_tokens_cross_words_encode_whole_texts():
    side = tokenizer(B)
    words = Words(tokenizer(A), side)
    words._apart = False
    for (x, n), (y, m) in zip(words.encode(TEXTS), Words(tokenizer(A), side).encode(TEXTS)):
        assert x.tolist() == y.tolist() and n.tolist() == m.tolist()
