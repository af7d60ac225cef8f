"""The conversation trie against sequences compared as a whole, in tasks and by joins."""

import hashlib
import math
import random
import zlib

import numpy as np
import pytest

from rinse.llm.centroids import subtree_sums
from rinse.llm.prefix_trie import continued, conversation_trie, nodes_and_paths, numbered_turns, prefixes


def rebuilt(rows):
    """Conversations as lists of (role, text), rebuilt as the contract says."""
    own = {}
    for conv, turn, role, text in rows:
        if conv is not None:
            own.setdefault(conv, []).append((turn is not None, turn or 0, role or "", text or ""))
    own = {conv: [(r, t) for _, _, r, t in sorted(turns, key=lambda one: one[:2])] for conv, turns in own.items()}
    out = {}
    for conv, turns in own.items():
        h = zlib.crc32(str(conv).encode()) % 9
        out[conv] = own.get(conv - int(math.fmod(conv, 5)), [])[:h] + turns[h:]
    return out


def by_hand(rows):
    convs = rebuilt(rows)
    members = {}
    for conv, turns in convs.items():
        for depth in range(len(turns) + 1):
            members.setdefault(tuple(turns[:depth]), []).append(conv)
    children = {node: 0 for node in members}
    for node in members:
        if node:
            children[node[:-1]] += 1
    leaves, saved = dict.fromkeys(members, 0), dict.fromkeys(members, 0)
    for node, of in members.items():
        for depth in range(len(node) + 1):
            leaves[node[:depth]] += children[node] == 0
            saved[node[:depth]] += (len(of) - 1) * len(node[-1][1].encode()) if node else 0
    out = []
    for node, of in members.items():
        ends = ",".join(str(conv) for conv in sorted(of) if len(convs[conv]) == len(node))
        parent = min(members[node[:-1]]) if node else None
        out.append((min(of), len(node), parent, len(of), children[node], leaves[node], saved[node], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=repr)


def frame(spark, rows):
    return spark.createDataFrame([(*row, 1, "x") for row in rows], "conv_id long, turn long, role string, text string, size int, top string")


def conversations(seed, texts):
    rng = random.Random(seed)
    rows = [(conv, None if at == 0 and rng.random() < 0.3 else at, rng.choice(["user", None]), rng.choice(texts))
            for conv in range(-6, 25) for at in range(rng.randint(1, 11))]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize(("texts", "task_nodes"), [(["x", "é", "", None], 1 << 14), (["x", "é"], 3), (["x"], 1)])
def test_trie_equals_whole_sequences(spark, texts, task_nodes):
    rows = conversations(len(texts), texts)
    found = conversation_trie(frame(spark, rows), task_nodes)
    assert found.columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    assert sorted(map(tuple, found.collect()), key=repr) == by_hand(rows)


def test_odd_rows(spark):
    long = [(5, at, "u", "t" * (at % 3)) for at in range(1500)]  # several chunks
    copies = [(conv, 0, "u", "same") for conv in range(100, 1400, 2)]  # one node with many ends
    rows = [*long, *copies, (None, 1, "u", "lost"), (3, None, None, None), (1_000_001, 7, "u", "")]
    assert sorted(map(tuple, conversation_trie(frame(spark, rows), 64).collect()), key=repr) == by_hand(rows)
    assert conversation_trie(frame(spark, rows).limit(0)).count() == 0
    assert conversation_trie(frame(spark, [(None, 1, "u", "lost")])).count() == 0


def test_rows_in_any_order_and_repeated_turns(spark):
    """Turns with one number stand in the order of their digests, however the rows lie."""
    rows = [(1, 0, "u", text) for text in "abcab"]
    found = [sorted((r.place, r.digest) for r in numbered_turns(frame(spark, order)).collect()) for order in (rows, rows[::-1])]
    assert found[0] == found[1] and [place for place, _ in found[0]] == [1, 2, 3, 4, 5]


def test_chunks_do_not_change_names(spark):
    turns, lengths = continued(numbered_turns(frame(spark, [(5, at, "u", str(at % 4)) for at in range(50)] + [(6, at, "u", "z") for at in range(3)])))
    whole, cut = (sorted(map(tuple, prefixes(turns, chunk).collect())) for chunk in (1024, 7))
    assert whole == cut
    nodes, _ = nodes_and_paths(turns, lengths)
    sizes = {(row.m, row.depth): row["size"] for row in nodes.collect()}
    assert sizes[(5, 0)] == len(sizes)


def test_centroids_equal_plain_sums():
    rng = random.Random(5)
    for _ in range(200):
        n = rng.randint(1, 60)
        above = [-1 if at == 0 or rng.random() < 0.1 else at - 1 if rng.random() < 0.5 else rng.randrange(at) for at in range(n)]
        place = rng.sample(range(n), n)
        parent, depth = np.full(n, -1), np.zeros(n, np.int64)
        for at, up in enumerate(above):
            if up >= 0:
                parent[place[at]], depth[place[at]] = place[up], depth[place[up]] + 1
        values = np.array([[rng.randrange(1 << 60), 1] for _ in range(n)])
        values[:, 0] //= n
        want = values.copy()
        for at in range(n):
            up = parent[at]
            while up >= 0:
                want[up] += values[at]
                up = parent[up]
        assert (subtree_sums(parent, depth, want[:, 1].copy(), values) == want).all()
