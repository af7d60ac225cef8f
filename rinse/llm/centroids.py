"""Sums over the subtrees of a forest by centroid decomposition, in numpy for one task."""

from __future__ import annotations

import numpy as np


def preorder(parent: np.ndarray, depth: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The place of each node where every subtree stands in one run behind its top.

    ``parent`` is -1 for tops, ``size`` counts the nodes of a subtree.
    """
    place = np.zeros(len(parent), np.int64)
    tops = np.flatnonzero(parent < 0)
    place[tops] = np.cumsum(size[tops]) - size[tops]
    inner = np.flatnonzero(parent >= 0)
    inner = inner[np.lexsort((parent[inner], depth[inner]))]
    before = np.cumsum(size[inner]) - size[inner]
    first = np.ones(len(inner), bool)
    first[1:] = parent[inner][1:] != parent[inner][:-1]
    start = np.maximum.accumulate(np.where(first, np.arange(len(inner)), 0))
    beside = before - before[start]  # nodes below siblings further left
    levels = np.append(np.flatnonzero(np.diff(depth[inner], prepend=-1)), len(inner))
    for low, high in zip(levels[:-1], levels[1:], strict=True):
        nodes = inner[low:high]
        place[nodes] = place[parent[nodes]] + 1 + beside[low:high]
    return place


def subtree_sums(parent: np.ndarray, depth: np.ndarray, size: np.ndarray, values: np.ndarray) -> np.ndarray:
    """For each node the sums of ``values`` (nodes x columns, whole numbers) over its subtree.

    In each round every component is split at its centroid, the lowest node that has at least half of the
    component below it. What lies below the centroid is summed up and added to the centroid and to
    all nodes on its way to the top; the subtrees of its children and the rest go on as components
    of their own, of half the size at most. Each node is a centroid once.
    """
    place = preorder(parent, depth, size)
    order = np.argsort(place)
    moved = np.append(place, -1)  # a top's parent stays -1
    parent, values = moved[parent[order]], values[order]
    left = size[order].copy()  # nodes of the component below each node
    end = np.arange(len(left)) + left
    sums = np.zeros_like(values)
    active = np.arange(len(left))
    label = np.maximum.accumulate(np.where(parent < 0, active, 0))  # the component's top
    while len(active):
        starts = np.flatnonzero(np.diff(label, prepend=-1))
        run = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(active))))
        at = np.arange(len(active))
        heavy = 2 * left[active] >= left[label]
        centre = active[np.maximum.reduceat(np.where(heavy, at, -1), starts)]  # heavy nodes are a chain
        own = centre[run]
        below = (active >= own) & (active < end[own])
        part = np.add.reduceat(values[active] * below[:, None], starts, axis=0)
        above = (active < own) & (end[active] > own)
        sums[centre] += part
        sums[active[above]] += part[run[above]]
        left[active[above]] -= left[own[above]]
        tops = np.maximum.accumulate(np.where(below & (parent[active] == own), at, 0))
        label = np.where(below, active[tops], label)
        kept = active != own
        active, label = active[kept], label[kept]
        order_ = np.lexsort((active, label))
        active, label = active[order_], label[order_]
    return sums[place]
