"""Suffix arrays and longest common prefixes of many short texts, in numpy."""

from __future__ import annotations

import numpy as np

SYMBOLS = 7  # of nine bits, in one 63-bit key


class Suffixes:
    """All suffixes of texts that are joined by ends, each of which differs from all others.

    ``order`` is the suffix array, ``common[k]`` the length of the longest common prefix of the
    suffixes ``order[k - 1]`` and ``order[k]``. With a ``depth`` suffixes are sorted by that many
    symbols only; ``first[k]`` says whether those of ``order[k - 1]`` and ``order[k]`` differ, and
    there is no ``common``.
    """

    def __init__(self, data: np.ndarray, lengths: np.ndarray, depth: int | None = None) -> None:
        """``data`` holds the bytes of the texts one after another."""
        self._depth = depth or max(SYMBOLS, len(data) + len(lengths))
        stops = np.cumsum(lengths)
        symbols = np.zeros(len(data) + len(lengths), np.int64)
        text = np.repeat(np.arange(len(lengths)), lengths)
        symbols[np.arange(len(data)) + text] = data.astype(np.int64) + 1
        self.starts = np.concatenate([[0], stops[:-1] + np.arange(1, len(lengths))]).astype(np.int64)
        self._symbols = symbols
        self._keys = self._packed()
        self._sort()
        if depth is None:
            self._compare()

    def _packed(self) -> np.ndarray:
        """The next symbols of each place as one number; nothing counts behind an end."""
        padded = np.concatenate([self._symbols, np.zeros(SYMBOLS, np.int64)])
        n = len(self._symbols)
        keys, alive = np.zeros(n, np.int64), np.ones(n, bool)
        for step in range(min(SYMBOLS, self._depth)):
            symbol = np.where(alive, padded[step : step + n], 0)
            keys = (keys << 9) | symbol
            alive &= symbol != 0
        return keys

    def _sort(self) -> None:
        """Larsson-Sadakane: groups that share h symbols are sorted by the groups h places on.

        Where three ranks fit into a key, the groups 2 h places on are used too.
        """
        n = len(self._keys)
        # ends differ in the order of their places, which a stable sort keeps
        order = np.argsort(self._keys, kind="stable")
        keys = self._keys[order]
        first = np.ones(n, bool)
        first[1:] = (keys[1:] != keys[:-1]) | (keys[1:] & 511 == 0)
        group = np.maximum.accumulate(np.where(first, np.arange(n), 0))
        rank = np.empty(n, np.int32 if n < 1 << 31 else np.int64)
        bits = n.bit_length()
        ranks = 3 if 3 * bits < 64 else 2
        rank[order] = group
        places = np.arange(n)
        have = min(SYMBOLS, self._depth)
        while True:
            last = np.append(first[1:], True)
            places = places[~(first & last)[places]] if len(places) < n else np.flatnonzero(~(first & last))
            if not len(places) or have == self._depth:
                break
            reach = min(have * ranks, self._depth)
            suffixes = order[places]
            keys = rank[suffixes].astype(np.int64)
            for step in range(1, ranks):  # behind an end nothing decides: ends are unique
                keys = (keys << bits) | rank[np.minimum(suffixes + min(step * have, reach - have), n - 1)]
            turn = np.argsort(keys)
            keys, suffixes = keys[turn], suffixes[turn]
            order[places] = suffixes
            begins = np.ones(len(places), bool)
            begins[1:] = keys[1:] != keys[:-1]
            first[places] = begins
            rank[suffixes] = places[np.maximum.accumulate(np.where(begins, np.arange(len(places)), 0))]
            have = reach
        self.order, self.first = order, first

    def _compare(self) -> None:
        """Kasai: a prefix is at most one shorter than that of the place before.

        Where the symbols before a suffix and before its neighbour are equal it is exactly one
        shorter, so only the other places are compared, all of them at once.
        """
        n = len(self.order)
        before = np.full(n, -1, np.int64)  # of each suffix the one in front of it in the order
        before[self.order[1:]] = self.order[:-1]
        compared = np.ones(n, bool)
        at = np.arange(1, n)
        at = at[(before[1:] > 0)]
        symbol = self._symbols[at - 1]
        compared[at] = (symbol != self._symbols[before[at] - 1]) | (symbol == 0)
        compared[0] = True
        prefix = np.zeros(n, np.int64)
        one = np.flatnonzero(compared & (before >= 0))
        other, start = before[one], one.copy()
        limit = n - 1
        here = one
        while len(start):
            left, right = self._keys[np.minimum(here, limit)], self._keys[np.minimum(other, limit)]
            differ = left ^ right
            equal = (differ == 0) & (left & 511 != 0)
            # symbols before the first different one, or before both ends
            bits = np.frexp(differ.astype(np.float64))[1]
            exact = np.where(differ >> np.maximum(bits - 1, 0) == 0, bits - 1, bits)  # if rounded up
            shared = np.where(differ != 0, SYMBOLS - 1 - (exact - 1) // 9, self._before_end(left))
            done = ~equal
            prefix[start[done]] += shared[done]
            prefix[start[equal]] += SYMBOLS
            start, here, other = start[equal], here[equal] + SYMBOLS, other[equal] + SYMBOLS
        latest = np.maximum.accumulate(np.where(compared, np.arange(n), 0))
        prefix = np.where(compared, prefix, prefix[latest] - (np.arange(n) - latest))
        self.common = prefix[self.order]

    @staticmethod
    def _before_end(keys: np.ndarray) -> np.ndarray:
        count = np.zeros(len(keys), np.int64)
        for step in range(SYMBOLS):
            count += keys >> (9 * step) & 511 != 0
        return count
