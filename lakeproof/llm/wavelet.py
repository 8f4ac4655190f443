"""Suffix arrays with their dyadic blocks, and wavelet trees for range successors, as whole-array steps."""

from __future__ import annotations

import numpy as np


class Blocks:
    """The suffix array of a sequence of symbols, and for each dyadic length the slots of the suffixes that begin alike.

    ``names[k][i]`` is the first slot of the suffixes whose first 2^k symbols are those at ``i``, and ``sizes[k]`` has the
    number of slots at each first slot. So a block of length 2^k is known by its name, and its occurrences are
    ``order[name : name + size]``. Doubling ends when no block is repeated. The sequence must end with a symbol of its own.
    """

    def __init__(self, symbols: np.ndarray) -> None:
        n = len(symbols)
        self.order = np.argsort(symbols, kind="stable").astype(np.int32)
        ordered = symbols[self.order]
        first = np.ones(n + 1, dtype=bool)  # slots that start a group
        first[1:n] = ordered[1:] != ordered[:-1]
        name = np.empty(n, dtype=np.int32)
        starts = np.flatnonzero(first)
        name[self.order] = np.repeat(starts[:-1], np.diff(starts))
        self.names, self.sizes = [name], [self._sizes(n, starts[:-1], np.diff(starts))]
        length = 1
        while len(open_slots := np.flatnonzero(~(first[:-1] & first[1:]))):
            at = self.order[open_slots]
            # a repeated block does not reach the last symbol, so the block after it exists
            key = name[at].astype(np.int64) * n + name[at + length]
            sort = np.argsort(key)
            at, key = at[sort], key[sort]
            self.order[open_slots] = at
            new = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
            counts = np.diff(np.append(new, len(key)))
            starts = open_slots[new]
            name = name.copy()
            name[at] = np.repeat(starts, counts)
            first[starts] = True
            self.names.append(name)
            self.sizes.append(self._sizes(n, starts, counts))
            length *= 2

    @staticmethod
    def _sizes(n: int, starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
        out = np.ones(n, dtype=np.int32)
        out[starts] = counts
        return out

    def common_after(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """How many symbols from ``a`` and from ``b`` on are equal; a < b."""
        a, b, last = a.copy(), b.copy(), len(self.order) - 1
        start = a.copy()
        for k in range(len(self.names) - 1, -1, -1):
            name = self.names[k]
            step = (name[a] == name[np.minimum(b, last)]) & (b <= last)
            a[step] += 1 << k
            b[step] += 1 << k
        return a - start

    def common_before(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """How many symbols before ``a`` and before ``b`` are equal; a < b."""
        a, b = a.copy(), b.copy()
        start = a.copy()
        for k in range(len(self.names) - 1, -1, -1):
            name, length = self.names[k], 1 << k
            step = (a >= length) & (name[np.maximum(a - length, 0)] == name[np.maximum(b - length, 0)])
            a[step] -= length
            b[step] -= length
        return start - a


class WaveletTree:
    """Counts and successors in ranges of an array of non-negative integers, one step per bit for all queries at once."""

    def __init__(self, values: np.ndarray) -> None:
        self.bits = int(values.max(initial=0)).bit_length()
        self.levels = []  # how many of the values before a place have a zero at this bit; the last entry is all of them
        for bit in range(self.bits - 1, -1, -1):
            one = (values >> bit & 1).astype(bool)
            self.levels.append(np.concatenate((np.zeros(1, dtype=np.int32), np.cumsum(~one, dtype=np.int32))))
            values = np.concatenate((values[~one], values[one]))

    def _smaller(self, low: np.ndarray, high: np.ndarray, limit: np.ndarray) -> np.ndarray:
        """How many values of [low, high) are below the limit."""
        found = np.where(limit >> self.bits > 0, high - low, 0)
        open_ = limit >> self.bits == 0
        for bit, zeros in zip(range(self.bits - 1, -1, -1), self.levels, strict=True):
            low0, high0, one = zeros[low], zeros[high], limit >> bit & 1 == 1
            found += np.where(one & open_, high0 - low0, 0)
            low = np.where(one, zeros[-1] + low - low0, low0)
            high = np.where(one, zeros[-1] + high - high0, high0)
        return found

    def _ranked(self, low: np.ndarray, high: np.ndarray, rank: np.ndarray) -> np.ndarray:
        """The value of that rank in [low, high)."""
        value = np.zeros(len(low), dtype=np.int64)
        for bit, zeros in zip(range(self.bits - 1, -1, -1), self.levels, strict=True):
            low0, high0 = zeros[low], zeros[high]
            one = rank >= high0 - low0
            rank = np.where(one, rank - (high0 - low0), rank)
            value |= one.astype(np.int64) << bit
            low = np.where(one, zeros[-1] + low - low0, low0)
            high = np.where(one, zeros[-1] + high - high0, high0)
        return value

    def successor(self, low: np.ndarray, high: np.ndarray, at_least: np.ndarray) -> np.ndarray:
        """The smallest value of [low, high) that is at least so large; -1 without any."""
        rank = self._smaller(low, high, at_least)
        out = np.full(len(low), -1, dtype=np.int64)
        there = rank < high - low
        out[there] = self._ranked(low[there], high[there], rank[there])
        return out
