"""Suffix arrays by linear grouping.

Phase one orders the suffixes by their Lyndon prefixes. Suffixes start out in groups by first symbol. Groups are processed
in descending order: every suffix of a group points to the nearest earlier suffix of a smaller group, and the suffixes
pointed to are moved out of their group, into a new one right after it, those with more pointers higher. Phase two walks
the order so far: behind each placed suffix, the chain of pointers from its left neighbour names those that come next in
their groups. No symbol is renamed on the way and there is no recursion.
"""

from __future__ import annotations

import numpy as np


def suffix_array(symbols: np.ndarray) -> list[int]:
    """Starts of all suffixes of non-negative integers in ascending order; a suffix is smaller than its extensions."""
    text = np.append(np.asarray(symbols, dtype=np.int64) + 1, 0)  # the end is the smallest symbol
    n = len(text)
    first = np.argsort(text, kind="stable")
    ordered = text[first]
    starts = np.flatnonzero(np.concatenate(([True], ordered[1:] != ordered[:-1])))
    sizes = np.diff(np.append(starts, n))
    group_of = np.empty(n, dtype=np.int64)
    group_of[first] = np.repeat(starts, sizes)
    place = np.empty(n, dtype=np.int64)
    place[first] = np.arange(n)
    size_at = np.zeros(n, dtype=np.int64)
    size_at[starts] = sizes
    order, at, group, size = first.tolist(), place.tolist(), group_of.tolist(), size_at.tolist()
    before = [-1] * n

    def move(suffix: int) -> int:
        """Put a suffix behind the rest of its group, which shrinks; the group's start."""
        start = group[suffix]
        size[start] -= 1
        end = start + size[start]
        other, spot = order[end], at[suffix]
        order[spot], at[other] = other, spot
        order[end], at[suffix] = suffix, end
        return start

    high = n
    while high:
        low = group[order[high - 1]]
        if high - low == 1:
            suffix = order[low]
            left = suffix - 1
            while left >= 0 and group[left] > low:
                left = before[left]
            before[suffix] = left
            if left >= 0:
                start = group[left]
                if size[start] > 1:
                    move(left)
                    end = start + size[start]
                    size[end] = 1
                    group[left] = end
        else:
            pointed: dict[int, int] = {}
            for suffix in sorted(order[low:high]):
                left = suffix - 1
                while left >= 0 and group[left] >= low:
                    left = before[left]
                before[suffix] = left
                if left >= 0:
                    pointed[left] = pointed.get(left, 0) + 1
            by_count: dict[int, list[int]] = {}
            for suffix, count in pointed.items():
                by_count.setdefault(count, []).append(suffix)
            for count in sorted(by_count, reverse=True):
                moved: dict[int, list[int]] = {}
                for suffix in by_count[count]:
                    moved.setdefault(move(suffix), []).append(suffix)
                for start, suffixes in moved.items():
                    if not size[start]:  # the whole group was moved: it stays what it was
                        size[start] = len(suffixes)
                        continue
                    end = start + size[start]
                    size[end] = len(suffixes)
                    for suffix in suffixes:
                        group[suffix] = end
        high = low

    result, slot, placed = [0] * n, list(range(n)), bytearray(n)
    result[0], placed[n - 1], slot[0] = n - 1, 1, 1
    for k in range(n):
        suffix = result[k] - 1
        while suffix >= 0 and not placed[suffix]:
            start = group[suffix]
            result[slot[start]] = suffix
            slot[start] += 1
            placed[suffix] = 1
            suffix = before[suffix]
    return result[1:]


def ranks(strings: list[bytes], width: int) -> tuple[np.ndarray, np.ndarray]:
    """(rank of each string, common prefix of each rank with the one before), for strings padded with zeros to ``width``.

    The strings are read as words of eight bytes, so the order of symbols is that of bytes, and set one after the other
    into one text; the suffixes that start a string give the order. Equal strings share a rank.
    """
    width += -width % 8
    distinct: dict[bytes, int] = {}
    number = np.array([distinct.setdefault(s.ljust(width, b"\0"), len(distinct)) for s in strings], dtype=np.int64)
    if not distinct:
        return number, np.zeros(0, dtype=np.int64)
    words = np.frombuffer(b"".join(distinct), dtype=">u8").reshape(len(distinct), -1).astype(np.uint64)
    symbols = np.unique(words, return_inverse=True)[1].reshape(words.shape) + 1
    text = np.concatenate([symbols, np.zeros((len(words), 1), dtype=np.int64)], axis=1).reshape(-1)
    order = np.array(suffix_array(text), dtype=np.int64)
    step = words.shape[1] + 1
    order = order[order % step == 0] // step
    rank = np.empty(len(words), dtype=np.int64)
    rank[order] = np.arange(len(words))
    sorted_words = words[order]
    same = sorted_words[1:] == sorted_words[:-1]
    equal = np.cumprod(same, axis=1).sum(axis=1)  # words before the first difference; distinct strings differ somewhere
    pair = np.arange(len(equal))
    differ = sorted_words[1:][pair, equal] ^ sorted_words[:-1][pair, equal]
    common = np.zeros(len(words), dtype=np.int64)
    common[1:] = equal * 8 + _leading_zero_bytes(differ)
    return rank[number], common


def _leading_zero_bytes(values: np.ndarray) -> np.ndarray:
    out = np.zeros(len(values), dtype=np.int64)
    for shift in range(8, 64, 8):
        out += values < np.uint64(1 << (64 - shift))
    return out
