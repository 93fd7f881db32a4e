"""Suffix array of many short strings by grouping suffixes on their Lyndon prefixes.

The strings are taken as one text in which each ends with a mark of its own, smaller than every byte, a later mark smaller
than an earlier one. A suffix's Lyndon prefix ends where the next smaller suffix begins. Suffixes with one Lyndon
prefix form a group, and groups are ordered as their prefixes are. Previous-smaller pointers link each suffix to the
nearest smaller one on its left. With the groups laid out from the largest down, one pass emits the order inside each
of them: the suffix at hand tells which suffixes on its left go on with it, and these take the next free places of
their groups. No group is sorted by renaming, and the order of a suffix never needs those of halves of it.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from plantwatch.llm.textblocks import ragged

SYMBOLS, BITS = 7, 9  # a machine word holds seven symbols: 0 for nothing, else a byte + 1
KEEP = np.array([((1 << BITS * k) - 1) << (BITS * (SYMBOLS - k)) for k in range(SYMBOLS + 1)], np.uint64)


@dataclass
class Strings:
    """Texts laid end to end, each followed by its mark. `end` is the place of the mark behind each position."""

    symbols: np.ndarray
    end: np.ndarray
    words: np.ndarray
    depth: int

    @classmethod
    def of(cls, data: np.ndarray, lengths: np.ndarray) -> Strings:
        """From concatenated bytes and the length of each string."""
        n, total = len(lengths), int(lengths.sum())
        firsts = np.cumsum(lengths + 1) - lengths - 1
        symbols = np.zeros(total + n, np.uint64)
        symbols[ragged(firsts, lengths)] = data.astype(np.uint64) + np.uint64(1)
        end = np.repeat(firsts + lengths, lengths + 1)
        padded = np.concatenate([symbols, np.zeros(SYMBOLS, np.uint64)])
        words = np.zeros(len(symbols), np.uint64)
        for k in range(SYMBOLS):
            words |= padded[k : k + len(symbols)] << np.uint64(BITS * (SYMBOLS - 1 - k))
        words &= KEEP[np.minimum(end - np.arange(len(end)), SYMBOLS)]
        return cls(symbols, end, words, -(-int(lengths.max(initial=0) + 1) // SYMBOLS))

    def word(self, x: np.ndarray, k: int) -> np.ndarray:
        """Word k of the suffixes at x; nothing lies behind the end of a string."""
        at = x + k * SYMBOLS
        last = self.end[x]
        return np.where(at < last, self.words[np.minimum(at, last)], 0)

    def smaller(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Whether the suffix at x is smaller than that at y, for pairs of different positions."""
        out = np.zeros(len(x), dtype=bool)
        same = np.arange(len(x))
        for k in range(self.depth):
            a, b = self.word(x[same], k), self.word(y[same], k)
            out[same] = a < b
            same = same[a == b]
            if not len(same):
                return out
        out[same] = x[same] > y[same]
        return out

    def share(self, x: np.ndarray, y: np.ndarray, length: int) -> np.ndarray:
        """Whether the suffixes at x and y begin with the same `length` bytes of their strings."""
        out = (self.end[x] - x >= length) & (self.end[y] - y >= length)
        for k in range(0, length, SYMBOLS):
            same = np.flatnonzero(out)
            keep = KEEP[min(SYMBOLS, length - k)]
            out[same] = (self.words[x[same] + k] ^ self.words[y[same] + k]) & keep == 0
        return out


def smaller_pointers(strings: Strings) -> tuple[np.ndarray, np.ndarray]:
    """For each suffix the next smaller one on its right (n if none) and on its left (-1 if none), by pointer jumping.

    Whatever lies between a suffix and the one its pointer names is larger than the suffix itself, so a pointer that names a
    larger suffix can take over that one's pointer.
    """
    n = len(strings.symbols)
    after = np.arange(1, n + 1)
    todo = np.arange(n)
    while len(todo):
        todo = todo[after[todo] < n]
        todo = todo[strings.smaller(todo, after[todo])]
        after[todo] = after[after[todo]]
    before = np.arange(-1, n - 1)
    todo = np.arange(n)
    while len(todo):
        todo = todo[before[todo] >= 0]
        todo = todo[strings.smaller(todo, before[todo])]
        before[todo] = before[before[todo]]
    return after, before


def lyndon_groups(strings: Strings, after: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The group of each suffix, groups numbered in ascending order, and where each group starts in the suffix array."""
    n = len(after)
    marks = np.flatnonzero(strings.symbols == 0)[::-1]
    rest = np.flatnonzero(strings.symbols)
    length = after - np.arange(n)
    first = strings.words[rest] & KEEP[np.minimum(length[rest], SYMBOLS)]
    by_first = np.argsort(first, kind="stable")
    order, value = rest[by_first], first[by_first]
    new = np.ones(len(order), dtype=bool)
    new[1:] = value[1:] != value[:-1]
    for k in range(1, strings.depth):
        # Refine the groups with members whose prefixes go on.
        label = np.cumsum(new) - 1
        going_on = np.zeros(len(order), dtype=bool)
        going_on[label[length[order] > SYMBOLS * k]] = True
        at = np.flatnonzero(going_on[label] & (np.bincount(label, minlength=1)[label] > 1))
        if not len(at):
            break
        members, owner = order[at], label[at]
        part = strings.word(members, k) & KEEP[np.clip(length[members] - SYMBOLS * k, 0, SYMBOLS)]
        sub = np.lexsort((part, owner))
        order[at], value, owner = members[sub], part[sub], owner[sub]
        new[at[1:]] |= (value[1:] != value[:-1]) & (owner[1:] == owner[:-1])
    group = np.empty(n, np.int64)
    group[marks] = np.arange(len(marks))
    group[order] = np.cumsum(new) - 1 + len(marks)
    return group, np.concatenate([np.arange(len(marks)), np.flatnonzero(new) + len(marks)])


def suffix_array(strings: Strings) -> np.ndarray:
    """Positions of the laid-out text in the order of their suffixes."""
    n = len(strings.symbols)
    after, before = smaller_pointers(strings)
    group, starts = lyndon_groups(strings, after)
    # The largest group has the last places, so each group's first place is known before any place is filled.
    free = starts.tolist()
    group_of, left = group.tolist(), before.tolist()
    out = [-1] * n
    placed = bytearray(n + 1)
    todo = n  # the empty suffix behind the text is the smallest of all
    for k in range(n + 1):
        at = todo - 1
        while at >= 0 and not placed[at]:
            g = group_of[at]
            out[free[g]] = at
            free[g] += 1
            placed[at] = 1
            at = left[at]
        if k < n:
            todo = out[k]
    return np.array(out, np.int64)
