"""Recompression of word sequences: runs and pairs of symbols get names that depend on them alone.

A round first names maximal runs of one symbol, then pairs (x, y) whose names have the bits 0 and 1
of the round. A name is a 64-bit hash of what it stands for, so that the same run or pair has the
same name in every task. Beside the words that a symbol covers, the words that decide it are kept:
wherever these words occur together, the same symbol stands there.
"""

from __future__ import annotations

import numpy as np

_M1, _M2, _M3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    """A well spread 64-bit hash of 64-bit numbers."""
    x = x + _M1
    x = (x ^ (x >> np.uint64(30))) * _M2
    x = (x ^ (x >> np.uint64(27))) * _M3
    return x ^ (x >> np.uint64(31))


class Symbols:
    """A sequence of symbols: name, covered words [lo, hi), words [left, right) that decide it.

    ``left`` is -1, or ``right`` lies beyond the last word, where something outside would decide.
    """

    def __init__(self, name, lo, hi, left, right, wall):
        self.name, self.lo, self.hi = name, lo, hi
        self.left, self.right, self.wall = left, right, wall

    def __len__(self):
        return len(self.name)


def words(names: np.ndarray, wall: np.ndarray) -> Symbols:
    """Every word as a symbol of its own; ``wall`` marks the gaps between documents."""
    at = np.arange(len(names), dtype=np.int64)
    return Symbols(names, at, at + 1, at, at + 1, wall)


def name_runs(s: Symbols, word: np.ndarray) -> Symbols:
    """Maximal runs of one symbol as one symbol.

    That a neighbour is another symbol is told by one word if its near end differs from the far
    end's counterpart here, else by all that decides the neighbour.
    """
    n = len(s)
    if n == 0:
        return s
    first = np.flatnonzero(np.r_[True, (s.name[1:] != s.name[:-1]) | s.wall[1:]])
    last = np.r_[first[1:] - 1, n - 1]
    times = (last - first + 1).astype(np.uint64)
    name = np.where(times > 1, mix(s.name[first] ^ mix(times)), s.name[first])
    lo, hi = s.lo[first], s.hi[last]
    left, right = np.minimum.reduceat(s.left, first), np.maximum.reduceat(s.right, first)
    before, after = np.maximum(first - 1, 0), np.minimum(last + 1, n - 1)
    near = np.maximum(lo - 1, 0)
    plain = (word[near] != word[s.hi[first] - 1]) | (lo == 0)
    left = np.minimum(left, np.where(plain, lo - 1, s.left[before]))
    right = np.where(plain, right, np.maximum(right, s.right[before]))
    near = np.minimum(hi, len(word) - 1)
    plain = (word[near] != word[s.lo[last]]) | (hi == len(word))
    right = np.maximum(right, np.where(plain, hi + 1, s.right[after]))
    left = np.where(plain, left, np.minimum(left, s.left[after]))
    return Symbols(name, lo, hi, left, right, s.wall[first])


def name_pairs(s: Symbols, turn: int) -> Symbols:
    """Pairs of a symbol with bit 0 and one with bit 1 as one symbol.

    A symbol that stays alone does so because of one neighbour: the one it would pair with.
    """
    n = len(s)
    if n < 2:
        return s
    bit = mix(s.name ^ mix(np.full(1, turn, np.uint64))) >> np.uint64(63) == 1
    joins = ~bit[:-1] & bit[1:] & ~s.wall[:-1] & ~s.wall[1:]
    head, tail = np.r_[joins, False], np.r_[False, joins]
    at = np.flatnonzero(~tail)
    end = at + head[at]
    after, before = np.minimum(at + 1, n - 1), np.maximum(at - 1, 0)
    pair = head[at]
    name = np.where(pair, mix(mix(s.name[at]) + s.name[end]), s.name[at])
    left, right = np.minimum(s.left[at], s.left[end]), np.maximum(s.right[at], s.right[end])
    other = np.where(bit[at], before, after)
    left = np.where(pair, left, np.minimum(left, s.left[other]))
    right = np.where(pair, right, np.maximum(right, s.right[other]))
    # what stands before the first and after the last symbol is not known
    left[0] = left[0] if pair[0] or not bit[0] else -1
    right[-1] = right[-1] if pair[-1] or bit[at[-1]] else s.hi[-1] + 1
    return Symbols(name, s.lo[at], s.hi[end], left, right, s.wall[at])


def levels(names: np.ndarray, wall: np.ndarray, rounds: int):
    """The words, then the symbols after each round of runs and pairs."""
    s = words(names, wall)
    yield s
    for turn in range(rounds):
        s = name_pairs(name_runs(s, names), turn)
        yield s
