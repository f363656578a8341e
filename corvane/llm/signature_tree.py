"""Signature trees over sets of hashes, and a dual traversal that finds pairs which may be similar.

A leaf is one set: a bitmap with the bits that its tokens fall on, its size and its excess (tokens
beyond the bitmap's set bits, which collisions cause). A node holds the OR of its children's
bitmaps, the range of their sizes, their largest excess and, where all below are known to be
connected, their label. Two nodes' sets can't have more tokens in common than

    bits that both bitmaps have + the lesser of the two excesses

and similar sets need at least t / (1 + t) times the sum of their sizes. A pair of nodes that can't
reach that, or all of whose sets are connected already, is dropped with everything below it.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

FANOUT = 8
#: Pairs looked at in one step of a traversal, to bound its memory.
STEP = 1 << 16


def width(size: int) -> int:
    """Bits of the bitmap of a set of that size: a power of two, at least twice the size: what
    unlike sets have in common by chance stays well under what similar ones need."""
    return 64 << max(0, (2 * max(size, 1) - 1).bit_length() - 6)


def bitmap(hashes: np.ndarray, bits: int) -> np.ndarray:
    """uint64 words."""
    flags = np.zeros(bits, np.uint8)
    flags[(hashes & np.uint64(bits - 1)).astype(np.int64)] = 1
    return np.packbits(flags, bitorder="little").view("<u8")


def folded(words: np.ndarray, bits: int) -> np.ndarray:
    """A bitmap made narrower: halves are ORed, as a token's bit is its hash modulo the width."""
    while len(words) * 64 > bits:
        half = len(words) // 2
        words = words[:half] | words[half:]
    return words


@dataclass
class _Level:
    maps: np.ndarray
    least: np.ndarray
    most: np.ndarray
    excess: np.ndarray
    label: np.ndarray  # -1: several


class Tree:
    """Levels from the sets (0) to the root."""

    def __init__(self, maps: np.ndarray, sizes: np.ndarray, labels: np.ndarray) -> None:
        bits = np.bitwise_count(maps).sum(axis=1, dtype=np.int64)
        self.levels = [_Level(maps, sizes, sizes, np.maximum(sizes - bits, 0), labels)]
        while len(self.levels[-1].least) > 1:
            self.levels.append(self._parents(self.levels[-1]))

    @staticmethod
    def _parents(x: _Level) -> _Level:
        at = np.arange(0, len(x.least), FANOUT)
        low, high = np.minimum.reduceat(x.label, at), np.maximum.reduceat(x.label, at)
        return _Level(np.bitwise_or.reduceat(x.maps, at, axis=0), np.minimum.reduceat(x.least, at), np.maximum.reduceat(x.most, at), np.maximum.reduceat(x.excess, at), np.where((low == high) & (low >= 0), low, -1))

    def pairs(self, num: int, den: int):
        """Blocks (i, j, most) with i < j: sets that may be similar and aren't connected, and the
        most tokens that they can have in common."""
        top = len(self.levels) - 1
        stack = [(top, np.zeros(1, np.int64), np.zeros(1, np.int64))]
        while stack:
            k, i, j = stack.pop()
            if len(i) > STEP:
                stack += [(k, i[n : n + STEP], j[n : n + STEP]) for n in range(0, len(i), STEP)]
                continue
            x = self.levels[k]
            fits = (x.most[i] * den >= x.least[j] * num) & (x.most[j] * den >= x.least[i] * num) & ((x.label[i] != x.label[j]) | (x.label[i] < 0))
            if k == 0:
                fits &= i < j
            i, j = i[fits], j[fits]
            most = np.bitwise_count(x.maps[i] & x.maps[j]).sum(axis=1, dtype=np.int64) + np.minimum(x.excess[i], x.excess[j])
            fits = most * (num + den) >= num * (x.least[i] + x.least[j])
            i, j, most = i[fits], j[fits], most[fits]
            if not len(i):
                continue
            if k == 0:
                yield i, j, most
                continue
            below = len(self.levels[k - 1].least)
            child = np.arange(FANOUT)
            a = np.repeat(i[:, None] * FANOUT + child, FANOUT, axis=1).ravel()
            b = np.tile(j[:, None] * FANOUT + child, (1, FANOUT)).ravel()
            ok = (a < below) & (b < below) & (a <= b)
            stack.append((k - 1, a[ok], b[ok]))


class Forest:
    """Union-find over 0..n-1."""

    def __init__(self, n: int) -> None:
        self.up = list(range(n))

    def root(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x

    def join(self, x: int, y: int) -> bool:
        x, y = self.root(x), self.root(y)
        self.up[max(x, y)] = min(x, y)
        return x != y
