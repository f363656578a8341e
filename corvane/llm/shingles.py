"""Hashed word shingles of whole texts, with numpy.

Words are ``[^\\x20\\x09-\\x0D]+`` of the text with A-Z lower-cased; a shingle is a run of ``size``
words, or all words where there are fewer. Words and shingles stand as 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_LOWER = np.arange(256, dtype=np.uint64)
_LOWER[65:91] += np.uint64(32)
_GAP = np.zeros(256, bool)
_GAP[[9, 10, 11, 12, 13, 32]] = True
#: An odd base of the polynomial hash and its inverse modulo 2 ** 64.
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
#: Longer texts are hashed piece by piece, cut in white space.
PIECE = 1 << 20


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every bit of the input reaches every bit of the output."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def mix_int(x: int) -> int:
    return int(mix(np.array([x & (2**64 - 1)], np.uint64))[0])


class _Powers:
    def __init__(self) -> None:
        self.up = self.down = np.ones(1, np.uint64)

    def upto(self, n: int) -> None:
        if n > len(self.up):
            n = max(n, 2 * len(self.up), 1 << 14)
            factors = np.full(n, _BASE, np.uint64)
            factors[0] = 1
            self.up = np.multiply.accumulate(factors)
            factors[1:] = _INVERSE
            self.down = np.multiply.accumulate(factors)


_POWERS = _Powers()


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n or more powers of the base of the polynomial hash, and their inverses."""
    _POWERS.upto(n)
    return _POWERS.up, _POWERS.down


def _piece_words(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    gap = _GAP[raw]
    edges = np.flatnonzero(np.diff(np.concatenate([[True], gap, [True]]).astype(np.int8)))
    starts, ends = edges[::2], edges[1::2]
    _POWERS.upto(len(raw) + 1)
    sums = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum((_LOWER[raw] + np.uint64(1)) * _POWERS.up[: len(raw)], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * _POWERS.down[starts] + (ends - starts).astype(np.uint64)), starts


def words_of(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The words' hashes and their first bytes, in order, of a text's UTF-8 bytes."""
    if len(raw) <= PIECE:
        return _piece_words(raw)
    out, at = [], 0
    while at < len(raw):
        end = at + PIECE
        gaps = np.flatnonzero(_GAP[raw[end : end + PIECE]]) if end < len(raw) else []
        while end < len(raw) and not len(gaps):  # a word longer than a piece
            end += PIECE
            gaps = np.flatnonzero(_GAP[raw[end : end + PIECE]])
        end = min(len(raw), end + int(gaps[0])) if len(gaps) else len(raw)
        hashes, starts = _piece_words(raw[at:end])
        out.append((hashes, starts + at))
        at = end
    return np.concatenate([x for x, _ in out]), np.concatenate([x for _, x in out])


@dataclass
class Batch:
    """Several texts at once. raw: their bytes, each text ended by a line feed; words and starts: the words'
    hashes and first bytes; doc: the number of the text that a word is in; edges: each text's first byte."""

    raw: np.ndarray
    words: np.ndarray
    starts: np.ndarray
    doc: np.ndarray
    edges: np.ndarray

    @property
    def first_word(self) -> np.ndarray:
        return np.searchsorted(self.starts, self.edges)

    def points(self, first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First and end code point, in their text, of the runs from the words ``first`` to ``last``."""
        gaps = np.flatnonzero(_GAP[self.raw])
        points = np.concatenate([[0], np.cumsum((self.raw & 0xC0) != 0x80)])
        base = points[self.edges[self.doc[first]]]
        return points[self.starts[first]] - base, points[gaps[np.searchsorted(gaps, self.starts[last])]] - base


def batches_of(batches: Iterator[pa.RecordBatch], most: int = PIECE) -> Iterator[tuple[pa.RecordBatch, Batch]]:
    """The rows, by column text, in slices of about ``most`` bytes (a longer text by itself)."""
    for batch in batches:
        text = pc.binary_join_element_wise(pc.fill_null(batch.column("text"), ""), "", "\n")
        offsets = np.frombuffer(text.buffers()[1], np.int32 if pa.types.is_string(text.type) else np.int64)[text.offset : text.offset + len(text) + 1].astype(np.int64)
        data, at = np.frombuffer(text.buffers()[2] or b"", np.uint8), 0
        while at < len(text):
            end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most, "right")) - 1)
            raw = data[offsets[at] : offsets[end]]
            edges = offsets[at:end] - offsets[at]
            words, starts = words_of(raw)
            yield batch.slice(at, end - at), Batch(raw, words, starts, np.searchsorted(edges, starts, "right") - 1, edges)
            at = end


def word_hashes(text: str) -> np.ndarray:
    """The hashes of the words, in order."""
    return words_of(np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8))[0]


def rolled(words: np.ndarray, size: int) -> np.ndarray:
    """The hash of each shingle, in order."""
    if not len(words):
        return words
    n = max(len(words) - size + 1, 1)
    out = words[:n].copy()
    for k in range(1, min(size, len(words))):
        out = mix(out * np.uint64(3) + words[k : k + n])
    return out


def shingle_set(text: str, size: int) -> np.ndarray:
    """The distinct shingles' hashes, ascending."""
    return np.unique(rolled(word_hashes(text), size))


def set_id(hashes: np.ndarray) -> int:
    """A signed 64-bit name of a set of hashes; 0 is the empty set."""
    if not len(hashes):
        return 0
    with np.errstate(over="ignore"):
        both = int(mix(hashes).sum(dtype=np.uint64)) ^ mix_int(int(np.bitwise_xor.reduce(mix(hashes ^ np.uint64(_BASE)))) + len(hashes))
    return (both or 1) - (1 << 64) if both >= 1 << 63 else both or 1
