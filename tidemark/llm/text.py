"""Words and rolling hashes of many texts at once, as numpy arrays over one byte buffer.

A hash of a span is a polynomial modulo 2^64 with an odd base, mixed afterwards.
Word hashes are mixed before they enter a window's polynomial.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa

BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93)


@dataclass
class Texts:
    """UTF-8 bytes of some documents: document i is data[offsets[i]:offsets[i + 1]]."""

    data: np.ndarray
    offsets: np.ndarray

    def __len__(self) -> int:
        return len(self.offsets) - 1

    def take(self, at: np.ndarray) -> Texts:
        """The documents at the given places."""
        if len(at) == len(self):
            return self
        parts = [self.data[self.offsets[i] : self.offsets[i + 1]] for i in at.tolist()]
        data = np.concatenate(parts) if parts else np.zeros(0, np.uint8)
        return Texts(data, np.concatenate([[0], np.cumsum(np.diff(self.offsets)[at])]).astype(np.int64))

    def slices(self, most: int):
        """(first, last, Texts) of runs of whole documents of about `most` bytes; a longer document is alone."""
        i, n = 0, len(self)
        while i < n:
            j = max(i + 1, int(np.searchsorted(self.offsets, self.offsets[i] + most, "right")) - 1)
            o = self.offsets[i : j + 1]
            yield i, j, Texts(self.data[o[0] : o[-1]], o - o[0])
            i = j


def from_arrow(column) -> Texts:
    """Of an Arrow string array; a null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.fill_null("").cast(pa.large_binary())
    buffers = column.buffers()
    offsets = np.frombuffer(buffers[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None and buffers[2].size else np.zeros(0, np.uint8)
    return Texts(data[offsets[0] : offsets[-1]], offsets - offsets[0])


def byte_class(pattern_out: bytes) -> np.ndarray:
    """Table of the bytes that are part of a word: all but `pattern_out`."""
    inside = np.ones(256, bool)
    inside[list(pattern_out)] = False
    return inside


SPACES = bytes([0x20, *range(0x09, 0x0E)])
NOT_ALNUM = bytes([*range(0x00, 0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)])
WORD = byte_class(SPACES)
ALNUM = byte_class(NOT_ALNUM)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def lower(texts: Texts) -> Texts:
    """A-Z become a-z; all other bytes stay."""
    return Texts(_LOWER[texts.data], texts.offsets)


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit hash."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


TABLE_BITS = 18
TABLE = 1 << TABLE_BITS  # powers kept for each base: two megabytes, whatever the texts


@lru_cache(maxsize=2 * len(BASES))
def _table(base: int) -> np.ndarray:
    p = np.full(TABLE, base, np.uint64)
    p[0] = 1
    return np.multiply.accumulate(p)


def _steps(base: int, n: int) -> np.ndarray:
    """base^(TABLE * k) for as many k as n positions have blocks."""
    p = np.full(n // TABLE + 1, pow(base, TABLE, 1 << 64), np.uint64)
    p[0] = 1
    return np.multiply.accumulate(p)


def prefix(values: np.ndarray, base: int) -> np.ndarray:
    """Running sums of values[i] * base^i, with a zero in front; bytes count as one more than they are."""
    out = np.zeros(len(values) + 1, np.uint64)
    for k, step in enumerate(_steps(base, len(values)).tolist()):
        a, b = k * TABLE, min((k + 1) * TABLE, len(values))
        block = values[a:b]
        if block.dtype == np.uint8:
            block = block.astype(np.uint64) + np.uint64(1)
        block = block * _table(base)[: b - a]
        if k:
            block *= np.uint64(step)
        np.cumsum(block, out=out[a + 1 : b + 1])
        if k:
            out[a + 1 : b + 1] += out[a]
    return out


def spans_hash(sums: np.ndarray, start: np.ndarray, end: np.ndarray, base: int) -> np.ndarray:
    inverse = pow(base, -1, 1 << 64)
    if len(sums) <= TABLE:
        return (sums[end] - sums[start]) * _table(inverse)[start]
    back = _table(inverse)[start & (TABLE - 1)] * _steps(inverse, len(sums))[start >> TABLE_BITS]
    return (sums[end] - sums[start]) * back


def rolling_hash(sums: np.ndarray, width: int, base: int) -> np.ndarray:
    """`spans_hash` of the `width` items from each place on."""
    out = sums[width:] - sums[: len(sums) - width]
    inverse = pow(base, -1, 1 << 64)
    for k, step in enumerate(_steps(inverse, len(out)).tolist()):
        block = out[k * TABLE : (k + 1) * TABLE]
        block *= _table(inverse)[: len(block)]
        if step != 1:
            block *= np.uint64(step)
    return out


@dataclass
class Words:
    start: np.ndarray  # byte offsets in Texts.data
    end: np.ndarray
    first: np.ndarray  # words of document i: first[i]:first[i + 1]

    def counts(self) -> np.ndarray:
        return np.diff(self.first)


def words(texts: Texts, inside: np.ndarray) -> Words:
    """Maximal runs of bytes of the class; no run crosses a document."""
    n = len(texts.data)
    mask = np.zeros(n + 1, bool)
    mask[:n] = inside[texts.data]
    edges = texts.offsets
    before = np.zeros(n + 1, bool)
    before[1:] = mask[:-1]
    before[edges] = False
    start = np.flatnonzero(mask & ~before)
    after = np.zeros(n + 1, bool)
    after[:-1] = mask[1:]
    after[edges[edges > 0] - 1] = False
    end = np.flatnonzero(mask & ~after) + 1
    return Words(start, end, np.searchsorted(start, edges))


def word_hashes(texts: Texts, w: Words) -> np.ndarray:
    sums = prefix(texts.data, BASES[0])
    h = spans_hash(sums, w.start, w.end, BASES[0])
    return mix(h + (w.end - w.start).astype(np.uint64) * np.uint64(BASES[1]))


def windows(counts: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(start item, document) of each window of `size` items inside a document of counts[i] items."""
    each = np.maximum(counts - size + 1, 0)
    doc = np.repeat(np.arange(len(counts)), each)
    first = np.cumsum(counts) - counts
    shift = np.cumsum(each) - each
    return np.arange(int(each.sum())) - np.repeat(shift, each) + np.repeat(first, each), doc


def window_hashes(hashes: np.ndarray, start: np.ndarray, size, seed: int = 0) -> np.ndarray:
    """Of hashes[start:start + size]; different seeds give independent hashes of the same items."""
    base = BASES[1 + seed % 2]
    items = mix(hashes + np.uint64((seed * 2 + 1) * BASES[2] % (1 << 64))) if seed else hashes
    sums = prefix(items, base)
    return mix(spans_hash(sums, start, start + size, base) + np.uint64(seed))


def covered(start: np.ndarray, size: int, total: int) -> np.ndarray:
    """Mask of the items covered by windows of `size` that begin at `start`."""
    step = np.bincount(start, minlength=total + 1) - np.bincount(np.minimum(start + size, total), minlength=total + 1)
    return np.cumsum(step)[:total] > 0
