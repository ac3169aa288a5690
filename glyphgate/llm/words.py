"""Words and their hashes for whole columns of texts, in numpy over Arrow buffers.

A word is a run of bytes other than U+0020 and U+0009-U+000D of the UTF-8 text.  Hashes are
64-bit: two of n different words share one with a probability of about n*n/2**65.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 4 << 20
_BLOCK = 1 << 16
_MASK = (1 << 64) - 1
_BASE = 0x9E3779B97F4A7C15
_U = np.uint64


def _powers(base: int) -> np.ndarray:
    out = np.full(_BLOCK, base, _U)
    out[0] = 1
    return np.multiply.accumulate(out)


_UP, _DOWN = _powers(_BASE), _powers(pow(_BASE, -1, 1 << 64))
_STEP, _STEP_DOWN = pow(_BASE, _BLOCK, 1 << 64), pow(pow(_BASE, -1, 1 << 64), _BLOCK, 1 << 64)
RAW = np.random.default_rng(20240601).integers(1, 1 << 63, 256, dtype=_U) * _U(2) + _U(1)
LOWER = RAW.copy()
LOWER[65:91] = RAW[97:123]

SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """Spread all bits of 64-bit values (a bijection)."""
    x = x ^ (x >> _U(32))
    x *= _U(0xD6E8FEB86659FD93)
    x ^= x >> _U(29)
    x *= _U(0xBF58476D1CE4E5B9)
    return x ^ (x >> _U(32))


def join(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Hash of an ordered pair of hashes."""
    return mix(left * _U(0xC2B2AE3D27D4EB4F) + (right ^ (right >> _U(31))) * _U(0x9FB21C651E98DF25))


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts end to end, and the n + 1 offsets of the texts; nulls are empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_string()).fill_null("")
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, np.int64)[texts.offset:texts.offset + len(texts) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[at[0]:at[-1]], at - at[0]


def chunks(batch: pa.RecordBatch, column: str, limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of a batch that hold at most ``limit`` bytes of text, or one longer text."""
    _, at = buffers(batch.column(column))
    first, n = 0, batch.num_rows
    while first < n:
        last = max(first + 1, int(np.searchsorted(at, at[first] + limit, "right")) - 1)
        yield batch.slice(first, last - first)
        first = last


def spans(data: np.ndarray, at: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of bytes that ``stop`` does not mark; no run crosses a text."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    open_ = ~stop[data]
    border = np.zeros(n + 1, bool)
    border[at] = True
    start = open_.copy()
    start[1:] &= ~open_[:-1] | border[1:n]
    end = open_.copy()
    end[:-1] &= ~open_[1:] | border[1:n]
    return np.flatnonzero(start), np.flatnonzero(end) + 1


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, table: np.ndarray = RAW) -> np.ndarray:
    """A 64-bit hash of each span; starts and ends ascend.  Work memory doesn't grow with the data."""
    low, high = np.empty(len(starts), _U), np.empty(len(starts), _U)
    base, step = 0, 1
    for b in range(0, len(data), _BLOCK):
        part = table[data[b:b + _BLOCK]]
        m = len(part)
        sums = np.zeros(m + 1, _U)
        np.cumsum(part * _UP[:m], out=sums[1:])
        sums = sums * _U(step) + _U(base)
        i, j = np.searchsorted(starts, (b, b + m))
        low[i:j] = sums[starts[i:j] - b]
        i, j = np.searchsorted(ends, (b + 1, b + m + 1))
        high[i:j] = sums[ends[i:j] - b]
        base, step = int(sums[m]), step * _STEP & _MASK
    big = np.ones(len(data) // _BLOCK + 1, _U)
    big[1:] = _STEP_DOWN
    big = np.multiply.accumulate(big)
    return mix((high - low) * _DOWN[starts % _BLOCK] * big[starts // _BLOCK])


class Words(NamedTuple):
    data: np.ndarray     # bytes of all texts
    at: np.ndarray       # n + 1 offsets of the texts
    starts: np.ndarray   # byte spans of the words
    ends: np.ndarray
    first: np.ndarray    # n + 1: words of text i are first[i]:first[i + 1]
    hashes: np.ndarray

    @property
    def rows(self) -> np.ndarray:
        """The text of each word."""
        return np.repeat(np.arange(len(self.at) - 1), np.diff(self.first))


def words(texts: pa.Array, lower: bool = False) -> Words:
    """All words of all texts; ``lower`` folds A-Z before hashing."""
    data, at = buffers(texts)
    starts, ends = spans(data, at, SPACE)
    return Words(data, at, starts, ends, np.searchsorted(starts, at),
                 span_hashes(data, starts, ends, LOWER if lower else RAW))


def shingles(w: Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each run of ``size`` words within a text, and the index of its first word."""
    n = len(w.hashes) - size + 1
    if n <= 0:
        return np.zeros(0, _U), np.zeros(0, np.int64)
    out = w.hashes[:n]
    for k in range(1, size):
        out = join(out, w.hashes[k:k + n])
    begins = np.flatnonzero(w.rows[:n] == w.rows[size - 1:])
    return out[begins], begins
