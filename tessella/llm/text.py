"""Word, shingle and byte-code hashing of whole Arrow text columns with numpy.

A word is a run of bytes other than 0x20 and 0x09-0x0D, A-Z lower-cased. A word's hash is a
polynomial over random 64-bit byte values modulo 2**64, taken for all words of a chunk at once
from one running sum, and then mixed.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text handled at once.
CHUNK = 1 << 20
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_VALUES = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
IS_WORD = np.ones(256, dtype=bool)
IS_WORD[[0x20, 9, 10, 11, 12, 13]] = False
#: Bytes of words without punctuation: ASCII letters and digits, and all bytes beyond ASCII.
IS_ALNUM = np.array([b > 127 or chr(b).isalnum() for b in range(256)])
_powers: dict[int, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    """base ** (0 .. n-1), modulo 2**64."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = max(n, CHUNK + 1)
        have = np.full(size, base, dtype=np.uint64)
        have[0] = 1
        np.cumprod(have, out=have)
        if size <= 4 * CHUNK:
            _powers[base] = have
    return have[:n]


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser, so that every bit of a sum counts for every bit of the hash."""
    h = h ^ (h >> np.uint64(32))
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    offsets = np.frombuffer(column.buffers()[1], kind)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, kind)
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data, offsets.astype(np.int64)


def chunks(column: pa.Array, limit: int = CHUNK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, their bytes, offsets from 0) of about ``limit`` bytes; a
    longer row comes alone."""
    data, offsets = buffers(column)
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + limit, side="right")) - 1)
        hi = min(hi, n)
        yield lo, hi, data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
        lo = hi


def words(data: np.ndarray, offsets: np.ndarray, table: np.ndarray = IS_WORD) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each word, and the row that holds it."""
    n = len(data)
    inside = table[data]
    inner = offsets[(offsets > 0) & (offsets < n)]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    first[inner] = inside[inner]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    last[inner - 1] = inside[inner - 1]
    starts = np.flatnonzero(first)
    return starts, np.flatnonzero(last) + 1, np.searchsorted(offsets, starts, side="right") - 1


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = True) -> np.ndarray:
    """A 64-bit hash of each span of bytes, by default lower-cased."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    n = len(data)
    run = np.empty(n + 1, np.uint64)
    run[0] = 0
    np.cumsum(_VALUES[LOWER[data] if lower else data] * _power(_BASE, n), out=run[1:])
    return mix((run[ends] - run[starts]) * _power(_INVERSE, n + 1)[starts])


@functools.lru_cache(16)
def _weights(size: int) -> np.ndarray:
    """As many odd random numbers; the first are the same for every size."""
    return np.random.default_rng(7).integers(1, 1 << 63, size, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def sequence_hashes(h: np.ndarray, size: int) -> np.ndarray:
    """A hash of each ``size`` neighbours in ``h``, each with a weight of its own."""
    n = len(h) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    weights = _weights(size)
    out = h[:n] * weights[0]
    for k in range(1, size):
        out += h[k : k + n] * weights[k]
    return mix(out)


class Rolling:
    """Karp-Rabin hashes of runs of values (hashes of tokens, say), any run at once from running sums."""

    def __init__(self, h: np.ndarray):
        self.sums = np.append(np.uint64(0), np.cumsum(h * _power(_BASE, len(h))))
        self.back = _power(_INVERSE, len(h) + 1)

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self.back[start])


def shingle_sets(column: pa.Array, size: int) -> Iterator[tuple[int, np.ndarray]]:
    """(row, sorted distinct shingle hashes): of ``size`` words, or of all words of a shorter row."""
    for lo, hi, data, offsets in chunks(column):
        starts, ends, rows = words(data, offsets)
        h = span_hashes(data, starts, ends)
        s = sequence_hashes(h, size)
        bounds = np.searchsorted(rows, np.arange(hi - lo + 1))
        for k in range(hi - lo):
            a, b = int(bounds[k]), int(bounds[k + 1])
            if b - a >= size:
                yield lo + k, np.unique(s[a : b - size + 1])
            elif b > a:
                yield lo + k, mix(sequence_hashes(h[a:b], b - a) + np.uint64(b - a))
            else:
                yield lo + k, s[:0]
