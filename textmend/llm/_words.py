"""Vectorised word splitting and hashing over Arrow string columns.

Words are maximal runs of bytes other than 0x20 and 0x09-0x0D, which in UTF-8
is the same as ``[^\\x20\\x09-\\x0D]+`` over code points.  Every word gets a
64-bit hash: a polynomial over the ring of 64-bit integers with a random
substitution per byte, read off prefix sums, so the cost per byte is fixed
whatever the length of the words.  Null texts count as empty.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Text is processed in runs of whole rows of about this many bytes.
SLICE_BYTES = 2_000_000

_rng = np.random.default_rng(0x5EED)
_TABLE = _rng.integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
_BASE = 0x9E3779B97F4A7C15
_BASE_INV = pow(_BASE, -1, 2**64)
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, 9, 10, 11, 12, 13]] = True
_powers: dict[int, np.ndarray] = {}


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit values (splitmix64)."""
    h = h ^ (h >> np.uint64(30))
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def powers(base: int, n: int) -> np.ndarray:
    """``base ** i`` for i < n, modulo 2**64; kept per process up to a bound."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = max(n, 1 << 16)
        have = np.full(size, base, dtype=np.uint64)
        have[0] = 1
        np.multiply.accumulate(have, out=have)
        if size <= 4 * SLICE_BYTES:
            _powers[base] = have
    return have[:n]


def prefix_hash(values: np.ndarray, base: int = _BASE) -> np.ndarray:
    """Prefix sums of ``values[i] * base**i`` with a leading zero."""
    out = np.zeros(len(values) + 1, dtype=np.uint64)
    np.cumsum(values * powers(base, len(values)), out=out[1:])
    return out


def span_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of the spans [start, end), the same wherever a span lies."""
    inv = powers(_BASE_INV, len(prefix))
    return mix((prefix[end] - prefix[start]) * inv[start] + (end - start).astype(np.uint64))


def texts_of(column: pa.Array) -> pa.Array:
    """The column as 64-bit offset strings with nulls as empty texts."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string())
    return column.fill_null("") if column.null_count else column


def raw(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets from 0) of a large string array without nulls."""
    n = len(column)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + n + 1]
    whole = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return whole[at[0] : at[-1]], at - at[0]


def slices(column: pa.Array, size: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of runs of whole rows of about ``size`` bytes."""
    column = texts_of(column)
    n, i = len(column), 0
    data, at = raw(column)
    while i < n:
        j = int(np.searchsorted(at, at[i] + size, side="right")) - 1
        j = min(n, max(j, i + 1))
        yield i, j, data[at[i] : at[j]], at[i : j + 1] - at[i]
        i = j


class Words:
    """Words of some rows: ``start``, ``end`` (bytes), ``row``, ``first`` (word offsets by row), ``hash``."""

    def __init__(self, data: np.ndarray, at: np.ndarray, hashes: bool = True):
        self.data, self.at = data, at
        inside = ~_SPACE[data]
        edge = np.zeros(len(data) + 1, dtype=bool)
        edge[at] = True
        begins = inside.copy()
        begins[1:] &= ~inside[:-1] | edge[1:-1]
        ends = inside.copy()
        ends[:-1] &= ~inside[1:] | edge[1:-1]
        self.start = np.flatnonzero(begins)
        self.end = np.flatnonzero(ends) + 1
        self.first = np.searchsorted(self.start, at)
        self.count = np.diff(self.first)
        self.row = np.repeat(np.arange(len(at) - 1), self.count)
        self.inside = inside
        if hashes:
            self.prefix = prefix_hash(_TABLE[data])
            self.hash = span_hash(self.prefix, self.start, self.end)


def lower_ascii(data: np.ndarray) -> np.ndarray:
    """Bytes with A-Z lowered, everything else as it is."""
    out = data.copy()
    out[(data >= 65) & (data <= 90)] += 32
    return out


def windows(word_hash: np.ndarray, first: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, first word) of every window of n words that lies within one row."""
    total = len(word_hash)
    if total < n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    ok = np.ones(total, dtype=bool)
    ends = first[1:]
    for k in range(n - 1):
        i = ends - 1 - k
        ok[i[i >= first[:-1]]] = False
    start = np.flatnonzero(ok)
    prefix = prefix_hash(word_hash)
    return span_hash(prefix, start, start + n), start
