"""Ids of segments of bytes, solved once while they are kept: a table of bounded size, looked up for many segments at once.

A segment of at most ``WIDTH`` bytes is its own key (its bytes and its length in three
64-bit numbers), so a look-up compares whole segments and not hashes. A slot holds one
segment, the last that was solved for it. Longer segments are solved once a call.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

#: Bytes of a segment that is kept; bytes that must follow the data of a call.
WIDTH, PAD = 23, 32
_N = np.arange(WIDTH + 2)
_MASKS = [np.array([(1 << 8 * min(max(n - at, 0), most)) - 1 for n in _N.tolist()], np.uint64) for at, most in ((0, 8), (8, 8), (16, 7))]
_LENGTH = _N.astype(np.uint64) << np.uint64(56)
_ODD = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xBF58476D1CE4E5B9)]


def spread(start: np.ndarray, count: np.ndarray) -> np.ndarray:
    """start, start + 1, ... of every span, one span after the other."""
    end = np.cumsum(count)
    total = int(end[-1]) if len(end) else 0
    return np.repeat(start - (end - count), count) + np.arange(total)


class Kept:
    def __init__(self, slots: int, dtype: np.dtype):
        # a power of two, at most ``slots``
        bits = max(4, slots.bit_length() - 1)
        self.shift = np.uint64(64 - bits)
        #: Three numbers of the key; the place of its ids and, in the low byte, how many there are.
        self.rows = np.zeros((1 << bits, 4), np.uint64)
        self.pool, self.used = np.zeros(8 << bits, dtype), 0

    def items(self) -> dict[bytes, bytes]:
        """What is kept: segments and their ids."""
        full = self.rows[self.rows[:, 2] >= _LENGTH[1]]
        keys, places, counts = full[:, :3].tobytes(), (full[:, 3] >> np.uint64(8)).tolist(), (full[:, 3] & np.uint64(255)).tolist()
        return {keys[24 * i : 24 * i + keys[24 * i + WIDTH]]: self.pool[p : p + n].tobytes() for i, (p, n) in enumerate(zip(places, counts, strict=True))}

    def ids(self, data: np.ndarray, start: np.ndarray, end: np.ndarray, solve: Callable) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all segments [start, end), how many each has); ``solve`` gives the same for some segments by number.

        ``data`` are bytes with ``PAD`` more after the last segment; no segment is empty.
        """
        size = end - start
        n = np.minimum(size, WIDTH + 1)
        eights = np.ndarray((len(data) - 7,), "<u8", data, 0, (1,))
        k0 = eights[start] & _MASKS[0][n]
        k1 = eights[start + 8] & _MASKS[1][n]
        k2 = (eights[start + 16] & _MASKS[2][n]) | _LENGTH[n]
        h = k0 * _ODD[0] + (k1 ^ (k1 >> np.uint64(31))) * _ODD[1] + (k2 ^ (k2 >> np.uint64(29))) * _ODD[2]
        h ^= h >> np.uint64(32)
        h *= _ODD[3]
        slot = (h >> self.shift).astype(np.int64)
        got = self.rows.take(slot, 0)
        place = (got[:, 3] >> np.uint64(8)).astype(np.int64)
        count = (got[:, 3] & np.uint64(255)).astype(np.int64)
        lost = (got[:, 0] != k0) | (got[:, 1] != k1) | (got[:, 2] != k2)
        long = size > WIDTH
        lost &= ~long
        miss = np.flatnonzero(lost)
        miss = miss[np.argsort(h[miss], kind="stable")]
        new = np.ones(len(miss), bool)
        new[1:] = (k0[miss[1:]] != k0[miss[:-1]]) | (k1[miss[1:]] != k1[miss[:-1]]) | (k2[miss[1:]] != k2[miss[:-1]])
        own = miss[new]
        # longer segments, each once
        number: dict[bytes, int] = {}
        raw, far = data.data, np.flatnonzero(long)
        which = [number.setdefault(bytes(raw[s:e]), len(number)) for s, e in zip(start[far].tolist(), end[far].tolist(), strict=True)]
        first = far[np.unique(np.array(which, np.int64), return_index=True)[1]]
        pool, used = self.pool, self.used
        if len(own) or len(first):
            flat, counts = solve(np.concatenate([own, first]))
            at = np.cumsum(counts) - counts
            if used + len(flat) > len(pool):
                # full: the table begins anew, and what it held is copied for this call
                pool = np.concatenate([pool[:used], flat.astype(pool.dtype)])
                self.rows[:] = 0
                self.used = 0
            group = np.cumsum(new) - 1
            place[miss], count[miss] = used + at[group], counts[group]
            place[far], count[far] = used + at[len(own) :][which], counts[len(own) :][which]
            if self.used + len(flat) <= len(self.pool):
                self.pool[self.used : self.used + len(flat)] = flat
                m = len(own)
                self.rows[slot[own]] = np.stack([k0[own], k1[own], k2[own], ((self.used + at[:m]).astype(np.uint64) << np.uint64(8)) | counts[:m].astype(np.uint64)], axis=1)
                self.used += len(flat)
        return pool[spread(place, count)], count
