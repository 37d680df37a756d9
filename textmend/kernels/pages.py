"""Pages of glyphs as arrays: lines, cells, gaps, gutters and columns of one page at a time, without a row for each glyph."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

from . import points


class Glyphs:
    """Glyphs of a page: ``x``, ``y``, ``size``, ``line`` and ``ch`` (code points)."""

    def __init__(self, x: np.ndarray, y: np.ndarray, size: np.ndarray, line: np.ndarray, ch: np.ndarray):
        self.x, self.y, self.size, self.line, self.ch = x, y, size, line, ch

    def taken(self, at: np.ndarray) -> Glyphs:
        return Glyphs(self.x[at], self.y[at], self.size[at], self.line[at], self.ch[at])

    def with_copy(self, dx: float) -> Glyphs:
        """The page beside a copy of itself."""
        twice = lambda a: np.concatenate([a, a])
        return Glyphs(np.concatenate([self.x, self.x + dx]), twice(self.y), twice(self.size), twice(self.line), twice(self.ch))

    def by_line(self) -> tuple[Glyphs, np.ndarray]:
        """Glyphs by line and place, and where lines begin."""
        step = np.diff(self.line)
        # a page that is in this order already isn't sorted once more
        own = self if np.all((step > 0) | ((step == 0) & (np.diff(self.x) > 0))) else self.taken(np.lexsort((self.ch, self.x, self.line)))
        new = np.ones(len(own.line), bool)
        new[1:] = own.line[1:] != own.line[:-1]
        return own, np.flatnonzero(new)


def of_texts(texts: list[str], wide: float = 9.0, high: float = 22.0, size: float = 11.0) -> Glyphs:
    """Characters of every line on a grid; blanks leave gaps. Texts of one key are one page."""
    parts = []
    for t in texts:
        a = points.of(t)
        breaks = a == 10
        line = np.cumsum(breaks) - breaks
        starts = np.concatenate([[0], np.flatnonzero(breaks) + 1])
        keep = ~(breaks | (a == 32) | (a == 9) | (a == 13))
        parts.append(((np.arange(len(a)) - starts[line])[keep], line[keep], a[keep]))
    i, line, ch = (np.concatenate(p) for p in zip(*parts, strict=True))
    return Glyphs(wide * i, high * line, np.full(len(i), size), line, ch)


def cells(g: Glyphs, wide: float = 2.2) -> tuple:
    """line, cell, x0, x1, n, text: a new cell after a gap of ``wide`` sizes."""
    g, at = g.by_line()
    if not len(g.x):
        return (*np.empty((5, 0)), [])
    new = np.zeros(len(g.x), bool)
    new[1:] = g.x[1:] - g.x[:-1] > wide * g.size[1:]
    new[at] = False
    number = np.cumsum(new)
    cell = number - np.repeat(number[at], np.diff(np.append(at, len(g.x))))
    new[at] = True
    start = np.flatnonzero(new)
    end = np.append(start[1:], len(g.x))
    whole = points.text_of(g.ch)
    return g.line[start], cell[start], g.x[start], g.x[end - 1], end - start, [whole[a:b] for a, b in zip(start.tolist(), end.tolist(), strict=True)]


def thresholds(g: Glyphs, share: float = 0.72, least: float = 0.42) -> tuple:
    """line, threshold: of every line with gaps the gap at ``share`` of the sorted ones, no less than ``least`` median sizes."""
    g, at = g.by_line()
    n = np.diff(np.append(at, len(g.x))) - 1
    gap = np.diff(g.x, prepend=0.0)
    inside = np.ones(len(g.x), bool)
    inside[at] = False
    line, gap = g.line[inside], gap[inside]
    gap = gap[np.lexsort((gap, line))]
    some = n > 0
    n, begin = n[some], (np.cumsum(n) - n)[some]
    size = np.array([_median(g.size[a:b]) for a, b in zip(at, np.append(at[1:], len(g.x)), strict=True)])[some] if len(at) and np.ptp(g.size) else np.full(len(n), _median(g.size[:1]))
    return g.line[at][some], np.maximum(gap[begin + np.rint(share * (n - 1)).astype(int)], least * size)


def _median(size: np.ndarray) -> float:
    own = size[size > 0]
    return float(np.median(own)) if len(own) else 10.0


def rows(g: Glyphs, tolerance: float = 0.5) -> tuple:
    """line, row, once each: a row holds what is within half a size of its first glyph's height."""
    if not len(g.y):
        return np.empty(0, int), np.empty(0, int)
    most = max(tolerance * float(np.median(g.size)), 1.0)
    ys, where = np.unique(g.y, return_inverse=True)
    own, anchor, row = [], None, -1
    for y in ys.tolist():
        if anchor is None or abs(y - anchor) > most:
            anchor, row = y, row + 1
        own.append(row)
    pairs = np.unique(g.line * (row + 1) + np.array(own)[where])
    return pairs // (row + 1), pairs % (row + 1)


def gutters(g: Glyphs, width: float, ratio: float = 0.06, least: float = 18.0, side: float = 0.15) -> np.ndarray:
    """Middles of the wide gaps in x that no glyph crosses and that have enough on both sides."""
    xs, where = np.unique(np.round(g.x, 1), return_inverse=True)
    if len(g.x) < 8 or len(xs) < 4 or width <= 0:
        return np.empty(0)
    lo, hi = np.full(len(xs), np.inf), np.full(len(xs), -np.inf)
    np.minimum.at(lo, where, g.y)
    np.maximum.at(hi, where, g.y)
    left = np.cumsum(np.bincount(where)) / len(g.x)
    span = hi.max() - lo.min() or 1.0
    up = (np.maximum.accumulate(hi) - np.minimum.accumulate(lo))[:-1]
    down = (np.maximum.accumulate(hi[::-1]) - np.minimum.accumulate(lo[::-1]))[::-1][1:]
    enough = (np.diff(xs) >= max(width * ratio, least)) & (left[:-1] >= side) & (1 - left[:-1] >= side)
    enough &= (up > 0.25 * span) & (down > 0.25 * span)
    return ((xs[:-1] + xs[1:]) / 2)[enough]


def columns(g: Glyphs, cuts: np.ndarray, right_to_left: bool = True) -> tuple:
    """column, x0, x1, n: from 0 in reading order; columns without a glyph don't count."""
    part = np.searchsorted(cuts, g.x, side="right")
    there, where, n = np.unique(part, return_inverse=True, return_counts=True)
    x0, x1 = np.full(len(there), np.inf), np.full(len(there), -np.inf)
    np.minimum.at(x0, where, g.x)
    np.maximum.at(x1, where, g.x)
    order = np.arange(len(there))[:: -1 if right_to_left else 1]
    return np.arange(len(there)), x0[order], x1[order], n[order]


def over(run: Callable[[Glyphs], tuple], schema: pa.Schema) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """For ``mapInArrow`` over (key, texts): a row for every entry of the columns that ``run`` gives for a page, behind its key."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for begin in range(0, b.num_rows, 1024):
                part = b.slice(begin, 1024)
                found = [run(of_texts(t)) for t in part.column(1).to_pylist()]
                key = part.column(0).take(pa.array(np.repeat(np.arange(len(found)), [len(f[0]) for f in found])))
                columns_ = zip(*found, strict=True)
                own = [pa.array([x for c in own for x in c] if isinstance(own[0], list) else np.concatenate(own), type=f.type, safe=False) for own, f in zip(columns_, list(schema)[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([key, *own], schema=schema)

    return each
