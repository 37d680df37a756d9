"""Texts as arrays of code points: tables, classes and tallies over all characters at once."""

from __future__ import annotations

import unicodedata as ud
from functools import lru_cache

import numpy as np

from ..functions import tables as T

_MOST = 0x110000


def of(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")


def text_of(points: np.ndarray) -> str:
    return points.astype("<u4", copy=False).tobytes().decode("utf-32-le", "surrogatepass")


def table(pairs: dict[str, str]) -> np.ndarray:
    """Code point by code point of the one-to-one entries; what isn't listed stays."""
    own = np.arange(_MOST, dtype=np.uint32)
    for a, b in pairs.items():
        if len(b) == 1:
            own[ord(a)] = ord(b)
    return own


def members(*ranges: str) -> np.ndarray:
    """Whether a code point is in one of the ranges ("a-b"), or one of the characters of a text without a dash."""
    own = np.zeros(_MOST, bool)
    for r in ranges:
        if len(r) == 3 and r[1] == "-":
            own[ord(r[0]) : ord(r[2]) + 1] = True
        else:
            own[[ord(c) for c in r]] = True
    return own


def ranges(pattern: str) -> list[str]:
    """The ranges of a class that is made of nothing else."""
    return [pattern[i : i + 3] for i in range(0, len(pattern), 3)]


class Table:
    """A one-to-one table that is made when it is first used; texts without any of its characters come back as they are."""

    def __init__(self, pairs: dict[str, str]):
        self.pairs, self.own = pairs, None

    def __call__(self, text: str) -> str:
        if text.isascii():
            return text
        if self.own is None:
            self.own = table(self.pairs)
        a = of(text)
        b = self.own[a]
        return text if np.array_equal(a, b) else text_of(b)


@lru_cache(1)
def _word() -> np.ndarray:
    return members(*ranges(T.ARABIC), *ranges(T.FORMS))


@lru_cache(1)
def _joining() -> np.ndarray:
    """0 outside of words, 1 to 4 a form (I M F S), 5 a letter that isn't one."""
    own = _word().astype(np.uint8) * 5
    for c, kind in T.JOINING.items():
        own[ord(c)] = "IMFS".index(kind) + 1
    return own


#: By (form, following form): whether the pair can't stand in a logical order.
_WRONG = np.zeros((6, 6), bool)
_WRONG[np.ix_([1, 2], [1, 4])] = _WRONG[np.ix_([3, 4], [2, 3])] = True


def joining_tally(points: np.ndarray) -> tuple[int, int]:
    """Pairs of joining forms and wrong ones."""
    own = _joining()[points]
    own = own[own != 5]
    a, b = own[:-1], own[1:]
    return int(np.count_nonzero((a > 0) & (b > 0))), int(np.count_nonzero(_WRONG[a, b]))


def word_ends(points: np.ndarray) -> tuple[int, int, int, int]:
    """Words of two or more with a letter that only ends words at the head, and at the tail; words of four or more with the article turned at the end, and at the head."""
    a = np.concatenate([np.zeros(4, np.uint32), points, np.zeros(4, np.uint32)])
    w = _word()[a]
    m = len(points)

    def at(x: np.ndarray, d: int) -> np.ndarray:
        return x[4 + d : 4 + d + m]

    head, tail = at(w, 0) & ~at(w, -1), at(w, 0) & ~at(w, 1)
    last = (a == ord(T.FINAL_ONLY[0])) | (a == ord(T.FINAL_ONLY[1]))
    alef, lam = a == 0x627, a == ord(T.LAM)
    n = np.count_nonzero
    first = head & at(alef, 0) & at(lam, 1) & at(w, 2) & at(w, 3)
    end = tail & at(alef, 0) & at(lam, -1) & at(w, -2) & at(w, -3)
    return int(n(head & at(last, 0) & at(w, 1))), int(n(tail & at(last, 0) & at(w, -1))), int(n(end)), int(n(first))


@lru_cache(1)
def _shapes() -> tuple:
    from ..operators import derive as D

    return members(D.DUAL), members(D.JOINED), *(table(D.form_table(k)) for k in "MFIS")


def shaped(text: str) -> str:
    """Letters as the forms that a font would draw, by their neighbours."""
    if text.isascii():
        return text
    dual, joined, m, f, i, s = _shapes()
    a = of(text)
    d, j = dual[a], joined[a]
    back, on = np.zeros(len(a), bool), np.zeros(len(a), bool)
    back[1:] = d[:-1] & j[1:]
    on[:-1] = d[:-1] & j[1:]
    return text_of(np.where(back & on, m[a], np.where(back, f[a], np.where(on, i[a], s[a]))))


FAMILIES = ["R", "AN", "L", "EN", "W", "M", "N"]
_BIDI = {"AL": "R", "R": "R", "AN": "AN", "EN": "EN", "ES": "EN", "ET": "EN", "WS": "W", "S": "W", "B": "W", "BN": "W"}
#: Family of directions by code point: 0 a line break, 255 not asked for yet, else its place among ``FAMILIES`` and 1.
_FAMILY = np.full(_MOST, 255, np.uint8)
_FAMILY[[10, 13]] = 0


def _family(cp: int) -> int:
    listed = cp < 0x3100 or 0xFB1D <= cp < 0x10000
    own = _BIDI.get(ud.bidirectional(chr(cp))) if listed else None
    if own is None:
        k = ud.category(chr(cp))
        own = "L" if k[0] == "L" or k in ("Mc", "Nl", "Co") else "M" if k in ("Mn", "Me") else "N"
    return FAMILIES.index(own) + 1


def direction_runs(text: str) -> list[tuple[str, int]]:
    """(family, n): maximal runs of one family of directions within lines; a line break ends a run and is none."""
    a = of(text)
    own = _FAMILY[a]
    if 255 in own:
        for cp in np.unique(a[own == 255]).tolist():
            _FAMILY[cp] = _family(cp)
        own = _FAMILY[a]
    new = np.ones(len(own), bool)
    new[1:] = own[1:] != own[:-1]
    n = np.bincount(own[new], minlength=len(FAMILIES) + 1)
    return [(b, int(k)) for b, k in zip(FAMILIES, n[1:], strict=True) if k]
