"""``difflib``'s matching blocks of two sequences (without junk), found by sets of substrings and not by all pairs of equal items.

The blocks are the same: the longest first, of equally long ones the one that begins earliest in the first sequence and
then in the second; what is left on both sides of it is matched alike.
"""

from __future__ import annotations

from collections.abc import Sequence
from os.path import commonprefix


def _as_text(a: Sequence, b: Sequence) -> tuple[str, str]:
    """Items as characters, the same for equal ones."""
    if isinstance(a, str) and isinstance(b, str):
        return a, b
    number: dict = {}
    # not the surrogates, of which texts may not be made
    sign = lambda x: chr(k if (k := number.setdefault(x, len(number))) < 0xD800 else k + 0x800)
    return "".join(map(sign, a)), "".join(map(sign, b))


def _first(x: str, y: str, n: int) -> int:
    """Where the first substring of ``n`` begins in ``x`` that ``y`` has too; -1 without any."""
    if n == 1:
        own = set(y)
        return next((i for i, c in enumerate(x) if c in own), -1)
    own = {y[j : j + n] for j in range(len(y) - n + 1)}
    return next((i for i in range(len(x) - n + 1) if x[i : i + n] in own), -1)


def _alike(n: int, same) -> int:
    """The largest k up to ``n`` for which ``same`` holds, which holds for all smaller ones."""
    low, step = 0, 16
    while low < n and same(min(n, low + step)):
        low, step = min(n, low + step), step * 2
    high = min(n + 1, low + step)
    while high - low > 1:
        k = (low + high) // 2
        low, high = (k, high) if same(k) else (low, k)
    return low


#: Length of the pieces that are looked for first, and how many at most.
SEED, SEEDS = 8, 48


def _known(x: str, y: str) -> int:
    """A length that some common substring has for sure: pieces of ``x`` are looked for in ``y`` and grown to both sides."""
    best, p, stride = 0, 0, max(SEED, len(x) // SEEDS)
    while p + SEED <= len(x):
        j = y.find(x[p : p + SEED])
        if j >= 0:
            right = _alike(min(len(x) - p, len(y) - j), lambda k, p=p, j=j: x[p : p + k] == y[j : j + k])
            left = _alike(min(p, j), lambda k, p=p, j=j: x[p - k : p] == y[j - k : j])
            best = max(best, left + right)
            p += max(right, stride)
        else:
            p += stride
    return best


def longest(x: str, y: str, most: int) -> tuple[int, int, int]:
    """(i, j, n) of the longest common substring, given that it has no more than ``most``; n is 0 without any."""
    if len(x) == 1 or len(y) == 1:
        i, j = (0, y.find(x)) if len(x) == 1 else (x.find(y), 0)
        return (i, j, 1) if i >= 0 and j >= 0 else (0, 0, 0)
    low, at, high = len(commonprefix((x[:SEED], y[:SEED]))), 0, min(most, len(x), len(y)) + 1
    if high > 4 * SEED and (known := _known(x, y)) > low:
        low, at = known, -1
    step = 1
    while high - low > 1:
        # from below in growing steps: most are hardly longer than what is known
        n = min(low + step, (low + high) // 2)
        i = _first(x, y, n)
        if i < 0:
            high = n
        else:
            low, at, step = n, i, step * 2
    at = _first(x, y, low) if at < 0 else at
    return (at, y.find(x[at : at + low]), low) if low else (0, 0, 0)


class Matcher:
    """What is asked of ``difflib.SequenceMatcher(None, a, b, autojunk=False)``."""

    def __init__(self, a: Sequence, b: Sequence):
        self.a, self.b = _as_text(a, b)
        self.blocks: list[tuple[int, int, int]] | None = None

    def get_matching_blocks(self) -> list[tuple[int, int, int]]:
        if self.blocks is not None:
            return self.blocks
        a, b = self.a, self.b
        todo, found = [(0, len(a), 0, len(b), min(len(a), len(b)))], []
        while todo:
            alo, ahi, blo, bhi, most = todo.pop()
            x, y = a[alo:ahi], b[blo:bhi]
            if x == y:
                if x:
                    found.append((alo, blo, len(x)))
                continue
            i, j, n = longest(x, y, most)
            if not n:
                continue
            i, j = alo + i, blo + j
            found.append((i, j, n))
            if alo < i and blo < j:
                todo.append((alo, i, blo, j, n))
            if i + n < ahi and j + n < bhi:
                todo.append((i + n, ahi, j + n, bhi, n))
        found.sort()
        joined: list[tuple[int, int, int]] = []
        for i, j, n in found:
            if joined and joined[-1][0] + joined[-1][2] == i and joined[-1][1] + joined[-1][2] == j:
                joined[-1] = (*joined[-1][:2], joined[-1][2] + n)
            else:
                joined.append((i, j, n))
        self.blocks = [*joined, (len(a), len(b), 0)]
        return self.blocks

    def get_opcodes(self) -> list[tuple[str, int, int, int, int]]:
        i = j = 0
        out = []
        for ai, bj, n in self.get_matching_blocks():
            tag = "replace" if i < ai and j < bj else "delete" if i < ai else "insert" if j < bj else ""
            if tag:
                out.append((tag, i, ai, j, bj))
            i, j = ai + n, bj + n
            if n:
                out.append(("equal", ai, i, bj, j))
        return out

    def ratio(self) -> float:
        total = len(self.a) + len(self.b)
        return 2.0 * sum(n for _, _, n in self.get_matching_blocks()) / total if total else 1.0
