"""Alignment metrics of a recovered text against its reference, and patches between two texts."""

from __future__ import annotations

import re
import unicodedata as ud
from collections import Counter
from collections.abc import Sequence

from ..functions.tables import HOMOGLYPHS
from .direction import marks_in_order
from .matching import Matcher

LETTER = re.compile("[ء-يٮ-ۓۺ-ۿ]")
#: Harakat, maddah and hamza above or below, and the superscript alef: marks even where a font's data says otherwise.
HARAKAT = "ًٌٍَُِّْٰٕٓٔٗ٘"
FORM = re.compile("[ﭐ-﷿ﹰ-ﻼ]")
_FOLD = str.maketrans(HOMOGLYPHS)


def _is_mark(c: str) -> bool:
    return c in HARAKAT or ud.category(c) == "Mn"


def letters(text: str) -> str:
    """The Arabic letters of a text, without marks."""
    return "".join(LETTER.findall("".join(c for c in text if not _is_mark(c))))


def canonical(text: str) -> str:
    return letters(text).translate(_FOLD)


def distance(a: Sequence, b: Sequence) -> int:
    """Edit distance by bit vectors over ``a`` (Myers 1999, Hyyrö 2003), of code points or of any hashable items."""
    n, m = len(a), len(b)
    head = next((i for i in range(min(n, m)) if a[i] != b[i]), min(n, m))
    tail = next((i for i in range(min(n, m) - head) if a[n - 1 - i] != b[m - 1 - i]), min(n, m) - head)
    a, b = a[head : n - tail], b[head : m - tail]
    if not a or not b:
        return len(a) + len(b)
    where: dict = {}
    for i, x in enumerate(a):
        where[x] = where.get(x, 0) | 1 << i
    size = len(a)
    full, top = (1 << size) - 1, 1 << (size - 1)
    plus, minus, score = full, 0, size
    for x in b:
        eq = where.get(x, 0)
        diagonal = (((eq & plus) + plus) ^ plus) | eq | minus
        up, down = minus | ~(diagonal | plus) & full, plus & diagonal
        score += 1 if up & top else -1 if down & top else 0
        up = (up << 1 | 1) & full
        down = down << 1 & full
        plus, minus = down | ~(diagonal | up) & full, up & diagonal
    return score


def rate(reference: Sequence, hypothesis: Sequence) -> float:
    return distance(reference, hypothesis) / len(reference) if reference else 0.0


_matcher = Matcher


def continuity(reference: str, hypothesis: str, joining: tuple[int, int] = (0, 0)) -> dict:
    """Letters, word tokens and joining forms that survived; ``joining`` is (pairs, violations) in the hypothesis."""
    a, b = canonical(reference), canonical(hypothesis)
    fidelity = min(1.0, max(0.0, 1.0 - rate(a, b))) if a else 1.0
    words = [[t for w in s.split() if (t := canonical(w))] for s in (reference, hypothesis)]
    tokens = _matcher(*words).ratio()
    pairs, wrong = joining
    sound = (pairs - wrong) / pairs if pairs else 1.0
    return {"score": round(0.50 * fidelity + 0.35 * tokens + 0.15 * sound, 4), "letter_fidelity": round(fidelity, 4), "token_continuity": round(tokens, 4), "joining_integrity": round(sound, 4), "joining_pairs": pairs, "joining_violations": wrong}


def clusters(text: str) -> list[tuple[str, str]]:
    """(letter, marks) of Arabic letters; marks without one under "_"."""
    out, i, n = [], 0, len(text)
    while i < n:
        base = "_" if _is_mark(text[i]) else text[i].translate(_FOLD) if LETTER.match(text[i]) else ""
        j = i + (base != "_")
        k = j
        while base and k < n and _is_mark(text[k]):
            k += 1
        if base:
            out.append((base, text[j:k]))
        i = max(k, i + 1)
    return out


def attachment(reference: str, hypothesis: str) -> dict:
    """Whether marks are the same in kind and stand on the same letters."""
    own = [clusters(s) for s in (reference, hypothesis)]
    kinds = [Counter(m for _, ms in c for m in ms) for c in own]
    norm = [sum(v * v for v in k.values()) ** 0.5 or 1.0 for k in kinds]
    inventory = 1.0 if not kinds[0] and not kinds[1] else sum(v * kinds[1][m] for m, v in kinds[0].items()) / (norm[0] * norm[1])
    a, b = ([c for c in o if c[0] != "_"] for o in own)
    marked = right = 0
    for block in _matcher([c for c, _ in a], [c for c, _ in b]).get_matching_blocks():
        for i in range(block[2]):
            x, y = a[block[0] + i][1], b[block[1] + i][1]
            marked += bool(x)
            right += bool(x) and marks_in_order(x) == marks_in_order(y)
    attached = right / marked if marked else 1.0
    words = hypothesis.split()
    leading = sum(_is_mark(w[0]) for w in words) / len(words) if words else 0.0
    score = 0.55 * attached + 0.30 * inventory + 0.15 * (1.0 - min(1.0, 5.0 * leading))
    per = [sum(len(m) for _, m in o) / (len(c) or 1) for o, c in zip(own, (a, b), strict=True)]
    return {"score": round(score, 4), "inventory_match": round(inventory, 4), "attachment_accuracy": round(attached, 4), "leading_mark_rate": round(leading, 4), "marks_per_base_ref": round(per[0], 4), "marks_per_base_hyp": round(per[1], 4)}


def drift(reference: str, hypothesis: str) -> dict:
    """Homoglyphs among the letters, and how much of the letters' error they are."""
    a, b = letters(reference), letters(hypothesis)
    n = sum(c in HOMOGLYPHS for c in b)
    replaced = alike = 0
    for tag, i1, i2, j1, j2 in _matcher(a, b).get_opcodes():
        if tag == "replace":
            pairs = list(zip(a[i1:i2], b[j1:j2]))
            replaced += len(pairs)
            alike += sum(x.translate(_FOLD) == y.translate(_FOLD) for x, y in pairs)
    return {
        "drift_rate": round(n / (len(b) or 1), 4),
        "n_homoglyphs": n,
        "n_arabic_letters": len(b),
        "aligned_homoglyph_fraction": round(alike / replaced, 4) if replaced else 0.0,
        "true_letter_error_rate": round(rate(a.translate(_FOLD), b.translate(_FOLD)), 4),
        "raw_letter_error_rate": round(rate(a, b), 4),
    }


def error_kinds(gold: str, out: str) -> dict[str, int]:
    """Differing characters by what kind of damage they tell of."""
    kinds: Counter = Counter()
    for tag, i1, i2, j1, j2 in _matcher(gold, out).get_opcodes():
        if tag == "equal":
            continue
        g, o = gold[i1:i2], out[j1:j2]
        gs, os = ("".join(s.split()) for s in (g, o))
        if not gs and not os:
            kinds["spacing"] += max(len(g), len(o))
        elif FORM.search(os):
            kinds["residual-pf"] += len(os)
        elif not os:
            kind = "diacritic-loss" if all(map(_is_mark, gs)) else "spacing-loss" if len(gs) < len(g) else "letter-deletion"
            kinds[kind] += len(g) if kind == "spacing-loss" else len(gs)
        elif not gs:
            kinds["letter-insertion"] += len(os)
        else:
            bare = ["".join(c for c in s if not _is_mark(c)) for s in (g, o)]
            same = bare[0] == bare[1] and (len(bare[0]) < len(g) or any(map(_is_mark, os)))
            kinds["diacritic-mismatch" if same else "letter-substitution"] += max(len(g), len(o)) if same else max(len(gs), len(os))
    return dict(kinds)


#: Product of lengths up to which two spans are aligned character by character; larger ones are aligned by lines first.
ALIGNED = 4_000_000


def operations(before: str, after: str) -> list[tuple[int, int, int, int, str, str]]:
    """Spans that differ: (begin, end) in both texts and what stands there."""
    if len(before) * len(after) <= ALIGNED:
        return [(i1, i2, j1, j2, before[i1:i2], after[j1:j2]) for tag, i1, i2, j1, j2 in _matcher(before, after).get_opcodes() if tag != "equal"]
    pieces = [re.findall("[^\n]*\n|[^\n]+", s) for s in (before, after)]
    if min(map(len, pieces)) < 2:
        pieces = [re.findall(r"\S*\s+|\S+", s) for s in (before, after)]
    out, at = [], [[0], [0]]
    for k in (0, 1):
        for p in pieces[k]:
            at[k].append(at[k][-1] + len(p))
    for tag, i1, i2, j1, j2 in _matcher(*pieces).get_opcodes():
        if tag == "equal":
            continue
        a, b, c, d = at[0][i1], at[0][i2], at[1][j1], at[1][j2]
        if (b - a) * (d - c) <= ALIGNED:
            out += [(a + x, a + y, c + u, c + v, o, n) for x, y, u, v, o, n in operations(before[a:b], after[c:d])]
        else:
            out.append((a, b, c, d, before[a:b], after[c:d]))
    return out
