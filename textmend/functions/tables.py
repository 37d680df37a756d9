"""Code-point tables, derived from the Unicode data of the standard library."""

from __future__ import annotations

import unicodedata as ud

ALEFS = "\u0627\u0622\u0623\u0625\u0671"
LAM, TATWEEL, NBSP, SOFT_HYPHEN, THOUSANDS, COMMA, BAD = "\u0644", "\u0640", "\u00a0", "\u00ad", "\u066c", "\u060c", "\ufffd"
FINAL_ONLY = "\u0629\u0649"
ZERO_WIDTH = "\u200b\u200c\u200d\u200e\u200f\ufeff"
SPACES = "".join(chr(c) for c in range(0x3001) if ud.category(chr(c)) == "Zs" and c != 0x20)
DIGITS = "0-9\u0660-\u0669\u06f0-\u06f9"
#: Ranges for regular expressions.
ARABIC = "\u0600-\u06ff\u0750-\u077f\u08a0-\u08ff"
FORMS = "\ufb50-\ufdff\ufe70-\ufefe"
PRIVATE = "\ue000-\uf8ff"
HOMOGLYPHS = {"\u06cc": "\u064a", "\u06cd": "\u064a", "\u06be": "\u0647", "\u06c1": "\u0647", "\u06c2": "\u0647", "\u06a9": "\u0643", "\u06c3": "\u0629"}
MIRROR = {a: b for x, y in ("()", "[]", "{}", "<>", "«»", "‹›", "“”") for a, b in ((x, y), (y, x))}
#: Marks of Arabic: combining (Mn) code points of the Arabic blocks.
MARKS = "".join(chr(c) for a, b in ((0x600, 0x6FF), (0x750, 0x77F), (0x8A0, 0x8FF)) for c in range(a, b + 1) if ud.category(chr(c)) == "Mn")


def _forms() -> tuple[dict[str, str], dict[str, str]]:
    simple, deferred = {}, {}
    for c in (*range(0xFB50, 0xFE00), *range(0xFE70, 0xFEFF)):
        parts = ud.decomposition(chr(c)).split()
        if not parts or not parts[0].startswith("<"):
            continue
        base = "".join(chr(int(p, 16)) for p in parts[1:])
        if len(base) == 1:
            simple[chr(c)] = base
        else:
            # mark forms are shown on a space or a tatweel, which isn't part of the text
            deferred[chr(c)] = base[1:] if base[0] in " \u0640" else base
    return simple, deferred


SIMPLE, DEFERRED = _forms()


def _joining() -> dict[str, str]:
    """Initial, medial, final or isolated (I M F S) of the forms that join; forms of marks tell nothing."""
    tags = {"<initial>": "I", "<medial>": "M", "<final>": "F", "<isolated>": "S"}
    return {f: tags[tag] for f, base in {**SIMPLE, **DEFERRED}.items() if (tag := ud.decomposition(f).split()[0]) in tags and ud.category(base[0]) != "Mn"}


JOINING = _joining()
#: Presentation punctuation and what it stands for.
PUNCTUATION = {chr(c): ud.normalize("NFKC", chr(c)) for c in range(0xFE10, 0xFE6C) if ud.category(chr(c))[0] == "P" and ud.normalize("NFKC", chr(c)) != chr(c)}
#: A letter's isolated form.
ISOLATED = {ud.normalize("NFKC", f): f for f in SIMPLE if ud.decomposition(f).startswith("<isolated>") and f >= "\ufe70"}


def flat(table: dict[str, str]) -> tuple[str, str]:
    """(from, to) of the one-to-one entries, for translate."""
    one = {k: v for k, v in table.items() if len(v) == 1}
    return "".join(one), "".join(one.values())

#: Characters of CP1252 and the bytes they stand for, as code points; five bytes stand for none and are left as they are.
CP1252 = {bytes([b]).decode("cp1252"): chr(b) for b in range(0x80, 0xA0) if b not in (0x81, 0x8D, 0x8F, 0x90, 0x9D)}


def _legacy(page: str) -> dict[str, str]:
    """Characters as CP1252 or Latin-1 shows them and what their bytes stand for in ``page``; none for a byte that has no meaning there."""
    shown = {**{chr(b): b for b in range(0x80, 0x100)}, **{c: ord(b) for c, b in CP1252.items()}}
    return {c: bytes([b]).decode(page, "ignore") for c, b in shown.items()}


CP1256, ISO_8859_6 = _legacy("cp1256"), _legacy("iso8859_6")
