"""Diagnosis and the repair ladder on one text: the rules of ``functions.text`` and ``functions.spacing`` as one pass.

A text's distinct characters are taken once; every rule asks them first, so a text pays only for what it may hold.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata as ud
from decimal import ROUND_HALF_UP, Decimal
from functools import lru_cache
from itertools import chain

from ..functions import spacing
from ..functions import tables as T
from . import direction, encoding, points

_A, _L, _Z = T.ARABIC, T.ALEFS, T.LAM
WORDS = re.compile(f"[{_A}{T.FORMS}]+")
NOT_WORDS = re.compile(f"[^{_A}{T.FORMS}]+")
DECISIVE = re.compile(f"[{_L}][{_L}]{_Z}")
AMBIGUOUS = re.compile(f"(?<=[\u0600-\u06ff])[{_L}]{_Z}(?=[\u0600-\u06ff])")
SUSPECT = re.compile(f"(?<!^)(?<!^[وفبكل])(?<=[\u0600-\u06ff])[{_L}]{_Z}(?=[\u0600-\u06ff])")
TURNED = re.compile(f"([{_L}])([{_L}])({_Z})")
FORM_TATWEEL = re.compile(f"(?<=[{T.FORMS}]){T.TATWEEL}|{T.TATWEEL}(?=[{T.FORMS}])")
THOUSANDS = re.compile(f"(?<![{T.DIGITS}]){T.THOUSANDS}|{T.THOUSANDS}(?![{T.DIGITS}])")
_WORD = re.compile("[\u0621-\u06d3]+")
_MANY = re.compile("[ء-يٱ-ۓ]{3,}")
_BLANK = re.compile("[ \t\n\x0b\f\r]+")
_SPACES = points.Table(dict.fromkeys(T.SPACES, " "))
_SIMPLE, _MIRROR, _HOMOGLYPHS, _CP1252 = map(points.Table, (T.SIMPLE, T.MIRROR, T.HOMOGLYPHS, T.CP1252))
_PUNCTUATION = str.maketrans(T.PUNCTUATION)
_PRESENTED = re.compile(f"[{''.join(T.PUNCTUATION)}]")
_LAM_ALEFS = {k for k in T.DEFERRED if "ﻵ" <= k <= "ﻼ"}
_RARE = str.maketrans({k: v for k, v in T.DEFERRED.items() if k not in _LAM_ALEFS})
_ODD = re.compile(r"[0-9A-Za-z\u0660-\u0669\u06f0-\u06f9\u00c0-\u024f\u06e5\u06e6.()]")
_DEAF = T.BAD + T.ZERO_WIDTH
_FORM = re.compile(f"[{T.FORMS}]")


def rounded(x: float, n: int) -> float:
    """As Spark rounds: the shortest decimal of a number, halves away from zero."""
    return float(Decimal(repr(float(x))).quantize(Decimal(1).scaleb(-n), ROUND_HALF_UP))


def _is_arabic(c: str) -> bool:
    return "؀" <= c <= "ۿ" or "ݐ" <= c <= "ݿ" or "ࢠ" <= c <= "ࣿ"


def _is_form(c: str) -> bool:
    return "ﭐ" <= c <= "﷿" or "ﹰ" <= c <= "﻾"


def _is_private(c: str) -> bool:
    return "" <= c <= "" or "\U000f0000" <= c <= "\U000ffffd" or "\U00100000" <= c <= "\U0010fffd"


@lru_cache(1 << 16)
def _kind(c: str) -> int:
    """1 Arabic, 2 a form, 4 private use, 8 a combining mark; 0 anything else."""
    return _is_arabic(c) | _is_form(c) << 1 | _is_private(c) << 2 | (ud.category(c) == "Mn") << 3


def _of(chars: set[str], kind: int) -> list[str]:
    return [c for c in chars if c > "\u02ff" and _kind(c) & kind]


def _count(text: str, members) -> int:
    return sum(map(text.count, members))


def arabic_count(text: str) -> int:
    return 0 if text.isascii() else _count(text, _of(set(text), 1))


# misread bytes


def from_utf8(text: str) -> str | None:
    """UTF-8 bytes that were read as CP1252 or Latin-1; null where they are none, and where signs of both are mixed."""
    chars = set(text)
    if any(c in T.CP1252 for c in chars) and any("\x80" <= c < "\xa0" and c in _SIGNS for c in chars):
        return None
    t = _CP1252(text)
    try:
        return None if t.isascii() else t.encode("latin-1").decode()
    except UnicodeError:
        return None


_SIGNS = set(T.CP1252.values())


def _reading(page: dict[str, str]) -> tuple[points.Table, set[str]]:
    return points.Table({k: v for k, v in page.items() if v}), {k for k, v in page.items() if not v}


_PAGES = tuple(_reading(t) for t in (T.CP1256, T.ISO_8859_6))


def from_legacy(text: str) -> str | None:
    """CP1256 or ISO-8859-6 bytes that were read as CP1252 or Latin-1: the reading with more Arabic, the former of equal ones."""
    if text.isascii():
        return None
    chars = set(text)
    high = [c for c in chars if c > "\x7f"]
    if not any(c <= "\xff" for c in high) or any(c > "\xff" and c not in T.CP1252 for c in high):
        return None
    seen = len(text) - _count(text, " \t\n\x0b\f\r")
    # no reading has more Arabic than there are such characters
    if 2 * _count(text, high) < seen or encoding.cased_as_latin(text):
        return None
    best, most = None, 0
    for table, gone in _PAGES:
        if gone & chars:
            continue
        own = table(text)
        gain, left = arabic_count(own), len(_BLANK.sub("", own))
        if gain >= 3 and left >= 3 and 2 * gain >= left and gain > most:
            best, most = own, gain
    return best


def recovery(text: str) -> tuple[str, str] | None:
    """(text, how) of a text whose bytes were misread: whole as UTF-8 or a legacy page, else in windows."""
    if text.isascii():
        return None
    chars = set(text)
    if any("\x80" <= c <= "\xff" for c in chars):
        # every Arabic character of two or three bytes begins with one of these
        own = from_utf8(text) if chars & _LEADS else None
        if own is not None and arabic_count(own) > arabic_count(text):
            return own, "full-utf8"
        if (own := from_legacy(text)) is not None:
            return own, "full-legacy"
    return encoding.recover(text) if chars & set(encoding.LEADS) else None


_LEADS = {*encoding.LEADS, "Ý", "à"}


# signals and diagnosis


def has_form(text: str) -> bool:
    return not text.isascii() and _FORM.search(text) is not None


def fold_simple(text: str) -> str:
    if not has_form(text):
        return text
    return _SIMPLE(FORM_TATWEEL.sub("", text) if T.TATWEEL in text else text)


def _balance(x: int, y: int) -> float | None:
    return (x - y) / (x + y) if x + y else None


def signals(folded: str, shaped: str) -> tuple[float | None, float | None, float | None]:
    """final_only, joining and article; null without evidence."""
    a, b, c, d = (0, 0, 0, 0) if folded.isascii() else points.word_ends(points.of(folded))
    pairs, wrong = points.joining_tally(points.of(shaped)) if has_form(shaped) else (0, 0)
    return _balance(a, b), min(1.0, 0.6 + 0.4 * wrong / pairs) if wrong else -1.0 if pairs else None, _balance(c, d)


WEIGHTS = (0.5, 0.35, 0.15)


def vote(s: tuple) -> float:
    """Mean of the signals there are, weighted: above 0 the order is visual."""
    weight = total = 0.0
    for v, w in zip(s, WEIGHTS, strict=True):
        weight, total = weight + (0.0 if v is None else w), total + (0.0 if v is None else v * w)
    return total / weight if weight > 0 else 0.0


DIAGNOSIS = "struct<defects:array<string>,chars:int,arabic_ratio:double,pf_ratio:double,pua_ratio:double,tatweel_ratio:double,final_only:double,joining:double,article:double,order_score:double,lam_alef_decisive:bigint,lam_alef_ambiguous:bigint,defect_confidence:map<string,double>,confidence:double>"


def judged(text: str, mojibake: bool, th: dict) -> dict:
    """Measures, defects and confidence (the weakest of the defects') of a text, told whether its bytes were misread."""
    n, chars = len(text), set() if text.isascii() else set(text)
    forms = _of(chars, 2)
    n_forms = _count(text, forms)
    arabic = n_forms + _count(text, _of(chars, 1))
    nothing = text.strip(" ") == ""
    if mojibake and not nothing:
        return {"defects": ["mojibake"], "chars": n, "arabic_ratio": arabic / n, "pf_ratio": 0.0, "pua_ratio": 0.0, "tatweel_ratio": 0.0, "final_only": None, "joining": None, "article": None, "order_score": 0.0, "lam_alef_decisive": 0, "lam_alef_ambiguous": 0, "defect_confidence": {"mojibake": 1.0}, "confidence": 1.0}
    final, joining, article = signals(fold_simple(text), text) if arabic else (None, None, None)
    pf = n_forms / arabic if arabic else 0.0
    pua, tatweel = (_count(text, own) / n if n else 0.0 for own in (_of(chars, 4), T.TATWEEL))
    decisive = len(DECISIVE.findall(text)) if arabic else 0
    ambiguous = len(AMBIGUOUS.findall(text)) if arabic else 0
    enough = arabic >= th["min_arabic_chars"] or (joining or 0) > 0
    score = rounded(vote((final, joining, article)), 6) if enough and arabic else 0.0
    found = [d for d, x in (("presentation_forms", pf > th["presentation_forms"]), ("broken_cmap", pua > th["pua"]), ("lam_alef_transposed", decisive > 0), ("tatweel_noise", tatweel > th["tatweel"]), ("visual_order", score > th["visual_order"])) if x]
    defects = ["no_text_layer"] if nothing else found or ["none"]
    sure = {d: rounded(0.30 + 0.60 * min(1.0, n / 300.0), 3) if d == "none" else rounded(min(1.0, abs(score)), 3) if d == "visual_order" else 1.0 for d in defects}
    return {"defects": defects, "chars": n, "arabic_ratio": arabic / n if n else 0.0, "pf_ratio": pf, "pua_ratio": pua, "tatweel_ratio": tatweel, "final_only": final, "joining": joining, "article": article, "order_score": score, "lam_alef_decisive": decisive, "lam_alef_ambiguous": ambiguous, "defect_confidence": sure, "confidence": min(sure.values())}


def diagnosed(text: str, th: dict) -> dict:
    return judged(text, recovery(text) is not None, th)


# rewrites


def sanitized(text: str, zero_width: bool = True) -> str:
    """Spaces, separators, replacement characters, zero width and composition."""
    if text.isascii():
        return text
    chars = set(text)
    if chars & set(T.SPACES):
        text = _SPACES(text)
    if T.THOUSANDS in chars:
        text = THOUSANDS.sub(T.COMMA, text)
    for c in chars & set(_DEAF if zero_width else T.BAD):
        text = text.replace(c, "")
    return ud.normalize("NFC", text) if any(c > "\u02ff" for c in chars) else text


def folded_forms(text: str, how) -> str:
    """Forms, punctuation, tatweel, zero width and homoglyphs folded, then composed."""
    text = fold_simple(text)
    text = text.translate(_PUNCTUATION) if _PRESENTED.search(text) else text
    for c in (T.TATWEEL if how.tatweel else "") + (T.ZERO_WIDTH if how.zero_width else ""):
        text = text.replace(c, "")
    return ud.normalize("NFC", _HOMOGLYPHS(text) if how.homoglyphs else text)


_MARKS_GONE = re.compile(f"[{T.MARKS}]+")
_UNIFIED = {(a, b, c): points.Table({**(dict.fromkeys("آأإٱ", "ا") if a else {}), **({"ة": "ه"} if b else {}), **({"ى": "ي"} if c else {})}) for a in (0, 1) for b in (0, 1) for c in (0, 1)}


def normalized(text: str, diacritics: bool = False, alef: bool = False, taa: bool = False, maqsura: bool = False) -> str:
    """All layers: forms, ligatures, punctuation, tatweel, zero width, what is to be unified, homoglyphs, composition."""
    if text.isascii():
        return text
    text = fold_simple(text)
    text = expanded(text.translate(_PUNCTUATION) if _PRESENTED.search(text) else text)
    for c in T.TATWEEL + T.ZERO_WIDTH:
        text = text.replace(c, "")
    text = _UNIFIED[int(alef), int(taa), int(maqsura)](_MARKS_GONE.sub("", text) if diacritics else text)
    return ud.normalize("NFC", _HOMOGLYPHS(text))


def turned(text: str, how: direction.Turning) -> str:
    if how == direction.Turning() and not _ODD.search(text) and not _of(set(text), 8):
        return _MIRROR("\n".join(line[::-1] for line in text.split("\n")))
    return direction.turn(text, how)


def expanded(text: str) -> str:
    if not has_form(text):
        return text
    for c in _LAM_ALEFS:
        text = text.replace(c, T.DEFERRED[c])
    return text.translate(_RARE) if _FORM.search(text) else text


def lam_alef_mended(text: str, passes: int = 8) -> str:
    for _ in range(passes):
        if not TURNED.search(text):
            break
        text = TURNED.sub(r"\1\3\2", text)
    return text


def swapped(text: str, swaps: dict[str, str]) -> str:
    """Words that a map knows are replaced; only texts with an ambiguous lam-alef are cut into words."""
    if not swaps or not AMBIGUOUS.search(text):
        return text
    return _WORD.sub(lambda m: swaps.get(m[0], m[0]), text)


def suspects(text: str) -> list[str]:
    return sorted({w for w in _WORD.findall(text) if SUSPECT.search(w)}) if AMBIGUOUS.search(text) else []


_LETTER, _MARK = spacing.LETTER, spacing.MARK


def _python(pattern: str) -> re.Pattern:
    """A pattern of ``spacing`` as Python writes it: its class of blanks is what ``\\s`` stands for here."""
    return re.compile(pattern.replace(f"[{spacing.SPACE[1:-1]}&&[^\\r\\n]]", "[^\\S\\r\\n]").replace(spacing.SPACE, "\\s"))


_MIDWORD = [(_python(p), to) for p, to in spacing.midword_patterns()]
_PARTICLES = [(_python(p), to) for p, to in spacing.particle_patterns()]
_PUNCTUATED = [(_python(p), to) for p, to in spacing.punctuation_patterns()]
_SPACED = re.compile(spacing.ANY)


def _all(text: str, rules: list) -> str:
    for p, to in rules:
        text = p.sub(to, text)
    return text


def _confusion_steps() -> list:
    pattern = lambda p, to: ("p", _python(p), to)
    words = lambda rules: [("w", a, b) for a, b in spacing._rules(rules)]
    return [
        pattern(f"(?<![{_LETTER}])(امل{_MARK}*+){spacing.SPACE}+", r"\1"),
        *words(spacing.WHOLE),
        pattern(spacing.AL_MEEM, "الم"),
        *words(spacing.FIRST),
        pattern(*spacing.SHORT),
        *words(spacing.THEN),
        *(pattern(spacing._HINI + ending, "حين") for ending in ("(?=نا)", "(?!ن)")),
    ]


_CONFUSED = re.compile("امل|غري|حني|" + "|".join(sorted({a for a, _ in spacing._rules(f"{spacing.WHOLE} {spacing.FIRST} {spacing.THEN}")})))
_STEPS = _confusion_steps()


def confusions_mended(text: str) -> str:
    if not _CONFUSED.search(text):
        return text
    for kind, a, b in _STEPS:
        text = text.replace(a, b) if kind == "w" else a.sub(b, text)
    return text


def spaced_words(text: str) -> str:
    return _all(text, _MIDWORD) if " " in text and _SPACED.search(text) else text


def spaced_particles(text: str) -> str:
    return _all(text, list(chain(_PARTICLES, _PUNCTUATED))) if _SPACED.search(text) else text


# the ladder

LADDER = f"diagnosis {DIAGNOSIS}, repaired string, changed boolean, stages array<string>, confidence double, notes array<string>"
STEP = "array<struct<stage:string,rule:string,before:string,after:string,confidence:double>>"
ABSTENTION = "array<struct<stage:string,rule:string,decision:string,value:double>>"
AUDIT = f"audit struct<mode:string,original_sha256:string,repaired_sha256:string,steps:{STEP},abstentions:{ABSTENTION}>"


def _rescued(text: str, shaped: str, turning, th: dict) -> str:
    """The lines of a text that are visual by themselves, turned."""
    lines, shapes = text.split("\n"), shaped.split("\n")
    out = []
    for i, line in enumerate(lines):
        own = shapes[i] if len(lines) == len(shapes) else line
        s = signals(fold_simple(own), own)
        enough = sum(map(len, WORDS.findall(line))) >= th["min_arabic_chars"]
        visual = vote(s) > th["visual_order"] and (enough or (s[1] or 0) > 0)
        out.append(direction.turn_line(line, turning) if visual else line)
    return "\n".join(out)


def climbed(text: str | None, how, th: dict, turning: direction.Turning, known: list[dict]) -> dict:
    """A text through the ladder: what ``LADDER`` names, and ``AUDIT`` if it is asked for."""
    c0 = text or ""
    audit = (how.audit or "off").lower()
    steps: list[dict] = []

    def step(before: str, after: str, stage: str, rule: str, sure: float | None = None) -> str:
        if audit != "off" and before != after:
            steps.append({"stage": stage, "rule": rule, "before": before, "after": after, "confidence": sure})
        return after

    c1 = c0
    if how.hygiene:
        # a soft hyphen may be a byte of misread text
        soft = T.SOFT_HYPHEN in c0 and not (how.mojibake and recovery(c0) is not None)
        c1 = sanitized(c0.replace(T.SOFT_HYPHEN, "-") if soft else c0, how.zero_width)
    step(c0, c1, "hygiene", "SANITIZE_EXTRACTION")
    rec = recovery(c1)
    if how.mojibake:
        c2 = step(c1, rec[0] if rec else c1, "hygiene", "MOJIBAKE_UTF8_LATIN1_RECOVERY")
        dg = judged(c2, rec is not None and recovery(c2) is not None, th)
    else:
        c2, dg = c1, judged(c1, rec is not None, th)
    has = set(dg["defects"]).__contains__
    needs = how.normalize and (has("presentation_forms") or has("tatweel_noise"))
    c3 = step(c2, folded_forms(c2, how) if needs else c2, "normalize", "FOLD_PRESENTATION_FORMS")
    arabic = not c3.isascii() and WORDS.search(c3) is not None
    score = vote(signals(c3, c2)) if arabic else 0.0
    turn = how.reorder and (how.force_reorder or score > th["visual_order"])
    sure = 0.5 if how.force_reorder else min(1.0, abs(score))
    c4 = step(c3, turned(c3, turning) if turn else c3, "reorder", "VISUAL_ORDER_REVERSAL", sure)
    c4r = c4
    if how.reorder and how.rescue_lines and not turn and "\n" in c4:
        c4r = step(c4, _rescued(c4, c2, turning, th), "reorder", "MIXED_LINE_RESCUE")
    c5 = step(c4r, expanded(c4r) if how.normalize and how.expand else c4r, "expand_ligatures", "EXPAND_DEFERRED_FORMS")
    c6, left, lam = c5, [], 1.0
    if how.lam_alef:
        if not c5.isascii():
            c6 = lam_alef_mended(c5)
            for swaps in known:
                c6 = swapped(c6, swaps)
            left = suspects(c6)
        step(c5, c6, "repair_lam_alef", "LAM_ALEF_TRANSPOSITION")
        n = len(left)
        if how.confidence_mode == "classic":
            lam = rounded(max(0.35, 1.0 - 0.1 * n), 3) if c6 != c5 and n else 1.0
        else:
            lam = rounded(max(0.35, 1.0 - 2.0 * n / max(1, len(_MANY.findall(c6)))), 3)
    plain = c6.isascii()
    c7 = step(c6, _HOMOGLYPHS(c6) if how.homoglyphs and not plain else c6, "normalize", "FOLD_PDF_HOMOGLYPHS")
    c8 = step(c7, spaced_words(c7) if how.spacing and not plain else c7, "repair_spacing", "COLLAPSE_MIDWORD_SPACES")
    c9 = step(c8, confusions_mended(c8) if how.confusions and not plain else c8, "repair_pdf_confusions", "CLOSED_PDF_CONFUSIONS")
    c10 = step(c9, spaced_particles(c9) if how.spacing and not plain else c9, "repair_spacing", "CONTEXTUAL_ARABIC_SPACING")
    stages = [s for s, x in (("hygiene", c0 != c1), ("diagnose", True), ("normalize", needs), ("reorder", turn or c4 != c4r), ("expand_ligatures", c4r != c5), ("repair_lam_alef", c5 != c6), ("repair_pdf_confusions", c8 != c9), ("repair_spacing", c7 != c8 or c9 != c10)) if x]
    notes = [
        s
        for s, x in (
            ("bytes read in another code page were read again", c1 != c2),
            ("misread bytes were left as they are", has("mojibake")),
            ("ambiguous lam-alef left: " + ", ".join(left[:5]), bool(left)),
            ("private-use characters need the font's own map", has("broken_cmap")),
            ("no text layer", has("no_text_layer")),
        )
        if x
    ]
    final = min(sure if turn else 1.0, 0.3 if has("broken_cmap") else 1.0, 0.0 if has("no_text_layer") else 1.0)
    out = {"diagnosis": dg, "repaired": None if text is None else c10, "changed": c10 != c0, "stages": stages, "confidence": min(rounded(final, 3), lam), "notes": notes}
    if audit != "off":
        few = len(re.findall("[\ufe70-\ufe7f]", c1))
        below = how.reorder and not how.force_reorder and 0.20 <= abs(score) < th["visual_order"] and c4 == c4r
        seen = [
            (few > 0 and not has("presentation_forms"), "normalize", "PRESENTATION_FORM_BELOW_THRESHOLD", "uncertain", few),
            (has("mojibake") and not how.mojibake, "diagnose", "MOJIBAKE_FIX_DISABLED", "uncertain", 1),
            (below, "reorder", "VISUAL_ORDER_BELOW_THRESHOLD", "uncertain", score),
            (left and c5 == c6, "repair_lam_alef", "LAM_ALEF_AMBIGUOUS", "uncertain", len(left)),
            (has("broken_cmap"), "rebuild_cmap", "BROKEN_CMAP_NOT_RESOLVED_IN_TEXT_MODE", "unsafe", 1),
            (has("no_text_layer"), "ocr", "NO_TEXT_LAYER_OCR_NOT_SHIPPED", "unsafe", 1),
        ]
        abstained = [{"stage": s, "rule": r, "decision": d, "value": float(v)} for x, s, r, d, v in seen if x]
        sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
        out["audit"] = {"mode": audit, "original_sha256": sha(c0), "repaired_sha256": sha(c10), "steps": steps, "abstentions": abstained}
    return out
