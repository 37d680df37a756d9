"""Kernels as Arrow functions over columns.

A row that needs none is passed as null, which costs nothing to send, and comes back as null:
``only(kernel, column, where)`` keeps the column's own value there.
"""

from __future__ import annotations

import re
import unicodedata as ud
from collections import Counter
from dataclasses import replace

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..kernels import compare, direction, encoding, ladder, points


class _Kernel:
    """An Arrow function that is made when it is first used: its type needs a session."""

    def __init__(self, run, returns: str):
        self.run, self.returns, self.made = run, returns, None

    def __call__(self, *columns: Column) -> Column:
        if self.made is None:
            self.made = F.pandas_udf(self.run, self.returns)
        return self.made(*columns)


def _kernel(returns: str):
    return lambda run: _Kernel(run, returns)


def _each(fn, returns: str) -> tuple[_Kernel, _Kernel]:
    """``fn`` of the non-null values of one or two text columns, batch by batch."""

    def run1(a: pd.Series) -> pd.Series:
        return pd.Series([None if x is None else fn(x) for x in a], dtype="object")

    def run2(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([None if x is None or y is None else fn(x, y) for x, y in zip(a, b, strict=True)], dtype="object")

    return _Kernel(run1, returns), _Kernel(run2, returns)


def only(kernel, c: Column, where: Column) -> Column:
    return F.coalesce(kernel(F.when(where, c)), c)


def turned(how: direction.Turning = direction.Turning()):
    return _each(lambda t: direction.turn(t, how), "string")[0]


def turned_lines(how: direction.Turning):
    """Of an array of lines those that aren't null."""
    return _each(lambda lines: [None if x is None else direction.turn_line(x, how) for x in lines], "array<string>")[0]


shaped = _each(points.shaped, "string")[0]
direction_runs = _each(lambda t: [{"bucket": b, "n": n} for b, n in points.direction_runs(t)], "array<struct<bucket:string,n:bigint>>")[0]
legacy = _each(ladder.from_legacy, "string")[0]
spaced_words = _each(ladder.spaced_words, "string")[0]
confusions_mended = _each(ladder.confusions_mended, "string")[0]


def normalized(**how: bool) -> _Kernel:
    return _each(lambda t: ladder.normalized(t, **how), "string")[0]


def base_marks(letters: str, marks: str, fold: dict[str, str]) -> _Kernel:
    """Array of (base, mark, n): marks by the letter that they stand on, under "_" without one."""
    found = re.compile(f"([{letters}]?)([{marks}]+)")

    def counted(t: str) -> list[dict]:
        clusters_ = Counter(found.findall(t))
        own: Counter = Counter()
        for (base, ms), n in clusters_.items():
            for m in ms:
                own[fold.get(base, base) or "_", m] += n
        return [{"base": b, "mark": m, "n": n} for (b, m), n in own.items()]

    return _each(counted, "array<struct<base:string,mark:string,n:bigint>>")[0]


nfc = _each(lambda t: ud.normalize("NFC", t), "string")[0]
clusters = _each(direction.clusters, "array<string>")[0]
islands_restored = _each(direction.restore_islands, "string")[0]
parens_mended = _each(direction.mend_parens, "string")[0]
pages_ascending = _each(direction.ascending_pages, "string")[0]
solid = _each(direction.is_solid, "boolean")[0]
legacy_recovered = _each(encoding.from_legacy, "string")[0]
windows_recovered = _each(encoding.by_windows, "string")[0]

distance = _each(compare.distance, "int")[1]
word_distance = _each(lambda a, b: compare.distance(a.split(), b.split()), "int")[1]
error_kinds = _each(compare.error_kinds, "map<string,int>")[1]



def diagnosed(thresholds: dict) -> _Kernel:
    def run(t: pd.Series) -> pd.DataFrame:
        return _frame([ladder.diagnosed(x or "", thresholds) for x in t], ladder.DIAGNOSIS[7:-1])

    return _Kernel(run, ladder.DIAGNOSIS)


def climbed(how, thresholds: dict, core: dict[str, str]) -> _Kernel:
    """The ladder ``how`` over a column of texts and, if there is a second one, their own maps of swaps."""
    turning = replace(how.turning, forward_marks=how.forward_marks or how.turning.forward_marks)
    returns = f"struct<{', '.join([ladder.LADDER, *([ladder.AUDIT] if (how.audit or 'off').lower() != 'off' else [])])}>"

    def run(t: pd.Series) -> pd.DataFrame:
        return _frame([ladder.climbed(x, how, thresholds, turning, [core]) for x in t], returns[7:-1])

    def run2(t: pd.Series, swaps: pd.Series) -> pd.DataFrame:
        return _frame([ladder.climbed(x, how, thresholds, turning, [dict(m) if m is not None else {}, core]) for x, m in zip(t, swaps, strict=True)], returns[7:-1])

    one, two = _Kernel(run, returns), _Kernel(run2, returns)
    return lambda *columns: (one, two)[len(columns) - 1](*columns)


@_kernel("struct<pairs:bigint,wrong:bigint>")
def joining_tally(t: pd.Series) -> pd.DataFrame:
    """One wrong pair proves a visual order; texts without a form have no pairs."""
    own = [(0, 0) if not x or x.isascii() else points.joining_tally(points.of(x)) if ladder.has_form(x) else (0, 0) for x in t]
    return pd.DataFrame(own, columns=["pairs", "wrong"], dtype="int64")


@_kernel("struct<final_only:double,joining:double,article:double>")
def signals(folded: pd.Series, shaped: pd.Series) -> pd.DataFrame:
    own = [ladder.signals(x or "", y or "") for x, y in zip(folded, shaped, strict=True)]
    return pd.DataFrame(own, columns=["final_only", "joining", "article"], dtype="float64").astype("object").where(lambda d: d.notna(), None)


def _frame(rows: list[dict], fields: str) -> pd.DataFrame:
    names = re.findall(r"(\w+)[: ]", re.sub(r"<[^<>]*>", "", re.sub(r"<[^<>]*>", "", re.sub(r"<[^<>]*>", "", re.sub(r"<[^<>]*>", "", fields)))))
    return pd.DataFrame({k: pd.Series([r[k] for r in rows], dtype="object") for k in names})


OPERATION = "array<struct<start_before:int,end_before:int,start_after:int,end_after:int,before:string,after:string>>"


@_kernel("struct<text:string,how:string>")
def recovered(t: pd.Series) -> pd.DataFrame:
    got = [None if x is None else encoding.recover(x) for x in t]
    return pd.DataFrame({"text": [g and g[0] for g in got], "how": [g and g[1] for g in got]}, dtype="object")


@_kernel(OPERATION)
def operations(a: pd.Series, b: pd.Series) -> pd.Series:
    names = ("start_before", "end_before", "start_after", "end_after", "before", "after")
    return pd.Series([None if x is None or y is None else [dict(zip(names, o, strict=True)) for o in compare.operations(x, y)] for x, y in zip(a, b, strict=True)], dtype="object")


_MCS = "mcs_score double, letter_fidelity double, token_continuity double, joining_integrity double, joining_pairs long, joining_violations long"
_DBR = "dbr_score double, inventory_match double, attachment_accuracy double, leading_mark_rate double, marks_per_base_ref double, marks_per_base_hyp double"
_SHDR = "drift_rate double, n_homoglyphs long, n_arabic_letters long, aligned_homoglyph_fraction double, true_letter_error_rate double, raw_letter_error_rate double"


@_kernel(f"{_MCS}, {_DBR}, {_SHDR}")
def audited(reference: pd.Series, hypothesis: pd.Series, pairs: pd.Series, wrong: pd.Series) -> pd.DataFrame:
    rows = []
    for a, b, p, w in zip(reference, hypothesis, pairs, wrong, strict=True):
        a, b = a or "", b or ""
        m, d = compare.continuity(a, b, (int(p), int(w))), compare.attachment(a, b)
        rows.append({"mcs_score": m.pop("score"), **m, "dbr_score": d.pop("score"), **d, **compare.drift(a, b)})
    columns = [c.split()[0] for c in f"{_MCS}, {_DBR}, {_SHDR}".split(", ")]
    return pd.DataFrame(rows, columns=columns)
