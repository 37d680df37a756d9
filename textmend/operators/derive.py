"""Arabic and damaged tables derived from documents, for the queries: by ``translate``, so every engine can."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import arrow
from ..functions import tables as T

LATIN = "abcdefghijklmnopqrstuvwxyz"
#: One letter each: a is alef, l lam, y teh marbuta, i alef maqsura.
LETTERS = "ابتديفجهىخكلمنوذقرسطعغشصةز"


def arabic(df: DataFrame, text: str = "text") -> DataFrame:
    """``df`` with ``t``: its text in Arabic letters."""
    return df.withColumn("t", F.translate(F.lower(F.coalesce(text, F.lit(""))), LATIN, LETTERS))


def with_forms(c: Column) -> Column:
    return F.translate(c, "".join(T.ISOLATED), "".join(T.ISOLATED.values()))


def with_noise(c: Column) -> Column:
    """A zero width space first, spaces that don't break, commas as thousands separators, dots as soft hyphens."""
    return F.concat(F.lit(T.ZERO_WIDTH[0]), F.translate(c, " ,.", T.NBSP + T.THOUSANDS + T.SOFT_HYPHEN))


def with_homoglyphs(c: Column) -> Column:
    return F.translate(c, "\u064a\u0647\u0643", "\u06cc\u06be\u06a9")


def with_broken_lam_alef(c: Column) -> Column:
    return F.replace(c, F.lit(T.LAM + "\u0627"), F.lit("\u0627" + T.LAM))


def with_ligatures(c: Column) -> Column:
    return F.replace(c, F.lit(T.LAM + "\u0627"), F.lit("\ufefb"))


def _by_letter() -> dict[str, dict[str, str]]:
    table: dict[str, dict[str, str]] = {}
    for form, kind in T.JOINING.items():
        if (base := T.SIMPLE.get(form)) and form >= "\ufe70":
            table.setdefault(base, {})[kind] = form
    return table


FORMS = _by_letter()
#: Letters that join the following one, and all that join the one before.
DUAL = "".join(b for b, f in FORMS.items() if "I" in f)
JOINED = "".join(b for b, f in FORMS.items() if "F" in f)


def form_table(kind: str) -> dict[str, str]:
    return {b: f[kind] for b, f in FORMS.items() if kind in f}


def shaped(c: Column) -> Column:
    """Letters as the forms that a font would draw, by their neighbours: over arrays of code points."""
    return arrow.shaped(c)


def visual(c: Column) -> Column:
    """Every line backwards."""
    return F.array_join(F.transform(F.split(c, "\n"), F.reverse), "\n")


def with_spaces_cut(c: Column) -> Column:
    """Blanks after punctuation and the function words' own go."""
    return F.replace(F.replace(c, F.lit("، "), F.lit("،")), F.lit("؛ "), F.lit("؛"))
