"""Recovery metrics: error rates, entropy of direction runs, histograms of marks."""

from __future__ import annotations

import unicodedata as ud
from functools import lru_cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import arrow
from ..functions import tables as T


def error_rate(reference: Column, hypothesis: Column) -> Column:
    """Edit distance over the reference's length; 0 for an empty reference."""
    n = F.length(reference)
    return F.when(n > 0, F.levenshtein(reference, hypothesis) / n).otherwise(0.0)


def worst(rates: DataFrame, key: str, order: list[Column], k: int = 3) -> DataFrame:
    return rates.withColumn("rank", F.row_number().over(W.partitionBy(key).orderBy(*order))).where(F.col("rank") <= k)


_FAMILY = {"AL": "R", "R": "R", "AN": "AN", "EN": "EN", "ES": "EN", "ET": "EN", "WS": "W", "S": "W", "B": "W", "BN": "W"}


@lru_cache(1)
def families() -> dict[str, str]:
    """Members of the families of bidirectional classes R, AN, EN and W as ranges of code points, from the Unicode data.

    They are listed where they differ from the general categories: up to U+3100 and among the forms.
    """
    runs: dict[str, list[list[int]]] = {b: [] for b in ("R", "AN", "EN", "W")}
    for cp in (*range(0x3100), *range(0xFB1D, 0x10000)):
        b = _FAMILY.get(ud.bidirectional(chr(cp)))
        if b and runs[b] and runs[b][-1][1] == cp - 1:
            runs[b][-1][1] = cp
        elif b:
            runs[b].append([cp, cp])
    return {b: "".join(f"\\x{{{x:x}}}" if x == y else f"\\x{{{x:x}}}-\\x{{{y:x}}}" for x, y in r) for b, r in runs.items()}


#: Letters and what behaves like them, and marks, by general category.
LEFT, MARK = "\\p{L}\\p{Mc}\\p{Nl}\\p{Co}", "\\p{Mn}\\p{Me}"


def buckets() -> list[tuple[str, str]]:
    """(bucket, class) of the six named families; N is what is left."""
    f = families()
    return [("R", f["R"]), ("AN", f["AN"]), ("L", f"{LEFT}&&[^{f['R']}{f['AN']}{f['EN']}]"), ("EN", f["EN"]), ("W", f"{f['W']}&&[^\\r\\n]"), ("M", f"{MARK}&&[^{f['R']}]")]


def bucket_counts(c: Column) -> Column:
    """Array of (bucket, n): maximal runs of one family of directions within lines, counted in the row.

    A line break ends a run and is none itself.
    """
    return F.coalesce(arrow.direction_runs(c), F.array().cast("array<struct<bucket:string,n:bigint>>"))


def run_histogram(df: DataFrame, key: str = "doc_id", text: str = "t") -> DataFrame:
    """key, bucket, n of ``bucket_counts``."""
    return df.select(key, F.inline(bucket_counts(F.col(text))))


def flow(c: Column) -> Column:
    """Struct of n_runs, entropy_bits and normalized of a text's direction runs, in the row."""

    def told(h: Column) -> Column:
        total = F.aggregate(h, F.lit(0).cast("long"), lambda a, x: a + x["n"])
        bits = F.aggregate(h, F.lit(0.0), lambda a, x: a - x["n"] / total * F.log2(x["n"] / total))
        return F.struct(total.alias("n_runs"), F.round(F.abs(bits), 4).alias("entropy_bits"), F.when(F.size(h) > 1, F.round(bits / F.log2(F.size(h)), 4)).otherwise(0.0).alias("normalized"), F.map_from_entries(h).alias("histogram"))

    return F.transform(F.array(bucket_counts(c)), told)[0]


def entropy_delta(a: DataFrame, b: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, delta of the normalised entropies of two ``entropy`` tables."""
    return a.select(key, F.col("normalized").alias("x")).join(b.select(key, F.col("normalized").alias("y")), key).select(key, F.round(F.abs(F.col("x") - F.col("y")), 4).alias("delta"))


LETTERS = "ء-يٮ-ۓۺ-ۿ"


def base_marks(df: DataFrame, key: str = "doc_id", text: str = "t") -> DataFrame:
    """key, base, mark, n: marks by the letter that they stand on, homoglyphs folded; without a letter under "_"."""
    own = df.select(key, F.inline(arrow.base_marks(LETTERS, T.MARKS, T.HOMOGLYPHS)(F.col(text))))
    return own.groupBy(key, "base", "mark").agg(F.sum("n").alias("n"))


def top_bases(matrix: DataFrame, key: str = "doc_id", k: int = 12) -> DataFrame:
    """``base_marks`` of the ``k`` letters that carry most marks; of equal ones the first letters."""
    sums = matrix.where("base != '_'").groupBy(key, "base").agg(F.sum("n").alias("total"))
    top = sums.withColumn("rank", F.row_number().over(W.partitionBy(key).orderBy(F.desc("total"), "base"))).where(F.col("rank") <= k)
    return matrix.join(top.select(key, "base", "rank"), [key, "base"])


def mark_rates(c: Column) -> Column:
    """Struct of leading_mark_rate (words that begin with a mark) and marks_per_base."""
    words = F.filter(F.split(c, "\\s+"), lambda w: w != "")
    leading = F.size(F.filter(words, lambda w: w.rlike(f"^[{T.MARKS}]")))
    bases, marks = F.regexp_count(c, F.lit(f"[{LETTERS}]")), F.regexp_count(c, F.lit(f"[{T.MARKS}]"))
    return F.struct(F.round(leading / F.greatest(F.size(words), F.lit(1)), 4).alias("leading_mark_rate"), F.round(marks / F.greatest(bases, F.lit(1)), 4).alias("marks_per_base"))


def entropy(histogram: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, n_runs, entropy_bits, normalized (by the logarithm of the number of buckets)."""
    total = histogram.withColumn("p", F.col("n") / F.sum("n").over(W.partitionBy(key)))
    h = total.groupBy(key).agg(F.sum("n").alias("n_runs"), F.count("*").alias("k"), (-F.sum(F.col("p") * F.log2("p"))).alias("h"))
    return h.select(key, "n_runs", F.round(F.abs("h"), 4).alias("entropy_bits"), F.when(F.col("k") > 1, F.round(F.col("h") / F.log2("k"), 4)).otherwise(0.0).alias("normalized"))


def cosine(a: DataFrame, b: DataFrame, key: str, bucket: str = "bucket", n: str = "n") -> DataFrame:
    """key, similarity of two histograms; 1 where both are empty."""
    both = a.select(key, bucket, F.col(n).alias("x")).join(b.select(key, bucket, F.col(n).alias("y")), [key, bucket], "full").fillna(0, ["x", "y"])
    s = both.groupBy(key).agg(F.sum(F.col("x") * F.col("y")).alias("xy"), F.sum(F.col("x") * F.col("x")).alias("xx"), F.sum(F.col("y") * F.col("y")).alias("yy"))
    return s.select(key, F.round(F.when((F.col("xx") == 0) & (F.col("yy") == 0), 1.0).when((F.col("xx") == 0) | (F.col("yy") == 0), 0.0).otherwise(F.col("xy") / F.sqrt(F.col("xx").cast("double") * F.col("yy"))), 6).alias("similarity"))
