"""Recovery measured against references: rates, audits, worst lines, gates, mutations and error kinds."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import arrow
from ..functions import tables as T
from ..functions import text as X
from . import metrics

#: Built-in edit distance is quadratic; longer texts go to the bit-vector kernel.
BUILT_IN = 256


@dataclass(frozen=True)
class Compared:
    """What is made alike before texts are compared."""

    collapse_whitespace: bool = True
    ignore_diacritics: bool = False
    ignore_variants: bool = False
    ignore_punctuation: bool = False


def prepared(c: Column, how: Compared = Compared()) -> Column:
    if how.ignore_diacritics or how.ignore_variants:
        c = X.normalize(c, forms=False, diacritics=how.ignore_diacritics, alef=how.ignore_variants, taa=how.ignore_variants, maqsura=how.ignore_variants)
    if how.ignore_punctuation:
        c = F.regexp_replace(c, "(?U)[^\\w\\s؀-ۿ]", "")
    return F.trim(F.regexp_replace(c, "(?U)\\s+", " ")) if how.collapse_whitespace else c


def behind(df: DataFrame, **columns: Column) -> DataFrame:
    """``df`` with columns made behind a generator of one row: a Python function over them doesn't copy their plans."""
    return df.select("*", F.inline(F.array(F.struct(*(c.alias(k) for k, c in columns.items())))))


def distance(a: Column, b: Column) -> Column:
    """Edit distance in code points: built in for short texts, bit vectors in Arrow batches for long ones."""
    short = (F.length(a) <= BUILT_IN) & (F.length(b) <= BUILT_IN)
    return F.when(short, F.levenshtein(F.when(short, a), F.when(short, b))).otherwise(arrow.distance(F.when(~short, a), F.when(~short, b)))


def rates(df: DataFrame, reference: str, hypothesis: str, how: Compared = Compared()) -> DataFrame:
    """``df`` with cer, wer, cer_accuracy, ref_chars and hyp_chars; a rate's denominator is the reference's length, 0 gives 0."""
    own = behind(df, _a=prepared(F.coalesce(reference, F.lit("")), how), _b=prepared(F.coalesce(hypothesis, F.lit("")), how))
    n = F.length("_a")
    words = F.when(n > 0, F.size(F.split(F.trim(F.regexp_replace("_a", "(?U)\\s+", " ")), " "))).otherwise(0)
    own = own.withColumn("cer", F.when(n > 0, distance(F.col("_a"), F.col("_b")) / n).otherwise(0.0))
    own = own.withColumn("wer", F.when(words > 0, arrow.word_distance(F.col("_a"), F.col("_b")) / words).otherwise(0.0))
    return own.withColumns({"cer_accuracy": F.greatest(F.lit(0.0), 1.0 - F.col("cer")), "ref_chars": F.length(reference), "hyp_chars": F.length(hypothesis)}).drop("_a", "_b")


def paired_lines(df: DataFrame, key: str, reference: str, hypothesis: str) -> DataFrame:
    """key, line (from 1), r, h: lines that aren't blank, paired by their place; what one side has more is left over."""

    def lines(c: str) -> Column:
        return F.filter(F.split(F.coalesce(c, F.lit("")), "\n"), lambda x: F.trim(x) != "")

    n = F.least(F.size("_r"), F.size("_h"))
    own = df.select(key, lines(reference).alias("_r"), lines(hypothesis).alias("_h"))
    zipped = F.arrays_zip(F.slice("_r", F.lit(1), n).alias("r"), F.slice("_h", F.lit(1), n).alias("h"))
    return own.select(key, F.posexplode(zipped).alias("i", "z")).select(key, (F.col("i") + 1).alias("line"), F.col("z")["r"].alias("r"), F.col("z")["h"].alias("h"))


def worst_lines(df: DataFrame, key: str, reference: str, hypothesis: str, k: int = 3, how: Compared = Compared()) -> DataFrame:
    """key, line, cer, rank of the lines with the largest rate; of equal ones the later line is the worse."""
    pairs = paired_lines(df, key, reference, hypothesis)
    a, b = prepared(F.col("r"), how), prepared(F.col("h"), how)
    scored = behind(pairs.select(key, "line", a.alias("_r"), b.alias("_h")).where("_r != _h"), a=F.col("_r"), b=F.col("_h")).withColumn("cer", F.when(F.length("a") > 0, distance(F.col("a"), F.col("b")) / F.length("a")).otherwise(0.0))
    return metrics.worst(scored.select(key, "line", "cer"), key, [F.desc("cer"), F.desc("line")], k)


def audited(df: DataFrame, reference: str, hypothesis: str) -> DataFrame:
    """``df`` with the four scientific scores and their parts: continuity of letters and words, attachment of marks, flow of directions, drift of homoglyphs."""
    tally = X.joining_tally(F.coalesce(hypothesis, F.lit("")))
    own = behind(df, _a=F.coalesce(reference, F.lit("")), _b=F.coalesce(hypothesis, F.lit("")), _p=tally["pairs"], _w=tally["wrong"])
    a, b = F.col("_a"), F.col("_b")
    own = own.withColumn("_x", arrow.audited("_a", "_b", "_p", "_w"))
    own = own.withColumns({"_ref_flow": metrics.flow(a), "bfe": metrics.flow(b)})
    own = own.withColumn("bfe_delta", F.round(F.abs(F.col("bfe.normalized") - F.col("_ref_flow.normalized")), 4))
    return own.select("*", "_x.*").drop("_x", "_ref_flow", "_a", "_b", "_p", "_w")


def homoglyph_rate(c: Column) -> Column:
    letters = X.count_of(c, "ء-يٮ-ۓۺ-ۿ")
    return X.count_of(c, "".join(T.HOMOGLYPHS)) / F.greatest(letters, F.lit(1))


def gate(cases: DataFrame, text: str, expected: str, output: str, safe: str) -> DataFrame:
    """One row: false positive and recovery rates, mean rate of error over recoveries, and the decision."""
    fp = F.col(safe) & ((F.col(output) != F.col(text)) | (F.col(output) != F.col(expected)))
    recovery = ~F.col(safe) & (F.col(text) != F.col(expected))
    cases = behind(cases, _e=F.when(recovery & (F.col(output) != F.col(expected)), F.col(expected)), _o=F.col(output))
    error = F.when(recovery, F.coalesce(distance(F.col("_e"), F.col("_o")), F.lit(0)) / F.greatest(F.length(expected), F.lit(1)))
    own = cases.select(F.col(safe).alias("s"), fp.alias("fp"), recovery.alias("r"), (F.col(output) == F.col(expected)).alias("ok"), error.alias("cer"))
    sums = own.agg(
        F.count("*").alias("n_cases"),
        F.count_if("s").alias("n_safe"),
        F.count_if("fp").alias("false_positives"),
        F.count_if("r").alias("n_recovery"),
        F.count_if(F.col("r") & F.col("ok")).alias("recovered"),
        F.coalesce(F.avg("cer"), F.lit(0.0)).alias("mean_cer"),
    )
    fpr = F.when(F.col("n_safe") > 0, F.col("false_positives") / F.col("n_safe")).otherwise(0.0)
    rar = F.when(F.col("n_recovery") > 0, F.col("recovered") / F.col("n_recovery")).otherwise(1.0)
    told = sums.withColumns({"fpr": fpr, "rar": rar})
    return told.withColumn("decision", F.when(F.col("fpr") > 0, "blocked: sound text was changed").when(F.col("rar") < 0.98, "blocked: too little was recovered").otherwise("approved"))


#: name, category, what it needs, what stands there afterwards; whether the ladder must undo it.
MUTATIONS = (
    ("unicode_space", "spacing", " ", "\u00a0", "supported"),
    ("punctuation_attachment", "punctuation", "، ", "،", "supported"),
    ("pdf_homoglyph", "glyph_substitution", "ي", "ی", "supported"),
    ("presentation_form", "presentation_forms", "م", "ﻡ", "conditional-density"),
    ("ligature_form", "ligature", "لا", "ﻻ", "supported"),
    ("pdf_al_meem_confusion", "font_encoding", "الم", "امل", "supported"),
)


def mutations(df: DataFrame, key: str, text: str, seed: int = 0, most: int | None = None) -> DataFrame:
    """case_id, source, category, mutation, recoverability, original, mutated: each kind's first occurrence in every text that has one.

    The kinds are taken from the ``seed``-th on; ``most`` is a cap on all cases, in the order of sources and kinds.
    """
    k = seed % len(MUTATIONS)
    ordered = MUTATIONS[k:] + MUTATIONS[:k]
    own = F.array(*[F.struct(F.lit(i).alias("o"), *(F.lit(v).alias(n) for n, v in zip(("mutation", "category", "old", "new", "recoverability"), m, strict=True))) for i, m in enumerate(ordered)])
    each = df.select(F.col(key).cast("string").alias("source"), F.col(text).alias("original"), F.explode(own).alias("m"))
    confused = F.col("m.mutation") == "pdf_al_meem_confusion"
    # the article's confusion needs two letters behind it
    needle = F.when(confused, F.regexp_extract("original", "(الم[ء-ي][ء-ي])", 1)).otherwise(F.col("m.old"))
    placed = each.withColumn("needle", needle).where("needle != ''").withColumn("at", F.position("needle", "original")).where("at > 0")
    size = F.length("m.old")
    made = F.concat(F.substring("original", F.lit(1), F.col("at") - 1), F.col("m.new"), F.substring("original", F.col("at") + size, F.length("original")))
    out = placed.select(F.concat("source", F.lit("::"), "m.mutation").alias("case_id"), "source", F.col("m.category").alias("category"), F.col("m.mutation").alias("mutation"), F.col("m.recoverability").alias("recoverability"), "original", made.alias("mutated"), F.col("m.o").alias("o")).where("mutated != original")
    return (out if most is None else out.orderBy("source", "o").limit(most)).drop("o")


def mutation_report(cases: DataFrame, output: str, reverted: str | None = None) -> DataFrame:
    """category, cases, exact, reverted."""
    back = F.count_if(F.col(reverted)) if reverted else F.lit(None).cast("long")
    return cases.groupBy("category").agg(F.count("*").alias("cases"), F.count_if(F.col(output) == F.col("original")).alias("exact"), back.alias("reverted"))


def error_kinds(df: DataFrame, key: str, gold: str, out: str) -> DataFrame:
    """key, kind, n: differing characters by the kind of damage, in lines paired by their place."""
    pairs = behind(paired_lines(df, key, gold, out).where("r != h"), a=F.col("r"), b=F.col("h"))
    return pairs.select(key, F.explode(arrow.error_kinds("a", "b")).alias("kind", "n")).groupBy(key, "kind").agg(F.sum("n").alias("n"))


def letters_only(c: Column) -> Column:
    return F.regexp_replace(c, "(?U)[^\\w؀-ۿ]+", "")


def gold_cleaned(c: Column) -> Column:
    """Without comment lines and the page numbers at the end."""
    lines = F.array_join(F.filter(F.split(c, "\n"), lambda x: ~F.startswith(x, F.lit("#"))), "\n")
    return F.trim(F.regexp_replace(lines, "(?U)(?:\\n[ \\t]*\\d+[ \\t]*)+\\s*$|^\\d+\\s*$", ""))


def extract_cleaned(c: Column, most: int = 6000) -> Column:
    """A wiki extract without reference signs, addresses and runs of blanks or blank lines, cut at a paragraph or word."""
    t = F.regexp_replace(c, r"\[(?:[0-9]+|note\s*[0-9]+|[a-z])\]", "")
    t = F.regexp_replace(F.regexp_replace(t, r"https?://\S+", ""), "[ \\t\u00a0]+", " ")
    t = F.regexp_replace(F.regexp_replace(t, r"[ \t]+(?=\n)|\s+$", ""), r"\n(?:[ \t]*\n)+", "\n\n")
    t = F.trim(F.regexp_replace(t, r"^\s+", ""))

    def cut(own: Column) -> Column:
        head = F.substring(own, F.lit(1), F.lit(most))
        tail = lambda sign: most - F.instr(F.reverse(head), sign)
        line, word = tail("\n"), tail(" ")
        at = F.when((F.instr(head, "\n") > 0) & (line >= most // 2), line).when(F.instr(head, " ") > 0, word).otherwise(most)
        return F.when(F.length(own) > most, F.rtrim(F.substring(own, F.lit(1), at))).otherwise(own)

    return X.let(t, cut)


def sampled_pages(pages: DataFrame, k: int = 5) -> DataFrame:
    """doc_id, page: of every document the page densest in Arabic of each of ``k`` stretches, filled up with the next densest.

    ``pages``: doc_id, page, arabic, total.
    """
    w = W.partitionBy("doc_id")
    n = F.max("page").over(w)
    good = pages.withColumn("n", n).where((F.col("page") >= F.greatest(F.lit(1), F.floor(0.05 * F.col("n")))) & (F.col("page") <= F.greatest(F.floor(0.05 * F.col("n")) + 1, F.floor(0.98 * F.col("n")))) & (F.col("arabic") >= 80) & (F.col("total") >= 200))
    lo, hi = F.min("page").over(w), F.max("page").over(w)
    placed = good.withColumn("bucket", F.when(hi > lo, F.least(F.lit(k - 1), F.floor((F.col("page") - lo) * k / (hi - lo)))).otherwise(0))
    best = F.row_number().over(W.partitionBy("doc_id", "bucket").orderBy(F.desc("arabic"), "page"))
    order = F.row_number().over(W.partitionBy("doc_id").orderBy(F.when(F.col("best") == 1, 0).otherwise(1), F.desc("arabic"), "page"))
    return placed.withColumn("best", best).withColumn("o", order).where(F.col("o") <= k).select("doc_id", "page")


def mismatches(reference: Column, hypothesis: Column, n: int = 5) -> Column:
    """The first spans that differ, of letters only: (start_before, before, after)."""
    ops = arrow.operations(letters_only(reference), letters_only(hypothesis))
    return F.transform(F.slice(ops, 1, n), lambda o: F.struct(o["start_before"].alias("at"), o["before"].alias("reference"), o["after"].alias("hypothesis")))


def compared_extractors(runs: DataFrame) -> DataFrame:
    """extractor, cer, wer of runs (extractor, reference, hypothesis), best first."""
    return rates(runs, "reference", "hypothesis").groupBy("extractor").agg(F.avg("cer").alias("cer"), F.avg("wer").alias("wer")).orderBy("cer", "extractor")
