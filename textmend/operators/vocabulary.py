"""Document vocabularies: counts of words, neighbours and character grams; lexicon and near-word joins."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType, _parse_datatype_string

from ..functions import tables as T
from ..functions import text as X
from ..kernels import grams
from .layout import paged

WORD = "([ء-ۓ]{3,})"


def tokens(df: DataFrame, key: str = "doc_id", text: str = "t") -> DataFrame:
    """key, i (place), word of every word of three letters or more."""
    return df.select(key, F.posexplode(F.regexp_extract_all(text, F.lit(WORD), F.lit(1))).alias("i", "word"))


def word_counts(df: DataFrame, key: str = "doc_id") -> DataFrame:
    return tokens(df, key).groupBy(key, "word").agg(F.count("*").alias("n"))


def ngrams(df: DataFrame, n: int, key: str = "doc_id") -> DataFrame:
    """key, gram (words joined by a space), n: texts are moved to their key once and counted where they are.

    No gram crosses from one text to another, and none is moved.
    """
    own = paged(df, "t", key)
    schema = StructType([own.schema[0], *_parse_datatype_string("gram string, n long")])
    return own.mapInArrow(grams.over(WORD, n, to_arrow_schema(schema)), schema)


def paragraph_counts(df: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, para (from 0; a blank line ends one), word, n of all words, however short."""
    parts = df.select(key, F.posexplode(F.split("t", "\n\n")).alias("para", "t"))
    return parts.select(key, "para", F.explode(F.regexp_extract_all("t", F.lit("([ء-يٱ-ۓ]+)"), F.lit(1))).alias("word")).groupBy(key, "para", "word").agg(F.count("*").alias("n"))


def char_grams(counts: DataFrame, n: int) -> DataFrame:
    """gram, n over words padded with ^ and $; weighted by the words' counts, so each word is cut once."""
    p = F.concat(F.lit("^"), "word", F.lit("$"))
    grams = F.transform(F.sequence(F.lit(1), F.greatest(F.length(p) - n + 1, F.lit(1))), lambda i: F.substring(p, i, F.lit(n)))
    return counts.groupBy("word").agg(F.sum("n").alias("n")).select(F.explode(grams).alias("gram"), "n").groupBy("gram").agg(F.sum("n").alias("n"))


def likelihood(counts: DataFrame, grams: DataFrame, n: int) -> DataFrame:
    """word, score: mean log((c + 1) / (total + distinct)) over the word's grams."""
    p = F.concat(F.lit("^"), "word", F.lit("$"))
    cut = F.transform(F.sequence(F.lit(1), F.greatest(F.length(p) - n + 1, F.lit(1))), lambda i: F.substring(p, i, F.lit(n)))
    total = grams.agg(F.sum("n").alias("total"), F.count("*").alias("kinds"))  # one row
    scored = counts.select("word").distinct().select("word", F.explode(cut).alias("gram")).join(grams, "gram").crossJoin(F.broadcast(total))
    return scored.groupBy("word").agg(F.round(F.avg(F.log((F.col("n") + 1) / (F.col("total") + F.col("kinds")))), 6).alias("score"))


def vocabulary(counts: DataFrame, least: int = 3, key: str = "doc_id") -> DataFrame:
    return counts.where(F.col("n") >= least).select(key, "word", "n")


def harvest(df: DataFrame, key: str = "doc_id", text: str = "t") -> DataFrame:
    """key, word: distinct words of a document that aren't suspected of a turned lam-alef themselves."""
    word = F.explode(F.array_distinct(F.regexp_extract_all(text, F.lit("([ء-يٱ-ۓ]{3,})"), F.lit(1)))).alias("word")
    return df.select(key, word).where(~X.is_suspect(F.col("word"))).distinct()


def union_lexicon(*lexicons: DataFrame) -> DataFrame:
    """The distinct words of all lexicons."""
    return reduce(DataFrame.union, [x.select("word") for x in lexicons]).distinct()


def lexicon_swaps(lexicon: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """(keys,) broken, fixed: every way a lexicon's word loses a lam-alef to alef-lam between Arabic characters.

    A broken word that the lexicon has itself is none; of several words that it can come from, the one that is
    turned at the first place is meant.  With ``keys``, each key has a lexicon of its own.
    """
    keys = keys or []
    at = F.filter(F.sequence(F.lit(2), F.length("word") - 2), lambda i: F.substring("word", i - 1, F.lit(4)).rlike(f"^[\u0600-\u06ff]{T.LAM}[{T.ALEFS}][\u0600-\u06ff]"))
    cut = lexicon.where(F.col("word").rlike(f".{T.LAM}[{T.ALEFS}].")).select(*keys, "word", F.explode(at).alias("i"))
    broken = F.concat(F.substring("word", F.lit(1), F.col("i") - 1), F.substring("word", F.col("i") + 1, F.lit(1)), F.lit(T.LAM), F.substring("word", F.col("i") + 2, F.length("word")))
    first = cut.select(*keys, broken.alias("broken"), F.col("word").alias("fixed"), "i").groupBy(*keys, "broken").agg(F.min_by("fixed", F.struct("i", "fixed")).alias("fixed"))
    return first.join(lexicon.select(*keys, F.col("word").alias("broken")).distinct(), [*keys, "broken"], "left_anti")


def lexicon_repairs(words: DataFrame, lexicon: DataFrame) -> DataFrame:
    """word, fixed: words that the lexicon lacks and of which it has the mended form."""
    lex = lexicon.select("word").distinct()
    return words.select("word").distinct().join(lex, "word", "left_anti").join(lexicon_swaps(lex), F.col("word") == F.col("broken")).select("word", "fixed")


def near_words(observed: DataFrame, known: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """(keys,) word, near: pairs within edit distance one, by deletion neighbourhoods and then the distance itself.

    With ``keys``, words meet only within the same document.
    """
    keys = keys or []

    def keyed(df: DataFrame, name: str) -> DataFrame:
        cut = F.transform(F.sequence(F.lit(1), F.length("own")), lambda i: F.concat(F.substring("own", F.lit(1), i - 1), F.substring("own", i + 1, F.length("own"))))
        return df.select(*keys, F.col("word").alias("own")).distinct().select(*keys, F.col("own").alias(name), F.explode(F.array_distinct(F.concat(F.array("own"), cut))).alias("k"))

    pairs = keyed(observed, "word").join(keyed(known, "near"), [*keys, "k"]).where("word != near").select(*keys, "word", "near").distinct()
    return pairs.where(F.levenshtein("word", "near") == 1)


def ranked(candidates: DataFrame, key: str, score: str, text: str) -> DataFrame:
    """``candidates`` with rank and margin to the next best, best first; ties by text, descending."""
    w = W.partitionBy(key).orderBy(F.desc(score), F.desc(text))
    return candidates.withColumn("rank", F.row_number().over(w)).withColumn("margin", F.col(score) - F.coalesce(F.lead(score).over(w), F.lit(0)))
