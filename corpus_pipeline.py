"""The corpus pipeline: language ID, quality rules, near duplicates, substring dedup, packing.

Each stage reads what its predecessor kept.  Language ID drops texts without a
letter and texts whose language is doubtful; quality rules drop short and
repetitive texts; of documents that the n-gram Jaccard join links, directly or
through others, the one with the least id stays; substring dedup cuts repeated
passages out of the texts (a text may end up empty, its row stays, and
``n_chars`` follows); packing returns a row per piece of a sequence.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textmend.llm import jaccard_join, language_id, packing, repetition, substring_dedup
from textmend.llm._common import stored
from textmend.llm.queries import BYTE_BPE

#: Least score of a language that is believed.
LEAST_SCORE = 0.3
#: Words whose ids a process keeps while packing: fewer than when packing runs alone, as earlier stages have filled the heap.
KEPT_WORDS = 400_000


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return language_id.identified(docs, language_id.learn(docs), LEAST_SCORE)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return repetition.kept_documents(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard_join.one_of_each(docs)


def substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    out = substring_dedup.without_repeats(docs)
    return out.withColumn("n_chars", F.coalesce(F.length("text"), F.lit(0)).cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack_documents(docs, BYTE_BPE, end_id=0, with_ids=False, kept_words=KEPT_WORDS)


STAGES: list = [("language_id", language), ("quality_rules", quality), ("jaccard_join", near_duplicates), ("substring_dedup", substrings), ("packing", packed)]
#: Hashes, trained models and byte-pair encoding: tested against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
