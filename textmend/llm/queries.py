"""The registered queries of the operators: thin, over whole tables, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")
PIECE_BPE = public_tokenizers.path("piece_bpe_32k.model")


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import token_store

    return token_store.write_tokens(_documents(spark, sf_dir), BYTE_BPE, end_id=0).summary()


def op5_repetition(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import repetition

    return repetition.quality(_documents(spark, sf_dir))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import packing

    return packing.pack_documents(_documents(spark, sf_dir), BYTE_BPE, end_id=0, with_ids=False)


def op2_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import lm_score

    return lm_score.score(_documents(spark, sf_dir))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import language_id

    docs = _documents(spark, sf_dir)
    return language_id.identify(docs, language_id.learn(docs))


def op4_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import jaccard_join

    return jaccard_join.similar(_documents(spark, sf_dir))


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import token_counts

    return token_counts.section_counts(_documents(spark, sf_dir), BYTE_BPE)


def op7_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import piece_lattice

    return piece_lattice.encode(_documents(spark, sf_dir), PIECE_BPE).drop("ids")


def op9_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import chunk_fingerprint

    return chunk_fingerprint.edit_probe(_documents(spark, sf_dir))


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import substring_dedup

    return substring_dedup.repeats(_documents(spark, sf_dir))


_ALL = (op1_token_store, op2_lm_score, op3_language_id, op4_jaccard_join, op5_repetition, op6_token_counts, op7_pieces, op8_packing, op9_fingerprint, op10_substring_dedup)
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in _ALL}
