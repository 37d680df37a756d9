"""What queries over texts may cost in their plans: kernels over whole texts, and texts moved once."""

from __future__ import annotations

import pytest

from textmend import catalogue_documents as catalogue

from .test_ladder import explained

SMALL = "/root/testdata/sf0.001"


def physical(spark, name):
    return explained(catalogue.QUERIES[name](spark, SMALL)).split("== Physical Plan ==")[1]


@pytest.mark.parametrize("name", ["recover_legacy", "direction_runs", "closed_confusions", "normalized", "collapsed_midword", "base_mark_matrix"])
def test_one_kernel(spark, name):
    """one pass in one kernel, and no lambda over characters."""
    plan = physical(spark, name)
    assert plan.count("ArrowEvalPython") == 1 and "lambda" not in plan


@pytest.mark.parametrize("name", ["bigram_counts", "trigram_counts"])
def test_texts_are_moved_and_not_their_grams(spark, name):
    """F25, F30."""
    plan = physical(spark, name)
    assert plan.count("Exchange") == 1 and "Generate" not in plan


def test_grams_of_texts_with_one_key(spark):
    from textmend.operators import vocabulary

    df = spark.createDataFrame([(1, "سلام كلام سلام"), (1, "سلام كلام"), (2, "سلام"), (3, None)], "doc_id long, t string")
    assert sorted(tuple(r) for r in vocabulary.ngrams(df, 2).collect()) == [(1, "سلام كلام", 2), (1, "كلام سلام", 1)]


def test_lines_are_moved_once(spark):
    """chunks are made where their document's lines are."""
    plan = physical(spark, "rag_chunks")
    moves = [x for x in plan.splitlines() if "Exchange" in x]
    assert moves and all("hashpartitioning(doc_id" in x and "REPARTITION_BY_NUM" in x for x in moves) and "Join" not in plan
