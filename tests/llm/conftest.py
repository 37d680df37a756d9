from __future__ import annotations

import pytest
from pyspark.sql import SparkSession


@pytest.fixture(scope="session")
def spark():
    s = SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").config("spark.driver.memory", "4g").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    s.sparkContext.setLogLevel("ERROR")
    return s


AWKWARD = [
    (1, "the same words here", "en"),
    (1, "the same words here", "en"),
    (2, None, "en"),
    (3, "", None),
    (4, "  \n\t \n", "fr"),
    (5, "a", "de"),
    (None, "an id that is null", "en"),
    (6, "one two three four " * 5000, "en"),
    (7, "x" * 50_000, None),
    (8, "été ça où   nbsp line 😀 don't 's  two  spaces \n end ", "fr"),
    (9, "line\nline\nline\n\nother", "en"),
    (10, "<|endoftext|> text", "en"),
]


@pytest.fixture(scope="session")
def awkward(spark):
    """Nulls, empty and long texts, repeated rows, and other columns whose names clash with the operators'."""
    return spark.createDataFrame([(*r, 1, "y", 3.0) for r in AWKWARD], "doc_id long, text string, lang string, start int, kept string, score double").repartition(3)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string")
