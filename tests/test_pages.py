"""Whole pages as arrays against the same analysis over tables of glyphs."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from textmend import catalogue_documents as catalogue
from textmend.kernels import pages
from textmend.operators import layout

from .test_ladder import explained

TEXTS = [(1, "ab  cd\n\n e\tf   g\r\nhi"), (1, "xy z\n  q"), (2, ""), (3, None), (4, "\n \n"), (5, "a" * 30 + " " * 40 + "b" * 30 + "\n" + "c" * 90), (6, "one line"), (7, "ü😀 é   ñ" * 9 + "\n" + "zz" * 7)]


def rows(df):
    return sorted(tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in df.collect())


def test_pages_as_glyph_tables(spark):
    """Texts of one key are one page; texts that are null, empty or blank give no glyph."""
    df = spark.createDataFrame(TEXTS, "doc_id long, text string")
    g, own = layout.glyphs(df), layout.paged(df)
    assert rows(layout.over_pages(own, pages.cells, "line int, cell long, x0 double, x1 double, n long, text string")) == rows(layout.cells(g))
    assert rows(layout.over_pages(own, pages.thresholds, "line int, threshold double")) == rows(layout.gap_threshold(g).where("threshold < 1e300"))
    assert rows(layout.over_pages(own, pages.rows, "line int, row int")) == rows(layout.lines_of(g).select("doc_id", "line", "row").distinct())
    both = g.unionByName(g.withColumn("x", F.col("x") + 100000.0))
    both = both.join(both.groupBy("doc_id").agg((F.max("x") + 100.0).alias("width")), "doc_id")
    cuts = layout.gutters(both, F.col("width"))
    assert rows(layout.over_pages(own, lambda p: (catalogue._gutters(p.with_copy(100000.0)),), "cut double")) == rows(cuts)
    want = layout.columns(both, cuts).groupBy("doc_id", "column").agg(F.min("x"), F.max("x"), F.count("*"))
    told = lambda p: pages.columns(p.with_copy(100000.0), catalogue._gutters(p.with_copy(100000.0)))
    assert rows(layout.over_pages(own, told, "column int, x0 double, x1 double, n long")) == rows(want)


def test_sizes_that_differ():
    g = pages.Glyphs(np.array([0.0, 10.0, 30.0, 0.0, 5.0]), np.zeros(5), np.array([10.0, 10.0, 10.0, 20.0, 20.0]), np.array([0, 0, 0, 1, 1]), np.arange(65, 70, dtype=np.uint32))
    line, least = pages.thresholds(g)
    assert line.tolist() == [0, 1] and least.tolist() == [20.0, 8.4]


@pytest.mark.parametrize("name", ["line_cells", "page_gutters", "page_columns", "clustered_lines", "gap_thresholds"])
def test_no_row_for_each_glyph(spark, name):
    """What is moved is the texts, once; no glyph becomes a row."""
    plan = explained(catalogue.QUERIES[name](spark, "/root/testdata/sf0.001")).split("== Physical Plan ==")[1]
    assert "Generate" not in plan and plan.count("Exchange") == 1 and "Join" not in plan
