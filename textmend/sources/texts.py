"""Text, block, glyph and page sources by name, and text, JSON and markdown sinks."""

from __future__ import annotations

import importlib.util
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Reader:
    """A named source: what it reads, and whether it can here."""

    name: str
    read: Callable[[SparkSession, str], DataFrame]
    available: Callable[[], bool] = lambda: True
    #: Pages of files; ``auto`` is the first of these that is available.
    pages: bool = False


READERS: dict[str, Reader] = {}


def reader(name: str, available: Callable[[], bool] = lambda: True, pages: bool = False) -> Callable:
    """Register a function (spark, path) -> DataFrame as a source; the last of a name counts."""

    def add(fn: Callable[[SparkSession, str], DataFrame]) -> Callable:
        READERS[name] = Reader(name, fn, available, pages)
        return fn

    return add


def get_reader(name: str = "auto") -> Reader:
    """The reader of a name; ``auto`` is the first reader of pages that is available."""
    if name == "auto":
        found = next((r for r in READERS.values() if r.pages and r.available()), None)
        if found is None:
            raise RuntimeError("no reader of pages is available")
        return found
    if name not in READERS:
        raise KeyError(name)
    if not READERS[name].available():
        raise RuntimeError(f"the reader {name} needs a package that isn't installed")
    return READERS[name]


GLYPHS = "path string, page int, span long, seq long, x double, y double, size double, ch string, font string, glyph_id int, width double, height double"


@reader("pdf", available=lambda: importlib.util.find_spec("fitz") is not None, pages=True)
def pdf_glyphs(spark: SparkSession, path: str) -> DataFrame:
    """A row per painted glyph of PDF files, in the order of the paint stream; needs a PDF parser."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import fitz

        for b in batches:
            for name, content in zip(b["path"], b["content"], strict=True):
                with fitz.open(stream=content, filetype="pdf") as doc:
                    for number, page in enumerate(doc, 1):
                        rows, seq = [], 0
                        for n, span in enumerate(sorted(page.get_texttrace(), key=lambda s: s.get("seqno", 0))):
                            for cp, glyph, origin, _ in span["chars"] if span.get("type", 0) == 0 else ():
                                seq += 1
                                rows.append((name, number, n, seq, origin[0], origin[1], span.get("size") or 10.0, chr(cp), span.get("font") or "", glyph, page.rect.width, page.rect.height))
                        yield pd.DataFrame(rows, columns=[c.split()[0] for c in GLYPHS.split(", ")])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, GLYPHS)


@reader("glyphs", pages=True)
def glyph_table(spark: SparkSession, path: str) -> DataFrame:
    """A table of glyphs that another program has read."""
    return spark.read.parquet(path)


@reader("text")
def whole_texts(spark: SparkSession, path: str) -> DataFrame:
    """path, text of every file; a byte order mark is dropped."""
    return spark.read.option("wholetext", True).text(path).select(F.col("_metadata.file_path").alias("path"), F.regexp_replace("value", "^﻿", "").alias("text"))


@reader("lines")
def lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).withColumnRenamed("value", "text")


@reader("table")
def table(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def read(spark: SparkSession, path: str, how: str = "text") -> DataFrame:
    return get_reader(how).read(spark, path)


def page_limit(df: DataFrame, n: int | None, page: str = "page") -> DataFrame:
    """Pages up to the ``n``-th; all for None or 0."""
    if n is not None and n < 0:
        raise ValueError("a number of pages isn't negative")
    return df.where(F.col(page) <= n) if n else df


def blocks(spark: SparkSession, items: list) -> DataFrame:
    """id, text, role of blocks given as texts, pairs (id, text) or dicts; anything else is a TypeError."""
    rows = []
    for i, item in enumerate(items):
        if isinstance(item, str):
            rows.append((i, None, item, None))
        elif isinstance(item, tuple) and len(item) == 2 and all(isinstance(x, str) for x in item):
            rows.append((i, item[0], item[1], None))
        elif isinstance(item, dict):
            rows.append((i, item.get("id"), str(item.get("text", "")), item.get("role")))
        else:
            raise TypeError(f"no block: {type(item).__name__}; a text, a pair (id, text) or a dict is one")
    return spark.createDataFrame(rows, "ord int, id string, text string, role string")


def any_text(df: DataFrame, *columns: str) -> DataFrame:
    """``df`` with text: the first of the columns that is neither null nor empty."""
    return df.withColumn("text", F.coalesce(*[F.when(F.col(c) != "", F.col(c)) for c in columns], F.lit("")))


def write_texts(df: DataFrame, path: str, source: str | None = None) -> None:
    """One text column as files; refuses to write over its own source."""
    if source is not None and source.rstrip("/") == path.rstrip("/"):
        raise ValueError("the output is the input")
    df.write.text(path)


def as_json(df: DataFrame) -> DataFrame:
    """json: a row's columns in the order of their names."""
    return df.select(F.to_json(F.struct(*sorted(df.columns))).alias("json"))


def spread(df: DataFrame) -> DataFrame:
    """``df`` over all cores where its files are fewer than those: a few row groups would keep a few cores busy.

    Only tables of fewer files than cores, each no larger than a scan's split on average, are moved, so what is moved has a bound.
    """
    spark = df.sparkSession
    cores = spark.sparkContext.defaultParallelism
    files = df.inputFiles()
    return df.repartition(cores) if 0 < len(files) < cores and df.rdd.getNumPartitions() <= 4 * cores else df


def exit_code(confidence: float | None = None, cer: float | None = None, failed: bool = False) -> int:
    """1 on an error, 2 below half confidence, 3 at five per cent of errors, else 0."""
    if failed:
        return 1
    if confidence is not None and confidence < 0.5:
        return 2
    return 3 if cer is not None and cer >= 0.05 else 0
