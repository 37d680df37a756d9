"""What the operators share: the shared folder, ordered shards and Arrow mapping."""

from __future__ import annotations

import atexit
import ctypes
import gc
import math
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: ``doc_id`` of a row that has none sorts before all others, under this value.
NO_ID = -(2**63)
_LIBC = ctypes.CDLL(None)


def shared_root(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``; where that is unset and all runs in one process (tests), a temporary one."""
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="textmend-")
        spark.conf.set("spark.checkpoint.dir", root)
        atexit.register(shutil.rmtree, root.removeprefix("file://"), ignore_errors=True)
    return root.rstrip("/")


def shared_path(spark: SparkSession, what: str) -> str:
    """A new path below the shared folder."""
    return f"{shared_root(spark)}/textmend/{what}-{uuid.uuid4().hex}"


def stored(df: DataFrame, what: str) -> DataFrame:
    """``df`` written as a Parquet table in the shared folder and read back: lineage ends at replicated files."""
    path = shared_path(df.sparkSession, what)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def documents(df: DataFrame, *more: str) -> DataFrame:
    """``doc_id`` as long and ``text`` as string, and of the other columns only those named."""
    return df.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *more)


def mapped(df: DataFrame, fn: Callable[[pa.RecordBatch], Iterator[dict]], schema: str | T.StructType) -> DataFrame:
    """``fn`` gives, for a batch, dicts of equally long columns."""
    from pyspark.sql.pandas.types import to_arrow_schema

    struct = T._parse_datatype_string(schema) if isinstance(schema, str) else schema
    arrow = to_arrow_schema(struct)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for out in fn(batch):
                yield record(out, arrow)

    return df.mapInArrow(run, struct)


def record(columns: dict, schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c := columns[f.name], pa.Array) and c.type == f.type else pa.array(c, f.type) for f in schema], schema=schema)


def arrow_schema(schema: str | T.StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(T._parse_datatype_string(schema) if isinstance(schema, str) else schema)


def shards(df: DataFrame, rows: int, least: int = 1) -> list[int]:
    """Upper bounds of ranges of ``doc_id`` with about ``rows`` rows each, from the id column alone.

    The number of bounds grows with the table, one long each; equal ids always share a range.
    """
    ids = df.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("k"))
    total = ids.count()
    n = max(least, math.ceil(total / rows))
    if n <= 1 or total == 0:
        return []
    cuts = [i / n for i in range(1, n)]
    got = ids.agg(F.percentile_approx("k", cuts, max(10_000, 20 * n)).alias("q")).first()["q"]
    return sorted(set(got))


def shard_of(column, bounds: list[int]):
    """Index of the range that an id lies in, by halving: an expression of logarithmic depth."""

    def part(lo: int, hi: int):
        if lo == hi:
            return F.lit(lo)
        mid = (lo + hi) // 2
        return F.when(column <= F.lit(bounds[mid]), part(lo, mid)).otherwise(part(mid + 1, hi))

    return part(0, len(bounds)).cast("int")


def trim() -> None:
    """Give memory that is free back to the system: Python workers outlive their tasks, and others need it."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    if hasattr(_LIBC, "malloc_trim"):
        _LIBC.malloc_trim(0)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
