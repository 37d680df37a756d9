"""The ladder over a stream: the same projection, so a stream needs no state."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..plans.repair import repair


def read_texts(spark: SparkSession, folder: str) -> DataFrame:
    return spark.readStream.option("wholetext", True).text(folder).withColumnRenamed("value", "text")


def write_repaired(stream: DataFrame, folder: str, checkpoint: str) -> StreamingQuery:
    return repair(stream).writeStream.format("parquet").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(folder)
