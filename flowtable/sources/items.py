"""Item sources."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def items(spark: SparkSession, source: str | range) -> DataFrame:
    """Items from a parquet path, or the numbers of a Python range as column `item`."""
    if isinstance(source, range):
        return spark.range(source.start, source.stop, source.step).withColumnRenamed("id", "item")
    return spark.read.parquet(source)
