"""Reading the engine's tables by name."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A Parquet table of a folder; filters and column lists reach its scan."""
    return spark.read.parquet(f"{folder}/{name}.parquet")
