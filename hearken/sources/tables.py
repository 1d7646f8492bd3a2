"""The parquet tables of one data folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """Table ``name`` of a data folder (one parquet file or directory each)."""
    return spark.read.parquet(f"{folder}/{name}.parquet")
