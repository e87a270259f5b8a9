"""Readers of the given Parquet tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """``name`` from a folder of Parquet tables; any file system Spark can read."""
    return spark.read.parquet(f"{folder}/{name}.parquet")
