"""Readers of the Parquet tables a query is given."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One table of a folder of ``<name>.parquet`` files or directories."""
    return spark.read.parquet(f"{folder}/{name}.parquet")
