"""The parquet tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One table of a folder of parquet tables; a table is a file or a folder of parts."""
    return spark.read.parquet(f"{folder}/{name}.parquet")
