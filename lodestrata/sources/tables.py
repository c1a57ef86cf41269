"""The corpus tables as parquet."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """Table ``name`` below ``folder``: one parquet file, or a folder of part files of that name."""
    return spark.read.parquet(f"{folder}/{name}.parquet")
