"""Named Parquet tables under one directory (local path, object store or any Hadoop file system)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, base: str, name: str) -> DataFrame:
    """``<base>/<name>.parquet``, read only through Spark so that any store works."""
    return spark.read.parquet(f"{base}/{name}.parquet")
