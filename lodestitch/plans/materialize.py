"""Cutting lineage in a way that survives lost executors."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def _ensure_checkpoint_dir(spark: SparkSession) -> None:
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        shared = spark.conf.get("spark.checkpoint.dir", None)
        if shared is None and not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        # Only an unconfigured local session (tests) falls back to a folder of its own.
        sc.setCheckpointDir(shared or tempfile.mkdtemp(prefix="lodestitch-checkpoint-"))


def materialize(df: DataFrame) -> DataFrame:
    """Compute ``df`` once and keep it in the shared checkpoint folder.

    The result is re-read from the shared folder, so an executor lost later costs nothing
    but the tasks it was running.
    """
    _ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def scratch_folder(spark: SparkSession) -> str:
    """A new folder below the shared checkpoint folder, for tables that one run writes and reads again."""
    _ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/{uuid.uuid4().hex}"


def stored(df: DataFrame, **options: str) -> DataFrame:
    """Compute ``df`` once and keep it as Parquet below the shared checkpoint folder; readers take only the columns they need.

    ``options``: of the writer.
    """
    folder = scratch_folder(df.sparkSession)
    df.write.options(**options).parquet(folder)
    return df.sparkSession.read.parquet(folder)


def spread(df: DataFrame) -> DataFrame:
    """A scan over all cores when it has fewer partitions than the cluster has cores, for work that is heavy per row."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def shuffle_partitions(spark: SparkSession) -> int:
    """The session's shuffle width; operators derive their own group counts from it."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
