"""Consecutive numbers over a global order, without sorting everything in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestitch.plans.materialize import materialize, shuffle_partitions


def row_numbers(df: DataFrame, *order: Column, into: str = "number") -> DataFrame:
    """``df`` with 1, 2, 3 ... in the given order.

    Rows are dealt to ranges of the order and numbered inside their range; each range starts
    after the counts of those before it (one row per range, so that step is small). The ranges
    are kept in the shared folder, so that a task that runs again sees the same ones.
    """
    n = shuffle_partitions(df.sparkSession)
    ranged = materialize(df.repartitionByRange(n, *order).withColumn("_range", F.spark_partition_id()))
    counts = ranged.groupBy("_range").agg(F.count("*").alias("_rows"))
    earlier = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("_range", F.coalesce(F.sum("_rows").over(earlier), F.lit(0)).alias("_start"))
    inside = F.row_number().over(Window.partitionBy("_range").orderBy(*order))
    numbered = ranged.join(F.broadcast(starts), "_range").withColumn(into, F.col("_start") + inside)
    return numbered.drop("_range", "_start")
