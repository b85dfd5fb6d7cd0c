"""A folder of item lists as a stream: each micro-batch is staged and appended once.

The sink keeps the batch id with every row and skips one that it has, so a batch that is run
again after a failure does not repeat rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lodestitch.sources.ingest import ALIASES, clean_rows, first_in_batch

LINES = ", ".join(f"{name} string" for name in ALIASES)


def item_stream(spark: SparkSession, folder: str) -> DataFrame:
    """New CSV files of a folder, with the canonical header, as they come."""
    return spark.readStream.schema(LINES).option("header", True).option("quote", '"').option("escape", '"').csv(folder)


def staged_batch(batch: DataFrame) -> DataFrame:
    """Cleaned rows of one micro-batch, the first of each code."""
    valid, _ = clean_rows(batch.withColumn("row_no", F.monotonically_increasing_id()))
    return first_in_batch(valid).drop("row_no")


def append_new(target: str) -> Callable[[DataFrame, int], None]:
    """A sink that appends the rows whose code the target does not have yet."""

    def write(batch: DataFrame, batch_id: int) -> None:
        from pyspark.errors import AnalysisException

        rows = staged_batch(batch).withColumn("batch_id", F.lit(batch_id).cast("long"))
        try:
            have = batch.sparkSession.read.parquet(target)
            if have.where(F.col("batch_id") == batch_id).limit(1).count():
                return
            rows = rows.join(have.select("source_org", "local_code").distinct(), ["source_org", "local_code"], "left_anti")
        except AnalysisException as e:
            if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
                raise
        rows.write.mode("append").parquet(target)

    return write


def start(spark: SparkSession, folder: str, target: str, checkpoint: str) -> StreamingQuery:
    """Ingest what is in the folder, then stop."""
    return (
        item_stream(spark, folder)
        .writeStream.foreachBatch(append_new(target))
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def events_by_window(events: DataFrame, every: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Counts and sums of an event stream by tumbling window and type, with a watermark for late rows."""
    return (
        events.withWatermark("ts", late)
        .groupBy(F.window("ts", every), "event_type")
        .agg(F.count("*").alias("events"), F.sum("value").alias("value"))
        .select(F.col("window.start").alias("window_start"), "event_type", "events", "value")
    )
