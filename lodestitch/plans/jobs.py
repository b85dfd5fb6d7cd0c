"""A resolution run as a job: an append-only log of what began, succeeded and failed."""

from __future__ import annotations

import json
import time
import uuid
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestitch.operators.resolve import resolve, run_statistics
from lodestitch.sources import snapshots

EVENTS = "job_id string, status string, stage string, stats string, error string, at timestamp"
RUNNING, SUCCEEDED, FAILED = "RUNNING", "SUCCEEDED", "FAILED"


def log_event(spark: SparkSession, base: str, job_id: str, status: str, stats: dict | None = None, error: str | None = None, stage: str = "resolve") -> None:
    row = [(job_id, status, stage, json.dumps(stats or {}), error, datetime.now(timezone.utc))]
    spark.createDataFrame(row, EVENTS).coalesce(1).write.mode("append").parquet(f"{base}/jobs")


def jobs(spark: SparkSession, base: str) -> DataFrame:
    """The last event of every job, newest first."""
    last = Window.partitionBy("job_id").orderBy(F.desc("at"))
    return spark.read.schema(EVENTS).parquet(f"{base}/jobs").withColumn("n", F.row_number().over(last)).where("n = 1").drop("n").orderBy(F.desc("at"))


def run(spark: SparkSession, records: DataFrame, base: str, **options) -> str:
    """Resolve, check, publish; returns the job id. A failure is logged and raised, and publishes nothing.

    It is a failure too if another job has published meanwhile: its decisions would be lost.
    """
    job_id, began = uuid.uuid4().hex, time.time()
    log_event(spark, base, job_id, RUNNING, {k: v for k, v in options.items() if k != "weights"})
    try:
        based_on = snapshots.current_run(spark, base)
        plan = resolve(records, **options)
        before = snapshots.read_current(spark, base, "review")
        tables = plan.tables()
        if before is not None:
            tables["review"] = snapshots.keep_decisions(tables["review"], before)
        snapshots.assert_consistent(records, tables["crosswalk"], tables["entities"], tables["review"])
        snapshots.publish(spark, base, job_id, tables, based_on)
        stats = run_statistics(plan).first().asDict() | {"seconds": round(time.time() - began, 3)}
        log_event(spark, base, job_id, SUCCEEDED, stats)
    except Exception as e:
        log_event(spark, base, job_id, FAILED, error=str(e)[:1000])
        raise
    return job_id
