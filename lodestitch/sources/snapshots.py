"""Publishing a run: all tables below a new folder, a version claimed, then one pointer.

Readers follow the manifest of the highest version, which is written last as one small Parquet table of its own. A run that
fails before its manifest leaves nothing that a reader sees; a manifest is never changed.

Two runs that began from the same version can't both become the next one: a version is a file that is created only if it
is not there, and the run that comes second is refused, or goes behind the first if it is not based on anything. (A store has to
create files exclusively for this, as HDFS does.) A run that dies between its claim and its manifest keeps the
version until ``release`` gives it back.
"""

from __future__ import annotations

from datetime import datetime, timezone

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MANIFEST = "run_id string, published_at timestamp, tables array<string>, version int"
#: ``based_on`` of a run that does not depend on what is published.
NOTHING = "<nothing>"


class PublishConflict(RuntimeError):
    """Another run was published since the run began that this one is based on."""


def _claims(spark: SparkSession, base: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{base}/claims")
    return path.getFileSystem(spark._jsc.hadoopConfiguration()), path


def _claim(spark: SparkSession, base: str, version: int) -> bool:
    """Whether the version is now this run's: its file was not there and has been created."""
    fs, folder = _claims(spark, base)
    fs.mkdirs(folder)
    path = spark._jvm.org.apache.hadoop.fs.Path(folder, f"{version:010d}")
    if fs.getScheme() == "file":
        # Hadoop looks first and creates then; the file system itself does both at once.
        return spark._jvm.java.io.File(path.toUri().getPath()).createNewFile()
    try:
        fs.create(path, False).close()
    except Py4JJavaError as e:
        if "FileAlreadyExists" in str(e.java_exception.getClass().getName()) or fs.exists(path):
            return False
        raise
    return True


def release(spark: SparkSession, base: str, version: int) -> bool:
    """Give back a version that has no manifest, because its run died; False if it has one or was never claimed."""
    if manifest(spark, base).where(F.col("version") == version).limit(1).count():
        return False
    fs, folder = _claims(spark, base)
    return fs.delete(spark._jvm.org.apache.hadoop.fs.Path(folder, f"{version:010d}"), False)


def _last(spark: SparkSession, base: str):
    """The newest manifest row; runs from before there were versions count as version 0."""
    order = F.desc(F.coalesce("version", F.lit(0))), F.desc("published_at"), F.desc("run_id")
    return manifest(spark, base).orderBy(*order).limit(1).first()


def publish(spark: SparkSession, base: str, run_id: str, tables: dict[str, DataFrame], based_on: str | None = NOTHING) -> int:
    """Write every table of a run, then make the run the current one; returns its version.

    ``based_on``: the run that was current when this one read its inputs (None: there was none). If another has been published
    since, ``PublishConflict`` is raised and nothing changes for readers.
    """
    for name, df in tables.items():
        df.write.mode("errorifexists").parquet(f"{base}/runs/{run_id}/{name}")
    last = _last(spark, base)
    if based_on != NOTHING and (last["run_id"] if last else None) != based_on:
        raise PublishConflict(f"{run_id} is based on {based_on}, but {last['run_id'] if last else None} is current")
    version = ((last["version"] or 0) if last else 0) + 1
    while not _claim(spark, base, version):
        if based_on != NOTHING:
            raise PublishConflict(f"version {version} is claimed by another run")
        version += 1
    row = [(run_id, datetime.now(timezone.utc), sorted(tables), version)]
    spark.createDataFrame(row, MANIFEST).coalesce(1).write.parquet(f"{base}/manifest/v-{version:010d}")
    return version


def manifest(spark: SparkSession, base: str) -> DataFrame:
    """All published runs; empty before the first."""
    from pyspark.errors import AnalysisException

    try:
        return spark.read.schema(MANIFEST).option("recursiveFileLookup", "true").parquet(f"{base}/manifest")
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], MANIFEST)


def current_run(spark: SparkSession, base: str) -> str | None:
    last = _last(spark, base)
    return last["run_id"] if last else None


def read_current(spark: SparkSession, base: str, name: str) -> DataFrame | None:
    """A table of the current run; None before the first run."""
    run = current_run(spark, base)
    return None if run is None else spark.read.parquet(f"{base}/runs/{run}/{name}")


def reset(spark: SparkSession, base: str, run_id: str) -> None:
    """A forced reseed: all tables of the current run, empty, as a new run; older runs stay in their folders."""
    last = _last(spark, base)
    names = last["tables"] if last else []
    publish(spark, base, run_id, {n: spark.read.parquet(f"{base}/runs/{last['run_id']}/{n}").limit(0) for n in names})


def keep_decisions(review: DataFrame, before: DataFrame) -> DataFrame:
    """New review rows with the APPROVED or REJECTED status that the record had before, its reviewer and time.

    Rows without an earlier decision have no reviewer and no time; ``before`` may lack these columns.
    """
    types = {"reviewer": "string", "decided_at": "timestamp"}
    known = [F.col(c) if c in before.columns else F.lit(None).cast(t).alias(c) for c, t in types.items()]
    done = before.where(F.col("status").isin("APPROVED", "REJECTED")).select("record_id", F.col("status").alias("kept"), *known)
    out = review.drop(*types).join(done, "record_id", "left")
    return out.withColumn("status", F.coalesce("kept", "status")).drop("kept")


def dangling_links(crosswalk: DataFrame, entities: DataFrame, records: DataFrame) -> DataFrame:
    """Links to an entity or a record that does not exist."""
    no_entity = crosswalk.join(entities.select("entity_id"), "entity_id", "left_anti").withColumn("missing", F.lit("entity"))
    no_record = crosswalk.join(records.select(F.col("id").alias("record_id")), "record_id", "left_anti").withColumn("missing", F.lit("record"))
    return no_entity.unionByName(no_record)


def unlinked_records(records: DataFrame, crosswalk: DataFrame) -> DataFrame:
    """Records without a link."""
    return records.join(crosswalk.select(F.col("record_id").alias("id")), "id", "left_anti")


def broken_keys(df: DataFrame, *keys: str) -> DataFrame:
    """Keys that occur more than once."""
    return df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def assert_consistent(records: DataFrame, crosswalk: DataFrame, entities: DataFrame, review: DataFrame) -> None:
    """The constraints that hold before a run is published; raises with the first that fails."""
    checks = {
        "dangling links": dangling_links(crosswalk, entities, records),
        "records without a link": unlinked_records(records, crosswalk),
        "records linked twice": broken_keys(crosswalk, "record_id"),
        "records reviewed twice": broken_keys(review, "record_id"),
        "codes that occur twice": broken_keys(records, "source_org", "local_code"),
    }
    for what, rows in checks.items():
        if rows.limit(1).count():
            raise ValueError(f"not published: {what}")
