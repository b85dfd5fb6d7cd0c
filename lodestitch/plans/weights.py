"""Scoring weights by category: defaults, overrides, bounds."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestitch.functions import rules as R

SCHEMA = "category string, semantic double, lexical double, attributes double, keys map<string,double>"


def default_weights(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(c, *w) for c, w in R.WEIGHTS.items()], SCHEMA)


def check_weights(semantic: float, lexical: float, attributes: float, keys: dict[str, float]) -> None:
    """Shares from 0 to 1 with a positive sum, key weights from 0 to 2."""
    shares = (semantic, lexical, attributes)
    if any(not 0 <= w <= 1 for w in shares) or sum(shares) <= 0:
        raise ValueError("shares must lie in 0..1 and have a positive sum")
    if any(not 0 <= w <= 2 for w in keys.values()):
        raise ValueError("key weights must lie in 0..2")


def effective_weights(spark: SparkSession, overrides: DataFrame | None = None) -> DataFrame:
    """Overrides, and the defaults of the categories without one."""
    defaults = default_weights(spark)
    return defaults if overrides is None else defaults.join(overrides.select("category"), "category", "left_anti").unionByName(overrides)


def as_table(weights: DataFrame) -> dict[str, tuple[float, float, float, dict[str, float]]]:
    """The weights as literals for the scoring expressions; one row per category."""
    return {r["category"]: (r["semantic"], r["lexical"], r["attributes"], dict(r["keys"] or {})) for r in weights.collect()}


def with_override(overrides: DataFrame, category: str, semantic: float, lexical: float, attributes: float, keys: dict[str, float]) -> DataFrame:
    """The overrides with one category set."""
    check_weights(semantic, lexical, attributes, keys)
    row = overrides.sparkSession.createDataFrame([(category, semantic, lexical, attributes, keys)], SCHEMA)
    return without_override(overrides, category).unionByName(row)


def without_override(overrides: DataFrame, category: str) -> DataFrame:
    """Back to the default of one category."""
    return overrides.where(F.col("category") != category)
