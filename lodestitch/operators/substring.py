"""Substring search through trigram postings, with verification.

``ilike '%text%'`` reads every row. Here trigrams are listed once, sorted by trigram in every task's part of the list, so that a search
reads the row groups of its own trigrams only: a pattern's literal parts are cut into trigrams, the rarest few of them are intersected, and what
is left is checked with the pattern itself. Results are those of the scan, wildcards and all.

A column whose texts repeat is cut into trigrams once a distinct text, and rows are listed by text; the others are cut row by row. Nothing but
the distinct texts is shuffled.

A pattern without three literal characters in a row has no trigram; it goes to the scan. Case is ignored as ``ilike`` does, by lower case.
Rows with a null id are never found by an index; null texts hold nothing.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestitch.functions.text import let
from lodestitch.plans.materialize import stored

#: Characters of a gram, and how many of a pattern's grams are looked up.
WIDTH, RAREST = 3, 4


def contains_any(pattern: str | None, *columns: str) -> Column:
    """Whether a text occurs in one of the columns, in any case; ``%`` and ``_`` are wildcards."""
    if not pattern:
        return F.lit(True)
    return reduce(lambda a, b: a | b, [F.coalesce(F.col(c).ilike(f"%{pattern}%"), F.lit(False)) for c in columns], F.lit(False))


def grams_of(text: Column) -> Column:
    """The distinct trigrams of a text in lower case."""

    def cut(low: Column) -> Column:
        starts = F.when(F.length(low) >= WIDTH, F.sequence(F.lit(1), F.length(low) - WIDTH + 1))
        return F.transform(F.coalesce(starts, F.array().cast("array<int>")), lambda i: F.substring(low, i, F.lit(WIDTH)))

    return F.array_distinct(let(F.lower(text), cut))


def literal_parts(pattern: str) -> list[str]:
    """What stands between the wildcards of a pattern; a backslash makes the next character a literal."""
    parts, now, at = [], "", 0
    while at < len(pattern):
        c = pattern[at]
        if c == "\\" and at + 1 < len(pattern):
            now += pattern[at + 1]
            at += 1
        elif c in "%_":
            parts.append(now)
            now = ""
        else:
            now += c
        at += 1
    return [p for p in [*parts, now] if p]


@dataclass(frozen=True)
class GramIndex:
    """``postings``: gram, id of the columns that are cut row by row; ``shared``: gram, value of the distinct texts of the others;
    ``holders``: value, id of the rows with a text; and the columns that were read. Values name lower-case texts; two of one name only
    mean more rows to check."""

    postings: DataFrame
    shared: DataFrame
    holders: DataFrame
    columns: tuple[str, ...]


def _cut(texts: DataFrame, key: str) -> DataFrame:
    """gram, key: every trigram of the lower-case texts; one that occurs twice is listed twice."""
    starts = F.sequence(F.lit(1), F.length("text") - WIDTH + 1)
    placed = texts.where(F.length("text") >= WIDTH).select(key, "text", F.explode(starts).alias("at"))
    return placed.select(F.substring(F.col("text"), F.col("at"), F.lit(WIDTH)).alias("gram"), key)


def build_grams(rows: DataFrame, id_col: str, *columns: str) -> GramIndex:
    """The trigrams of the text columns of all rows."""
    low = [F.lower(F.col(c).cast("string")) for c in columns]
    rows = rows.where(F.col(id_col).isNotNull())
    # What repeats is estimated; it decides how rows are listed and not what is found.
    counted = rows.agg(F.count("*"), *[F.approx_count_distinct(text) for text in low]).first()
    repeat = [2 * distinct <= counted[0] for distinct in counted[1:]]
    columns_of = lambda repeated: [t for t, r in zip(low, repeat, strict=True) if r == repeated] + [F.lit(None).cast("string")]
    unlike = rows.select(F.col(id_col).alias("id"), F.explode(F.array(*columns_of(False))).alias("text"))
    held = rows.select(F.explode(F.array_distinct(F.array(*columns_of(True)))).alias("text"), F.col(id_col).alias("id")).where("text is not null")
    postings = _cut(unlike, "id")
    shared = _cut(held.select("text").distinct().withColumn("value", F.xxhash64("text")), "value")
    holders = held.select(F.xxhash64("text").alias("value"), "id")
    # Sorted ids of one gram or text are close to each other, and this version of the format stores their differences.
    kept = lambda df: stored(df.sortWithinPartitions(*df.columns), **{"parquet.writer.version": "PARQUET_2_0"})
    return GramIndex(kept(postings), kept(shared), kept(holders), columns)


def _with_rarest(listed: DataFrame, key: str, grams: list[str]) -> DataFrame:
    """The keys of a list that hold the rarest of some trigrams."""
    here = listed.where(F.col("gram").isin(grams))
    known = {r["gram"]: r["n"] for r in here.groupBy("gram").agg(F.count("*").alias("n")).collect()}
    rarest = sorted(grams, key=lambda g: (known.get(g, 0), g))[:RAREST]
    found = here.where(F.col("gram").isin(rarest)).groupBy(key).agg(F.count_distinct("gram").alias("n"))
    return found.where(F.col("n") == len(rarest)).select(key)


def candidate_ids(index: GramIndex, pattern: str) -> DataFrame | None:
    """id of the rows that hold the rarest trigrams of a pattern; None if it has no trigram."""
    spark = index.postings.sparkSession
    parts = spark.createDataFrame([(p,) for p in literal_parts(pattern)] or [("",)], "part string")
    grams = [r["gram"] for r in parts.select(F.explode(grams_of(F.col("part"))).alias("gram")).distinct().collect()]
    if not grams:
        return None
    by_text = index.holders.join(_with_rarest(index.shared, "value", grams), "value", "left_semi").select("id")
    return _with_rarest(index.postings, "id", grams).unionByName(by_text).distinct()


def find_rows(rows: DataFrame, index: GramIndex, pattern: str | None, id_col: str = "id") -> DataFrame:
    """The rows in which the pattern occurs in one of the index's columns."""
    ids = candidate_ids(index, pattern) if pattern else None
    if ids is not None:
        rows = rows.join(ids.withColumnRenamed("id", id_col), id_col, "left_semi").select(*rows.columns)
    return rows.where(contains_any(pattern, *index.columns))
