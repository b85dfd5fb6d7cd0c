"""The training-corpus pipeline: each stage works on all that the one before kept."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestitch.llm.byte_bpe import encode_documents
from lodestitch.llm.line_dedup import remove_near_lines
from lodestitch.llm.ngram_join import similar_components
from lodestitch.llm.quality_rules import keep_good_documents
from lodestitch.llm.queries import VOCABULARY
from lodestitch.llm.template_decontam import keep_clean_documents
from lodestitch.plans.materialize import scratch_folder
from lodestitch.sources.tables import table

#: Near-duplicate documents: word shingles of this width, and this Jaccard similarity in percent.
SHINGLE_WORDS, SIMILAR_PERCENT = 5, 80
#: What a text with words has: anything but the white space between them.
WORD = r"[^\x20\x09-\x0D]"


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go. A null or empty text has no words and goes; repeated rows fare alike."""
    return keep_good_documents(docs, table(spark, sf_dir, "labels"), joint=True)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines near an earlier line go, short ones when equal; a document that is left without words goes with them.

    A null text stays null; rows with a null id come last; of rows with equal ids and texts, none loses lines to
    the other; any further columns come along.
    """
    others = [c for c in docs.columns if c not in ("doc_id", "text", "n_chars")]
    rest = F.struct(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(others)], F.lit(0).alias("none"))
    kept = remove_near_lines(docs.select("doc_id", "text", rest.alias("rest")), carry=("rest",))
    # A copy would else live on as blank lines.
    kept = kept.where((F.size("removed_lines") == 0) | F.col("text").isNull() | F.col("text").rlike(WORD))
    now = {c: F.col(f"rest.c{i}").alias(c) for i, c in enumerate(others)}
    now |= {"doc_id": F.col("doc_id").cast(docs.schema["doc_id"].dataType).alias("doc_id"), "text": F.col("text")}
    now |= {"n_chars": F.length("text").cast(docs.schema["n_chars"].dataType).alias("n_chars")}
    return kept.select(*[now[c] for c in docs.columns])


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays: the one with the smallest id.

    Of equal rows with that id one stays; rows with a null id, a null text or no words resemble nothing and stay.
    """
    groups = similar_components(docs, width=SHINGLE_WORDS, percent=SIMILAR_PERCENT)
    first = groups.where("doc_id = component_id").select("doc_id").distinct()
    known = docs.join(first, "doc_id", "left_semi").dropDuplicates(["doc_id", "text"])
    return known.unionByName(docs.where("doc_id is null")).select(*[f"`{c}`" for c in docs.columns])


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item, re-parameterised or not, go; a null text holds none; repeated rows fare alike."""
    return keep_clean_documents(docs, table(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of what is left, one row per row; a null text has no tokens."""
    return encode_documents(docs, public_tokenizers.path(VOCABULARY), public_tokenizers.PATTERN)


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

STAGES: list[tuple[str, Stage]] = [
    ("quality rules", quality),
    ("line dedup", line_dedup),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", decontaminate),
    ("byte-level BPE", encode),
]

#: No SQL for the byte-level BPE stage; tests hold run() against a brute-force version.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written as Parquet to the shared folder and read again."""
    docs, folder = table(spark, sf_dir, "documents"), scratch_folder(spark)
    for i, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{i}")
        docs = spark.read.parquet(f"{folder}/{i}")
    return docs
