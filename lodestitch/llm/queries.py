"""One query per operator, with production parameters, over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestitch.llm.byte_bpe import encode_documents
from lodestitch.llm.html_consensus import extract_main_text
from lodestitch.llm.line_dedup import remove_near_lines
from lodestitch.llm.ngram_join import similar_components
from lodestitch.llm.quality_rules import quality_rules
from lodestitch.llm.quote_linking import link_quotes
from lodestitch.llm.ring_sharding import shard_rows
from lodestitch.llm.suffix_dedup import remove_repeats
from lodestitch.llm.template_decontam import find_contamination
from lodestitch.llm.tput_search import search
from lodestitch.llm.url_reputation import judge_urls
from lodestitch.llm.warc import assemble, index_archive, read_records, resolve, write_archive
from lodestitch.llm.whitening import whiten
from lodestitch.plans.materialize import scratch_folder
from lodestitch.sources.tables import table

#: The rule list of the production filter.
URL_RULES = (
    ("block", "com/en/"),
    ("allow", "example.com/en/7"),
    ("allow", "net/de/"),
    ("block", "example.net/de/8"),
    ("block", "org/es/"),
)
#: The vocabulary that production encodes with.
VOCABULARY = "byte_bpe_multi_50k.tiktoken"


def op1_url_reputation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(table(spark, sf_dir, "pages"), table(spark, sf_dir, "labels"), URL_RULES)


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    removed = F.aggregate(F.zip_with("starts", "ends", lambda a, b: b - a), F.lit(0).cast("long"), lambda a, b: a + b)
    return remove_repeats(table(spark, sf_dir, "documents")).select(
        "doc_id",
        "n_bytes",
        removed.alias("n_removed"),
        F.size("starts").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_quote_linking(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link_quotes(table(spark, sf_dir, "conversations"))


def op5_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar_components(table(spark, sf_dir, "documents"), width=3, percent=90, links=True)


def op6_template_decontam(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "contaminated", "items")


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_near_lines(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_lines", "removed_lines", F.sha2("text", 256).alias("kept_sha256")
    )


def op8_ring_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_rows(table(spark, sf_dir, "documents"), 24)


def op9_html_consensus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_main_text(table(spark, sf_dir, "pages"))


def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return encode_documents(
        table(spark, sf_dir, "documents"), public_tokenizers.path(VOCABULARY), public_tokenizers.PATTERN
    )


def op11_warc_transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{scratch_folder(spark)}/warc"
    write_archive(table(spark, sf_dir, "pages"), folder)
    captures = resolve(assemble(index_archive(read_records(spark, folder))))
    return captures.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "sound")


def op12_tput_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(table(spark, sf_dir, "embeddings"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        f.__name__: f
        for f in (
            op1_url_reputation,
            op2_suffix_dedup,
            op3_quality_rules,
            op4_quote_linking,
            op5_ngram_join,
            op6_template_decontam,
            op7_line_dedup,
            op8_ring_sharding,
            op9_html_consensus,
            op10_byte_bpe,
            op11_warc_transactions,
            op12_tput_search,
            op13_whitening,
        )
    }
