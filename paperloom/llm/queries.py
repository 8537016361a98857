"""The registered queries of the training-data operators, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import byte_bpe, toxicity
from .bm25_search import search
from .hard_negatives import mine_hard_negatives
from .html_extraction import extract_main_text
from .license_scan import license_scan
from .line_dedup import line_dedup
from .near_dedup import near_duplicates
from .oracles import ORACLE_SQL
from .packing import pack
from .repetition import repetition_rules
from .substring_dedup import find_repeats
from .token_alignment import align, rate_links
from .warc import round_trip

__all__ = ["ORACLE_SQL", "QUERIES"]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every fragment of a passage of at least 50 words that an earlier document holds as well."""
    found = find_repeats(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.explode("repeats").alias("r")).select(
        "doc_id", F.col("r.source_id").alias("source_id"), F.col("r.start").alias("first_word"), F.col("r.words").alias("n_words"), F.col("r.source_start").alias("source_word"), F.col("r.edits").alias("edits")
    )


def op2_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate components of all documents on two-word shingles."""
    return near_duplicates(_table(spark, sf_dir, "documents"), k=2)


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages written as WARC archives and read back."""
    return round_trip(_table(spark, sf_dir, "pages"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity scores of all documents, learned from the labels that are not held out."""
    docs = _table(spark, sf_dir, "documents")
    scored = toxicity.toxicity(docs, toxicity.learn(docs, _table(spark, sf_dir, "labels")))
    return scored.select("doc_id", toxicity.held_out().alias("held_out"), F.col("toxicity").alias("score")).withColumn("predicted", (F.col("score") >= toxicity.THRESHOLD).cast("int"))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suffix-array repetition verdicts of every document."""
    return repetition_rules(_table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_covered_words"
    )


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's token pieces placed in windows of 2048."""
    return pack(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op7_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of every document's byte-level BPE ids and of the decoded bytes."""
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    done = byte_bpe.decode(byte_bpe.encode(_table(spark, sf_dir, "documents"), path, public_tokenizers.PATTERN), path)
    decimal = F.array_join(F.col("ids").cast("array<string>"), ",")
    return done.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(decimal.cast("binary"), 256).alias("ids_sha256"), F.sha2("bytes", 256).alias("decoded_sha256"))


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document after deletion of later repeated runs of lines."""
    kept = line_dedup(_table(spark, sf_dir, "documents"))
    lines = F.when(F.col("text").isNull(), 0).otherwise(F.size(F.split("text", "\n", -1)))
    return kept.select("doc_id", "lines_removed", lines.alias("lines_kept"), F.md5(F.coalesce("text", F.lit(""))).alias("text_md5"))


def op9_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best documents for every document whose doc_id is divisible by 100, taken as a query with its whole text."""
    docs = _table(spark, sf_dir, "documents")
    return search(docs, docs.filter(F.col("doc_id") % 100 == 0))


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The license notices that every document holds."""
    found = license_scan(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.size("found").alias("n_licenses"), F.array_join("found.name", ",").alias("licenses"))


def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of every document's alignment of two tokenizers, and how frequent its links are in the corpus."""
    aligned = align(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"), public_tokenizers.PATTERN, packed=True)
    groups = F.coalesce(F.sha2("groups", 256), F.lit("")).alias("groups_sha256")
    return rate_links(aligned.select("doc_id", "n_a", "n_b", "n_groups", groups, "pairs"))


def op12_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    return extract_main_text(_table(spark, sf_dir, "pages"))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of every vector whose vec_id is divisible by 100, some labels being wrong on purpose."""
    rows = _table(spark, sf_dir, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mine_hard_negatives(rows.withColumn("label", label), F.col("vec_id") % 100 == 0)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_substring_dedup,
        op2_near_dedup,
        op3_warc,
        op4_toxicity,
        op5_quality_rules,
        op6_packing,
        op7_byte_bpe,
        op8_line_dedup,
        op9_search,
        op10_license_scan,
        op11_token_alignment,
        op12_html_extraction,
        op13_hard_negatives,
    )
}
