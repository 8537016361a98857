"""From raw documents to packed token sequences in five stages, each written as Parquet before the next reads it.

Every stage takes all rows its predecessor kept, and all but the last return the columns of documents.  ``n_chars``, where there is such a
column, follows the text.

In every stage null and empty texts are kept (they score as clean, hold no lines, shingles or passages, and pack as the end id alone), rows with a null
doc_id are kept as they are, texts of any length are taken whole, and an empty table gives an empty table.  Of rows that repeat a doc_id and text all stay or all
go, but in packing, where each is packed on its own.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paperloom.llm._store import cut
from paperloom.llm.line_dedup import line_dedup
from paperloom.llm.near_dedup import near_duplicates
from paperloom.llm.packing import pack
from paperloom.llm.substring_dedup import substring_dedup
from paperloom.llm.toxicity import learn, not_toxic


def _as_documents(changed: DataFrame, docs: DataFrame) -> DataFrame:
    if "n_chars" in docs.columns:
        changed = changed.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return changed.select(docs.columns)


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is under the threshold."""
    model = learn(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return not_toxic(docs, model)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without later copies of runs of lines."""
    return _as_documents(line_dedup(docs), docs)


def keep_one_of_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the one with the least doc_id, of each near-duplicate component."""
    lost = near_duplicates(docs).filter(~F.col("kept")).select("doc_id").distinct()
    return docs.join(lost, "doc_id", "left_anti").select(docs.columns)


def cut_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without later copies of long passages."""
    return _as_documents(substring_dedup(docs), docs)


def pack_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces placed in windows of 2048."""
    return pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("toxicity", reject_toxic),
    ("line dedup", drop_repeated_lines),
    ("near dedup", keep_one_of_near_duplicates),
    ("substring dedup", cut_repeated_passages),
    ("packing", pack_tokens),
]

#: SQL can't express the learned model of the first stage; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packed pieces of all documents that pass the stages."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), "stage-" + name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
