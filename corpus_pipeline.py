"""A training-corpus pipeline in stages, each written as Parquet and read again.

Every stage takes what the one before kept. The first four give back the columns of ``documents``, the last one the tokens.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from themeloom.llm import bpe, common, decontaminate, pii, quality, simhash
from themeloom.session import drop_staged, stage

BPE_SLICE, BPE_KEPT = 1 << 20, 60_000


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that the quality classifier rejects."""
    return quality.keep_good(docs, common.table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each SimHash group."""
    return simhash.drop_near_duplicates(docs)


def contamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents of which a twentieth or more are benchmark words; others stay as they are."""
    return decontaminate.drop_contaminated(docs, common.table(spark, sf_dir, "benchmark"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data by the name of its kind."""
    clean = pii.redact_pii(docs)
    return clean.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``<doc_id, n_tokens, ids_sha256, decoded_sha256>`` of the byte-level BPE of every text."""
    # The workers stand beside what the stages before have left in the executor's memory.
    return bpe.token_digests(docs, BPE_SLICE, BPE_KEPT)


STAGES = [
    ("quality", quality_filter),
    ("simhash", near_duplicates),
    ("decontamination", contamination),
    ("pii", personal_data),
    ("byte_bpe", tokens),
]

# Trained stages cannot be said in SQL; tests hold the pipeline against a plain version of its stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of ``documents`` after all stages."""
    docs = common.table(spark, sf_dir, "documents")
    for name, function in STAGES:
        before, docs = docs, stage(function(spark, docs, sf_dir), name)
        drop_staged(before)
    return docs
