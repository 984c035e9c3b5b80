"""The corpus pipeline: documents to tokens, each stage written and read again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidewire.llm import bpe, decontamination, pii, resampling, simhash
from tidewire.llm.common import fresh_dir, table, with_small_batches


def select_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Quality classifier (3): documents that the importance sample leaves out go."""
    with_small_batches(spark)
    return resampling.selected_documents(docs, table(spark, sf_dir, "labels"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """SimHash near-dedup (8): one document of each group stays, that with the least doc_id."""
    with_small_batches(spark)
    return simhash.deduplicated_documents(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Benchmark decontamination (9): documents that hold a benchmark item, or an edited copy of one, go."""
    with_small_batches(spark)
    return decontamination.clean_documents(docs, table(spark, sf_dir, "benchmark"))


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """PII (4): personal data is replaced in every text; n_chars follows."""
    with_small_batches(spark)
    return pii.redacted_documents(docs)


def encode_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Byte-level BPE (6): the ids of every text, and digests of them and of what they decode to."""
    with_small_batches(spark)
    return bpe.tokenised_documents(docs)


STAGES = [
    ("quality", select_quality),
    ("near_copies", drop_near_copies),
    ("decontamination", drop_contaminated),
    ("pii", redact_personal_data),
    ("bpe", encode_tokens),
]

#: Trained weights, fingerprints and alignments are beyond SQL; tests plant cases for each stage and check the pipeline's rows on a small table.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = fresh_dir(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
