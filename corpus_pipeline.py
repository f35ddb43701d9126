"""From raw documents to token ids in five stages, each on all that its predecessor kept.

``run`` writes every stage's result as Parquet to the shared folder and reads it back as the next stage's input.  SQL cannot
express the models; a test holds every stage against its operator, which has a brute-force test of its own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from millrace.llm import decontaminate, importance, minhash, secrets, sentencepiece_scan
from millrace.llm.common import materialize, table
from millrace.llm.queries import UNIGRAM_VOCABULARY, vocabulary_path, wanted_labels


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that importance resampling keeps."""
    return importance.keep(docs, wanted_labels(spark, sf_dir))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate component."""
    return minhash.deduplicate(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any verified overlap with the benchmark."""
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with their secrets replaced by a mark; n_chars follows the text."""
    return secrets.redact_documents(docs, secrets.train(secrets.samples(spark)))


def sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_crc32, round_trip and ids of each document."""
    return sentencepiece_scan.encode(docs, vocabulary_path(UNIGRAM_VOCABULARY))


STAGES = [
    ("quality classifier", quality_classifier),
    ("minhash near-dedup", near_dedup),
    ("benchmark decontamination", decontamination),
    ("secret scans", secret_scan),
    ("sentencepiece encoding", sentencepiece),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
