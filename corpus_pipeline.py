"""Training-corpus pipeline: each stage takes the documents the stage before it kept.

quality -> near duplicates -> benchmark decontamination -> secret redaction -> packing. All stages but the last return
the columns of their input. The filters decide row by row, whatever ids are null or repeated. Each stage's result is written to the shared folder and read again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from pregame.llm import decontaminate, jaccard_join, packing, quality, secret_scan
from pregame.llm.common import materialise, table

#: Words that a worker of the packing remembers, and characters it takes at once. Workers are kept for the next stages, and so is what they once took.
KEPT_WORDS, GROUP_CHARS = 200_000, 500_000


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go."""
    return quality.keep_good_rows(docs, table(spark, sf_dir, "labels"))


def without_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked documents the one with the smallest id stays."""
    return jaccard_join.one_row_per_component(docs)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return decontaminate.without_leaking_rows(docs, table(spark, sf_dir, "benchmark"))


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are blanked in the text; every document stays."""
    found = materialise(secret_scan.candidates(docs), "candidates")
    return secret_scan.redact(docs, secret_scan.train_forest(secret_scan.rule_labels(found)))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents and their place in sequences of 4096 tokens."""
    import public_tokenizers

    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"), kept=KEPT_WORDS, group=GROUP_CHARS)


STAGES = [
    ("quality classifier", good_quality),
    ("n-gram Jaccard join", without_near_duplicates),
    ("benchmark decontamination", without_benchmark),
    ("secret scans", without_secrets),
    ("best-fit packing", packed),
]

#: Models, hashes and tokenizers have no SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
