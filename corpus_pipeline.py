"""The corpus pipeline: quality, near-duplicates, benchmark leaks, secrets, mix.

Every stage works on all that the one before kept and returns the table of
documents; the last adds the sizes and targets of the mix and the words taken.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessera.llm import decontaminate, importance, near_copies, secret_scan, token_mix
from tessera.llm.common import table
from tessera.session import stage


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that importance resampling keeps."""
    return importance.kept_documents(docs, table(spark, sf_dir, "labels"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the one with the smallest id, of each group of near-duplicates: Jaccard 0.8 of 5-word shingles."""
    return near_copies.first_of_groups(docs)


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no item of the benchmark."""
    return decontaminate.clean_documents(docs, table(spark, sf_dir, "benchmark"))


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets replaced by a mark and `n_chars` following."""
    return secret_scan.redact(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents of the mix, with the words that it takes of each."""
    return token_mix.mixed_documents(docs, token_mix.quality_weights(table(spark, sf_dir, "labels")))


STAGES = [("quality classifier", keep_quality), ("near-dedup by shingles", drop_near_duplicates), ("benchmark decontamination", drop_benchmark_leaks),
          ("secret scans", mask_secrets), ("mixing sources", mix_sources)]

#: Hashed models, fingerprints and byte-level scans are not SQL; the tests compare every stage with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, fn in STAGES:
        docs = stage(fn(spark, docs, sf_dir), name.lower().replace(" ", "-"))
    return docs
