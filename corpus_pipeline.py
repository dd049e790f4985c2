"""The corpus pipeline: five stages over ``documents``, each written and read again.

All stages but the last return the columns of ``documents``. Rows without a doc_id pass the
near-duplicate stage; rows that repeat a doc_id count as copies there, and one stays.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrykit.llm import decontaminate, minhash, packing, quality, secrets
from quarrykit.llm.common import free_name
from quarrykit.session import stored, table


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects as low or toxic go."""
    return quality.accepted(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays: that with the smallest id."""
    kept = stored(minhash.near_duplicates(docs).where("kept and doc_id is not null").select("doc_id").distinct(), "kept")
    named = docs.where("doc_id is not null")
    repeats = stored(named.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1"), "repeats")
    if not repeats.isEmpty():
        # Each task gives one row an id to the shuffle, so an id of very many rows is no burden.
        (row,) = free_name(docs, "_row")
        whole = F.struct(*(F.col(f"`{c}`") for c in docs.columns))
        named = named.groupBy("doc_id").agg(F.min_by(whole, F.xxhash64("text")).alias(row)).select(f"{row}.*")
    return named.join(kept, "doc_id", "left_semi").select(*docs.columns).unionByName(docs.where("doc_id is null"))


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Contaminated documents go."""
    return decontaminate.clean_rows(docs, table(spark, sf_dir, "benchmark"))


def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document stays; secrets in its text are masked and n_chars kept true."""
    return secrets.redacted_rows(docs)


def length_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A place in a batch for every document."""
    return packing.pack(docs)


STAGES = [
    ("quality classifier", quality_classifier),
    ("MinHash near-dedup", near_duplicates),
    ("benchmark decontamination", benchmark_decontamination),
    ("secret scans", secret_scans),
    ("packing", length_packing),
]

#: A fitted classifier and decoded layers have no SQL; the tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = stored(docs, "stage")
    return docs
