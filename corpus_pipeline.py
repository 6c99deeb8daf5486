"""A training-data pipeline in five stages, each of which writes Parquet for the next one.

Nulls, empty and long texts, ties, repeated rows and further columns are handled as the stage's operator says: a null text counts as empty everywhere, a null
id comes last among near copies, repeated rows count once in near-dedup, and an empty table passes all stages as one.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from lexshelf.llm import mixing, packing, quality, queries, secrets, simhash
from lexshelf.llm.common import scratch, table
from lexshelf.shared import removed, shared_dir


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score at least 0.5; the model is fitted on labelled documents of the whole table."""
    weights = quality.fit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), usable=~queries.held_out())
    return quality.keep_good(docs, weights)


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of exact and near copies (five-word shingles, 0.8 alike)."""
    return simhash.keep_one(docs)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with live-looking secrets masked; widely copied examples stay."""
    return secrets.redact(docs, secrets.scan(docs))


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix takes it."""
    return mixing.apply_mix(docs)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces with their sequences and offsets."""
    return packing.pack(docs, queries.vocabulary())


STAGES = [
    ("quality classifier", quality_classifier),
    ("simhash near-dedup", simhash_near_dedup),
    ("secret scans", secret_scan),
    ("mixing sources", source_mixing),
    ("best-fit packing", best_fit_packing),
]

#: The classifier and the near-duplicate search are no SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage. What a stage wrote for itself, and the output of the stage before it, go once its own output is written."""
    base = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        with scratch(spark):
            stage(spark, docs, sf_dir).write.parquet(f"{base}/{i}")
        docs = spark.read.parquet(f"{base}/{i}")
        removed(spark, f"{base}/{i - 1}")
    return docs
