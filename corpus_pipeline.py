"""From raw documents to packed sequences, one operator a stage; each stage works on all rows that the one before kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fedlens.llm import jaccard_join, packing, quality, secret_scan, substring_dedup
from fedlens.llm.queries import vocabulary
from fedlens.session import workspace

PASSAGE_WORDS = 50


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and are no outlier of their language and source."""
    return quality.clean_documents(spark, docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The smallest document of each group of near copies (five words, similarity 0.8); rows without an id stay.

    Rows that repeat an id are one document, so all of them stay or go; their texts may differ, so none is dropped.
    """
    groups = jaccard_join.linked(spark, docs, size=5, percent=80)
    gone = groups.where(F.col("doc_id") != F.col("component_id")).select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(docs.columns)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without passages of PASSAGE_WORDS or more words that an earlier document holds."""
    return substring_dedup.without_repeats(spark, docs, PASSAGE_WORDS)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with their secrets masked; values that many owners hold are examples and stay."""
    return secret_scan.redacted(spark, docs, owner="source", repository="doc_id")


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents that are left, placed in sequences of 2048 tokens."""
    return packing.pack(spark, docs, vocabulary("byte_bpe_50k.json"), window=2048)


STAGES = [
    ("quality rules", quality_rules),
    ("near duplicates", near_duplicates),
    ("substring dedup", repeated_passages),
    ("secret scan", secrets),
    ("packing", packed),
]
#: Estimates, similarity groups and token ids are beyond SQL; tests compare every stage with brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``, each result written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            path = workspace(spark, name.replace(" ", "-"))
            docs.write.parquet(path)
            docs = spark.read.parquet(path)
    return docs
