"""From raw documents to packed token sequences: five stages, each over all that the one before kept."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seriesloom.llm import decontaminate, exact, jaccard, queries, toxicity
from seriesloom.llm.shared import free_name, stage
from seriesloom.session import scratch_path

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def toxic_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that the classifier holds for toxic. Rows count by their text."""
    labels = queries.table(spark, sf_dir, "labels", "doc_id", "toxic")
    scorers = toxicity.train(docs, labels, F.coalesce(toxicity.crc_of_id() % 4, F.lit(0)) != 2)
    code = free_name(docs, "code_")
    coded = docs.withColumn(code, F.xxhash64("text"))
    scored = toxicity.score(coded.select(F.col(code).alias("doc_id"), "text"), scorers)
    bad = scored.where(F.col("score") >= toxicity.THRESHOLD).select(F.col("doc_id").alias(code)).distinct()
    return coded.join(stage(bad, "toxic"), code, "left_anti").select(docs.columns)


def copies_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents with the same text the one with the largest id stays."""
    return exact.keep_one(docs).select(docs.columns)


def near_copies_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by shingle overlap the one with the smallest id stays."""
    return jaccard.thin(docs).select(docs.columns)


def benchmark_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that contain a benchmark item. Rows count by their text."""
    return decontaminate.clean(docs, queries.table(spark, sf_dir, "benchmark", "item_id", "text")).select(docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token sequences: a row per piece of a document."""
    return queries.pieces(docs)


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", toxic_out),
    ("exact_dedup", copies_out),
    ("ngram_jaccard", near_copies_out),
    ("decontamination", benchmark_out),
    ("packing", packed),
]

ORACLE_SQL = None  # a trained classifier and a tokenizer are not SQL; tested against brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of a folder; each is written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, function in STAGES:
        path = scratch_path(spark, name)
        function(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
