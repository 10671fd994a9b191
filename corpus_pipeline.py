"""Corpus pipeline: quality, near copies, benchmark leaks, secrets, packing. Each stage's result is written and read again.

Nulls in any column are kept; a null text counts as an empty one, is scored like it and packed as its end alone. Null and
empty texts are copies of each other. Rows without an id are copies like any other and never name a group. Of repeated
rows one stays. Very long texts are read whole. An empty table gives empty results of the same columns, and columns beside
those of documents, whatever their names, are passed on by all stages but the last.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from strideline.llm import decontaminate, near_copies, packing, quality, secret_scan
from strideline.llm.common import documents, written


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts; it learns from the labels of the corpus, by bounded samples. Equal texts have one fate."""
    return quality.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document with the smallest id stays; of repeated rows one."""
    return near_copies.keep_one(docs)


def without_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return decontaminate.without_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets in a text are replaced by a mark and n_chars follows; every document stays, null texts too."""
    return secret_scan.redact(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token sequences with their places."""
    return packing.pack(docs)


STAGES = [
    ("quality", keep_good),
    ("near_dedup", near_dedup),
    ("decontaminate", without_leaks),
    ("secret_scan", without_secrets),
    ("packing", packed),
]
#: SQL has neither the tokenizer nor the models.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        docs = docs if i == len(STAGES) - 1 else written(docs)
    return docs
