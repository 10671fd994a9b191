"""Queries of the document operators, each over its whole table with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strideline.llm import decontaminate, html_extract, merkle, minhash_dedup, packing, quality, quality_rules, secret_scan, simhash_dedup, spelling, sql, substring_dedup, suffix_dedup, toxicity
from strideline.llm.common import documents


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def op1_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(documents(spark, sf_dir))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score(documents(spark, sf_dir), labels(spark, sf_dir))


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.findings(documents(spark, sf_dir))


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash_dedup.near_groups(documents(spark, sf_dir))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score(documents(spark, sf_dir), labels(spark, sf_dir))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge(documents(spark, sf_dir))


def benchmark(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/benchmark.parquet")


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.leaks(documents(spark, sf_dir), benchmark(spark, sf_dir))


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.dedup(documents(spark, sf_dir))


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.dedup(documents(spark, sf_dir))


def op11_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = minhash_dedup.near_groups(documents(spark, sf_dir))
    return found.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def op12_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(documents(spark, sf_dir))


def op13_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tampering: n_chars grows by 1 where 7 divides the crc32 of the id."""
    hit = (F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(7)) == 0) & F.col("n_chars").isNotNull()
    tampered = F.when(hit, merkle.leaf(n_chars=F.col("n_chars").cast("long") + 1))
    return merkle.verified(merkle.manifest(documents(spark, sf_dir), tampered=tampered), "tampered")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_html_extract": op1_html_extract,
    "op2_packing": op2_packing,
    "op3_toxicity": op3_toxicity,
    "op4_secret_scan": op4_secret_scan,
    "op5_simhash": op5_simhash,
    "op6_quality": op6_quality,
    "op7_quality_rules": op7_quality_rules,
    "op8_decontaminate": op8_decontaminate,
    "op9_suffix_dedup": op9_suffix_dedup,
    "op10_substring_dedup": op10_substring_dedup,
    "op11_minhash": op11_minhash,
    "op12_spelling": op12_spelling,
    "op13_merkle": op13_merkle,
}

ORACLES: dict[str, str] = {"op11_minhash": sql.MINHASH, "op12_spelling": sql.SPELLING, "op13_merkle": sql.MERKLE}
