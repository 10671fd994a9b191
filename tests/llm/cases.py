"""Documents with nulls, empty and long texts, ties, repeated rows and clashing extra columns."""

from __future__ import annotations

import random

from pyspark.sql import DataFrame, SparkSession

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, rid long, marks string, key int, fp string, row string, scan int, part string, y int, score string"


def prose(n: int, seed: int, words: int = 5000) -> str:
    rng = random.Random(seed)
    return " ".join(f"w{rng.randrange(words)}" for _ in range(n))


def odd_rows() -> list[tuple]:
    long = prose(30_000, 1)
    shared = prose(120, 2)
    texts = [
        (1, prose(80, 3)), (2, prose(80, 3)), (3, None), (4, ""), (5, " \n\t "), (6, long), (7, "one"), (8, shared + " " + prose(30, 4)),
        (9, prose(25, 5) + "\n" + shared), (10, "ÄÖ é x   日本語 " * 20), (11, prose(80, 3)), (11, prose(80, 3)), (None, prose(60, 6)), (None, None),
        (12, "a" * 5000), (13, "<|endoftext|> and <|startoftext|> end"), (14, "\x00 zero \x1f byte"),
    ]
    return [(i, t, None if k % 3 == 0 else "en", None if k % 4 == 0 else "web", None, 7, "m", 1, "f", "r", 2, "p", 1, "s") for k, (i, t) in enumerate(texts)]


def odd(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(odd_rows(), SCHEMA).repartition(3)


def none(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], SCHEMA)


def table(spark: SparkSession, texts: list[str | None]) -> DataFrame:
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)


def pairs(df: DataFrame) -> list[tuple]:
    """doc_id and text of each row."""
    return [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]


def ordered(rows) -> list[tuple]:
    return sorted((tuple(r) for r in rows), key=repr)
