"""Labelled rows for training: the hold-out rule and a bounded, documented sample."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def held_out(doc_id: Column, folds: int, fold: int) -> Column:
    """Whether crc32 of the id as text falls in the fold kept out of training (null id: not held out)."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(folds)) == fold, F.lit(False))


def training_sample(labels: DataFrame, target: str, folds: int, fold: int, most: int) -> DataFrame:
    """doc_id and y (0 or 1) of labelled rows outside the held-out fold; an id counts once, with its largest label.

    About ``most`` rows at most: beyond that, rows are taken by a hash of the id.
    """
    rows = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(target).cast("int").alias("y"))
    rows = rows.where(F.col("y").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"), folds, fold))
    rows = rows.groupBy("doc_id").agg(F.max("y").alias("y"))
    total = rows.count()
    if total > most:
        rows = rows.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < int((1 << 30) * most / total))
    return rows


def sampled(docs: DataFrame, sample: DataFrame) -> DataFrame:
    """doc_id, text, y of the sampled documents. The sample is bounded, so it is broadcast and no text is shuffled."""
    return docs.join(F.broadcast(sample), "doc_id")
