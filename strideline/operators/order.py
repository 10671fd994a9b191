"""Ranks in a total order without a sort in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strideline.sources.scratch import written


def ranked(rows: DataFrame, name: str, *order: str) -> DataFrame:
    """rows with their place (from 0) in ``order``: sorted over range partitions, written, and counted by partition.

    Only the counts, one row for each partition, stand in one window.
    """
    table = written(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()))
    table = table.withColumn("_part", F.shiftright("_at", 33))
    counts = table.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"), F.min("_at").alias("_first"))
    before = F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("_n")
    shift = counts.select("_part", (F.col("_first") - before).alias("_shift"))
    return table.join(F.broadcast(shift), "_part").withColumn(name, F.col("_at") - F.col("_shift")).drop("_at", "_part", "_shift")


def quantiles(rows: DataFrame, value: str, shares: list[float]) -> list[float]:
    """Exact quantiles with linear interpolation, as ``percentile`` gives them, from the few rows whose ranks they need."""
    known = rows.where(F.col(value).isNotNull()).select(F.col(value).cast("double").alias("_v"))
    placed = ranked(known, "_rank", "_v")
    n = placed.count()
    if not n:
        return []
    at = {int(s * (n - 1)) for s in shares}
    wanted = sorted(at | {min(i + 1, n - 1) for i in at})
    by_rank = {r["_rank"]: r["_v"] for r in placed.where(F.col("_rank").isin(wanted)).collect()}
    out = []
    for s in shares:
        i = int(s * (n - 1))
        low, high = by_rank[i], by_rank[min(i + 1, n - 1)]
        out.append(low + (s * (n - 1) - i) * (high - low))
    return out


def season_bounds(games: DataFrame) -> DataFrame:
    """season, first day, last day of the regular season: one row for each season, which calendars bound."""
    regular: Column = F.when(~F.col("is_playoff"), F.col("game_date"))
    return games.groupBy("season").agg(F.min("game_date").alias("_first"), F.max(regular).alias("_regular"))
