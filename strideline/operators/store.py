"""Table state: upserts, idempotent inserts, settlement, as joins that give the next version of a table."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _same(keys: list[str], a: str = "old", b: str = "new") -> Column:
    return reduce(lambda x, y: x & y, [F.col(f"{a}.{k}").eqNullSafe(F.col(f"{b}.{k}")) for k in keys])


def upsert(table: DataFrame, incoming: DataFrame, keys: list[str], lock: list[str], latest: list[str], replace: list[str]) -> DataFrame:
    """The table after a merge. ``lock`` columns keep their first value, ``latest`` take the newest there is, ``replace`` the incoming one."""
    both = table.alias("old").join(incoming.alias("new"), _same(keys), "full")
    there = F.coalesce(*[F.col(f"new.{k}").isNotNull() for k in keys[:1]], F.lit(False))
    return both.select(
        *[F.coalesce(f"new.{k}", f"old.{k}").alias(k) for k in keys],
        *[F.coalesce(f"old.{c}", f"new.{c}").alias(c) for c in lock],
        *[F.coalesce(f"new.{c}", f"old.{c}").alias(c) for c in latest],
        *[F.when(there, F.col(f"new.{c}")).otherwise(F.col(f"old.{c}")).alias(c) for c in replace],
    )


def open_close(log: DataFrame, keys: list[str], at: str, tie: str, value: str) -> DataFrame:
    """An upsert log at once: the first and the last value that is not null, in time order, with its size."""
    order = F.struct(at, tie)
    known = F.col(value).isNotNull()
    return log.groupBy(*keys).agg(F.min_by(value, F.when(known, order)).alias("open"), F.max_by(value, F.when(known, order)).alias("close"), F.count(F.lit(1)).alias("ticks"), F.count(value).alias("priced"))


def insert_missing(table: DataFrame, incoming: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Rows of ``incoming`` to append: those whose keys (null equals null) the table lacks, each key once."""
    once = incoming.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_r = 1").drop("_r")
    return once.alias("new").join(table.alias("old"), _same(keys), "left_anti")


def deduplicated(rows: DataFrame, keys: list[str], settled: str, tie: str) -> DataFrame:
    """One row per key (null equals null): settled ones first, then the smallest ``tie``."""
    w = Window.partitionBy(*keys).orderBy(F.col(settled).isNotNull().desc(), tie)
    return rows.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def freshness(rows: DataFrame, key: str, at: str) -> DataFrame:
    return rows.groupBy(key).agg(F.max(at).alias("latest"))


def since(rows: DataFrame, start: DataFrame, at: str) -> DataFrame:
    """Rows at or after a time. ``start`` is one row, so it is broadcast."""
    return rows.crossJoin(F.broadcast(start)).where(F.col(at) >= F.col(start.columns[0])).drop(start.columns[0])


def history_union(history: DataFrame, live: DataFrame, day: str) -> DataFrame:
    """History plus the live rows after its last day; columns that one side lacks are null."""
    last = history.agg(F.max(day).alias("_last"))
    new = live.crossJoin(F.broadcast(last)).where(F.col("_last").isNull() | (F.col(day) > F.col("_last"))).drop("_last")
    return history.unionByName(new, allowMissingColumns=True)


def page(rows: DataFrame, conditions: dict[str, object], order: list[Column], size: int, number: int) -> DataFrame:
    """A page of the rows that meet every condition that is given, with the number of all such rows."""
    wanted = [F.col(c) == v for c, v in conditions.items() if v is not None]
    found = rows.where(reduce(lambda a, b: a & b, wanted)) if wanted else rows
    total = found.agg(F.count(F.lit(1)).alias("total"))
    return found.orderBy(*order).offset(size * number).limit(size).crossJoin(F.broadcast(total))
