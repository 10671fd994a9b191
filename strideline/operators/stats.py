"""Grouped statistics: fit, calibration, coverage, regression, leaders."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strideline.operators import order
from strideline.sources.scratch import written


def fit(frame: DataFrame, pairs: dict[str, tuple[str, str]], *keys: str) -> DataFrame:
    """Correlation and mean absolute error of each named (actual, predicted) pair, by keys; null correlation under 5 rows."""
    n = F.count(F.lit(1))
    columns = [c for name, (a, p) in pairs.items() for c in (F.when(n >= 5, F.corr(a, p)).alias(f"{name}_corr"), F.avg(F.abs(F.col(a) - F.col(p))).alias(f"{name}_mae"))]
    return frame.groupBy(*keys).agg(n.alias("n"), *columns)


def regression(frame: DataFrame, y: str, x: str, *keys: str) -> DataFrame:
    return frame.groupBy(*keys).agg(F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"), F.count(F.lit(1)).alias("n"))


def calibration(frame: DataFrame, probability: str, outcome: str, bins: int = 10) -> DataFrame:
    """Right-closed quantile bins with equal edges merged: size, mean prediction, actual rate, mean absolute error."""
    frame = written(frame.select(probability, outcome))
    edges = sorted(set(order.quantiles(frame, probability, [i / bins for i in range(bins + 1)])))
    p = F.col(probability)
    # A value equal to an edge is in the bin that the edge closes.
    cut = frame.withColumn("bin", sum(((p > e).cast("int") for e in edges[1:-1]), F.lit(0)))
    return cut.groupBy("bin").agg(F.count(F.lit(1)).alias("n"), F.avg(p).alias("mean_pred"), F.avg(F.col(outcome).cast("double")).alias("actual_rate"), F.avg(F.abs(p - F.col(outcome))).alias("mean_abs_err"))


def coverage(frame: DataFrame, columns: list[str], *keys: str) -> DataFrame:
    """Share of rows with a value, by keys."""
    return frame.groupBy(*keys).agg(*[F.avg(F.col(c).isNotNull().cast("double")).alias(f"{c}_rate") for c in columns])


def leaders(frame: DataFrame, keys: list[str], value: str, tie: str) -> DataFrame:
    """The row with the largest value of each group; a tie goes to the smaller ``tie``."""
    return frame.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(value), tie))).where("_r = 1").drop("_r")


def key_audit(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Coverage of a join key: keys on both sides, on one side only, and shared out of all."""
    a, b = (x.select(key).distinct().withColumn(f"_{s}", F.lit(1)) for x, s in ((left, "l"), (right, "r")))
    both = F.col("_l").isNotNull() & F.col("_r").isNotNull()
    return a.join(b, key, "full").agg(F.count_if(both).alias("shared"), F.count_if(F.col("_r").isNull()).alias("left_only"), F.count_if(F.col("_l").isNull()).alias("right_only"), F.avg(both.cast("double")).alias("shared_rate"))


def roster_overlap(rows: DataFrame, key: str, member: str) -> DataFrame:
    """Sizes of both sides' member sets of each event and of their intersection."""
    sets = rows.groupBy(key).agg(*[F.collect_set(F.when(F.col("is_home") == flag, F.col(member))).alias(n) for flag, n in ((True, "a"), (False, "b"))])
    return sets.select(key, F.size("a").alias("home_members"), F.size("b").alias("away_members"), F.size(F.array_intersect("a", "b")).alias("shared"))
