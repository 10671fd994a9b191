"""The registry of queries: a name, a function of a session and a folder, and the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strideline.operators import betting, log
from strideline.plans import build
from strideline.sources import tables
from strideline.sources.scratch import written

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def r6(c: Column | str) -> Column:
    return F.round(F.col(c) if isinstance(c, str) else c, 6)


def rounded(df: DataFrame) -> DataFrame:
    """All doubles to six digits; a negative zero is zero."""
    return df.withColumns({c: F.round(c, 6) + F.lit(0.0) for c, t in df.dtypes if t == "double"})


def frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    return betting.predicted(build.features(tables.games(spark, sf_dir)))


def opps(spark: SparkSession, sf_dir: str, price: str = "close") -> DataFrame:
    f = written(frame(spark, sf_dir).select(*betting.NEEDED))
    return betting.opportunities(f, betting.residual_stds(f), price)


def bets(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = written(frame(spark, sf_dir).select(*betting.NEEDED))
    return betting.backtest(f, betting.residual_stds(f))


def the_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return log.team_log(tables.games(spark, sf_dir))
