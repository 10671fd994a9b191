"""Named read queries over built tables: what an API serves."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strideline.operators import parlays, store


def rating_table(finals: DataFrame, played: DataFrame, least: int = 1) -> DataFrame:
    """Teams by rating, with games played; ties keep the team order."""
    counts = played.select(F.explode(F.array("home", "away")).alias("team")).groupBy("team").agg(F.count(F.lit(1)).alias("games"))
    rows = finals.join(counts, "team", "left").where(F.coalesce("games", F.lit(0)) >= least)
    return rows.withColumn("rating", F.round("rating", 1)).withColumn("place", F.row_number().over(Window.partitionBy("league").orderBy(F.desc("rating"), "team")))


def history(games: DataFrame, season: int | None = None, team: int | None = None, size: int = 50, number: int = 0) -> DataFrame:
    """A page of past games, newest first, by optional season and team."""
    rows = games.where((F.col("home") == team) | (F.col("away") == team)) if team is not None else games
    return store.page(rows, {"season": season}, [F.desc("game_date"), F.desc("game_id")], size, number)


def forward_summary(picks: DataFrame) -> DataFrame:
    """Forward-test figures overall, by season and by market. CLV shares are of picks that have a CLV, unlike a back-test's."""
    result, clv = F.col("result"), F.col("clv")
    decided = F.nullif(F.count_if(result != 0), F.lit(0))
    m, y = F.col("market"), F.col("season")
    return picks.groupingSets([[], [m], [y]], m, y).agg(
        F.count(F.lit(1)).alias("picks"),
        F.count(result).alias("settled"),
        F.count_if(result == 1).alias("won"),
        (F.count_if(result == 1) / decided).alias("hit_rate"),
        (F.sum("profit") / F.nullif(F.count(result), F.lit(0)) * 100).alias("roi_pct"),
        (F.count_if(clv > 0) / F.nullif(F.count(clv), F.lit(0))).alias("pct_positive_clv"),
    )


def line_movement(picks: DataFrame) -> DataFrame:
    """Mean size of CLV and the share that moved more than two points, by market."""
    size = F.abs("clv")
    return picks.groupBy("market").agg(F.count("clv").alias("n"), F.avg(size).alias("mean_abs_clv"), F.avg((F.round(size, 9) > 2).cast("double")).alias("moved_share"))


def daily_suggestions(opps: DataFrame, day: str = "game_date", top: int = 5) -> DataFrame:
    """The ``top`` opportunities of each day by edge."""
    w = Window.partitionBy(day).orderBy(F.desc("edge_pct"), "game_id", "market", "side")
    return opps.withColumn("place", F.row_number().over(w)).where(F.col("place") <= top)


def combine(legs: DataFrame, key: str = "parlay_id") -> DataFrame:
    """Parlays made by hand: the legs of each key, priced."""
    w = F.sort_array(F.collect_list(F.struct(*parlays.LEG)))
    return parlays.priced(legs.groupBy(key).agg(w.alias("legs")))
