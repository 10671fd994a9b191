"""Features of a team's star: last season's leader by minutes, and his own record strictly before the game."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strideline.operators import stats


def player_games(box: DataFrame, log: DataFrame) -> DataFrame:
    """A row of each player's game for a team: player_id, minutes, pts, with the team log's team, opponent, season and day."""
    sums = box.groupBy(F.col("event_id").alias("game_id"), "player_id", "is_home").agg(F.sum("minutes").alias("minutes"), F.sum("pts").alias("pts"))
    return log.select("game_id", "is_home", "team", "opponent", "season", "game_date").join(sums, ["game_id", "is_home"])


def with_star(log: DataFrame, played: DataFrame) -> DataFrame:
    """game_id, is_home, team, opponent, game_date and star: who had most minutes for the team in the season before (ties: least id)."""
    best = stats.leaders(played.groupBy("team", "season", "player_id").agg(F.sum("minutes").alias("minutes")), ["team", "season"], "minutes", "player_id")
    last = best.select("team", (F.col("season") + 1).alias("season"), F.col("player_id").alias("star"))
    return log.join(last, ["team", "season"], "left").select("game_id", "is_home", "team", "opponent", "game_date", "star")


def before(asked: DataFrame, played: DataFrame, by: list[str], **values: Column) -> DataFrame:
    """asked with sums of ``values`` (of played rows) over all days before its own, for equal columns ``by``.

    Rows that ask and sums by day stand in one window by key and day, so each day is read once and no game sees its own day.
    """
    days = played.groupBy(*by, "game_date").agg(*[F.sum(v).alias(f"_{k}") for k, v in values.items()])
    w = Window.partitionBy(*by).orderBy(F.unix_date("game_date")).rangeBetween(Window.unboundedPreceding, -1)
    both = asked.withColumn("_asked", F.lit(True)).unionByName(days.withColumn("_asked", F.lit(False)), allowMissingColumns=True)
    return both.select(*asked.columns, "_asked", *[F.coalesce(F.sum(f"_{k}").over(w), F.lit(0)).alias(k) for k in values]).where("_asked").drop("_asked")


def venue_gap(log: DataFrame, played: DataFrame, least: int = 10) -> DataFrame:
    """game_id, is_home, venue_gap: the star's mean points at home less those away; 0 with under ``least`` games of either kind, or no star."""
    at_home = F.col("is_home").cast("int")
    asked = with_star(log, played)
    known = asked.where("star is not null").withColumnRenamed("star", "player_id")
    sums = before(known, played, ["player_id"], home_pts=F.col("pts") * at_home, home_n=at_home, away_pts=F.col("pts") * (1 - at_home), away_n=1 - at_home)
    gap = F.when((F.col("home_n") >= least) & (F.col("away_n") >= least), F.col("home_pts") / F.col("home_n") - F.col("away_pts") / F.col("away_n"))
    return asked.select("game_id", "is_home").join(sums.select("game_id", "is_home", gap.alias("venue_gap")), ["game_id", "is_home"], "left").withColumn("venue_gap", F.coalesce("venue_gap", F.lit(0.0)))


def opponent_trail(log: DataFrame, played: DataFrame, neutral: float) -> DataFrame:
    """game_id, is_home, trail, meetings: the star's mean points in earlier games against this opponent; ``neutral`` without any."""
    asked = with_star(log, played)
    known = asked.where("star is not null").withColumnRenamed("star", "player_id")
    sums = before(known, played, ["player_id", "opponent"], pts=F.col("pts"), meetings=F.lit(1))
    found = sums.select("game_id", "is_home", F.when(F.col("meetings") > 0, F.col("pts") / F.col("meetings")).alias("trail"), "meetings")
    out = asked.select("game_id", "is_home").join(found, ["game_id", "is_home"], "left")
    return out.select("game_id", "is_home", F.coalesce("trail", F.lit(neutral)).alias("trail"), F.coalesce("meetings", F.lit(0)).cast("long").alias("meetings"))
