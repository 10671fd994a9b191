"""Enrichment of games from other sources: weather by place and day, own-side rows, a second source's lines and games."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strideline.functions import rules
from strideline.operators import joins
from strideline.sources.scratch import written


def weather(games: DataFrame, stadiums: DataFrame, archive: DataFrame, neutral: dict[str, float], digits: int = 3) -> DataFrame:
    """games: game_id, team, day. The archive's values at the stadium's rounded place on the day; neutral in a dome or without a match."""
    place = lambda df: df.withColumns({"lat": F.round("lat", digits), "lon": F.round("lon", digits)})
    at = games.join(place(stadiums), "team", "left").join(place(archive).dropDuplicates(["lat", "lon", "day"]), ["lat", "lon", "day"], "left")
    dome = F.coalesce("is_dome", F.lit(False))
    return at.withColumns({"is_dome": dome, **{c: F.when(dome, v).otherwise(F.coalesce(c, F.lit(v))) for c, v in neutral.items()}})


def starter_quality(games: DataFrame, starts: DataFrame, neutral: float, least: int = 1, last: int = 8) -> DataFrame:
    """games with home_quality and away_quality: earned runs per start over each starter's ``last`` starts before the game.

    games: game_id. starts: game_id, day, is_home, pitcher, earned, one row for each known start; repeated ones count once
    (of several starters of a side the first by name). No start before, or no starter: ``neutral``. Games keep their number.
    """
    once = joins.first_of(starts, ["game_id", "is_home"], "pitcher", "earned")
    before = Window.partitionBy("pitcher").orderBy("day", "game_id").rowsBetween(-last, -1)
    mean = F.when(F.count("earned").over(before) >= least, F.avg("earned").over(before))
    rolled = once.select("game_id", "is_home", mean.alias("quality"))
    sides = rolled.groupBy("game_id").agg(*[F.max(F.when(F.col("is_home") == flag, F.col("quality"))).alias(f"{side}_quality") for side, flag in (("home", True), ("away", False))])
    return games.join(sides, "game_id", "left").withColumns({f"{side}_quality": F.coalesce(f"{side}_quality", F.lit(neutral)) for side in ("home", "away")})


def own_side(rows: DataFrame, both: DataFrame, keys: list[str], side: str) -> DataFrame:
    """Rows joined with values of their own side; the other side's rows fall away in the join key."""
    return rows.join(both, [*keys, side])


def second_source(games: DataFrame, extra: DataFrame) -> DataFrame:
    """Lines of ``extra`` fill missing ones of the games it matches, its other games are appended, results are computed anew.

    A match has the same teams, and the extra row's day is that of the game or the day before.
    """
    candidates = extra.select("extra_id", "home", "away", F.expr("date_add(day, 1)").alias("until"))
    asked = games.select("game_id", "home", "away", "game_date")
    # The match counts days back from the game: on a mirrored calendar that is the match ahead,
    # and its last day is the first of the games.
    mirrored = lambda c: F.date_sub(F.lit("2100-01-01").cast("date"), F.unix_date(c))
    left = asked.withColumn("_at", mirrored("game_date"))
    right = candidates.withColumn("_back", mirrored(F.date_sub("until", 1))).drop("until")
    matched = written(joins.band_match(left, right, ["home", "away"], "game_id", "_at", "extra_id", "_back", latest_first=True).select("game_id", "extra_id"))
    lines = matched.join(extra.select("extra_id", "line"), "extra_id").select("game_id", "line")
    filled = games.join(lines, "game_id", "left").withColumn("was_filled", F.col("home_line").isNull() & F.col("line").isNotNull()).withColumn("home_line", F.coalesce("home_line", "line")).drop("line")
    new = extra.join(matched.select("extra_id"), "extra_id", "left_anti").select(F.col("extra_id").alias("game_id"), "home", "away", F.col("day").alias("game_date"), "margin", "total", F.col("line").alias("home_line"), F.lit(False).alias("was_filled"))
    every = filled.unionByName(new, allowMissingColumns=True)
    return every.withColumn("covers", rules.cover_result(F.col("margin"), F.col("home_line"))).withColumn("over", rules.over_result(F.col("total"), F.col("total_line")))


def existing(df: DataFrame, *wanted: str) -> DataFrame:
    """Those of the wanted columns that there are."""
    return df.select(*[c for c in wanted if c in df.columns])

