"""Between the one-row-per-game frame and the two-rows-per-game team log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strideline.operators import order

def play_order() -> list[str | Column]:
    """The order of a team's games: on the same day home rows first, then by game."""
    return ["game_date", F.desc("is_home"), "game_id"]


def team_log(games: DataFrame) -> DataFrame:
    """Two rows per game in one pass over the games: results turn sign for the away team, and a tie is its win."""
    home = F.struct(F.col("home").alias("team"), F.col("away").alias("opponent"), F.lit(True).alias("is_home"), F.col("home_score").alias("pf"), F.col("away_score").alias("pa"), F.col("covers").alias("covered"), F.col("home_win").alias("won"))
    away = F.struct(F.col("away").alias("team"), F.col("home").alias("opponent"), F.lit(False).alias("is_home"), F.col("away_score").alias("pf"), F.col("home_score").alias("pa"), (-F.col("covers")).alias("covered"), (1 - F.col("home_win")).alias("won"))
    return games.select("game_id", "game_date", "season", "over", F.explode(F.array(home, away)).alias("x")).select("game_id", "game_date", "season", "over", "x.*").withColumn("ats", (F.col("covered") + 1) / 2)


def team_window(*more: str) -> Window:
    return Window.partitionBy("team", *more).orderBy(*play_order())


#: Rows of a log that stand in a block, and in a task.
BLOCK, TASK = 5_000, 50_000


def in_blocks(log: DataFrame, reach: int) -> DataFrame:
    """The log in blocks of its total order (_rank: by team, then as played), each with the ``reach`` rows before it (_before).

    A block may cut a team's games anywhere; trailing frames of ``reach`` rows are whole in it, so no task holds a team.
    """
    ranks = order.ranked(log.withColumn("_away", ~F.col("is_home")), "_rank", "team", "game_date", "_away", "game_id").drop("_away")
    parts = -(-ranks.count() // TASK)
    at, near = F.expr(f"_rank div {BLOCK}"), F.col("_rank") % BLOCK >= BLOCK - reach
    rows = ranks.withColumn("_at", at).withColumn("_block", F.explode(F.when(near, F.array("_at", F.col("_at") + 1)).otherwise(F.array("_at"))))
    return rows.withColumn("_before", F.col("_block") != F.col("_at")).drop("_at").repartition(max(1, parts), "_block")


def out_of_blocks(rows: DataFrame) -> DataFrame:
    return rows.where(~F.col("_before")).drop("_before", "_block", "_rank")


def window(log: DataFrame) -> Window:
    """A team's games in order: all of them, or those of a block."""
    return Window.partitionBy("_block", "team").orderBy("_rank") if "_block" in log.columns else team_window()


def two_rows_to_one(rows: DataFrame, key: str, side: str, values: list[str]) -> DataFrame:
    """Pivot home and away rows to one row per key in one shuffle; keys without exactly one row of each side drop out."""
    picked = [F.max(F.when(F.col(side) == flag, F.col(v))).alias(f"{name}_{v}") for flag, name in ((True, "home"), (False, "away")) for v in values]
    sides = F.sum(F.col(side).cast("int"))
    return rows.groupBy(key).agg(*picked, F.count(F.lit(1)).alias("_n"), sides.alias("_h")).where("_n = 2 and _h = 1").drop("_n", "_h")


def wide(log: DataFrame, values: list[str]) -> DataFrame:
    """Re-attach team values to the game with home_ and away_ prefixes: conditional aggregates, one shuffle instead of two joins."""
    return log.groupBy("game_id").agg(*[F.max(F.when(F.col("is_home") == flag, F.col(v))).alias(f"{name}_{v}") for flag, name in ((True, "home"), (False, "away")) for v in values])


def ordinal_ids(rows: DataFrame, league: str, *by: str) -> DataFrame:
    """``<league>_<ordinal>`` ids in the total order of season and ``by``."""
    return order.ranked(rows, "ordinal", "season", *by).withColumn("ordinal_id", F.concat(F.lit(f"{league}_"), F.col("ordinal").cast("string")))
