"""As-of form: trailing and expanding windows, streaks and calendar features, none of which sees the game itself."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strideline.functions import rules
from strideline.operators import order
from strideline.operators.log import play_order, team_window, window

PRIOR = (Window.unboundedPreceding, -1)


def trailing(log: DataFrame, values: dict[str, str], games: int = 10, inclusive: bool = False) -> DataFrame:
    """Trailing means of columns, named by ``values``; frames share one sort. Inclusive frames hold the current row."""
    frame = window(log).rowsBetween(1 - games, 0) if inclusive else window(log).rowsBetween(-games, -1)
    return log.select("*", *[F.avg(c).over(frame).alias(name) for c, name in values.items()])


def trailing_ratio(log: DataFrame, part: str, whole: str, name: str, games: int = 10) -> DataFrame:
    """Ratio of trailing sums; null where the denominator is 0."""
    frame = team_window().rowsBetween(-games, -1)
    return log.withColumn(name, rules.share(F.sum(part).over(frame), F.sum(whole).over(frame).cast("double")))


def trend(log: DataFrame, value: str, short: int = 3, long: int = 10) -> DataFrame:
    w = team_window()
    return log.withColumn("trend", F.avg(value).over(w.rowsBetween(-short, -1)) - F.avg(value).over(w.rowsBetween(-long, -1)))


def latest(log: DataFrame, values: dict[str, str], games: int = 10) -> DataFrame:
    """Current form of each team: trailing means that hold its last game."""
    last = Window.partitionBy("team").orderBy(F.desc("game_date"), F.asc("is_home"), F.desc("game_id"))
    return trailing(log, values, games, inclusive=True).withColumn("_r", F.row_number().over(last)).where("_r = 1").drop("_r")


def season_to_date(log: DataFrame, value: str, name: str) -> DataFrame:
    return log.withColumn(name, F.avg(value).over(team_window("season").rowsBetween(*PRIOR)))


def versus(log: DataFrame, value: str, name: str) -> DataFrame:
    """Expanding mean and count against the same opponent, prior games only."""
    frame = team_window("opponent").rowsBetween(*PRIOR)
    return log.withColumn(name, F.avg(value).over(frame)).withColumn(f"{name}_n", F.count(value).over(frame))


def rest_days(log: DataFrame, missing: int = 7) -> DataFrame:
    return log.withColumn("rest", F.coalesce(F.date_diff("game_date", F.lag("game_date").over(window(log))), F.lit(missing)))


def streak(log: DataFrame, inclusive: bool = False) -> DataFrame:
    """Signed run of wins (+) or losses (-) by gaps and islands; before the game, or with it."""
    if "_block" in log.columns:
        return _streak_in_blocks(log, inclusive)
    w = team_window()
    turned = F.when(F.col("won") == F.lag("won").over(w), 0).otherwise(1)
    island = log.withColumn("_turn", turned).withColumn("_island", F.sum("_turn").over(w))
    run = F.row_number().over(Window.partitionBy("team", "_island").orderBy(*play_order()))
    now = island.withColumn("streak", F.when(F.col("won") == 1, run).otherwise(-run))
    if not inclusive:
        now = now.withColumn("streak", F.coalesce(F.lag("streak").over(w), F.lit(0)))
    return now.drop("_turn", "_island")


def _streak_in_blocks(log: DataFrame, inclusive: bool) -> DataFrame:
    """A run's length is the distance of ranks from the game it began with, which may stand in an earlier block: of each
    block and team only the last such game, one row, stands in a window over blocks."""
    w = window(log)
    began = F.when(~F.coalesce(F.col("won") == F.lag("won").over(w), F.lit(False)) & ~F.col("_before"), F.col("_rank"))
    ends = log.select("team", "_block", "_rank", "_before", "won").withColumn("_began", began).groupBy("team", "_block").agg(F.max("_began").alias("_last"))
    earlier = Window.partitionBy("team").orderBy("_block").rowsBetween(*PRIOR)
    carried = ends.select(F.col("team").alias("_team"), F.col("_block").alias("_at"), F.max("_last").over(earlier).alias("_carried"))
    rows = log.withColumn("_began", began).join(F.broadcast(carried), F.col("team").eqNullSafe(F.col("_team")) & (F.col("_block") == F.col("_at")), "left")
    last = 0 if inclusive else -1
    since = F.coalesce(F.max("_began").over(w.rowsBetween(Window.unboundedPreceding, last)), F.col("_carried"))
    run = (F.col("_rank") + last - since + 1).cast("int")
    won, there = (F.col("won"), F.lit(True)) if inclusive else (F.lag("won").over(w), F.lag("_rank").over(w).isNotNull())
    signed = F.when(there, F.when(won == 1, run).otherwise(-run)).otherwise(0)
    return rows.withColumn("streak", signed).drop("_began", "_team", "_at", "_carried")


def calendar_sum(rows: DataFrame, keys: list[str], day: str, value: str, days: int, name: str) -> DataFrame:
    """Sum over the ``days`` calendar days before each row's day: a range frame, so missing days need no rows."""
    number = F.date_diff(F.col(day), F.lit("1970-01-01").cast("date"))
    frame = Window.partitionBy(*keys).orderBy(number).rangeBetween(-days, -1)
    return rows.withColumn(name, F.coalesce(F.sum(value).over(frame), F.lit(0)))


def densified(rows: DataFrame, keys: list[str], day: str, value: str) -> DataFrame:
    """One row for each key and calendar day between its first and last, missing days as 0.

    Each row is followed by the days up to the next one of its key, so the given rows are shuffled and the days are not.
    """
    following = F.lead(day).over(Window.partitionBy(*keys).orderBy(day))
    spans = rows.where(F.col(day).isNotNull()).withColumn("_last", F.greatest(F.col(day), F.date_sub(following, 1)))
    every = spans.withColumn("_day", F.explode(F.sequence(F.col(day), F.coalesce("_last", day))))
    known = reduce(lambda a, k: a & F.col(k).isNotNull(), keys, F.col("_day") == F.col(day))  # null keys match nothing
    held = {c: F.when(known, F.col(c)) for c in rows.columns if c not in (*keys, day)}
    held[value] = F.coalesce(held[value], F.lit(0))
    return every.select(*keys, F.col("_day").alias(day), *[v.alias(c) for c, v in held.items()])


def reset_point(rows: DataFrame, keys: list[str], order: list[str], counter: str, most: int) -> DataFrame:
    """The latest day on which a counter falls and restarts at ``most`` or less: rows before it are a preseason."""
    w = Window.partitionBy(*keys).orderBy(*order)
    fell = (F.col(counter) < F.lag(counter).over(w)) & (F.col(counter) <= most)
    marked = rows.withColumn("_reset", F.when(fell, F.col(order[0])))
    return marked.withColumn("reset_day", F.max("_reset").over(Window.partitionBy(*keys))).withColumn("is_preseason", F.coalesce(F.col(order[0]) < F.col("reset_day"), F.lit(False))).drop("_reset")


def plateau(rows: DataFrame, keys: list[str], day: str, counter: str) -> DataFrame:
    """First day on which a counter reaches its maximum: rows after it are beyond the regular season."""
    w = Window.partitionBy(*keys)
    top = rows.withColumn("_top", F.max(counter).over(w))
    return top.withColumn("plateau_day", F.min(F.when(F.col(counter) == F.col("_top"), F.col(day))).over(w)).withColumn("is_beyond", F.col(day) > F.col("plateau_day")).drop("_top")


def season_weeks(games: DataFrame) -> DataFrame:
    """games with week (from the season's first day) and week_adjusted: postseason games get the last regular week plus one.

    The bounds of seasons are an aggregate of one row a season, so no task holds a season.
    """
    week = lambda day: (F.floor(F.date_diff(day, "_first") / 7) + 1).cast("int")
    out = games.join(F.broadcast(order.season_bounds(games)), "season").withColumn("week", week("game_date"))
    return out.withColumn("week_adjusted", F.when(F.col("is_playoff"), week("_regular") + 1).otherwise(F.col("week"))).drop("_first", "_regular")


def travel(log: DataFrame, venue: str, rest: int = 1) -> DataFrame:
    """Whether a team plays at another venue than last time after ``rest`` days or less."""
    w = team_window()
    moved = (F.col(venue) != F.lag(venue).over(w)) & (F.date_diff("game_date", F.lag("game_date").over(w)) <= rest)
    return log.withColumn("short_rest_travel", F.coalesce(moved, F.lit(False)))
