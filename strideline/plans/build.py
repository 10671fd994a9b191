"""The build plan: games to features, predictions, bets and summaries."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strideline.functions import rules
from strideline.operators import betting, form, log, models, ratings
from strideline.operators.boosting import Ensemble, Spec
from strideline.plans.leagues import REGISTRY
from strideline.sources.scratch import written

FORM = {"pf": "pf10", "pa": "pa10", "won": "won10", "ats": "ats10"}
#: Games of a trailing mean.
GAMES = 10
#: Neutral values for a team without history.
NEUTRAL = {"won10": 0.5, "ats10": 0.5}
FEATURES = [f"{s}_{c}" for s in ("home", "away") for c in ("pf10", "pa10", "won10", "ats10", "streak", "rest")]


def team_features(games: DataFrame, missing_rest: int = 7) -> DataFrame:
    """The team log with form, streak and rest: all frames share one shuffle and sort, in blocks that cut long histories."""
    rows = log.in_blocks(log.team_log(games).drop("season", "over", "opponent", "covered"), GAMES)
    return log.out_of_blocks(form.streak(form.rest_days(form.trailing(rows, FORM, GAMES), missing_rest)))


def features(games: DataFrame, missing_rest: int = 7) -> DataFrame:
    """One row per game with both teams' prior form."""
    values = [*FORM.values(), "streak", "rest"]
    return games.join(log.wide(team_features(games, missing_rest), values), "game_id")


def filled(frame: DataFrame) -> DataFrame:
    """Neutral values where a team has no history; points by the average of the column."""
    points = [f"{s}_{c}" for s in ("home", "away") for c in ("pf10", "pa10")]
    means = F.broadcast(frame.agg(*[F.avg(c).alias(f"_{c}") for c in points]))
    out = frame.crossJoin(means).withColumns({c: F.coalesce(c, f"_{c}") for c in points}).drop(*[f"_{c}" for c in points])
    return out.na.fill({f"{s}_{c}": v for s in ("home", "away") for c, v in NEUTRAL.items()})


def derived(frame: DataFrame, pythagorean: float) -> DataFrame:
    """What follows from both teams' form, rest and ratings: differences, naive scores, win shares, second nights in a row."""
    naive_total = (F.col("home_pf10") + F.col("away_pa10") + F.col("away_pf10") + F.col("home_pa10")) / 2
    naive_margin = (F.col("home_pf10") - F.col("home_pa10") - F.col("away_pf10") + F.col("away_pa10")) / 2
    shares = {f"{s}_pyth": F.coalesce(rules.pythagorean(F.col(f"{s}_pf10"), F.col(f"{s}_pa10"), pythagorean), F.lit(0.5)) for s in ("home", "away")}
    nights = {f"{s}_b2b": (F.col(f"{s}_rest") <= 1).cast("double") for s in ("home", "away")}
    flags = {f"{c}_flag": F.coalesce(F.col(c), F.lit(False)).cast("double") for c in ("is_playoff", "is_neutral")}
    out = frame.withColumns({"rest_diff": F.col("home_rest") - F.col("away_rest"), "naive_total": naive_total, "naive_margin": naive_margin, **shares, **nights, **flags})
    return out.withColumn("pyth_diff", F.col("home_pyth") - F.col("away_pyth"))


def rated_games(games: DataFrame, league: str) -> DataFrame:
    """The league's ratings before and after each game, written once: a history passes one task in order."""
    return written(ratings.history(games.withColumn("league", F.lit(league))))


def model_frame(games: DataFrame, league: str, rated: DataFrame | None = None) -> DataFrame:
    """A row of each played game with all that the league's models may use, as of before the game. rated: of ``rated_games``, if made."""
    spec = REGISTRY[league]
    games = reduce(lambda frame, step: frame.transform(step), spec.attach, games)
    rated = ratings.history(games.withColumn("league", F.lit(league))) if rated is None else rated
    apart = rated.select("game_id", (F.col("home_pre") - F.col("away_pre")).alias("rating_diff"))
    frame = derived(filled(written(features(games, spec.missing_rest))), spec.pythagorean).join(apart, "game_id")
    return written(frame.transform(spec.extra) if spec.extra else frame)


def evaluated(frame: DataFrame, league: str, chosen: Sequence[str] | None = None, trees: Spec | None = None) -> dict[str, DataFrame]:
    """Out-of-sample predictions by season, the deviations of just these predictions and of ratings, bets and summaries.

    frame: of ``model_frame``. The deviations are those of the predictors that opportunities use: Elo before the game,
    boosted trees that never saw the season, and the naive total.
    """
    return compared(frame, league, [list(chosen or REGISTRY[league].features)], trees)[0]


def compared(frame: DataFrame, league: str, sets: Sequence[Sequence[str]], trees: Spec | None = None) -> list[dict[str, DataFrame]]:
    """``evaluated`` with each of several sets of features, fitted together."""
    return [_assessed(written(oos), league) for oos in models.walk_forwards(frame, sets, spec=trees)]


def _assessed(oos: DataFrame, league: str) -> dict[str, DataFrame]:
    spec = REGISTRY[league]
    stds = written(betting.residual_stds(oos, spec.rating.points))
    bets = betting.backtest(oos.select(*betting.NEEDED), stds, spec.price, strength=spec.rating.points)
    return {"predictions": oos, "residuals": stds, "bets": bets, "summary": betting.summaries(bets)}


def build(games: DataFrame, league: str, trees: Spec | None = None) -> dict[str, DataFrame]:
    """Everything that a league's build yields: features, predictions, deviations, bets, summaries, ratings, form."""
    rated = None if REGISTRY[league].attach else rated_games(games, league)  # enriched games are rated apart from those as given
    frame = model_frame(games, league, rated)
    return {"features": frame} | evaluated(frame, league, trees=trees) | as_of_now(games, league, rated)


def as_of_now(games: DataFrame, league: str, rated: DataFrame | None = None) -> dict[str, DataFrame]:
    """Ratings and form with every game so far, from which games to come are scored. rated: of ``rated_games``, if made."""
    rated = ratings.history(games.withColumn("league", F.lit(league))) if rated is None else rated
    rows = log.in_blocks(log.team_log(games), GAMES)
    now = form.streak(form.trailing(rows, FORM, GAMES, inclusive=True), inclusive=True).where(~F.col("_before"))
    last = now.groupBy("team").agg(F.max_by(F.struct(*[c for c in now.columns if not c.startswith("_") and c != "team"]), "_rank").alias("_x"))
    return {
        "ratings": rated,
        "final_ratings": ratings.final(rated),
        "current_form": last.select("team", "_x.*").withColumnRenamed("game_date", "last_day"),
    }


def upcoming(games: DataFrame, form_now: DataFrame, ratings_now: DataFrame, league: str = "nfl") -> DataFrame:
    """Feature rows of games to come (home, away, game_date): ratings and current form; unknown teams get neutral values."""
    spec = REGISTRY[league]
    form_now, ratings_now = written(form_now), written(ratings_now)  # a row for each team, made once for both sides
    out = games
    for side in ("home", "away"):
        team = form_now.select(F.col("team").alias(side), *[F.col(c).alias(f"{side}_{c}") for c in (*FORM.values(), "streak")], F.col("last_day").alias(f"_{side}_day"))
        rating = ratings_now.select(F.col("team").alias(side), F.col("rating").alias(f"{side}_rating"))
        out = out.join(team, side, "left").join(rating, side, "left")
        rest = F.date_diff("game_date", f"_{side}_day")
        out = out.withColumns({f"{side}_rating": F.coalesce(f"{side}_rating", F.lit(spec.rating.start)), f"{side}_rest": F.coalesce(rest, F.lit(spec.missing_rest)), f"{side}_streak": F.coalesce(f"{side}_streak", F.lit(0))}).drop(f"_{side}_day")
    out = out.withColumns({c: F.lit(False) for c in ("is_playoff", "is_neutral") if c not in out.columns})
    return derived(filled(out), spec.pythagorean).withColumn("rating_diff", F.col("home_rating") - F.col("away_rating"))


def matchups(games: DataFrame, made: dict[str, DataFrame], final: Ensemble, league: str) -> DataFrame:
    """Opportunities of games to come at quoted prices and lines: their features as of now, the final models, and the
    deviations of the walk-forward sample (``made``: of ``build``). A feature that a game to come lacks is missing to the trees."""
    spec = REGISTRY[league]
    rows = upcoming(games, made["current_form"], made["final_ratings"], league)
    rows = rows.transform(spec.extra) if spec.extra else rows
    rows = rows.withColumns({f: F.lit(None).cast("double") for f in final.features if f not in rows.columns})
    scored = final.transform(rows)
    unknown = {c: F.lit(None).cast("double") for c in betting.KEPT if c not in scored.columns}
    found = betting.opportunities(scored.withColumns(unknown), made["residuals"], strength=spec.rating.points)
    return found.transform(spec.display) if spec.display else found
