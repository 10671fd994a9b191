"""Markets: opportunities, settlement, back-test, summaries and bankroll curves."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strideline.functions import odds
from strideline.sources.tables import FLAT

STRENGTH = 25.0


def predicted(features: DataFrame) -> DataFrame:
    """A deterministic predictor from trailing form: rating difference, margin, total and a naive total."""
    gap = (F.col("home_pf10") - F.col("home_pa10")) - (F.col("away_pf10") - F.col("away_pa10"))
    naive = (F.col("home_pf10") + F.col("away_pa10") + F.col("away_pf10") + F.col("home_pa10")) / 2
    return features.select("*", (gap * STRENGTH / 2).alias("rating_diff"), (0.4 * gap + 1.5).alias("predicted_margin"), (0.9 * naive + 4.0).alias("predicted_total"), naive.alias("naive_total")).where("rating_diff is not null")


def residual_stds(frame: DataFrame, strength: float = STRENGTH) -> DataFrame:
    """One row of four residual deviations."""
    return frame.agg(
        F.stddev_samp(F.col("margin") - F.col("rating_diff") / strength).alias("elo_margin_std"),
        F.stddev_samp(F.col("margin") - F.col("predicted_margin")).alias("ml_margin_std"),
        F.stddev_samp(F.col("total") - F.col("predicted_total")).alias("ml_total_std"),
        F.stddev_samp(F.col("total") - F.col("naive_total")).alias("naive_total_std"),
    )


KEPT = ["game_id", "game_date", "season", "home", "away", "margin", "total", "home_win", "home_close", "away_close"]
#: Columns of a frame that opportunities and back-tests use.
NEEDED = [*KEPT, "home_open", "away_open", "home_line", "total_line", "rating_diff", "predicted_margin", "predicted_total", "naive_total"]


def opportunities(frame: DataFrame, stds: DataFrame, price: str = "close", strength: float = STRENGTH) -> DataFrame:
    """Zero, two, four or six rows per game: each side of each market that has prices, with its edge, stake and confidence.

    Probabilities, then what follows from them, are columns of projections of their own: each is computed once, and no
    expression holds another's polynomial. ``stds`` is one row, so it is broadcast.
    """
    elo, zero, flat = F.col("rating_diff") / strength, F.lit(0.0), F.lit(FLAT)
    chances = {
        "moneyline": (odds.cover_prob(elo, "elo_margin_std", zero), odds.cover_prob("predicted_margin", "ml_margin_std", zero)),
        "spread": (odds.cover_prob(elo, "elo_margin_std", "home_line"), odds.cover_prob("predicted_margin", "ml_margin_std", "home_line")),
        "total": (odds.over_prob("predicted_total", "ml_total_std", "total_line"), odds.over_prob("naive_total", "naive_total_std", "total_line")),
    }
    prices = {"moneyline": (F.col(f"home_{price}"), F.col(f"away_{price}")), "spread": (flat, flat), "total": (flat, flat)}
    sides = {"moneyline": ("home", "away"), "spread": ("home", "away"), "total": ("over", "under")}
    lines = {"moneyline": (F.lit(None).cast("double"),) * 2, "spread": (F.col("home_line"), -F.col("home_line")), "total": (F.col("total_line"),) * 2}
    g = frame.crossJoin(F.broadcast(stds)).select(*frame.columns, *[p.alias(f"_{m}{i}") for m, both in chances.items() for i, p in enumerate(both)])
    every = []
    for m in chances:
        fair = odds.devig(*prices[m])
        there = fair[0].isNotNull() if m == "moneyline" else fair[0].isNotNull() & lines[m][0].isNotNull()
        one, two = F.col(f"_{m}0"), F.col(f"_{m}1")
        for i in (0, 1):
            p = odds.blend(one, two) if i == 0 else 1 - odds.blend(one, two)
            every.append(F.when(there, F.struct(F.lit(m).alias("market"), F.lit(sides[m][i]).alias("side"), lines[m][i].alias("line"), p.alias("model_prob"), fair[i].alias("fair_prob"), prices[m][i].alias("price"), odds.confidence_tier(one, two).alias("confidence"))))
    rows = g.select(*KEPT, F.explode(F.array_compact(F.array(*every))).alias("x")).select(*KEPT, "x.*")
    return rows.select(*KEPT, "market", "side", "line", "model_prob", "fair_prob", "price", odds.edge_over_fair("model_prob", "fair_prob").alias("edge_pct"), odds.expected_value(F.col("model_prob"), F.col("price")).alias("ev"), odds.kelly(F.col("model_prob"), F.col("price")).alias("kelly"), "confidence")


def settled(bets: DataFrame) -> DataFrame:
    """result: 1 won, 0 push, -1 lost. A moneyline never pushes: a tie is the away side's."""
    side, line, margin, total = (F.col(c) for c in ("side", "line", "margin", "total"))
    won = F.when(side == "home", F.col("home_win") == 1).otherwise(F.col("home_win") != 1)
    spread = F.when(side == "home", margin + line).otherwise(line - margin)
    over = F.when(side == "over", total - line).otherwise(line - total)
    result = F.when(F.col("market") == "moneyline", F.when(won, 1).otherwise(-1)).when(F.col("market") == "spread", F.signum(spread)).otherwise(F.signum(over))
    return bets.withColumn("result", result.cast("int"))


def backtest(frame: DataFrame, stds: DataFrame, price: str = "open", min_edge: float = 3.0, confidence: tuple[str, ...] = ("Medium", "High"), strength: float = STRENGTH) -> DataFrame:
    """Bets with enough edge and confidence, settled at flat stakes, with their closing line value."""
    picked = settled(opportunities(frame, stds, price, strength).where((F.col("edge_pct") >= min_edge) & F.col("confidence").isin(*confidence)))
    close = F.when(F.col("market") != "moneyline", F.lit(FLAT)).when(F.col("side") == "home", F.col("home_close")).otherwise(F.col("away_close"))
    profit = F.when(F.col("result") == 0, 0.0).when(F.col("result") == 1, F.col("price") - 1).otherwise(-1.0)
    return picked.select("*", profit.alias("profit"), odds.clv_pct(F.col("price"), close).alias("clv"), odds.edge_bucket("edge_pct").alias("edge_bucket"))


def summary_columns() -> list[Column]:
    """Bets, hit rate without pushes, return, its standard error, mean edge and CLV, and the share of all bets with positive CLV."""
    n, result, profit, clv = F.count(F.lit(1)), F.col("result"), F.col("profit"), F.col("clv")
    return [
        n.alias("bets"),
        (F.count_if(result == 1) / F.nullif(F.count_if(result != 0), F.lit(0))).alias("hit_rate"),
        (F.sum(profit) / n * 100).alias("roi_pct"),
        F.when(n >= 2, F.stddev_samp(profit) / F.sqrt(n) * 100).alias("roi_stderr_pct"),
        F.avg("edge_pct").alias("avg_edge_pct"),
        F.avg(clv).alias("avg_clv_pct"),
        F.when(F.count(clv) > 0, F.count_if(clv > 0) / n).alias("pct_positive_clv"),
    ]


def summaries(bets: DataFrame) -> DataFrame:
    """All summary levels in one pass: overall, by market, by market and edge bucket, by market and side, by season."""
    m, b, s, y = (F.col(c) for c in ("market", "edge_bucket", "side", "season"))
    return bets.groupingSets([[], [m], [m, b], [m, s], [y]], m, b, s, y).agg(*summary_columns())


#: Game days in a chunk of a running sum.
DAYS = 30


def running(bets: DataFrame, by: str, **values: Column) -> DataFrame:
    """Running sums of ``values`` in the order of bets, by ``by``: sums within chunks of days plus the sums of earlier chunks.

    The chunks of a season are sorted apart; only their totals, one row each, stand in one window.
    """
    order, chunk = ("game_date", "game_id", "market", "side"), F.floor(F.unix_date("game_date") / DAYS)
    rows = bets.withColumns({f"_{n}": v for n, v in values.items()}).withColumn("_chunk", chunk)
    totals = rows.groupBy(by, "_chunk").agg(*[F.sum(f"_{n}").alias(f"_t_{n}") for n in values])
    earlier = Window.partitionBy(by).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    base = totals.select(by, "_chunk", *[F.coalesce(F.sum(f"_t_{n}").over(earlier), F.lit(0)).alias(f"_b_{n}") for n in values])
    within = Window.partitionBy(by, "_chunk").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    summed = rows.select(*bets.columns, "_chunk", *[F.sum(f"_{n}").over(within).alias(f"_s_{n}") for n in values])
    return summed.join(base, [by, "_chunk"]).select(*[summed[c] for c in bets.columns], *[(F.col(f"_b_{n}") + F.col(f"_s_{n}")).alias(n) for n in values])


def kelly_curve(bets: DataFrame, start: float = 100.0, by: str = "season") -> DataFrame:
    """Bankroll after each bet under compounding stakes, and its logarithm: a running sum of log growth, so no fold is needed.

    The logarithm stays exact where a long run's bankroll is too large or too small for a double.
    """
    stake = F.col("kelly")
    growth = F.when(F.col("result") == 1, 1 + stake * (F.col("price") - 1)).when(F.col("result") == -1, 1 - stake).otherwise(1.0)
    grown = running(bets, by, log_growth=F.ln(growth))
    return grown.withColumn("bankroll", start * F.exp("log_growth")).withColumn("log_bankroll", F.ln(F.lit(start)) + F.col("log_growth")).drop("log_growth")


def flat_curve(bets: DataFrame, by: str = "season") -> DataFrame:
    """Cumulative profit and return at flat stakes."""
    return running(bets, by, profit_to_date=F.col("profit"), bets_to_date=F.lit(1)).withColumn("roi_to_date", F.col("profit_to_date") / F.col("bets_to_date") * 100)


def sweep(opps: DataFrame, edges: tuple[float, ...] = (0.0, 1.0, 2.0, 3.0, 5.0, 8.0)) -> DataFrame:
    """Bets and return for every edge threshold and confidence set: the grid is an array in each row, so opportunities are read once."""
    sets = {"High": ("High",), "Medium+": ("High", "Medium"), "All": ("High", "Medium", "Low")}
    grid = F.array(*[F.when((F.col("edge_pct") >= e) & F.col("confidence").isin(*names), F.struct(F.lit(e).alias("min_edge"), F.lit(label).alias("allowed"))) for e in edges for label, names in sets.items()])
    profit = F.when(F.col("result") == 0, 0.0).when(F.col("result") == 1, F.col("price") - 1).otherwise(-1.0)
    rows = settled(opps).select(profit.alias("profit"), F.explode(F.filter(grid, lambda x: x.isNotNull())).alias("x")).select("profit", "x.*")
    return rows.groupBy("min_edge", "allowed").agg(F.count(F.lit(1)).alias("bets"), (F.sum("profit") / F.count(F.lit(1)) * 100).alias("roi_pct"))
