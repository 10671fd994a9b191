"""Queries over joins, statistics, markets, back-tests and parlays. Doubles are rounded to six digits, as in their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strideline.functions import odds, rules
from strideline.operators import betting, joins, log, parlays, stars, stats
from strideline.plans import serving
from strideline.registry import bets, frame, opps, query, r6, rounded, the_log
from strideline.sources import tables
from strideline.sql import BASE, BETS, LOG, OPPS, PREDICTED, PROFIT, SUMMARY, with_

# ---------------------------------------------------------------- joins


SIDES = "sides as (select event_id, is_home, cast(sum(pts) as bigint) as pts, cast(sum(minutes) as bigint) as minutes, count(*) as players from box group by all)"


@query(with_(BASE, SIDES, "select h.event_id, h.pts as home_pts, h.minutes as home_minutes, a.pts as away_pts, a.minutes as away_minutes from sides h join sides a using (event_id) where h.is_home and not a.is_home"))
def two_row_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = tables.box(spark, sf_dir).groupBy("event_id", "is_home").agg(F.sum("pts").alias("pts"), F.sum("minutes").alias("minutes"))
    return log.two_rows_to_one(rows, "event_id", "is_home", ["pts", "minutes"])


def _market_rows(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    g = tables.games(spark, sf_dir)
    return g.where("home_line is not null and game_id % 3 <> 0").select("game_id", "home_line"), g.where("game_id % 4 <> 0").select("game_id", "home_close"), g.where("total_line is not null and game_id % 5 <> 0").select("game_id", "total_line")


@query(with_(BASE, "select game_id, home_line, round(home_close, 6) as home_close, total_line from (select game_id, home_line from games where home_line is not null and game_id % 3 <> 0) full join (select game_id, home_close from games where game_id % 4 <> 0) using (game_id) full join (select game_id, total_line from games where total_line is not null and game_id % 5 <> 0) using (game_id)"))
def outer_join_markets(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b, c = _market_rows(spark, sf_dir)
    return rounded(a.join(b, "game_id", "full").join(c, "game_id", "full"))


@query(with_(BASE, "q as (select home, game_date, home_score, home_close as price, game_id as quote_id from games where game_id % 2 = 0)", "select game_id, round(case when n > 1 then null else price end, 6) as price, n as matches from (select g.game_id, q.price, count(q.quote_id) over (partition by g.game_id) as n, row_number() over (partition by g.game_id order by q.quote_id) as r from games g left join q on g.home = q.home and g.game_date = q.game_date and g.home_score % 5 = q.home_score % 5) where r = 1"))
def disambiguating_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = tables.games(spark, sf_dir).withColumn("s", F.col("home_score") % 5)
    q = g.where("game_id % 2 = 0").select("home", "game_date", "s", F.col("home_close").alias("price"), F.col("game_id").alias("quote_id"))
    return rounded(joins.unambiguous(g, q, ["home", "game_date", "s"], "game_id", ["price"], ["quote_id"]).select("game_id", "price", "matches"))


PAIRED = "l as (select game_id, home, game_date from games where game_id % 2 = 0), r as (select game_id as right_id, home, game_date as right_date from games where game_id % 2 = 1)"


def _pairs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    g = tables.games(spark, sf_dir)
    return g.where("game_id % 2 = 0").select("game_id", "home", "game_date"), g.where("game_id % 2 = 1").select(F.col("game_id").alias("right_id"), "home", F.col("game_date").alias("right_date"))


@query(with_(BASE, PAIRED, "select game_id, right_id, cast(right_date - game_date as int) as delta from (select *, row_number() over (partition by game_id order by abs(right_date - game_date), right_date, right_id) as k from l join r on l.home = r.home and right_date between game_date - 1 and game_date + 1) where k = 1"))
def asof_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    left, right = _pairs(spark, sf_dir)
    return joins.asof_nearest(left, right, ["home"], "game_id", "game_date", "right_id", "right_date").select("game_id", "right_id", F.date_diff("right_date", "game_date").alias("delta"))


@query(with_(BASE, "r as (select home, game_date as right_date, max(game_id) as right_id from games where game_id % 3 = 0 group by all)", "select g.game_id, r.right_id from games g left join (select g.game_id as id, max(right_date) as d from games g join r on g.home = r.home and right_date < g.game_date group by 1) m on m.id = g.game_id left join r on r.home = g.home and r.right_date = m.d"))
def asof_backward_strict(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = tables.games(spark, sf_dir).select("game_id", "home", "game_date")
    right = g.where("game_id % 3 = 0").groupBy("home", "game_date").agg(F.max("game_id").alias("right_id"))
    return joins.asof_backward(g, right, ["home"], "game_date", ["right_id"]).select("game_id", "right_id")


BAND = """near as (select game_id, right_id, cast(right_date - game_date as int) as delta, dense_rank() over (order by game_date, game_id) as ord from l join r on l.home = r.home and right_date between game_date and game_date + 1),
rounds as (select *, 0 as round from near union all
 select game_id, right_id, delta, ord, round + 1 from (select *, sum(cast(lost as int)) over () as losses from (
  select *, coalesce(ord > min(case when k = 1 then ord end) over (partition by right_id), false) as lost from (select *, row_number() over (partition by game_id order by delta, right_id) as k from rounds)))
 where losses > 0 and not lost)"""


@query(with_("recursive " + BASE, PAIRED, BAND, "select game_id, right_id, delta from (select *, row_number() over (partition by game_id order by delta, right_id) as k from rounds where round = (select max(round) from rounds)) where k = 1"))
def band_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    left, right = _pairs(spark, sf_dir)
    return joins.band_match(left, right, ["home"], "game_id", "game_date", "right_id", "right_date").select("game_id", "right_id", "delta")


@query(with_(BASE, "d as (select n_nationkey as k, 1990 as lo, 1997 as hi, 'old ' || n_name as venue from nation union all select n_nationkey, 1998, 2000, 'new ' || n_name from nation where n_nationkey % 2 = 0)", "select game_id, coalesce(venue, 'unknown') as venue from games left join d on home = k and season between lo and hi"))
def range_dim_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = tables.table(spark, sf_dir, "nation")
    old = n.select(F.col("n_nationkey").alias("k"), F.lit(1990).alias("lo"), F.lit(1997).alias("hi"), F.concat(F.lit("old "), "n_name").alias("venue"))
    new = n.where("n_nationkey % 2 = 0").select(F.col("n_nationkey").alias("k"), F.lit(1998).alias("lo"), F.lit(2000).alias("hi"), F.concat(F.lit("new "), "n_name").alias("venue"))
    g = tables.games(spark, sf_dir).withColumn("k", F.col("home"))
    return joins.valid_range(g, old.unionByName(new), "k", "season", "lo", "hi").select("game_id", F.coalesce("venue", F.lit("unknown")).alias("venue"))


@query(with_(LOG, "s as (select team, season, opponent, cast(sum(pf) as bigint) as pts from log group by all), best as (select * from (select *, row_number() over (partition by team, season order by pts desc, opponent) as k from s) where k = 1)", "select l.game_id, l.team, l.is_home, b.opponent as last_leader, b.pts from log l left join best b on b.team = l.team and b.season = l.season - 1"))
def prior_season_leader(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = the_log(spark, sf_dir)
    best = stats.leaders(rows.groupBy("team", "season", "opponent").agg(F.sum("pf").alias("pts")), ["team", "season"], "pts", "opponent")
    last = best.select("team", (F.col("season") + 1).alias("season"), F.col("opponent").alias("last_leader"), "pts")
    return rows.join(last, ["team", "season"], "left").select("game_id", "team", "is_home", "last_leader", "pts")


@query(with_(BASE, "w as (select home, game_date, 'label ' || cast(max(game_id) as varchar) as label from games where game_id % 7 = 0 group by all)", "select g.game_id, coalesce(a.label, b.label, 'none') as label from games g left join w a on a.home = g.home and a.game_date = g.game_date left join w b on b.home = g.home and b.game_date = g.game_date - 1"))
def fallback_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = tables.games(spark, sf_dir).select("game_id", "home", "game_date")
    w = g.where("game_id % 7 = 0").groupBy("home", "game_date").agg(F.concat(F.lit("label "), F.max("game_id").cast("string")).alias("label"))
    return joins.with_fallback(g, w, ["home"], "game_date", "label", "none").select("game_id", "label")


@query(with_(BASE, "select game_id, game_id in (select event_id from box) as has_box from games"))
def anti_semi(spark: SparkSession, sf_dir: str) -> DataFrame:
    g, b = tables.games(spark, sf_dir).select("game_id"), tables.box(spark, sf_dir).select(F.col("event_id").alias("game_id"))
    return joins.marked(g, b, "game_id", "has_box")


@query(with_(BASE, "select count(*) filter (g is not null and b is not null) as shared, count(*) filter (b is null) as left_only, count(*) filter (g is null) as right_only, round(avg(cast(g is not null and b is not null as double)), 6) as shared_rate from (select game_id as g from games) full join (select distinct event_id as b from box) on g = b"))
def key_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(stats.key_audit(tables.games(spark, sf_dir), tables.box(spark, sf_dir).withColumnRenamed("event_id", "game_id"), "game_id"))


@query(with_(BASE, "select event_id, cast(coalesce(len(a), 0) as int) as home_members, cast(coalesce(len(b), 0) as int) as away_members, cast(coalesce(len(list_intersect(a, b)), 0) as int) as shared from (select event_id, list(distinct player_id) filter (is_home) as a, list(distinct player_id) filter (not is_home) as b from box group by 1)"))
def roster_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.roster_overlap(tables.box(spark, sf_dir), "event_id", "player_id")


# ---------------------------------------------------------------- grouped statistics


COMP = "string_split(comp_att, '/')"


@query(with_(BASE, f"select event_id, is_home, cast(sum(c) as double) as comp, cast(sum(a) as double) as att, round(sum(c) / nullif(sum(a), 0), 6) as comp_pct, round(avg(c / nullif(a, 0)), 6) as mean_pct from (select event_id, is_home, try_cast({COMP}[1] as double) as c, try_cast({COMP}[2] as double) as a from box) group by all"))
def split_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    made, tried = rules.made_of(F.col("comp_att"), "/")
    rows = tables.box(spark, sf_dir).withColumns({"c": made, "a": tried})
    return rounded(rows.groupBy("event_id", "is_home").agg(F.sum("c").alias("comp"), F.sum("a").alias("att"), rules.share(F.sum("c"), F.sum("a")).alias("comp_pct"), F.avg(rules.share(F.col("c"), F.col("a"))).alias("mean_pct")))


@query(with_(BASE, SIDES, "select event_id, is_home, pts, minutes, players, round(pts / nullif(cast(minutes as double), 0), 6) as rate, round((pts + 0.5 * players) / nullif(cast(minutes as double), 0), 6) as efg, round(players / nullif(cast(players + pts as double), 0), 6) as tov from sides"))
def four_factors(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = tables.box(spark, sf_dir).groupBy("event_id", "is_home").agg(F.sum("pts").alias("pts"), F.sum("minutes").alias("minutes"), F.count(F.lit(1)).alias("players"))
    minutes = F.col("minutes").cast("double")
    return rounded(s.select("*", rules.share(F.col("pts"), minutes).alias("rate"), rules.share(F.col("pts") + 0.5 * F.col("players"), minutes).alias("efg"), rules.share(F.col("players"), (F.col("players") + F.col("pts")).cast("double")).alias("tov")))


@query(with_(BASE, "select event_id, player_id, minutes from (select *, row_number() over (partition by event_id order by minutes desc, player_id) as k from (select event_id, player_id, cast(sum(minutes) as bigint) as minutes from box group by all)) where k = 1"))
def minutes_leader(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = tables.box(spark, sf_dir).groupBy("event_id", "player_id").agg(F.sum("minutes").alias("minutes"))
    return stats.leaders(rows, ["event_id"], "minutes", "player_id")


@query(with_(BASE, "select player_id, round(avg(case when is_home then pts end), 6) as home_mean, round(avg(case when not is_home then pts end), 6) as away_mean, count(case when is_home then 1 end) as home_n, count(case when not is_home then 1 end) as away_n from box group by 1"))
def venue_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = tables.box(spark, sf_dir).groupBy("player_id").pivot("is_home", [True, False]).agg(F.avg("pts").alias("mean"), F.count(F.lit(1)).alias("n"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long")
    return rounded(p.select("player_id", F.col("true_mean").alias("home_mean"), F.col("false_mean").alias("away_mean"), zero("true_n").alias("home_n"), zero("false_n").alias("away_n")))


@query(with_(PREDICTED, "select round(elo_margin_std, 6) as elo_margin_std, round(ml_margin_std, 6) as ml_margin_std, round(ml_total_std, 6) as ml_total_std, round(naive_total_std, 6) as naive_total_std from stds"))
def residual_stds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(betting.residual_stds(frame(spark, sf_dir)))


@query(with_(PREDICTED, "select season, count(*) as n, round(corr(margin, predicted_margin), 6) as margin_corr, round(avg(abs(margin - predicted_margin)), 6) as margin_mae, round(corr(total, predicted_total), 6) as total_corr, round(avg(abs(total - predicted_total)), 6) as total_mae from oos group by 1"))
def fit_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(stats.fit(frame(spark, sf_dir), {"margin": ("margin", "predicted_margin"), "total": ("total", "predicted_total")}, "season"))


@query(with_(PREDICTED, "select season, round(regr_slope(margin, rating_diff), 6) as slope, round(regr_intercept(margin, rating_diff), 6) as intercept, count(*) as n from oos group by 1"))
def regression(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(stats.regression(frame(spark, sf_dir), "margin", "rating_diff", "season"))


@query(with_(PREDICTED, "e as (select list_distinct(quantile_cont(p, [0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0])) as edges from (select 1 / (1 + exp(-predicted_margin / 10)) as p from oos)), s as (select list_sort(edges) as edges from e)", "select cast(len(list_filter(edges[2:len(edges) - 1], lambda x : x < p)) as int) as bin, count(*) as n, round(avg(p), 6) as mean_pred, round(avg(cast(home_win as double)), 6) as actual_rate, round(avg(abs(p - home_win)), 6) as mean_abs_err from (select 1 / (1 + exp(-predicted_margin / 10)) as p, home_win from oos), s group by 1"))
def calibration_deciles(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = frame(spark, sf_dir).withColumn("p", odds.logistic(F.col("predicted_margin") / 10))
    return rounded(stats.calibration(f, "p", "home_win"))


@query(with_(BASE, "select season, round(avg(cast(home_line is not null as double)), 6) as home_line_rate, round(avg(cast(total_line is not null as double)), 6) as total_line_rate from games group by 1"))
def coverage_by_season(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(stats.coverage(tables.games(spark, sf_dir), ["home_line", "total_line"], "season"))


@query(with_(BASE, "select h.n_name as team, count(*) as games, min(game_date) as first_day, max(game_date) as last_day, count(distinct season) as seasons from (select home as t, game_date, season from games union all select away, game_date, season from games) join nation h on h.n_nationkey = t group by 1"))
def games_played(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = the_log(spark, sf_dir).join(tables.table(spark, sf_dir, "nation"), F.col("team") == F.col("n_nationkey"))
    return rows.groupBy(F.col("n_name").alias("team")).agg(F.count(F.lit(1)).alias("games"), F.min("game_date").alias("first_day"), F.max("game_date").alias("last_day"), F.countDistinct("season").alias("seasons"))


@query(with_(LOG, "select team, first_opponent, last_opponent from (select team, first_value(opponent) over (partition by team order by game_date, is_home desc, game_id) as first_opponent, last_value(opponent) over (partition by team order by game_date, is_home desc, game_id rows between unbounded preceding and unbounded following) as last_opponent, row_number() over (partition by team order by game_date, is_home desc, game_id) as k from log) where k = 1"))
def first_last_opponent(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = F.struct("game_date", (~F.col("is_home")).alias("a"), "game_id")
    return the_log(spark, sf_dir).groupBy("team").agg(F.min_by("opponent", order).alias("first_opponent"), F.max_by("opponent", order).alias("last_opponent"))


# ---------------------------------------------------------------- markets


OPP = "market, side, line, round(model_prob, 6) as model_prob, round(fair_prob, 6) as fair_prob, round(price, 6) as price, round(edge_pct, 6) as edge_pct, round(ev, 6) as ev, round(kelly, 6) as kelly, confidence"


@query(with_(OPPS, f"select game_id, {OPP} from opps"))
def unpivot_opportunities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(opps(spark, sf_dir).select("game_id", "market", "side", "line", "model_prob", "fair_prob", "price", "edge_pct", "ev", "kelly", "confidence"))


@query(with_(OPPS, "select market, side, result, count(*) as n from opps group by all"))
def settle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return betting.settled(opps(spark, sf_dir)).groupBy("market", "side", "result").agg(F.count(F.lit(1)).alias("n"))


@query(with_(BETS, f"select game_id, {OPP}, result, round(profit, 6) as profit, round(clv, 6) as clv, edge_bucket from bets"))
def backtest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(bets(spark, sf_dir).select("game_id", "market", "side", "line", "model_prob", "fair_prob", "price", "edge_pct", "ev", "kelly", "confidence", "result", "profit", "clv", "edge_bucket"))


@query(with_(BETS, f"select market, edge_bucket, side, season, {SUMMARY} from bets group by grouping sets ((), (market), (market, edge_bucket), (market, side), (season))"))
def summary_grouping_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(betting.summaries(bets(spark, sf_dir)))


@query(with_(OPPS, f"select min_edge, allowed, count(*) as bets, round(sum({PROFIT}) / count(*) * 100, 6) as roi_pct from opps, (select unnest([0.0::double, 1.0, 2.0, 3.0, 5.0, 8.0]) as min_edge), (values ('High', ['High']), ('Medium+', ['High', 'Medium']), ('All', ['High', 'Medium', 'Low'])) t(allowed, names) where edge_pct >= min_edge and list_contains(names, confidence) group by all"))
def threshold_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(betting.sweep(opps(spark, sf_dir)))


CURVE = "partition by season order by game_date, game_id, market, side rows between unbounded preceding and current row"


@query(with_(BETS, f"select game_id, market, side, round(ln(100::double) + sum(ln(case when result = 1 then 1 + kelly * (price - 1) when result = -1 then 1 - kelly else 1.0::double end)) over ({CURVE}), 6) as log_bankroll from bets"))
def bankroll_kelly(spark: SparkSession, sf_dir: str) -> DataFrame:
    return betting.kelly_curve(bets(spark, sf_dir)).select("game_id", "market", "side", F.round("log_bankroll", 6).alias("log_bankroll"))


@query(with_(BETS, f"select game_id, market, side, round(sum(profit) over w, 6) + 0.0 as profit_to_date, round(sum(profit) over w / count(*) over w * 100, 6) + 0.0 as roi_to_date from bets window w as ({CURVE})"))
def bankroll_flat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(betting.flat_curve(bets(spark, sf_dir)).select("game_id", "market", "side", "profit_to_date", "roi_to_date"))


@query(with_(BETS, "select market, season, count(*) as picks, count(r) as settled, count(*) filter (r = 1) as won, round(count(*) filter (r = 1) / nullif(cast(count(*) filter (r <> 0) as double), 0), 6) as hit_rate, round(sum(p) / nullif(count(r), 0) * 100, 6) as roi_pct, round(count(*) filter (c > 0) / nullif(cast(count(c) as double), 0), 6) as pct_positive_clv from (select market, season, case when game_id % 4 <> 0 then result end as r, case when game_id % 4 <> 0 then profit end as p, case when game_id % 3 <> 0 then clv end as c from bets) group by grouping sets ((), (market), (season))"))
def forward_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    open_ = F.col("game_id") % 4 != 0
    picks = bets(spark, sf_dir).withColumns({"result": F.when(open_, F.col("result")), "profit": F.when(open_, F.col("profit")), "clv": F.when(F.col("game_id") % 3 != 0, F.col("clv"))})
    return rounded(serving.forward_summary(picks))


@query(with_(BETS, "select market, count(clv) as n, round(avg(abs(clv)), 6) as mean_abs_clv, round(avg(cast(round(abs(clv), 9) > 2 as double)), 6) as moved_share from bets group by 1"))
def line_movement(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(serving.line_movement(bets(spark, sf_dir)))


@query(with_(OPPS, "select game_date, cast(place as int) as place, game_id, market, side, round(edge_pct, 6) as edge_pct from (select *, row_number() over (partition by game_date order by round(edge_pct, 9) desc, game_id, market, side) as place from opps) where place <= 5"))
def daily_suggestions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(serving.daily_suggestions(_rounded_opps(spark, sf_dir)).select("game_date", "place", "game_id", "market", "side", F.col("edge").alias("edge_pct")))


# ---------------------------------------------------------------- parlays


GOOD = "good as (select * exclude (edge_pct), edge_pct as edge, round(edge_pct, 9) as edge_pct from opps where edge_pct >= 3 and confidence in ('Medium', 'High')), best as (select * from (select *, row_number() over (partition by game_id order by edge_pct desc, market, side) as k from good) where k = 1)"
POOL = "pool as (select *, row_number() over (partition by game_date order by edge_pct desc, game_id) as rank from best)"
PAIR = "pairs as (select a.game_date, a.game_id as g1, b.game_id as g2, a.price * b.price as odds, a.model_prob * b.model_prob as p, a.fair_prob * b.fair_prob as f, [a.side, b.side] as sides, [a.market, b.market] as markets from pool a join pool b on a.game_date = b.game_date and a.rank < b.rank)"


def _rounded_opps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges to nine digits, so that ties are ties on both sides; ``edge`` is as computed."""
    return opps(spark, sf_dir).withColumn("edge", F.col("edge_pct")).withColumn("edge_pct", F.round("edge_pct", 9))


@query(with_(OPPS, GOOD, "select game_id, market, side, round(edge, 6) as edge_pct from best"))
def best_leg_per_game(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _rounded_opps(spark, sf_dir)
    return rounded(parlays.best_legs(rows).select("game_id", "market", "side", F.col("edge").alias("edge_pct")))


THEME = """case when len(list_distinct(sides)) = 1 and len(list_distinct(markets)) = 1 then 'all ' || sides[1] || ' ' || markets[1] || 's'
 when len(list_filter(sides, lambda x : x not in ('home', 'favorite'))) = 0 then 'all favorites' when len(list_filter(sides, lambda x : x not in ('away', 'underdog'))) = 0 then 'all underdogs'
 when len(list_distinct(markets)) = 1 then 'all ' || markets[1] || ' bets' else '2-leg mixed parlay' end"""


@query(with_(OPPS, GOOD, POOL, PAIR, f"select g1, g2, round(odds, 6) as combined_odds, round(p, 6) as combined_prob, round((p - f) * 100, 6) as combined_edge, round(p * (odds - 1) - (1 - p), 6) as combined_ev, round(greatest(0::double, ((odds - 1) * p - (1 - p)) / (odds - 1)) * 0.25, 6) as combined_kelly, {THEME} as theme from pairs"))
def parlay_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = parlays.priced(parlays.pairs(parlays.pool(_rounded_opps(spark, sf_dir), "game_date"), "game_date"), 2)
    return rounded(out.select(F.col("legs")[0]["game_id"].alias("g1"), F.col("legs")[1]["game_id"].alias("g2"), "combined_odds", "combined_prob", "combined_edge", "combined_ev", "combined_kelly", "theme"))


#: All sets of two to five legs of a day, grown leg by leg.
SETS = """grown as (select game_date, 1 as leg_count, rank as last, [game_id] as ids, price as odds, model_prob as p, fair_prob as f from pool union all
 select g.game_date, leg_count + 1, b.rank, list_append(ids, b.game_id), odds * b.price, p * b.model_prob, f * b.fair_prob from grown g join pool b on g.game_date = b.game_date and b.rank > g.last where leg_count < 5),
named as (select game_date, leg_count, odds, (p - f) * 100 as edge, round((p - f) * 100, 9) as e, array_to_string(list_sort(ids), '-') as signature from grown where leg_count > 1),
cut as (select *, row_number() over (partition by game_date order by e desc, signature) as r from named)"""


@query(with_("recursive " + OPPS, GOOD, POOL, SETS, "select game_date, leg_count, cast(place as int) as place, signature, round(odds, 4) as combined_odds, round(edge, 4) as combined_edge from (select *, row_number() over (partition by game_date, leg_count order by e desc, signature) as place from cut where r <= 500) where place <= 3"))
def parlay_suggest(spark: SparkSession, sf_dir: str) -> DataFrame:
    best = parlays.suggested(_rounded_opps(spark, sf_dir), "game_date")
    return best.select("game_date", "leg_count", "place", "signature", F.round("combined_odds", 4).alias("combined_odds"), F.round("combined_edge", 4).alias("combined_edge"))


@query(with_(BETS, "legs as (select game_id // 3 as parlay_id, price, case when game_id % 11 <> 0 then result end as result from bets)", "select parlay_id, legs, result, round(case result when 1 then payout - 1 when 0 then 0 when -1 then -1 end, 6) as profit from (select parlay_id, legs, payout, cast(case when done < legs then null when lost > 0 then -1 when won = 0 then 0 else 1 end as int) as result from (select parlay_id, count(*) as legs, count(result) as done, count(*) filter (result = -1) as lost, count(*) filter (result = 1) as won, coalesce(product(price) filter (result = 1), 1.0) as payout from legs group by 1))"))
def parlay_settle(spark: SparkSession, sf_dir: str) -> DataFrame:
    legs = bets(spark, sf_dir).select(F.floor(F.col("game_id") / 3).alias("parlay_id"), "price", F.when(F.col("game_id") % 11 != 0, F.col("result")).alias("result"))
    out = parlays.settled(legs.select("parlay_id").distinct(), legs)
    return rounded(out.select("parlay_id", "legs", "result", "profit"))


@query(with_(BETS, "legs as (select game_id // 2 as parlay_id, game_id, price, model_prob, fair_prob from bets)", "select parlay_id, cast(count(*) as int) as leg_count, round(product(price), 6) as combined_odds, round(case when count(distinct game_id) = count(*) and count(*) >= 2 then product(model_prob) end, 6) as combined_prob from legs group by 1"))
def parlay_combine(spark: SparkSession, sf_dir: str) -> DataFrame:
    legs = bets(spark, sf_dir).withColumn("parlay_id", F.floor(F.col("game_id") / 2))
    return rounded(serving.combine(legs).select("parlay_id", "leg_count", "combined_odds", "combined_prob"))


@query(with_(LOG, "select team, opponent, count(*) as n, round(avg(pf - pa), 6) as mean_margin from log group by all having count(*) >= 5"))
def pair_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    return the_log(spark, sf_dir).groupBy("team", "opponent").agg(F.count(F.lit(1)).alias("n"), r6(F.avg(F.col("pf") - F.col("pa"))).alias("mean_margin")).where("n >= 5")


@query(with_(LOG, "g as (select game_id, max(case when is_home then d end) as h, max(case when not is_home then d end) as a from (select game_id, is_home, pf - pa as d from log) group by 1)", "select count(*) as n, round(corr(h, a), 6) as same_game_corr from g"))
def leakage_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = log.wide(the_log(spark, sf_dir).withColumn("d", F.col("pf") - F.col("pa")), ["d"])
    return rounded(both.agg(F.count(F.lit(1)).alias("n"), F.corr("home_d", "away_d").alias("same_game_corr")))


@query(with_(BASE, "d as (select event_id, player_id, avg(pts) as pts from box group by all), lead as (select player_id, day, event_id, pts, avg(pts) over (partition by player_id order by day, event_id rows between unbounded preceding and 1 preceding) as before from (select d.*, b.day from d join (select event_id, min(day) as day from box group by 1) b using (event_id)))", "select player_id, round(avg(pts), 6) as mean_pts, round(avg(before), 6) as mean_before, count(*) as n from lead group by 1"))
def star_trail(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = tables.box(spark, sf_dir)
    d = b.groupBy("event_id", "player_id").agg(F.avg("pts").alias("pts")).join(b.groupBy("event_id").agg(F.min("day").alias("day")), "event_id")
    w = Window.partitionBy("player_id").orderBy("day", "event_id").rowsBetween(Window.unboundedPreceding, -1)
    return rounded(d.withColumn("before", F.avg("pts").over(w)).groupBy("player_id").agg(F.avg("pts").alias("mean_pts"), F.avg("before").alias("mean_before"), F.count(F.lit(1)).alias("n")))


STARS = """played as (select l.game_id, l.is_home, l.team, l.opponent, l.season, l.game_date, b.player_id, sum(b.minutes) as minutes, sum(b.pts) as pts from log l join box b on b.event_id = l.game_id and b.is_home = l.is_home group by all),
best as (select team, season + 1 as season, player_id as star from (select *, row_number() over (partition by team, season order by m desc, player_id) as k from (select team, season, player_id, sum(minutes) as m from played group by all)) where k = 1),
asked as (select l.game_id, l.is_home, l.opponent, l.game_date, star from log l left join best using (team, season))"""


@query(with_(LOG, STARS, "select game_id, is_home, round(case when h >= 10 and a >= 10 then hm - am else 0 end, 6) as venue_gap from (select q.game_id, q.is_home, count(*) filter (p.is_home) as h, count(*) filter (not p.is_home) as a, avg(p.pts) filter (p.is_home) as hm, avg(p.pts) filter (not p.is_home) as am from asked q left join played p on p.player_id = q.star and p.game_date < q.game_date group by all)"))
def star_venue_gap(spark: SparkSession, sf_dir: str) -> DataFrame:
    the = the_log(spark, sf_dir)
    return rounded(stars.venue_gap(the, stars.player_games(tables.box(spark, sf_dir), the)))


@query(with_(LOG, STARS, "select q.game_id, q.is_home, round(coalesce(avg(p.pts), 20), 6) as trail, count(p.pts) as meetings from asked q left join played p on p.player_id = q.star and p.opponent = q.opponent and p.game_date < q.game_date group by all"))
def star_opponent_trail(spark: SparkSession, sf_dir: str) -> DataFrame:
    the = the_log(spark, sf_dir)
    return rounded(stars.opponent_trail(the, stars.player_games(tables.box(spark, sf_dir), the), 20.0))
