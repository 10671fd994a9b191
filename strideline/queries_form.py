"""Queries over games, odds rules, the team log and its windows. Doubles are rounded to six digits, as in their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strideline.functions import odds, rules
from strideline.operators import form, log
from strideline.plans import build
from strideline.registry import query, r6, rounded, the_log
from strideline.sources import tables
from strideline.sql import BASE, FEATURES, FORM, LOG, cdf, devig, with_

# ---------------------------------------------------------------- games, rules, odds


@query(with_(BASE, "select least(9, cast(floor(fair * 10) as int)) as bucket, count(*) as games, round(avg(fair), 6) as mean_prob, round(avg(cast(home_win as double)), 6) as win_rate from (select *, " + devig("home_close", "away_close") + " as fair from games) group by 1"))
def market_efficiency(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = tables.games(spark, sf_dir).withColumn("fair", odds.devig("home_close", "away_close")[0])
    return g.groupBy(F.least(F.lit(9), F.floor(F.col("fair") * 10).cast("int")).alias("bucket")).agg(F.count(F.lit(1)).alias("games"), r6(F.avg("fair")).alias("mean_prob"), r6(F.avg(F.col("home_win").cast("double"))).alias("win_rate"))


GAME_COLUMNS = "game_id, game_date, season, home, away, home_score, away_score, is_playoff, is_neutral, home_line, total_line, margin, total, home_win, covers, \"over\""


@query(with_(BASE, f"select {GAME_COLUMNS}, round(home_close, 6) as home_close, round(away_close, 6) as away_close, round(home_open, 6) as home_open, round(away_open, 6) as away_open from games"))
def games_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(tables.games(spark, sf_dir)).select(*[c.strip().strip('"') for c in GAME_COLUMNS.split(",")], "home_close", "away_close", "home_open", "away_open")


@query(with_(BASE, "select game_id, cast(case when m >= 7 then y else y - 1 end as int) as nfl, cast(case when m >= 8 then y else y - 1 end as int) as nba, cast(y as int) as mlb, cast(case when m > 8 then y + 1 else y end as int) as nhl, cast(case when m >= 8 then y else y - 1 end as int) as cfb, case when game_date < date '1997-01-01' then 'first' when game_date < date '2000-01-01' then 'second' else 'third' end as book from (select game_id, game_date, month(game_date) as m, year(game_date) as y from games)"))
def season_assignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    g, day = tables.games(spark, sf_dir), F.col("game_date")
    book = rules.book_for(day, [("1997-01-01", "first"), ("2000-01-01", "second")], "third")
    return g.select("game_id", *[rules.season_for(day, x).alias(x) for x in ("nfl", "nba", "mlb", "nhl", "cfb")], book.alias("book"))


MOVES = {3: 4, 10: 11, 17: 24}


@query(with_(BASE, "select game_id, case home when 3 then 4 when 10 then 11 when 17 then 24 else home end as canonical, case home when 3 then 4 when 10 then 11 when 17 then 24 end as moved_to, h.n_name as name, h.n_regionkey = a.n_regionkey as is_divisional from games join nation h on h.n_nationkey = home join nation a on a.n_nationkey = away"))
def franchise_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    g, n = tables.games(spark, sf_dir), tables.table(spark, sf_dir, "nation")
    side = lambda s: n.select(F.col("n_nationkey").alias(s), F.col("n_regionkey").alias(f"{s}_division"), F.col("n_name").alias(f"{s}_name"))
    j = g.join(side("home"), "home").join(side("away"), "away")
    return j.select("game_id", rules.mapped(F.col("home"), MOVES, F.col("home")).alias("canonical"), rules.mapped(F.col("home"), MOVES).alias("moved_to"), F.col("home_name").alias("name"), (F.col("home_division") == F.col("away_division")).alias("is_divisional"))


@query(with_(BASE, "select season, covers, \"over\", count(*) as n from games group by all"))
def cover_over_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.games(spark, sf_dir).groupBy("season", "covers", "over").agg(F.count(F.lit(1)).alias("n"))


@query(with_(BASE, "select game_id, american, round(case when american > 0 then 1 + american / 100.0 when american < 0 then 1 + 100.0 / abs(american) end, 6) as decimal_price, cast(case when home_close >= 2 then round_even((home_close - 1) * 100, 0) when home_close > 1 then round_even(-100 / (home_close - 1), 0) end as bigint) as american_close from (select *, game_id % 401 - 200 as american from games)"))
def odds_convert(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = tables.games(spark, sf_dir).withColumn("american", F.col("game_id") % 401 - 200)
    return rounded(g.select("game_id", "american", odds.american_to_decimal("american").alias("decimal_price"), odds.decimal_to_american("home_close").alias("american_close")))


@query(with_(BASE, f"select game_id, round(1 / home_close, 6) as implied, round({devig('home_close', 'away_close')}, 6) as fair_home, round({devig('away_close', 'home_close')}, 6) as fair_away, round((1 / home_close + 1 / away_close - 1) * 100, 6) as vig from games"))
def devig_prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    home, away = odds.devig("home_close", "away_close")
    return rounded(tables.games(spark, sf_dir).select("game_id", odds.implied_prob("home_close").alias("implied"), home.alias("fair_home"), away.alias("fair_away"), odds.vig_pct("home_close", "away_close").alias("vig")))


@query(with_(BASE, "select game_id, round(p * (d - 1) - (1 - p), 6) as ev, round((p - 1 / d) * 100, 6) as edge, round(case when d <= 1 then 0 else greatest(0, ((d - 1) * p - (1 - p)) / (d - 1)) * 0.25 end, 6) as stake from (select game_id, cast(0.3 + (game_id % 41) / 100.0 as double) as p, home_close as d from games)"))
def ev_kelly(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = tables.games(spark, sf_dir).withColumn("p", 0.3 + (F.col("game_id") % 41) / 100.0)
    return rounded(g.select("game_id", odds.expected_value("p", "home_close").alias("ev"), odds.edge_over_price("p", "home_close").alias("edge"), odds.kelly("p", "home_close").alias("stake")))


@query(with_(BASE, "select game_id, round((1 / home_close - 1 / home_open) * 100 / (1 / home_close), 6) as clv from games"))
def clv(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(tables.games(spark, sf_dir).select("game_id", odds.clv_pct("home_open", "home_close").alias("clv")))


@query(with_(BASE, f"select game_id, round({cdf('margin', '0.0', '14.0')}, 6) as p, round(1 - {cdf('-home_line', '3.0', '13.5')}, 6) as cover_prob, round(1 - {cdf('total_line', '40.0', '11.0')}, 6) as over_prob, case when margin >= 0 then 1.0::double else 0.0::double end as step from games"))
def normal_cdf(spark: SparkSession, sf_dir: str) -> DataFrame:
    g, lit = tables.games(spark, sf_dir), F.lit
    return rounded(g.select("game_id", odds.normal_cdf(F.col("margin"), lit(0.0), lit(14.0)).alias("p"), odds.cover_prob(lit(3.0), lit(13.5), "home_line").alias("cover_prob"), odds.over_prob(lit(40.0), lit(11.0), "total_line").alias("over_prob"), odds.normal_cdf(F.col("margin"), lit(0.0), lit(0.0)).alias("step")))


@query(with_(BASE, "select tier, bucket, count(*) as n from (select case when (a - 0.5) * (b - 0.5) <= 0 then 'Low' when abs(a - b) <= 0.05 then 'High' when abs(a - b) <= 0.12 then 'Medium' else 'Low' end as tier, case when e < 5 then '3-5%' when e < 10 then '5-10%' when e < 20 then '10-20%' else '20%+' end as bucket from (select cast((game_id * 7) % 1009 as double) / 1009 as a, cast((game_id * 13) % 1013 as double) / 1013 as b, cast(game_id % 30 as double) as e from games)) group by all"))
def confidence_and_bucket(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("game_id")
    g = tables.games(spark, sf_dir).select(((key * 7) % 1009 / F.lit(1009.0)).alias("a"), ((key * 13) % 1013 / F.lit(1013.0)).alias("b"), (key % 30).cast("double").alias("e"))
    return g.groupBy(odds.confidence_tier("a", "b").alias("tier"), odds.edge_bucket("e").alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


@query(with_(FORM + FEATURES, "select game_id, round(pow(home_pf10, 2.37) / nullif(pow(home_pf10, 2.37) + pow(home_pa10, 2.37), 0), 6) as home_pyth, round((home_pf10 + away_pa10) / 2 - (away_pf10 + home_pa10) / 2, 6) as naive_margin, round((home_pf10 + away_pa10) / 2 + (away_pf10 + home_pa10) / 2, 6) as naive_total from feats"))
def pythagorean(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = build.features(tables.games(spark, sf_dir))
    hf, ha, af, aa = (F.col(c) for c in ("home_pf10", "home_pa10", "away_pf10", "away_pa10"))
    return rounded(f.select("game_id", rules.pythagorean(hf, ha).alias("home_pyth"), rules.naive_margin(hf, ha, af, aa).alias("naive_margin"), rules.naive_total(hf, ha, af, aa).alias("naive_total")))


@query(with_(BASE, "select game_id, round(case when 1.045 - 1 / home_close > 0 then 1 / (1.045 - 1 / home_close) end, 6) as other_price, round(1 / home_close / 1.045, 6) as fair from games"))
def one_sided_price(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(tables.games(spark, sf_dir).select("game_id", odds.other_side("home_close").alias("other_price"), odds.two_way("home_close").alias("fair")))


@query("select tick_id, cast(hour(ts at time zone 'UTC' at time zone zone) as int) as local_hour, hour(ts at time zone 'UTC' at time zone zone) >= 17 as is_night from (select event_id as tick_id, ts, case user_id % 3 when 0 then 'America/New_York' when 1 then 'America/Chicago' else 'America/Phoenix' end as zone from events)")
def local_night(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = tables.ticks(spark, sf_dir)
    zone = F.when(F.col("game_id") % 3 == 0, "America/New_York").when(F.col("game_id") % 3 == 1, "America/Chicago").otherwise("America/Phoenix")
    hour = rules.local_hour(F.col("ts"), zone)
    return t.select("tick_id", hour.alias("local_hour"), (hour >= 17).alias("is_night"))


@query("select o_orderkey as game_id, o_orderpriority[1:1] as grade, try_cast(o_orderpriority[1:1] as double) as grade_number, try_cast(o_orderpriority as double) as bad, upper(trim(o_orderstatus)) = 'F' as is_final, nullif(cast(o_orderkey % 5 as double), 0) as nonzero from orders where o_custkey is not null and o_orderstatus in ('F', 'O') and o_totalprice between 1000 and 400000")
def cleaning(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = tables.table(spark, sf_dir, "orders").na.drop(subset=["o_custkey"]).where(F.col("o_orderstatus").isin("F", "O") & F.col("o_totalprice").between(1000, 400000))
    grade = F.substring("o_orderpriority", 1, 1)
    return o.select(F.col("o_orderkey").alias("game_id"), grade.alias("grade"), rules.number(grade).alias("grade_number"), rules.number(F.col("o_orderpriority")).alias("bad"), (F.upper(F.trim("o_orderstatus")) == "F").alias("is_final"), rules.zero_as_null((F.col("o_orderkey") % 5).cast("double")).alias("nonzero"))


# ---------------------------------------------------------------- team log and windows


@query(with_(LOG, "select game_id, team, opponent, is_home, pf, pa, covered, won, ats from log"))
def team_game_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return the_log(spark, sf_dir).select("game_id", "team", "opponent", "is_home", "pf", "pa", "covered", "won", "ats")


@query(with_(FORM, "select game_id, team, is_home, round(pf10, 6) as pf10, round(pa10, 6) as pa10, round(won10, 6) as won10, round(ats10, 6) as ats10 from form"))
def rolling_form(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(form.trailing(the_log(spark, sf_dir), build.FORM).select("game_id", "team", "is_home", *build.FORM.values()))


@query(with_(FORM + FEATURES, "select game_id, " + ", ".join(f"round(coalesce({c}, {d}), 6) as {c}" for s in ("home", "away") for c, d in ((f"{s}_pf10", f"(select avg({s}_pf10) from feats)"), (f"{s}_pa10", f"(select avg({s}_pa10) from feats)"), (f"{s}_won10", "0.5"), (f"{s}_ats10", "0.5"))) + ", home_streak, away_streak, home_rest, away_rest from feats"))
def form_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(build.filled(build.features(tables.games(spark, sf_dir))).select("game_id", *build.FEATURES))


@query(with_(LOG, "select team, game_id, round(pf10, 6) as pf10, round(won10, 6) as won10 from (select *, avg(pf) over w as pf10, avg(won) over w as won10, row_number() over (partition by team order by game_date desc, is_home, game_id desc) as r from log window w as (partition by team order by game_date, is_home desc, game_id rows between 9 preceding and current row)) where r = 1"))
def current_form(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(form.latest(the_log(spark, sf_dir), {"pf": "pf10", "won": "won10"}).select("team", "game_id", "pf10", "won10"))


TEAM = "partition by team order by game_date, is_home desc, game_id"


@query(with_(LOG, f"select game_id, team, is_home, round(sum(pf) over w / nullif(cast(sum(pf + pa) over w as double), 0), 6) as point_share from log window w as ({TEAM} rows between 10 preceding and 1 preceding)"))
def ratio_of_sums(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = the_log(spark, sf_dir).withColumn("both", F.col("pf") + F.col("pa"))
    return rounded(form.trailing_ratio(rows, "pf", "both", "point_share").select("game_id", "team", "is_home", "point_share"))


@query(with_(LOG, f"select game_id, team, is_home, round(avg(pf) over ({TEAM} rows between 3 preceding and 1 preceding) - avg(pf) over ({TEAM} rows between 10 preceding and 1 preceding), 6) as trend from log"))
def trend_l3_l10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(form.trend(the_log(spark, sf_dir), "pf").select("game_id", "team", "is_home", "trend"))


@query(with_(LOG, f"select game_id, team, is_home, round(avg((\"over\" + 1) / 2) over ({TEAM} rows between 10 preceding and 1 preceding), 6) as over_rate from log"))
def over_tendency(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = the_log(spark, sf_dir).withColumn("o", (F.col("over") + 1) / 2)
    return rounded(form.trailing(rows, {"o": "over_rate"}).select("game_id", "team", "is_home", "over_rate"))


@query(with_(LOG, f"select game_id, team, is_home, round(avg(pf - pa) over ({TEAM} rows between 10 preceding and 1 preceding), 6) as margin10 from log"))
def trailing_margin(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = the_log(spark, sf_dir).withColumn("d", F.col("pf") - F.col("pa"))
    return rounded(form.trailing(rows, {"d": "margin10"}).select("game_id", "team", "is_home", "margin10"))


BOX_DAYS = "days as (select player_id, day, cast(sum(minutes) as bigint) as minutes, cast(sum(pts) as bigint) as pts, count(*) as lines from box group by all)"


def player_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.box(spark, sf_dir).groupBy("player_id", "day").agg(F.sum("minutes").alias("minutes"), F.sum("pts").alias("pts"), F.count(F.lit(1)).alias("lines"))


@query(with_(BASE, BOX_DAYS, "select player_id, day, round(avg(pts) over (partition by player_id order by day rows between 8 preceding and 1 preceding), 6) as pts8 from days"))
def per_player_l8(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("player_id").orderBy("day").rowsBetween(-8, -1)
    return rounded(player_days(spark, sf_dir).select("player_id", "day", F.avg("pts").over(w).alias("pts8")))


@query(with_(BASE, BOX_DAYS, "select player_id, day, cast(coalesce(sum(minutes) over (partition by player_id order by day range between interval 3 days preceding and interval 1 day preceding), 0) as bigint) as minutes3 from days"))
def calendar_window_3d(spark: SparkSession, sf_dir: str) -> DataFrame:
    return form.calendar_sum(player_days(spark, sf_dir), ["player_id"], "day", "minutes", 3, "minutes3").select("player_id", "day", "minutes3")


@query(with_(BASE, "d as (select venue_id, day, count(*) as n from box group by all), s as (select venue_id, unnest(generate_series(min(day), max(day), interval 1 day))::date as day from d group by venue_id)", "select s.venue_id, count(*) as days, count(*) filter (d.n is null) as empty_days, cast(sum(coalesce(d.n, 0)) as bigint) as n, max(coalesce(d.n, 0)) as most from s left join d on s.venue_id = d.venue_id and s.day = d.day group by 1"))
def densified_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = tables.box(spark, sf_dir).groupBy("venue_id", "day").agg(F.count(F.lit(1)).alias("n"))
    every = form.densified(rows, ["venue_id"], "day", "n")
    return every.groupBy("venue_id").agg(F.count(F.lit(1)).alias("days"), F.count_if(F.col("n") == 0).alias("empty_days"), F.sum("n").alias("n"), F.max("n").alias("most"))


@query(with_(LOG, f"select game_id, team, is_home, round(avg(won) over (partition by team, season order by game_date, is_home desc, game_id rows between unbounded preceding and 1 preceding), 6) as win_pct from log"))
def season_to_date(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(form.season_to_date(the_log(spark, sf_dir), "won", "win_pct").select("game_id", "team", "is_home", "win_pct"))


@query(with_(LOG, "select game_id, team, is_home, round(avg(pf) over w, 6) as vs, count(pf) over w as vs_n from log window w as (partition by team, opponent order by game_date, is_home desc, game_id rows between unbounded preceding and 1 preceding)"))
def vs_opponent_expanding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(form.versus(the_log(spark, sf_dir), "pf", "vs").select("game_id", "team", "is_home", "vs", "vs_n"))


@query(with_(LOG, f"select game_id, team, is_home, cast(coalesce(game_date - lag(game_date) over ({TEAM}), 7) as int) as rest from log"))
def rest_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    return form.rest_days(the_log(spark, sf_dir)).select("game_id", "team", "is_home", "rest")


@query(with_(FORM, "select game_id, team, is_home, streak from form"))
def streak(spark: SparkSession, sf_dir: str) -> DataFrame:
    return form.streak(the_log(spark, sf_dir)).select("game_id", "team", "is_home", "streak")


@query(with_(FORM, "select game_id, team, is_home, streak_now as streak from form"))
def streak_now(spark: SparkSession, sf_dir: str) -> DataFrame:
    return form.streak(the_log(spark, sf_dir), inclusive=True).select("game_id", "team", "is_home", "streak")


COUNTED = "counted as (select team, season, game_id, game_date, is_home, cast(sum(won) over (partition by team, season order by game_date, is_home desc, game_id) as bigint) % 40 as counter from log)"


def counted(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = log.team_window("season")
    return the_log(spark, sf_dir).select("team", "season", "game_id", "game_date", "is_home", (F.sum("won").over(w) % 40).alias("counter"))


@query(with_(LOG, COUNTED, "select team, season, game_id, is_home, reset_day, coalesce(game_date < reset_day, false) as is_preseason from (select *, max(case when counter < prev and counter <= 3 then game_date end) over (partition by team, season) as reset_day from (select *, lag(counter) over (partition by team, season order by game_date, is_home desc, game_id) as prev from counted))"))
def reset_detect(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = form.reset_point(counted(spark, sf_dir), ["team", "season"], log.play_order(), "counter", 3)
    return rows.select("team", "season", "game_id", "is_home", "reset_day", "is_preseason")


@query(with_(LOG, COUNTED, "select team, season, game_id, is_home, plateau_day, game_date > plateau_day as is_beyond from (select *, min(case when counter = top then game_date end) over (partition by team, season) as plateau_day from (select *, max(counter) over (partition by team, season) as top from counted))"))
def plateau_detect(spark: SparkSession, sf_dir: str) -> DataFrame:
    return form.plateau(counted(spark, sf_dir), ["team", "season"], "game_date", "counter").select("team", "season", "game_id", "is_home", "plateau_day", "is_beyond")


@query(with_(BASE, "select game_id, week, cast(case when is_playoff then max(case when not is_playoff then week end) over (partition by season) + 1 else week end as int) as week_adjusted from (select *, cast((game_date - min(game_date) over (partition by season)) // 7 + 1 as int) as week from games)"))
def season_phase(spark: SparkSession, sf_dir: str) -> DataFrame:
    return form.season_weeks(tables.games(spark, sf_dir)).select("game_id", "week", "week_adjusted")


@query(with_(LOG, f"select game_id, team, is_home, coalesce(venue <> lag(venue) over ({TEAM}) and game_date - lag(game_date) over ({TEAM}) <= 1, false) as short_rest_travel from (select *, case when is_home then team else opponent end as venue from log)"))
def travel_flag(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = the_log(spark, sf_dir).withColumn("venue", F.when(F.col("is_home"), F.col("team")).otherwise(F.col("opponent")))
    return form.travel(rows, "venue").select("game_id", "team", "is_home", "short_rest_travel")


@query(with_(BASE, "select game_id, 'nfl_' || cast(row_number() over (order by season, game_date, game_id) - 1 as varchar) as ordinal_id from games"))
def ordinal_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return log.ordinal_ids(tables.games(spark, sf_dir), "nfl", "game_date", "game_id").select("game_id", "ordinal_id")
