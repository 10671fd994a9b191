"""Queries over stored state, sets, feeds, ratings, models and streams. Doubles are rounded to six digits, as in their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strideline.operators import log, models, ratings, research, store
from strideline.plans import build, serving
from strideline.registry import bets, frame, query, rounded, the_log
from strideline.sources import cache, readers, sinks, tables
from strideline.sources.scratch import new_folder, written
from strideline.sql import BASE, BETS, LOG, PREDICTED, with_
from strideline.streaming import stateful
from strideline.streaming import ticks as streams

# ---------------------------------------------------------------- stored state


OPEN_CLOSE = "select game_id, market_side, round(arg_min(price, ts), 6) as open, round(arg_max(price, ts), 6) as close, count(*) as ticks, count(price) as priced from ticks group by all"


@query(with_(BASE, OPEN_CLOSE))
def upsert_open_close(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(store.open_close(tables.ticks(spark, sf_dir), ["game_id", "market_side"], "ts", "tick_id", "price"))


UPSERT = "a as (select game_id, market_side, min(price) as open, max(price) as close, count(*) as score from ticks where tick_id % 3 = 0 group by all), b as (select game_id, market_side, min(price) as open, max(price) as close, count(*) as score from ticks where tick_id % 3 = 1 group by all)"


@query(with_(BASE, UPSERT, "select coalesce(b.game_id, a.game_id) as game_id, coalesce(b.market_side, a.market_side) as market_side, round(coalesce(a.open, b.open), 6) as open, round(coalesce(b.close, a.close), 6) as close, case when b.game_id is not null then b.score else a.score end as score from a full join b on a.game_id = b.game_id and a.market_side = b.market_side"))
def upsert_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = tables.ticks(spark, sf_dir)
    part = lambda k: t.where(F.col("tick_id") % 3 == k).groupBy("game_id", "market_side").agg(F.min("price").alias("open"), F.max("price").alias("close"), F.count(F.lit(1)).alias("score"))
    return rounded(store.upsert(part(0), part(1), ["game_id", "market_side"], ["open"], ["close"], ["score"]))


PICKS = "old as (select distinct game_id, market, side, line from bets where game_id % 2 = 0), new as (select distinct game_id, market, side, line from bets where game_id % 3 = 0)"


@query(with_(BETS, PICKS, "select * from new n where not exists (select 1 from old o where o.game_id = n.game_id and o.market = n.market and o.side = n.side and o.line is not distinct from n.line)"))
def idempotent_insert(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = ["game_id", "market", "side", "line"]
    b = bets(spark, sf_dir).select(*key)
    return store.insert_missing(b.where("game_id % 2 = 0"), b.where("game_id % 3 = 0"), key, ["game_id"])


@query(with_(BASE, "p as (select game_id % 500 as g, case when game_id % 4 = 0 then null else home_line end as line, case when game_id % 3 = 0 then home_win end as result, game_id as id from games)", "select g, line, result, id from (select *, row_number() over (partition by g, line order by (result is not null) desc, id) as k from p) where k = 1"))
def dedupe_null_safe(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("game_id")
    p = tables.games(spark, sf_dir).select((key % 500).alias("g"), F.when(key % 4 != 0, F.col("home_line")).alias("line"), F.when(key % 3 == 0, F.col("home_win")).alias("result"), key.alias("id"))
    return store.deduplicated(p, ["g", "line"], "result", "id")


@query(with_(BASE, "select market_side, max(ts) as latest from ticks group by 1"))
def freshness(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.freshness(tables.ticks(spark, sf_dir), "market_side", "ts")


@query(with_(BASE, "h as (select * from games where season <= 1999), l as (select * from games where season >= 1999)", "select game_id, season, home_score, is_neutral from h union all select game_id, season, home_score, null from l where game_date > (select max(game_date) from h)"))
def live_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = tables.games(spark, sf_dir)
    history = g.where("season <= 1999").select("game_id", "game_date", "season", "home_score", "is_neutral")
    live = g.where("season >= 1999").select("game_id", "game_date", "season", "home_score")
    return store.history_union(history, live, "game_date").drop("game_date")


@query(with_(BASE, "select game_id, game_date, home, away, total from (select game_id, game_date, home, away, count(*) over () as total from games where season = 1998 and (home = 7 or away = 7) order by game_date desc, game_id desc limit 50 offset 50)"))
def history_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = tables.games(spark, sf_dir).select("game_id", "game_date", "season", "home", "away")
    return serving.history(rows, season=1998, team=7, size=50, number=1).select("game_id", "game_date", "home", "away", F.col("total"))


@query("select 'shared' as kind, count(*) as n from (select n_nationkey from nation intersect select c_nationkey from customer where c_acctbal < 1000) union all select 'unmapped', count(*) from (select c_custkey from customer except select o_custkey from orders) union all select 'either', count(*) from (select c_nationkey from customer where c_acctbal < 0 union select s_nationkey from supplier) union all select 'repeats', count(*) from (select l_orderkey, l_linenumber from lineitem except all select distinct l_orderkey, l_linenumber from lineitem)")
def set_ops(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = lambda name: tables.table(spark, sf_dir, name)
    customer, lines = t("customer"), t("lineitem").select("l_orderkey", "l_linenumber")
    parts = {
        "shared": t("nation").select("n_nationkey").intersect(customer.where("c_acctbal < 1000").select("c_nationkey")),
        "unmapped": customer.select("c_custkey").subtract(t("orders").select("o_custkey")),
        "either": customer.where("c_acctbal < 0").select("c_nationkey").union(t("supplier").select("s_nationkey")).distinct(),
        "repeats": lines.exceptAll(lines.distinct()),
    }
    out = None
    for name, part in parts.items():
        row = part.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("kind"), "n")
        out = row if out is None else out.unionByName(row)
    return out


@query("select event_id as tick_id, cast(json_extract_string(props, '$.k') as int) as k, round(try_cast(json_extract_string(props, '$.k') as double) / 7, 6) as share from events")
def json_props(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.from_json("props", "k int")["k"]
    return rounded(tables.ticks(spark, sf_dir).select("tick_id", k.alias("k"), (k / 7).alias("share")))


@query(with_(BASE, "select case when season > (select max(season) - 1 from games) then 'holdout' else 'research' end as part, count(*) as games, count(distinct season) as seasons from games group by 1"))
def holdout_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    before, after = research.split(tables.games(spark, sf_dir))
    count = lambda x, name: x.agg(F.count(F.lit(1)).alias("games"), F.countDistinct("season").alias("seasons")).select(F.lit(name).alias("part"), "games", "seasons")
    return count(before, "research").unionByName(count(after, "holdout"))


@query(with_(PREDICTED, "select case when season > (select max(season) - 1 from oos) then 'holdout' else 'research' end as part, count(*) as n, round(corr(margin, predicted_margin), 6) as margin_corr, round(corr(total, predicted_total), 6) as total_corr from oos group by 1"))
def holdout_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(research.holdout_report(frame(spark, sf_dir), {"margin": ("margin", "predicted_margin"), "total": ("total", "predicted_total")}))


@query(with_(LOG, """select game_id, '{"game_id":' || game_id || ',"pf":' || pf || ',"covered":' || coalesce(covered, 0.0) || '}' as record from log where is_home"""))
def api_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = the_log(spark, sf_dir).where("is_home").select("game_id", "pf", "covered")
    return sinks.records(rows).select(F.from_json("record", "game_id long")["game_id"].alias("game_id"), "record")


@query(with_(BASE, "cache as (select distinct venue_id from box where venue_id % 3 = 0)", "select distinct venue_id from box where venue_id not in (select venue_id from cache)"))
def incremental_fetch(spark: SparkSession, sf_dir: str) -> DataFrame:
    venues = tables.box(spark, sf_dir).select("venue_id").distinct()
    return sinks.missing_keys(venues, venues.where("venue_id % 3 = 0"), "venue_id")


@query(with_(BASE, "p as (select event_id, cast(sum(pts) as bigint) as pts, cast(sum(minutes) as bigint) as minutes from box group by 1)", "select g.game_id, p.pts, p.minutes from games g join p on p.event_id = g.game_id"))
def incremental_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Box sums by game, cached over three refreshes: early seasons, all seasons, and one that comes again."""
    g = tables.games(spark, sf_dir).select("game_id", "season")
    sums = tables.box(spark, sf_dir).groupBy(F.col("event_id").alias("game_id")).agg(F.sum("pts").alias("pts"), F.sum("minutes").alias("minutes"))
    cached = cache.Cache(spark, new_folder(spark), "game_id long, pts long, minutes long", "game_id")
    for batch, wanted in (("early", g.where("season < 1996")), ("all", g), ("early", g)):
        cached.refresh(batch, wanted, lambda missing: missing.join(sums, "game_id").select("game_id", "pts", "minutes"))
    return cached.read()


# ---------------------------------------------------------------- ratings and models: no SQL, tests hold them against plain Python


def _leagues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five leagues over the same games, one for each set of constants."""
    names = F.array(*[F.lit(x) for x in ratings.LEAGUES])
    return tables.games(spark, sf_dir).withColumn("league", F.explode(names))


@query()
def elo_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(ratings.history(_leagues(spark, sf_dir)))


@query()
def elo_entering_season(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(ratings.entering(ratings.final(ratings.history(_leagues(spark, sf_dir))), 2002))


@query()
def rating_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = _leagues(spark, sf_dir)
    return serving.rating_table(ratings.final(ratings.history(g)), tables.games(spark, sf_dir))


def _asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Games to come, three days after the last one: a team each, one of them unknown, with quoted lines and prices."""
    key = F.col("n_nationkey")
    day = tables.games(spark, sf_dir).agg(F.date_add(F.max("game_date"), 3).alias("game_date"))
    rows = tables.table(spark, sf_dir, "nation").crossJoin(F.broadcast(day))
    return rows.select(key.cast("long").alias("game_id"), "game_date", key.alias("home"), ((key + 7) % 26).alias("away"), ((key % 13) - 6.5).alias("home_line"), (key % 9 + 30.5).alias("total_line"), (1.5 + key % 10 / F.lit(10)).alias("home_close"), (2.9 - key % 10 / F.lit(10)).alias("away_close"))


@query()
def upcoming_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    now = build.as_of_now(tables.games(spark, sf_dir), "nfl")
    rows = build.upcoming(_asked(spark, sf_dir), now["current_form"], now["final_ratings"])
    return rounded(rows.select("home", "away", *[f"{s}_{c}" for s in ("home", "away") for c in ("pf10", "pa10", "won10", "ats10", "streak", "rest", "rating")]))


def _model_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Feature rows without gaps, with what scoring needs."""
    rows = build.filled(written(build.features(tables.games(spark, sf_dir))))  # of which means are taken first
    return written(rows.select("game_id", "season", "margin", "total", *build.FEATURES))


@query()
def walk_forward_gbt(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = models.walk_forward(_model_frame(spark, sf_dir), build.FEATURES)
    return rounded(out.select("game_id", "season", "margin", "predicted_margin", "total", "predicted_total"))


@query()
def permutation_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of the final models, fitted on all rows."""
    rows, targets = _model_frame(spark, sf_dir), ("margin", "total")
    found = models.permutation_importance(models.fit_final(rows, build.FEATURES, targets), rows, build.FEATURES, targets, "game_id")
    return spark.createDataFrame(found, "target string, feature string, loss double, spread double")


@query()
def score_matchups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Games to come: features as of now, the final models' predictions, and the opportunities at quoted prices."""
    made = build.build(tables.games(spark, sf_dir), "nfl")
    final = models.fit_final(made["features"], build.REGISTRY["nfl"].features, ("margin", "total"))
    scored = build.matchups(_asked(spark, sf_dir), made, final, "nfl")
    return rounded(scored.select("game_id", "home", "away", "market", "side", "line", "model_prob", "fair_prob", "price", "edge_pct", "kelly", "confidence"))


@query()
def league_deviations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The deviations of each predictor over the walk-forward sample, and the back-test on it."""
    made = build.build(tables.games(spark, sf_dir), "nfl")
    return rounded(made["residuals"].crossJoin(F.broadcast(research.fit_row(made["predictions"], made["bets"]))))


@query()
def feature_ablation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Walk-forward and back-test without and with the streaks, and the verdict of the gate on adding them."""
    frame, every = build.model_frame(tables.games(spark, sf_dir), "nhl"), build.REGISTRY["nhl"].features
    sets = [[f for f in every if not f.endswith("streak")], every]
    fits = [research.fit_row(made["predictions"], made["bets"]) for made in build.compared(frame, "nhl", sets)]
    return research.evaluated(research.side_by_side(*fits), tests=1)


# ---------------------------------------------------------------- text sources and streams


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A tagged-record text of every game with box lines: what an event file holds. The fifth and sixth lines are relief pitchers."""
    b, line = tables.box(spark, sf_dir), F.col("line_no")
    tag = F.when(line < 5, F.lit("start")).otherwise("sub")
    place = F.when(line < 5, line).when(line < 7, 1).otherwise(4)
    person = F.concat(tag, F.lit(",p"), F.col("player_id").cast("string"), F.lit(',"name, first",'), F.col("is_home").cast("int").cast("string"), F.lit(",9,"), place.cast("string"))
    earned = F.concat(F.lit("data,er,p"), F.col("player_id").cast("string"), F.lit(","), (F.col("pts") % 7).cast("string"))
    each = b.groupBy("event_id").agg(F.sort_array(F.collect_set(person)).alias("people"), F.sort_array(F.collect_set(earned)).alias("earned"))
    return each.select(F.array_join(F.concat(F.array(F.concat(F.lit("id,G"), F.col("event_id").cast("string")), F.lit("info,site,park")), "people", "earned"), "\n").alias("value"))


STARTED = "st as (select event_id, 'p' || player_id as pitcher, is_home from box where line_no = 1), home as (select event_id, max(pitcher) as pitcher from st where is_home group by 1), away as (select event_id, max(pitcher) as pitcher from st where not is_home group by 1), er as (select event_id, 'p' || player_id as pitcher, max(pts % 7) as er from box group by all)"


@query(with_(BASE, STARTED, "select 'G' || i.event_id as record_id, h.pitcher as home_starter, a.pitcher as away_starter, cast(x.er as double) as home_er, cast(y.er as double) as away_er from (select distinct event_id from box) i left join home h using (event_id) left join away a using (event_id) left join er x on x.event_id = i.event_id and x.pitcher = h.pitcher left join er y on y.event_id = i.event_id and y.pitcher = a.pitcher"))
def tagged_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{new_folder(spark)}/tagged"
    _lines(spark, sf_dir).write.text(path)
    return readers.starters(readers.tagged_records(spark, path)).select("record_id", "home_starter", "away_starter", "home_er", "away_er")


@query(with_(BASE, "select game_id, market_side, round(arg_min(price, ts), 6) as open, round(arg_max(price, ts), 6) as close from ticks group by all"))
def stream_open_close(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ticks in order of time, batch by batch; the state of a game goes five days after its last tick."""
    folder = new_folder(spark)
    for part in stateful.spans(tables.ticks(spark, sf_dir).select("tick_id", "game_id", "ts", "market_side", "price"), "ts", 4):
        part.write.mode("append").parquet(f"{folder}/in")
        stateful.drained(spark, stateful.open_close(streams.source(spark, f"{folder}/in", files=None)), folder, "update")
    return rounded(stateful.latest_prices(stateful.arrived(spark, folder, stateful.PRICES)))


@query(with_(BASE, "select date_trunc('day', ts) as window_start, market_side, count(*) as ticks, round(avg(price), 6) as mean_price from ticks group by all"))
def window_tumbling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(streams.tumbling(tables.ticks(spark, sf_dir)))


@query(with_(BASE, "select date_trunc('day', ts) - to_days(k) as window_start, market_side, count(*) as ticks, round(max(price), 6) as max_price from ticks, (values (0), (1)) t(k) group by all"))
def window_sliding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(streams.sliding(tables.ticks(spark, sf_dir)))


@query(with_(BASE, "select game_id, min(ts) as session_start, max(ts) + interval 6 hours as session_end, count(*) as ticks from (select *, sum(case when ts - prev < interval 6 hours then 0 else 1 end) over (partition by game_id order by ts, tick_id) as s from (select *, lag(ts) over (partition by game_id order by ts, tick_id) as prev from ticks)) group by game_id, s"))
def window_session(spark: SparkSession, sf_dir: str) -> DataFrame:
    return streams.sessions(tables.ticks(spark, sf_dir))
