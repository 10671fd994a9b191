"""Queries that read and write files, and enrichments of the games. Doubles are rounded to six digits, as in their SQL."""

from __future__ import annotations

from itertools import zip_longest

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strideline.functions import odds
from strideline.operators import betting, enrich, log, ratings, research, stats, store
from strideline.queries_state import _lines
from strideline.registry import bets, frame, query, rounded, the_log
from strideline.sources import readers, sinks, tables, web
from strideline.sources.scratch import new_folder, written
from strideline.sql import BASE, BETS, LOG, PREDICTED, with_
from strideline.streaming import stateful
from strideline.streaming import ticks as streams

# ---------------------------------------------------------------- files


@query(with_(BASE, "select lpad(cast(game_id as varchar), 12, '0') as game_id, home_score, round(home_line, 6) as home_line from games"))
def csv_games(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids are text, so leading zeros stay; missing lines are empty cells."""
    path = new_folder(spark)
    g = tables.games(spark, sf_dir)
    g.select(F.lpad(F.col("game_id").cast("string"), 12, "0").alias("game_id"), "home", "home_score", "home_line").write.option("header", True).csv(path)
    return rounded(readers.csv(spark, path, "game_id string, home int, home_score long, home_line double").select("game_id", "home_score", "home_line"))


@query("select cast(l_orderkey as varchar) as game, cast(l_linenumber as varchar) as line_no, case when l_linenumber % 3 = 0 then '' else l_returnflag end as flag from lineitem")
def positional_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Header-less files without types; empty cells stay empty text."""
    path = new_folder(spark)
    rows = tables.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.when(F.col("l_linenumber") % 3 != 0, F.col("l_returnflag")).otherwise("").alias("flag"))
    rows.write.option("emptyValue", "").csv(path)
    return readers.positional(spark, [path], ["game", "line_no", "flag"]).select("game", "line_no", "flag")


@query(with_(BASE, "select distinct 'G' || event_id as record_id, 'p' || player_id as pitcher, is_home, line_no = 1 as is_start from box where line_no in (1, 5, 6)"))
def pitcher_appearances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Starters and relief pitchers of every record."""
    path = new_folder(spark)
    _lines(spark, sf_dir).write.text(path)
    return readers.appearances(readers.tagged_records(spark, path)).select("record_id", "pitcher", "is_home", "is_start")


STARTS = """starts as (select event_id as game_id, is_home, 'p' || min(lpad(player_id::varchar, 9, '0')) as pitcher from box where line_no = 1 group by all),
er as (select event_id as game_id, 'p' || lpad(player_id::varchar, 9, '0') as pitcher, cast(max(pts % 7) as double) as earned from box group by all),
dated as (select s.*, e.earned, g.game_date from starts s join er e using (game_id, pitcher) join games g using (game_id)),
rolled as (select game_id, is_home, avg(earned) over (partition by pitcher order by game_date, game_id rows between 8 preceding and 1 preceding) as q from dated)"""


@query(with_(BASE, STARTS, "select g.game_id, round(coalesce(max(q) filter (is_home), 2.6), 6) as home_quality, round(coalesce(max(q) filter (not is_home), 2.6), 6) as away_quality from games g left join rolled r using (game_id) group by 1"))
def starter_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each side's starter by earned runs in up to eight starts before the game; a neutral value where nothing is known."""
    g = tables.games(spark, sf_dir).select("game_id", F.col("game_date").alias("day"))
    b = tables.box(spark, sf_dir).select(F.col("event_id").alias("game_id"), "is_home", "line_no", F.concat(F.lit("p"), F.lpad(F.col("player_id").cast("string"), 9, "0")).alias("pitcher"), "pts")
    earned = b.groupBy("game_id", "pitcher").agg(F.max(F.col("pts") % 7).cast("double").alias("earned"))
    starts = b.where("line_no = 1").select("game_id", "is_home", "pitcher").join(earned, ["game_id", "pitcher"]).join(g, "game_id")
    return rounded(enrich.starter_quality(g.select("game_id"), starts, 2.6))


#: Events of a scoreboard page, about: a document that one worker reads whole.
PAGE = 5_000


def _feed(spark: SparkSession, sf_dir: str, period: str) -> DataFrame:
    """Scoreboard texts, a page of at most about PAGE events after the other for each period: nested events with prices as American text.

    Plain games are dealt to their page; events are made where the page is.
    """
    g = tables.games(spark, sf_dir).withColumn("period", F.date_format("game_date", period))
    most = g.groupBy("period").count().agg(F.max("count")).first()[0] or 0
    g = g.withColumn("page", F.pmod(F.xxhash64("game_id"), F.lit(1 + most // PAGE)))
    g = g.select("period", "page", "game_id", "is_neutral", "home", "away", "home_score", "away_score", "home_line", "total_line", "home_open", "home_close", "away_open", "away_close").repartition("period", "page")
    price = lambda c: F.struct(F.when(odds.decimal_to_american(c) > 0, F.concat(F.lit("+"), odds.decimal_to_american(c).cast("string"))).otherwise(odds.decimal_to_american(c).cast("string")).alias("odds"))
    quoted = lambda s: F.struct(price(f"{s}_open").alias("open"), price(f"{s}_close").alias("close"))
    side = lambda s: F.struct(F.lit(s).alias("homeAway"), F.col(f"{s}_score").cast("string").alias("score"), F.struct(F.concat(F.lit("T"), F.col(s).cast("string")).alias("abbreviation")).alias("team"), F.array(F.struct(F.struct(F.concat(F.lit("P "), F.col(s).cast("string")).alias("displayName")).alias("athlete"))).alias("probables"))
    at = lambda line, shift, p: F.struct(F.struct(F.lit(str(-108 - shift)).alias("odds"), line(shift).alias("line")).alias("open"), F.struct(F.lit(p).alias("odds"), line(0).alias("line")).alias("close"))
    spread = lambda sign: lambda shift: F.format_string("%+.1f", sign * (F.col("home_line") + shift))
    total = lambda mark: lambda shift: F.concat(F.lit(mark), (F.col("total_line") + shift).cast("string"))
    lines = F.struct(at(spread(1), 1, "-110").alias("home"), at(spread(-1), 1, "EVEN").alias("away"))
    totals = F.struct(at(total("o"), 2, "-105").alias("over"), at(total("u"), 2, "+102").alias("under"))
    odds_ = F.array(F.struct(F.struct(quoted("home").alias("home"), quoted("away").alias("away")).alias("moneyline"), lines.alias("pointSpread"), totals.alias("total")))
    game = F.struct(F.col("is_neutral").alias("neutralSite"), F.struct(F.struct((F.col("home_score") > 0).alias("completed")).alias("type")).alias("status"), F.array(side("away"), side("home")).alias("competitors"), odds_.alias("odds"))
    event = F.struct(F.col("game_id").cast("string").alias("id"), F.array(game).alias("competitions"))
    return g.groupBy("period", "page").agg(F.collect_list(event).alias("events")).select(F.to_json(F.struct("events")).alias("value"))


AMERICAN = "case when {c} >= 2 then round_even(({c} - 1) * 100, 0) when {c} > 1 then round_even(-100 / ({c} - 1), 0) end"


FEED_SQL = (
    "select cast(game_id as varchar) as event_id, home_score > 0 as completed, is_neutral, 'T' || home as home_team, 'T' || away as away_team, cast(home_score as double) as home_score, cast(away_score as double) as away_score, 'P ' || home as home_probable, 'P ' || away as away_probable, "
    + ", ".join(f"{AMERICAN.format(c=f'{s}_{at}')} as {s}_ml_{at}" for s in ("home", "away") for at in ("open", "close"))
    + ", round(home_line + 1, 6) as home_line_open, round(home_line, 6) as home_line_close, round(-(home_line + 1), 6) as away_line_open, round(-home_line, 6) as away_line_close"
    + ", -109.0::double as home_line_odds_open, -110.0::double as home_line_odds_close, -109.0::double as away_line_odds_open, 100.0::double as away_line_odds_close"
    + ", round(total_line + 2, 6) as total_open, round(total_line, 6) as total_close, -110.0::double as over_odds_open, -105.0::double as over_odds_close, -110.0::double as under_odds_open, 102.0::double as under_odds_close from games"
)


@query(with_(BASE, FEED_SQL))
def feed_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON arrays become rows: sides by their mark, all prices and lines as numbers, probable starters."""
    path = new_folder(spark)
    _feed(spark, sf_dir, "yyyyMMdd").write.option("compression", "gzip").text(path)
    return rounded(readers.feed_events(spark.read.text(path)).drop("starts", "season_type"))


def _names(spark: SparkSession, path: str) -> list[dict]:
    """What a connector is asked for: the documents in a folder, by name."""
    return [{"name": r[0]} for r in spark.read.text(path).select("_metadata.file_name").distinct().collect()]


@query(with_(BASE, FEED_SQL))
def feed_over_the_web(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scoreboards of a month each, in pages where it has many games, fetched by the connector, a partition each; one that isn't there has no events."""
    path = new_folder(spark)
    _feed(spark, sf_dir, "yyyyMM").write.option("maxRecordsPerFile", 1).text(path)
    found = web.read(spark, web.Documents, f"{web.url_of(path)}/{{name}}", [*_names(spark, path), {"name": "missing"}])
    return rounded(readers.feed_events(found).drop("starts", "season_type"))


@query("select n_nationkey as team, 'S ' || n_nationkey as starter, n_nationkey % 3 = 0 as is_out from nation")
def starter_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first of the depth chart, found in the roster by id, with the state of injuries."""
    key = F.col("n_nationkey")
    person = lambda i, name, status: F.format_string('{"id":"%s","displayName":"%s","position":{"abbreviation":"QB"},"injuries":[{"status":"%s"}]}', i, name, status)
    first = person(key.cast("string"), F.concat(F.lit("S "), key.cast("string")), F.when(key % 3 == 0, "Out").otherwise("Active"))
    roster = F.concat(F.lit('{"athletes":[{"items":['), person(F.lit("x"), F.lit("Other"), F.lit("Out")), F.lit(","), first, F.lit("]}]}"))
    depth = F.format_string('{"depthchart":[{"positions":{"qb":{"athletes":[{"id":"%s"}]}}}]}', key.cast("string"))
    rows = tables.table(spark, sf_dir, "nation").select(key.alias("team"), roster.alias("roster"), depth.alias("depth"))
    return readers.starter_status(rows, "QB")


@query("select r_regionkey as key, r_name as name, round(r_regionkey / 4, 6) as part from region")
def workbook_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A workbook's sheet, read where its file is."""
    path = new_folder(spark)
    rows = tables.table(spark, sf_dir, "region").select(F.col("r_regionkey").cast("double").alias("key"), F.col("r_name").alias("name"), (F.col("r_regionkey") / 4).alias("part"))
    sinks.workbook(rows, path)
    return rounded(readers.workbook(spark, path, "key double, name string, part double", "Data").withColumn("key", F.col("key").cast("int")))


@query(with_(BASE, "select market_side, count(*) as n, max(tick_id) as last_tick from ticks where ts >= (select max(ts) - interval 10 days from ticks) group by 1"))
def decisions_since(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An append-only JSON log, written in two parts, read from a time on."""
    path = new_folder(spark)
    t = tables.ticks(spark, sf_dir).select("tick_id", "market_side", "ts")
    sinks.append_log(t.where("tick_id % 2 = 0"), path)
    sinks.append_log(t.where("tick_id % 2 = 1"), path)
    rows = readers.json_log(spark, path, "tick_id long, market_side string, ts timestamp")
    since = rows.agg((F.max("ts") - F.expr("interval 10 days")).alias("since"))
    return store.since(rows, since, "ts").groupBy("market_side").agg(F.count(F.lit(1)).alias("n"), F.max("tick_id").alias("last_tick"))


@query(with_(BASE, "select season, count(*) as games, cast(sum(home_score) as bigint) as points from games group by 1"))
def versioned_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The second version of a table; its first stays readable."""
    path = new_folder(spark)
    g = tables.games(spark, sf_dir).groupBy("season").agg(F.count(F.lit(1)).alias("games"), F.sum("home_score").alias("points"))
    sinks.write_version(g.where("season < 1996"), path, 1)
    sinks.write_version(g, path, 2)
    return sinks.read_version(spark, path, 2)


@query(with_(BASE, """select cast(season as varchar) as run, '{"games": ' || count(*) || ', "last": "' || max(game_date) || '", "points": ' || sum(home_score) || ', "run": "' || season || '"}' as line from games group by season"""))
def run_manifests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A manifest line of each season's build."""
    made = tables.games(spark, sf_dir).groupBy("season").agg(F.count(F.lit(1)).alias("games"), F.max("game_date").alias("last"), F.sum("home_score").alias("points"))
    lines = [(str(r["season"]), sinks.manifest(str(r["season"]), {k: r[k] for k in ("games", "last", "points")})) for r in made.collect()]
    return spark.createDataFrame(lines, "run string, line string")


REPORT = """t as (select season, count(*) as games, avg(home_line) as mean_line from games where home_line is not null or season > 1996 group by 1),
body as (select row_number() over (order by season) + 6 as place, '| ' || season || ' | ' || games || ' | ' || coalesce(format('{:.3f}', mean_line), '–') || ' |' as line from t)"""


@query(with_(BASE, REPORT, "select cast(place as int) as place, line from body union all select * from (values (1, '# Seasons'), (2, ''), (3, '## Lines'), (4, ''), (5, '| season | games | mean_line |'), (6, '| - | - | - |')) h(place, line)"))
def markdown_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A report of a summary table, line by line."""
    g = tables.games(spark, sf_dir).where("home_line is not null or season > 1996")
    table = g.groupBy("season").agg(F.count(F.lit(1)).alias("games"), F.avg("home_line").alias("mean_line")).orderBy("season")
    lines = sinks.markdown("Seasons", {"Lines": table}).splitlines()
    return spark.createDataFrame([(i, x) for i, x in enumerate(lines, 1)], "place int, line string")


# ---------------------------------------------------------------- enrichment


STADIUMS = "s as (select n_nationkey as team, round(30 + n_nationkey / 7.0::double, 3) as lat, round(-120 + n_nationkey / 3.0::double, 3) as lon, n_nationkey % 5 = 0 as is_dome from nation)"
WEATHER = "w as (select distinct s.lat, s.lon, day, cast((s.team * 7 + dayofyear(day)) % 90 as double) as temp, cast((s.team + day(day)) % 30 as double) as wind from s, (select distinct game_date as day from games where dayofyear(game_date) % 4 <> 0))"


@query(with_(BASE, STADIUMS, WEATHER, "select game_id, coalesce(s.is_dome, false) as is_dome, case when s.is_dome then 65.0::double else coalesce(temp, 65.0::double) end as temp, case when s.is_dome then 5.0::double else coalesce(wind, 5.0::double) end as wind from games g left join s on s.team = g.home left join w on w.lat = s.lat and w.lon = s.lon and w.day = g.game_date"))
def weather(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weather by rounded place and day, fetched by the connector, a partition for each place; domes and gaps get neutral values."""
    g, key, path = tables.games(spark, sf_dir), F.col("n_nationkey"), new_folder(spark)
    stadiums = tables.table(spark, sf_dir, "nation").select(key.alias("team"), (30 + key / 7).alias("lat"), (-120 + key / 3).alias("lon"), (key % 5 == 0).alias("is_dome"))
    # The archive's document of a place: every day of the games' range but some, as the service would give it.
    low, high = g.agg(F.min("game_date"), F.max("game_date")).first()
    days = F.filter(F.sequence(F.lit(low), F.lit(high)), lambda d: F.dayofyear(d) % 4 != 0)
    daily = F.struct(
        F.transform(days, lambda d: d.cast("string")).alias("time"),
        F.transform(days, lambda d: ((F.col("team") * 7 + F.dayofyear(d)) % 90).cast("double")).alias("temperature_2m_max"),
        F.transform(days, lambda d: ((F.col("team") + F.dayofmonth(d)) % 30).cast("double")).alias("wind_speed_10m_max"),
    )
    stadiums.select("lat", "lon", F.to_json(F.struct(daily.alias("daily"))).alias("value")).repartition("lat", "lon").write.partitionBy("lat", "lon").option("maxRecordsPerFile", 1).text(path)
    files = spark.read.option("basePath", path).text(path).select("lat", "lon", F.col("_metadata.file_path").alias("url")).distinct().collect()
    archive = web.read(spark, web.Weather, "{url}", [{"lat": r["lat"], "lon": r["lon"], "url": r["url"]} for r in files])
    values = archive.select("lat", "lon", "day", F.col("temp_max").alias("temp"), "wind")
    return enrich.weather(g.select("game_id", F.col("home").alias("team"), F.col("game_date").alias("day")), stadiums, values, {"temp": 65.0, "wind": 5.0}).select("game_id", "is_dome", "temp", "wind")


@query(with_(LOG, "p as (select event_id as game_id, is_home, cast(sum(pts) as bigint) as pts from box group by all)", "select l.game_id, l.team, l.is_home, p.pts from log l join p on p.game_id = l.game_id and p.is_home = l.is_home"))
def own_side(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Box sums joined to the team log: of both sides' rows each team keeps its own."""
    sums = tables.box(spark, sf_dir).groupBy(F.col("event_id").alias("game_id"), "is_home").agg(F.sum("pts").alias("pts"))
    return enrich.own_side(the_log(spark, sf_dir).select("game_id", "team", "is_home"), sums, ["game_id"], "is_home")


ENRICHED = """old as (select game_id, home, away, game_date, margin, total, case when game_id % 3 <> 0 then home_line end as home_line, total_line from games where game_id % 5 <> 0),
extra as (select game_id + 1000000000 as extra_id, home, away, game_date - 1 + cast(game_id % 2 as int) as day, home_line as line, margin, total from games where game_id % 4 <> 0),
near as (select o.game_id, e.extra_id, cast(o.game_date - e.day as int) as delta, dense_rank() over (order by o.game_date, o.game_id) as ord from old o join extra e on o.home = e.home and o.away = e.away and o.game_date between e.day and e.day + 1),
rounds as (select *, 0 as round from near union all
 select game_id, extra_id, delta, ord, round + 1 from (select *, sum(cast(lost as int)) over () as losses from (
  select *, coalesce(ord > min(case when k = 1 then ord end) over (partition by extra_id), false) as lost from (select *, row_number() over (partition by game_id order by delta, extra_id) as k from rounds)))
 where losses > 0 and not lost),
matched as (select game_id, extra_id from (select *, row_number() over (partition by game_id order by delta, extra_id) as k from rounds where round = (select max(round) from rounds)) where k = 1),
filled as (select o.game_id, coalesce(o.home_line, e.line) as home_line, o.margin, o.home_line is null and e.line is not null as was_filled from old o left join matched m using (game_id) left join extra e using (extra_id)
 union all select extra_id, line, margin, false from extra where extra_id not in (select extra_id from matched))"""


@query(with_("recursive " + BASE, ENRICHED, "select game_id, home_line, was_filled, case when home_line is null then null when margin > -home_line then 1.0::double when margin = -home_line then 0.0::double else -1.0::double end as covers from filled"))
def source_enrichment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A second source fills missing lines of matched games, its other games are appended, and results follow the new lines."""
    g = tables.games(spark, sf_dir)
    key = F.col("game_id")
    old = g.where(key % 5 != 0).select("game_id", "home", "away", "game_date", "margin", "total", F.when(key % 3 != 0, F.col("home_line")).alias("home_line"), "total_line")
    extra = g.where(key % 4 != 0).select((key + 1_000_000_000).alias("extra_id"), "home", "away", F.date_add(F.date_sub("game_date", 1), (key % 2).cast("int")).alias("day"), F.col("home_line").alias("line"), "margin", "total")
    return rounded(enrich.second_source(old, extra).select("game_id", "home_line", "was_filled", "covers"))


@query(with_(LOG, "select team, game_id, is_home, count(*) over w as n, round(avg(pf) over w, 6) as mean_pf from log window w as (partition by team, is_home order by game_date, is_home desc, game_id rows between unbounded preceding and current row)"))
def expanding_inclusive(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean and count so far, the row itself included, by team and venue."""
    w = log.team_window("is_home").rowsBetween(Window.unboundedPreceding, 0)
    return rounded(the_log(spark, sf_dir).select("team", "game_id", "is_home", F.count(F.lit(1)).over(w).alias("n"), F.avg("pf").over(w).alias("mean_pf")))


@query(with_(BASE, "select home, count(*) as n, min(game_date) as first_day, max(game_date) as last_day, round(sum(home_score) / (select sum(home_score) from games), 6) as league_share from games where home_score > 0 or away_score > 0 group by 1"))
def league_constants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Games that were played (no 0-0 rows), date ranges by team, and each team's share of a ratio of sums over the league."""
    g = tables.games(spark, sf_dir)
    whole = F.broadcast(g.agg(F.sum("home_score").alias("whole")))
    played = g.where("home_score > 0 or away_score > 0").groupBy("home").agg(F.count(F.lit(1)).alias("n"), F.min("game_date").alias("first_day"), F.max("game_date").alias("last_day"), F.sum("home_score").alias("s"))
    return rounded(played.crossJoin(whole).select("home", "n", "first_day", "last_day", (F.col("s") / F.col("whole")).alias("league_share")))


LADDER = """f as (select season, corr(margin, predicted_margin) as m, corr(total, predicted_total) as t from oos group by 1),
b as (select season, sum(profit) / count(*) * 100 as roi, stddev_samp(profit) / sqrt(count(*)) * 100 as err from (select season, case when sign(margin) = sign(predicted_margin) then 0.909::double else -1.0::double end as profit from oos) group by 1),
r as (select x.season, y.m - x.m as dm, y.t - x.t as dt, v.roi - u.roi as dr, u.err as err from f x join f y on y.season = x.season + 1 join b u on u.season = x.season join b v on v.season = y.season),
n as (select *, abs(dr) < err * {bar}::double as noise, dm > 0.005 or dt > 0.005 as better, dm < -0.005 or dt < -0.005 as worse from r)"""


@query(with_(PREDICTED, LADDER.format(bar=research.bonferroni(13)), "select season, noise as within_noise, dr > 0 and not better and not noise as suspicious, case when (dr > 0 and not better and not noise) or worse then 'reject' when better and dr >= 0 then 'adopt' when noise and (not better or dr < 0) then 'adopt_cautiously' else 'inconclusive' end as recommendation from n"))
def hypothesis_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each season's fit against the next one's through the gate, as the 13th test of a family."""
    f = written(frame(spark, sf_dir).select("season", "margin", "total", "predicted_margin", "predicted_total"))
    won = F.when(F.signum("margin") == F.signum("predicted_margin"), 0.909).otherwise(-1.0)
    n = F.count(F.lit(1))
    runs = written(f.groupBy("season").agg(F.corr("margin", "predicted_margin").alias("margin_corr"), F.corr("total", "predicted_total").alias("total_corr"), (F.avg(won) * 100).alias("roi"), (F.stddev_samp(won) / F.sqrt(n) * 100).alias("roi_stderr")))
    values = ["margin_corr", "total_corr", "roi", "roi_stderr"]
    before = runs.select("season", *[F.col(c).alias(f"{c}_before") for c in values])
    after = runs.select((F.col("season") - 1).alias("season"), *[F.col(c).alias(f"{c}_after") for c in values])
    return research.evaluated(before.join(after, "season"), tests=13).select("season", "within_noise", "suspicious", "recommendation")


@query(with_(BETS, "select market, count(*) as n, round(sum(profit), 6) as profit, cast(sum(case when result is null then 1 else 0 end) as bigint) as waiting from (select b.market, case when b.game_id % 3 <> 0 then b.result end as result, case when b.game_id % 3 <> 0 then b.profit else 0 end as profit from bets b) group by 1"))
def settled_later(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Picks wait for results that arrive later; what has none stays open."""
    b = written(bets(spark, sf_dir).select("game_id", "market", "side", "profit", "result"))
    picks, results = b.select("game_id", "market", "side"), b.where("game_id % 3 <> 0")
    joined = picks.join(results, ["game_id", "market", "side"], "left")
    return rounded(joined.groupBy("market").agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("profit"), F.lit(0.0)).alias("profit"), F.count_if(F.col("result").isNull()).alias("waiting")))


@query(with_(BASE, "p as (select game_id, game_date + interval 12 hours as picked_at, home_win from games)", "select game_id, home_win from p"))
def stream_settlement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Picks and results as two streams that meet by game within a bounded time."""
    folder = new_folder(spark)
    g = tables.games(spark, sf_dir)
    g.select("game_id", (F.col("game_date").cast("timestamp") + F.expr("interval 12 hours")).alias("picked_at")).write.parquet(f"{folder}/picks")
    g.select("game_id", (F.col("game_date").cast("timestamp") + F.expr("interval 2 days")).alias("ended_at"), "home_win", "margin", "total").write.parquet(f"{folder}/results")
    read = lambda name: spark.readStream.schema(spark.read.parquet(f"{folder}/{name}").schema).parquet(f"{folder}/{name}")
    joined = streams.settlement(read("picks"), read("results")).select("game_id", "home_win")
    joined.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state").outputMode("append").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema("game_id long, home_win int").parquet(f"{folder}/out")


@query()
def live_ratings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ratings stored at the end of history, moved on by the games since, which arrive in three batches."""
    folder = new_folder(spark)
    g = tables.games(spark, sf_dir).withColumn("league", F.explode(F.array(*[F.lit(x) for x in ratings.LEAGUES])))
    stored = written(ratings.final(ratings.history(g.where("season < 1999"))))
    for part in stateful.spans(g.where("season >= 1999"), "game_date", 3):
        part.write.mode("append").parquet(f"{folder}/in")
        games = spark.readStream.schema(g.schema).parquet(f"{folder}/in")
        live = stateful.live_ratings(spark, games, stored, folder)
    return rounded(live)


PLACED = "legs as (select cast(game_date - date '1970-01-01' as bigint) * 5 + game_id % 5 as parlay_id, game_id, market, side, price, case when game_id % 11 <> 0 then result end as result from bets)"


@query(with_(BETS, PLACED, "select parlay_id, cast(legs as int) as legs, cast(result as int) as result, round(case result when 1 then payout - 1 when 0 then 0 else -1 end, 6) as profit from (select parlay_id, count(*) as legs, case when count(*) filter (result = -1) > 0 then -1 when count(*) filter (result = 1) = 0 then 0 else 1 end as result, coalesce(product(price) filter (result = 1), 1) as payout, count(result) as done from legs group by 1) where done = legs"))
def stream_parlays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parlays as a stream: legs meet their games' results, and a parlay is settled when its last leg is. Both over several batches."""
    folder = new_folder(spark)
    b = written(bets(spark, sf_dir).select("game_id", "game_date", "market", "side", "line", "price", "home_win", "margin", "total"))
    day = F.unix_date("game_date").cast("long")
    legs = b.select((day * 5 + F.col("game_id") % 5).alias("parlay_id"), "game_id", "market", "side", "line", "price", "game_date")
    size = legs.groupBy("parlay_id").agg(F.count(F.lit(1)).alias("n_legs"))
    at = F.col("game_date").cast("timestamp")
    picks = written(legs.join(size, "parlay_id").select("*", (F.col("game_date").cast("timestamp") + F.expr("interval 12 hours")).alias("picked_at")).drop("game_date"))
    results = written(b.where("game_id % 11 <> 0").select("game_id", (at + F.make_interval(days=(1 + F.col("game_id") % 3).cast("int"))).alias("ended_at"), "home_win", "margin", "total").distinct())
    for name, rows in (("picks", picks), ("results", results)):  # a stream's folder is there before it starts
        rows.limit(0).write.parquet(f"{folder}/{name}")
    read = lambda name, rows: spark.readStream.schema(rows.schema).parquet(f"{folder}/{name}")
    joined = betting.settled(streams.settlement(read("picks", picks), read("results", results)))
    decided = joined.select("parlay_id", F.concat_ws("|", F.col("game_id").cast("string"), "market", "side").alias("leg"), F.col("n_legs").cast("int").alias("n_legs"), "price", "result", "ended_at")
    for some, ended in zip_longest(stateful.spans(picks, "picked_at", 3), stateful.spans(results, "ended_at", 4)):
        for name, rows in (("picks", some), ("results", ended)):
            if rows is not None:
                rows.write.mode("append").parquet(f"{folder}/{name}")
        stateful.drained(spark, decided, f"{folder}/decided")
    told = stateful.arrived(spark, f"{folder}/decided", "parlay_id long, leg string, n_legs int, price double, result int, ended_at timestamp")
    for part in stateful.spans(told, "ended_at", 4):
        part.write.mode("append").parquet(f"{folder}/told")
        stateful.drained(spark, stateful.parlays(read("told", told)), f"{folder}/parlays")
    out = stateful.arrived(spark, f"{folder}/parlays", stateful.PARLAYS)
    return rounded(out.where("result is not null").select("parlay_id", "legs", "result", "profit"))


@query(with_(PREDICTED, "select count(*) as n, round(corr(margin, predicted_margin), 6) as margin_corr, round(avg(abs(margin - predicted_margin)), 6) as margin_mae from oos"))
def overall_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(stats.fit(frame(spark, sf_dir), {"margin": ("margin", "predicted_margin")}))
