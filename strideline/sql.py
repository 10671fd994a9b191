"""SQL of the shared steps, for the statements that check the queries."""

from __future__ import annotations

from strideline.functions.odds import ERF_A, ERF_P
from strideline.sources.tables import FLAT

BASE = """games as (
 select *, cast(margin > 0 as int) as home_win,
  case when home_line is null then null when margin > -home_line then 1.0::double when margin = -home_line then 0.0::double else -1.0::double end as covers,
  case when total_line is null then null when total > total_line then 1.0::double when total = total_line then 0.0::double else -1.0::double end as "over"
 from (select *, home_score - away_score as margin, home_score + away_score as total from (
  select o_orderkey as game_id, cast(o_orderdate as date) as game_date, cast(year(o_orderdate) as int) as season, c_nationkey as home,
   cast((c_nationkey + 1 + o_orderkey % 24) % 25 as int) as away,
   cast(floor(o_totalprice) as bigint) % 41 as home_score, cast(floor(o_totalprice / 7) as bigint) % 38 as away_score,
   o_orderpriority = '1-URGENT' as is_playoff, o_orderstatus = 'P' as is_neutral,
   case when o_orderkey % 10 <> 0 then cast((o_orderkey % 29) - 14 as double) / 2 end as home_line,
   case when o_orderkey % 10 <> 0 then 30 + cast(o_orderkey % 21 as double) / 2 end as total_line,
   1.0::double / (p * 1.045::double) as home_close, 1.0::double / (q * 1.045::double) as away_close,
   1.0::double / (least(0.95::double, greatest(0.05::double, p + moved)) * 1.045::double) as home_open,
   1.0::double / (least(0.95::double, greatest(0.05::double, q - moved)) * 1.045::double) as away_open
  from (select *, (20 + (o_orderkey * 37) % 61) / 100.0::double as p, (80 - (o_orderkey * 37) % 61) / 100.0::double as q, ((o_orderkey % 7) - 3) / 100.0::double as moved
   from orders join customer on o_custkey = c_custkey)))),
box as (
 select l_orderkey as event_id, l_suppkey as player_id, l_partkey as venue_id, l_linenumber % 2 = 1 as is_home, l_linenumber as line_no,
  cast(l_quantity as int) as minutes, cast(floor(l_extendedprice) as bigint) % 40 as pts,
  cast(cast(floor(l_extendedprice) as bigint) % 15 as varchar) || '/' || cast(cast(floor(l_extendedprice) as bigint) % 15 + cast(l_quantity as bigint) % 20 as varchar) as comp_att,
  cast(l_shipdate as date) as day from lineitem),
ticks as (
 select event_id as tick_id, cast(user_id as bigint) as game_id, ts,
  case event_type when 'view' then 'moneyline_home' when 'click' then 'moneyline_away' when 'signup' then 'spread_home' when 'purchase' then 'total_over' else 'total_under' end as market_side,
  case when event_type = 'error' and event_id % 5 = 0 then null else 1.2::double + cast(cast(floor(value * 100) as bigint) % 380 as double) / 100.0::double end as price, props
 from events)"""

LOG = BASE + """,
log as (
 select game_id, game_date, season, "over", home as team, away as opponent, true as is_home, home_score as pf, away_score as pa, covers as covered, home_win as won, (covers + 1) / 2 as ats from games
 union all
 select game_id, game_date, season, "over", away, home, false, away_score, home_score, -covers + 0.0, 1 - home_win, (-covers + 1) / 2 from games)"""

_W = "partition by team order by game_date, is_home desc, game_id"
FORM = LOG + f""",
form as (
 select *, coalesce(lag(streak_now) over ({_W}), 0) as streak, cast(coalesce(game_date - lag(game_date) over ({_W}), 7) as int) as rest from (
  select *, cast(case when won = 1 then 1 else -1 end * row_number() over (partition by team, island order by game_date, is_home desc, game_id) as int) as streak_now,
   avg(pf) over w as pf10, avg(pa) over w as pa10, avg(won) over w as won10, avg(ats) over w as ats10
  from (select *, sum(case when won = prev then 0 else 1 end) over ({_W}) as island from (select *, lag(won) over ({_W}) as prev from log))
  window w as ({_W} rows between 10 preceding and 1 preceding)))"""

FEATURES = """,
feats as (
 select g.*, h.pf10 as home_pf10, h.pa10 as home_pa10, h.won10 as home_won10, h.ats10 as home_ats10, h.streak as home_streak, h.rest as home_rest,
  a.pf10 as away_pf10, a.pa10 as away_pa10, a.won10 as away_won10, a.ats10 as away_ats10, a.streak as away_streak, a.rest as away_rest
 from games g join form h on g.game_id = h.game_id and h.is_home join form a on g.game_id = a.game_id and not a.is_home)"""

PREDICTED = FORM + FEATURES + """,
oos as (
 select *, gap * 25 / 2 as rating_diff, 0.4::double * gap + 1.5::double as predicted_margin, 0.9::double * naive_total + 4.0::double as predicted_total
 from (select *, (home_pf10 - home_pa10) - (away_pf10 - away_pa10) as gap, (home_pf10 + away_pa10 + away_pf10 + home_pa10) / 2 as naive_total from feats)
 where gap is not null),
stds as (
 select stddev_samp(margin - rating_diff / 25) as elo_margin_std, stddev_samp(margin - predicted_margin) as ml_margin_std,
  stddev_samp(total - predicted_total) as ml_total_std, stddev_samp(total - naive_total) as naive_total_std from oos)"""


def cdf(x: str, mean: str, std: str) -> str:
    """SQL of the normal distribution function, by the same polynomial."""
    z = f"(({x} - {mean}) / ({std} * sqrt(2::double)))"
    t = f"(1 / (1 + {ERF_P}::double * abs{z}))"
    poly = "0::double"
    for a in reversed(ERF_A):
        poly = f"(({poly} + {a}::double) * {t})"
    return f"(0.5::double * (1 + sign{z} * (1 - {poly} * exp(-{z} * {z}))))"


def devig(a: str, b: str) -> str:
    return f"((1 / {a}) / (1 / {a} + 1 / {b}))"


def with_(*parts: str) -> str:
    """A statement of named steps and a last select."""
    return "with " + ", ".join(parts[:-1]) + " " + parts[-1]


def _opps(price: str) -> str:
    elo = "(rating_diff / 25)"
    probs = f"""
 select *, 1 - {cdf('0.0', elo, 'elo_margin_std')} as me, 1 - {cdf('0.0', 'predicted_margin', 'ml_margin_std')} as mm,
  1 - {cdf('-home_line', elo, 'elo_margin_std')} as se, 1 - {cdf('-home_line', 'predicted_margin', 'ml_margin_std')} as sm,
  1 - {cdf('total_line', 'predicted_total', 'ml_total_std')} as te, 1 - {cdf('total_line', 'naive_total', 'naive_total_std')} as tm
 from oos, stds"""
    rows = []
    for market, sides, one, two, a, b, lines, there in (
        ("moneyline", ("home", "away"), "me", "mm", f"home_{price}", f"away_{price}", ("null::double", "null::double"), "true"),
        ("spread", ("home", "away"), "se", "sm", f"{FLAT}::double", f"{FLAT}::double", ("home_line", "-home_line + 0.0"), "home_line is not null"),
        ("total", ("over", "under"), "te", "tm", f"{FLAT}::double", f"{FLAT}::double", ("total_line", "total_line"), "total_line is not null"),
    ):
        for i, side in enumerate(sides):
            p = f"(0.5::double * {one} + 0.5::double * {two})"
            rows.append(f"select game_id, game_date, season, home, away, margin, total, home_win, home_close, away_close, '{market}' as market, '{side}' as side, {lines[i]} as line, {p if i == 0 else '1 - ' + p} as model_prob, {devig(a, b) if i == 0 else devig(b, a)} as fair_prob, {a if i == 0 else b} as price, case when ({one} - 0.5) * ({two} - 0.5) <= 0 then 'Low' when abs({one} - {two}) <= 0.05 then 'High' when abs({one} - {two}) <= 0.12 then 'Medium' else 'Low' end as confidence from probs where {there}")
    return f""",
probs as ({probs}),
opps as (select *, (model_prob - fair_prob) * 100 as edge_pct, model_prob * (price - 1) - (1 - model_prob) as ev,
 greatest(0::double, ((price - 1) * model_prob - (1 - model_prob)) / (price - 1)) * 0.25::double as kelly,
 cast(case market when 'moneyline' then case when (side = 'home') = (home_win = 1) then 1 else -1 end
  when 'spread' then sign(case when side = 'home' then margin + line else line - margin end)
  else sign(case when side = 'over' then total - line else line - total end) end as int) as result
 from ({' union all '.join(rows)}))"""


OPPS = PREDICTED + _opps("close")
PROFIT = "case when result = 0 then 0.0::double when result = 1 then price - 1 else -1.0::double end"
BETS = PREDICTED + _opps("open") + f""",
bets as (select *, {PROFIT} as profit, (1 - c / price) * 100 as clv,
 case when edge_pct < 5 then '3-5%' when edge_pct < 10 then '5-10%' when edge_pct < 20 then '10-20%' else '20%+' end as edge_bucket
 from (select *, case when market <> 'moneyline' then {FLAT}::double when side = 'home' then home_close else away_close end as c from opps
  where edge_pct >= 3 and confidence in ('Medium', 'High')))"""
SUMMARY = """count(*) as bets, round(sum(cast(result = 1 as int)) / nullif(cast(sum(cast(result <> 0 as int)) as double), 0), 6) as hit_rate,
 round(sum(profit) / count(*) * 100, 6) as roi_pct, round(case when count(*) >= 2 then stddev_samp(profit) / sqrt(count(*)) * 100 end, 6) as roi_stderr_pct,
 round(avg(edge_pct), 6) as avg_edge_pct, round(avg(clv), 6) as avg_clv_pct, round(case when count(clv) > 0 then sum(cast(clv > 0 as int)) / count(*)::double end, 6) as pct_positive_clv"""
