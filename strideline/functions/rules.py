"""Domain rules as column expressions: seasons, results, shares, conversions of raw text."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F


def season_for(day: Column, league: str) -> Column:
    """Season that a date belongs to, by league."""
    year, month = F.year(day), F.month(day)
    starts = {"nfl": 7, "nba": 8, "cfb": 8}
    if league in starts:
        return F.when(month >= starts[league], year).otherwise(year - 1)
    if league == "mlb":
        return year
    if league == "nhl":
        return F.when(month > 8, year + 1).otherwise(year)
    raise ValueError(f"unknown league {league}")


def book_for(day: Column, eras: list[tuple[str, str]], last: str) -> Column:
    """Bookmaker in force on a date: eras are (first day after the era, name), in order."""
    out = F.lit(last)
    for end, name in reversed(eras):
        out = F.when(day < F.to_date(F.lit(end)), name).otherwise(out)
    return out


def mapped(key: Column, names: dict, default: Column | None = None) -> Column:
    """A literal dictionary look-up: null, or ``default``, where the key is missing."""
    found = F.try_element_at(F.create_map(*[F.lit(x) for x in chain(*names.items())]), key)
    return found if default is None else F.coalesce(found, default)


def cover_result(margin: Column, line: Column) -> Column:
    """1 home covers, 0 push, -1 not; null without a line."""
    return F.when(line.isNull(), None).when(margin > -line, 1.0).when(margin == -line, 0.0).otherwise(-1.0)


def over_result(total: Column, line: Column) -> Column:
    return F.when(line.isNull(), None).when(total > line, 1.0).when(total == line, 0.0).otherwise(-1.0)


def pythagorean(scored: Column, allowed: Column, exponent: float = 2.37) -> Column:
    top = F.pow(scored, F.lit(exponent))
    return top / F.nullif(top + F.pow(allowed, F.lit(exponent)), F.lit(0.0))


def naive_margin(hf: Column, ha: Column, af: Column, aa: Column) -> Column:
    return (hf + aa) / 2 - (af + ha) / 2


def naive_total(hf: Column, ha: Column, af: Column, aa: Column) -> Column:
    return (hf + aa) / 2 + (af + ha) / 2


def flag(text: Column) -> Column:
    """Y or N text as a boolean."""
    return F.upper(F.trim(text)) == "Y"


def number(text: Column) -> Column:
    """Bad text is null."""
    return text.try_cast("double")


def zero_as_null(x: Column) -> Column:
    return F.nullif(x, F.lit(0).cast("double"))


def finite(x: Column) -> Column:
    """NaN and infinities are null."""
    return F.when(~F.isnan(x) & (F.abs(x) != float("inf")), x)


def made_of(text: Column, mark: str) -> tuple[Column, Column]:
    """"14/35" as two numbers."""
    parts = F.split(text, mark)
    return number(F.get(parts, F.lit(0))), number(F.get(parts, F.lit(1)))


def share(part: Column, whole: Column) -> Column:
    return part / F.nullif(whole, F.lit(0).cast("double"))


def feed_price(text: Column) -> Column:
    """American price text ("+120", "-142", "EVEN") as a number."""
    return F.when(F.upper(F.trim(text)).isin("EVEN", "EV"), 100.0).otherwise(number(F.regexp_replace(F.trim(text), r"^\+", "")))


def feed_line(text: Column) -> Column:
    """Line text with an over or under mark ("o37.5") as a number."""
    return number(F.regexp_replace(F.trim(text), r"^[ouOU+]", ""))


def local_hour(ts: Column, zone: Column) -> Column:
    return F.hour(F.from_utc_timestamp(ts, zone))


def whole_days(later: Column, earlier: Column) -> Column:
    """Elapsed whole days between timestamps."""
    return F.floor((F.unix_timestamp(later) - F.unix_timestamp(earlier)) / 86400)


def theme(sides: Column, markets: Column, legs: Column) -> Column:
    """What the legs of a parlay have in common."""
    sides, markets = F.array_distinct(sides), F.array_distinct(markets)
    within = lambda *names: F.size(F.array_except(sides, F.array(*[F.lit(n) for n in names]))) == 0
    one_market = F.size(markets) == 1
    return (
        F.when((F.size(sides) == 1) & one_market, F.concat(F.lit("all "), sides[0], F.lit(" "), markets[0], F.lit("s")))
        .when(within("home", "favorite"), "all favorites")
        .when(within("away", "underdog"), "all underdogs")
        .when(one_market, F.concat(F.lit("all "), markets[0], F.lit(" bets")))
        .otherwise(F.concat(legs.cast("string"), F.lit("-leg mixed parlay")))
    )
