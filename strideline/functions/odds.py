"""Odds arithmetic as column expressions. Missing or impossible prices give null, never NaN."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

Cell = Column | str
#: Beyond this a double can't hold the exponential.
EXP_MOST = 709.78


def _c(x: Cell) -> Column:
    return F.col(x) if isinstance(x, str) else x


def american_to_decimal(a: Cell) -> Column:
    a = _c(a)
    return F.when(a > 0, 1 + a / 100.0).when(a < 0, 1 + 100.0 / F.abs(a))


def decimal_to_american(d: Cell) -> Column:
    """Whole American price, halves to even; null for prices of 1 or less."""
    d = _c(d)
    return F.when(d >= 2, F.bround((d - 1) * 100)).when(d > 1, F.bround(-100 / (d - 1))).cast("long")


def implied_prob(d: Cell) -> Column:
    d = _c(d)
    return F.when(d > 1, 1 / d)


def devig(a: Cell, b: Cell) -> tuple[Column, Column]:
    """Fair probabilities of both sides: implied probabilities over their sum."""
    pa, pb = implied_prob(a), implied_prob(b)
    return pa / (pa + pb), pb / (pa + pb)


def vig_pct(a: Cell, b: Cell) -> Column:
    return (implied_prob(a) + implied_prob(b) - 1) * 100


def expected_value(p: Cell, d: Cell, stake: float = 1.0) -> Column:
    p, d = _c(p), _c(d)
    return p * (d - 1) * stake - (1 - p) * stake


def edge_over_price(p: Cell, d: Cell) -> Column:
    """Percentage points over the break-even probability of the raw price."""
    return (_c(p) - implied_prob(d)) * 100


def edge_over_fair(p: Cell, fair: Cell) -> Column:
    """Percentage points over the devigged probability."""
    return (_c(p) - _c(fair)) * 100


def kelly(p: Cell, d: Cell, fraction: float = 0.25) -> Column:
    p, b = _c(p), _c(d) - 1
    return F.when(b <= 0, 0.0).otherwise(F.greatest(F.lit(0.0), (b * p - (1 - p)) / b) * fraction)


def clv_pct(taken: Cell, close: Cell) -> Column:
    """Closing line value: how much more the taken price pays than the closing price."""
    taken, close = _c(taken), _c(close)
    return F.when((taken > 1) & (close > 1), (1 / close - 1 / taken) * 100 / (1 / close))


#: Coefficients of formula 7.1.26 of Abramowitz and Stegun for erf; its error is below 1.5e-7.
ERF_P = 0.3275911
ERF_A = (0.254829592, -0.284496736, 1.421413741, -1.453152027, 1.061405429)


def erf(x: Column) -> Column:
    t = 1 / (1 + ERF_P * F.abs(x))
    poly = F.lit(0.0)
    for a in reversed(ERF_A):
        poly = (poly + a) * t
    return F.signum(x) * (1 - poly * F.exp(-x * x))


def normal_cdf(x: Cell, mean: Cell, std: Cell) -> Column:
    """P(N(mean, std) <= x); a step where std is not positive."""
    x, mean, std = _c(x), _c(mean), _c(std)
    return F.when(std > 0, 0.5 * (1 + erf((x - mean) / (std * 2**0.5)))).when(std.isNotNull(), F.when(x >= mean, 1.0).otherwise(0.0))


def cover_prob(margin: Cell, std: Cell, line: Cell) -> Column:
    """P(margin > -line) for a predicted home margin."""
    return 1 - normal_cdf(-_c(line), margin, std)


def over_prob(total: Cell, std: Cell, line: Cell) -> Column:
    return 1 - normal_cdf(line, total, std)


def blend(a: Cell, b: Cell, weight: float = 0.5) -> Column:
    return weight * _c(a) + (1 - weight) * _c(b)


def confidence_tier(a: Cell, b: Cell) -> Column:
    """Agreement of two models: on different sides of a half Low; else by their gap."""
    a, b = _c(a), _c(b)
    gap = F.abs(a - b)
    return F.when((a - 0.5) * (b - 0.5) <= 0, "Low").when(gap <= 0.05, "High").when(gap <= 0.12, "Medium").otherwise("Low")


def edge_bucket(edge: Cell) -> Column:
    edge = _c(edge)
    return F.when(edge < 5, "3-5%").when(edge < 10, "5-10%").when(edge < 20, "10-20%").otherwise("20%+")


def other_side(price: Cell, overround: float = 1.045) -> Column:
    """The price of the other side of a two-way market of which one side is known, at an assumed overround."""
    rest = overround - implied_prob(price)
    return F.when(rest > 0, 1 / rest)


def two_way(price: Cell, overround: float = 1.045) -> Column:
    """Fair probability of a side with a known price, at an assumed overround."""
    return implied_prob(price) / overround


def logistic(x: Column) -> Column:
    """1 / (1 + exp(-x)), with the exponential of the C library, as databases use it: Java's own differs in the last bit of a
    few values in a hundred, which moves ties at the edge of a bin."""

    @F.pandas_udf("double")
    def power(values: pd.Series) -> pd.Series:
        return pd.Series([math.inf if v > EXP_MOST else math.exp(v) for v in values.tolist()], dtype="float64")

    return 1 / (1 + F.when(x.isNotNull(), power(-x.cast("double"))))
