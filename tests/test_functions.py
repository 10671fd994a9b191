"""Scalar functions on known values, and as-of joins on ties and edges."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F
from strideline.functions import odds
from strideline.operators import joins


def one(spark, *columns) -> tuple:
    return tuple(spark.range(1).select(*columns).first())


def test_prices(spark):
    lit = F.lit
    got = one(spark, odds.american_to_decimal(lit(150.0)), odds.american_to_decimal(lit(-200.0)), odds.decimal_to_american(lit(2.5)), odds.implied_prob(lit(2.0)))
    assert got == pytest.approx((2.5, 1.5, 150.0, 0.5))
    a, b = odds.devig(lit(1.9), lit(1.9))
    assert one(spark, a, b) == pytest.approx((0.5, 0.5))
    assert one(spark, odds.implied_prob(lit(None).cast("double"))) == (None,)


def test_normal_distribution(spark):
    got = one(spark, *(odds.normal_cdf(F.lit(x), F.lit(0.0), F.lit(1.0)) for x in (-1.959964, 0.0, 1.0)))
    assert got == pytest.approx((0.025, 0.5, 0.8413447), abs=1e-5)


def test_kelly_is_never_negative(spark):
    good, bad = one(spark, odds.kelly(F.lit(0.6), F.lit(2.0)), odds.kelly(F.lit(0.4), F.lit(2.0)))
    assert good > 0 and bad == 0


def test_asof_backward_excludes_equal_times_when_strict(spark):
    left = spark.createDataFrame([("a", 2), ("a", 3), ("b", 1)], "k string, t int")
    right = spark.createDataFrame([("a", 1, 10), ("a", 2, 20), ("c", 0, 5)], "k string, t int, v int")
    strict = {(r["k"], r["t"]): r["v"] for r in joins.asof_backward(left, right, ["k"], "t", ["v"]).collect()}
    loose = {(r["k"], r["t"]): r["v"] for r in joins.asof_backward(left, right, ["k"], "t", ["v"], strict=False).collect()}
    assert strict == {("a", 2): 10, ("a", 3): 20, ("b", 1): None} and loose == {("a", 2): 20, ("a", 3): 20, ("b", 1): None}
