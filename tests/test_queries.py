"""Every query that has SQL gives the rows of its SQL."""

from __future__ import annotations

import compare
import pytest
from strideline.operators import boosting
from strideline.queries import ORACLES, QUERIES


@pytest.fixture(scope="module")
def duck(sf):
    return compare.connect(sf)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_rows_as_sql(spark, sf, duck, name):
    assert compare.difference(QUERIES[name](spark, sf), duck, ORACLES[name]) == ""


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_rows_without_sql(spark, sf, name, monkeypatch):
    """All rows at the queries' own settings, but for fewer rounds of boosting; values are held against plain Python elsewhere."""
    monkeypatch.setattr(boosting.Spec.__init__, "__defaults__", (4, *boosting.Spec.__init__.__defaults__[1:]))
    assert QUERIES[name](spark, sf).count() > 0
