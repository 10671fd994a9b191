"""The incremental cache: appends rewrite nothing, repeated and broken batches leave no trace, old versions stay readable."""

from __future__ import annotations

import os

import pytest
from pyspark.sql import functions as F
from strideline.sources.cache import Cache


def files(path) -> dict[str, float]:
    return {os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns for d, _, names in os.walk(path) for f in names if f.endswith(".parquet")}


def test_refreshes(spark, tmp_path):
    asked = []

    def fetch(missing):
        asked.append(sorted(r[0] for r in missing.collect()))
        return missing.select("k", (F.col("k") * 10).alias("v"))

    c = Cache(spark, str(tmp_path), "k long, v long", "k")
    keys = lambda *k: spark.createDataFrame([(x,) for x in k], "k long")
    assert c.read().count() == 0 and c.version() == 0
    assert c.refresh("a", keys(1, 2), fetch)
    before = files(tmp_path)
    assert c.refresh("b", keys(1, 2, 3, 4), fetch) and not c.refresh("b", keys(5), fetch) and not c.refresh("a", keys(6), fetch)
    assert asked == [[1, 2], [3, 4]]
    now = files(tmp_path)
    assert all(now[f] == t for f, t in before.items())
    assert sorted(tuple(r) for r in c.read().collect()) == [(k, 10 * k) for k in (1, 2, 3, 4)]
    assert sorted(r["k"] for r in c.read(1).collect()) == [1, 2]


def test_a_broken_batch_is_not_seen_and_comes_again(spark, tmp_path):
    c = Cache(spark, str(tmp_path), "k long, v long", "k")
    keys = spark.createDataFrame([(1,), (2,)], "k long")

    def broken(missing):
        return missing.select("k", F.raise_error("gone").cast("long").alias("v"))

    with pytest.raises(Exception, match="gone"):
        c.refresh("a", keys, broken)
    assert c.version() == 0 and c.read().count() == 0
    assert c.refresh("a", keys, lambda m: m.select("k", F.lit(1).cast("long").alias("v"))) and c.read().count() == 2


def test_of_two_writers_the_second_fails(spark, tmp_path):
    c = Cache(spark, str(tmp_path), "k long, v long", "k")
    keys = spark.createDataFrame([(1,)], "k long")

    def meanwhile(missing):
        c._commit(1, ["other"])
        return missing.select("k", "k")

    with pytest.raises(Exception, match="exist"):
        c.refresh("mine", keys, meanwhile)
    assert c.batches() == ["other"]
