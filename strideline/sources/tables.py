"""The games, box-score and odds-tick tables, as views over the star schema (FIXTURES.md, part 2)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strideline.functions import rules

#: Spread and total sides are quoted flat.
FLAT = 1.909090909


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def games(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per game, home perspective, with closing and opening odds and results."""
    orders, customers = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    key, price = F.col("o_orderkey"), F.col("o_totalprice")
    quoted = key % 10 != 0
    p = (20 + (key * 37) % 61) / F.lit(100.0)
    q = (80 - (key * 37) % 61) / F.lit(100.0)
    moved = ((key % 7) - 3) / F.lit(100.0)
    bounded = lambda x: F.least(F.lit(0.95), F.greatest(F.lit(0.05), x))
    out = orders.join(customers, F.col("o_custkey") == F.col("c_custkey")).select(
        key.alias("game_id"),
        F.to_date("o_orderdate").alias("game_date"),
        F.year("o_orderdate").alias("season"),
        F.col("c_nationkey").alias("home"),
        ((F.col("c_nationkey") + 1 + key % 24) % 25).cast("int").alias("away"),
        (F.floor(price) % 41).alias("home_score"),
        (F.floor(price / 7) % 38).alias("away_score"),
        (F.col("o_orderpriority") == "1-URGENT").alias("is_playoff"),
        (F.col("o_orderstatus") == "P").alias("is_neutral"),
        F.when(quoted, ((key % 29) - 14).cast("double") / 2).alias("home_line"),
        F.when(quoted, 30 + (key % 21).cast("double") / 2).alias("total_line"),
        (F.lit(1.0) / (p * 1.045)).alias("home_close"),
        (F.lit(1.0) / (q * 1.045)).alias("away_close"),
        (F.lit(1.0) / (bounded(p + moved) * 1.045)).alias("home_open"),
        (F.lit(1.0) / (bounded(q - moved) * 1.045)).alias("away_open"),
    )
    return (
        out.withColumn("margin", F.col("home_score") - F.col("away_score"))
        .withColumn("total", F.col("home_score") + F.col("away_score"))
        .withColumn("home_win", (F.col("margin") > 0).cast("int"))
        .withColumn("covers", rules.cover_result(F.col("margin"), F.col("home_line")))
        .withColumn("over", rules.over_result(F.col("total"), F.col("total_line")))
    )


def box(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Player lines of a game. (event_id, line_no) is not unique."""
    price = F.floor("l_extendedprice")
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("event_id"),
        F.col("l_suppkey").alias("player_id"),
        F.col("l_partkey").alias("venue_id"),
        (F.col("l_linenumber") % 2 == 1).alias("is_home"),
        F.col("l_linenumber").alias("line_no"),
        F.col("l_quantity").cast("int").alias("minutes"),
        (price % 40).alias("pts"),
        F.concat((price % 15).cast("string"), F.lit("/"), (price % 15 + F.col("l_quantity").cast("long") % 20).cast("string")).alias("comp_att"),
        F.to_date("l_shipdate").alias("day"),
    )


def ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Odds ticks in event time: market side and price (some missing)."""
    kind = F.col("event_type")
    side = F.when(kind == "view", "moneyline_home").when(kind == "click", "moneyline_away").when(kind == "signup", "spread_home").when(kind == "purchase", "total_over").otherwise("total_under")
    price = F.when(~((kind == "error") & (F.col("event_id") % 5 == 0)), F.lit(1.2) + (F.floor(F.col("value") * 100) % 380).cast("double") / 100.0)
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("tick_id"), F.col("user_id").cast("long").alias("game_id"), "ts", side.alias("market_side"), price.alias("price"), "props")
