"""Connected components of links between long ids, as joins and groupings with a written table for each round."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strideline.llm.common import written


def _both(edges: DataFrame) -> DataFrame:
    return edges.select(F.explode(F.array(F.struct(F.col("a").alias("u"), F.col("b").alias("v")), F.struct(F.col("b").alias("u"), F.col("a").alias("v")))).alias("x")).select("x.*")


def components(links: DataFrame) -> DataFrame:
    """links (a, b): node and root, the least id of its component, for every node in a link.

    Large-star and small-star rounds: each node's neighbours are linked to the least of them until nothing changes.
    A node with very many neighbours is one row of the grouped side of each join, so adaptive execution can split its
    other side. Null ends and links of a node with itself are left out; repeated links count once; no links, no rows.
    """
    edges = written(links.where("a <> b").select(F.least("a", "b").alias("b"), F.greatest("a", "b").alias("a")).distinct())
    seen = None
    while True:
        both = _both(edges)
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("x")).select("x.*")
        edges = written(small.where("a <> b").distinct(), instead_of=edges)
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == seen:
            return edges.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("root")).union(edges.select("b", "b").distinct())
        seen = now


def named(rooted: DataFrame) -> DataFrame:
    """rooted: node, least (an id), root (null: linked with none). node and component_id, the least id of its component.

    The least ids are a written table, so both sides of the join come straight from a shuffle and adaptive execution can
    split a component that holds a large share of all nodes.
    """
    rows = rooted.withColumn("root", F.coalesce("root", "node"))
    least = written(rows.groupBy("root").agg(F.min("least").alias("component_id")))
    return rows.join(least, "root").select("node", "component_id")
