"""Connected components as joins and minima; native DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from lexmill.llm.common import stored


def _stars(edges: DataFrame, large: bool) -> DataFrame:
    """One round: every vertex hangs its larger (or smaller) neighbours on its least one."""
    both = edges.unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))) if large else edges
    least = both.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m"))
    hung = both.join(least, "a")
    if large:
        return hung.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
    own = hung.select("b", "m").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    up = least.where("a <> m").select("a", F.col("m").alias("b"))
    return own.unionAll(up).distinct()


def components(edges: DataFrame, left: str, right: str, node: str = "node", component: str = "component") -> DataFrame:
    """(node, component) for every vertex of an edge: component is its least vertex.

    Large-star and small-star rounds alternate until no edge changes. Each round
    combines minima before its shuffle, joins on the vertex (hot vertices are
    split by adaptive execution) and is stored, so that a lost executor costs a
    re-read. Nulls and self-loops give no edge.
    """
    now = edges.select(F.greatest(left, right).alias("a"), F.least(left, right).alias("b")).where("a is not null and b is not null and a <> b").distinct()
    now = stored(now)
    seen = None
    while True:
        now = stored(_stars(_stars(now, True), False))
        mark = tuple(now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if mark == seen:
            break
        seen = mark
    roots = now.select(F.col("b").alias("a")).distinct().join(now.select("a"), "a", "left_anti")
    return now.select(F.col("a").alias(node), F.col("b").alias(component)).unionAll(roots.select(F.col("a").alias(node), F.col("a").alias(component)))
