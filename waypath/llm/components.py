"""Connected components of a link table, by alternating large and small stars until nothing changes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waypath.llm.common import checkpoint


def _state(edges: DataFrame) -> tuple:
    r = edges.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.lit(0))).first()
    return int(r[0]), int(r[1])


def _star(pairs: DataFrame, large: bool) -> DataFrame:
    """pairs: (u, v). Links the larger (large) or the smaller neighbours of u, and u, to the smallest of them and u."""
    if not large:
        pairs = pairs.where("v < u")
    least = pairs.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
    both = pairs.join(least, "u")
    if large:
        moved = both.where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))
    else:
        moved = both.select(F.col("v").alias("a"), F.col("m").alias("b")).unionByName(least.select(F.col("u").alias("a"), F.col("m").alias("b")))
    return moved.where("a <> b").distinct()


def components(links: DataFrame) -> DataFrame:
    """links: (a, b), undirected. Returns (node, root): the smallest node of each component, for all nodes of links.

    Both steps keep every component connected and move links towards its smallest node; they end at stars. Each round
    aggregates per node before it shuffles and joins by node, so no component is ever gathered in one place.
    """
    edges = checkpoint(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    before = _state(edges)
    while before[0]:
        both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
        edges = checkpoint(_star(_star(both, True).select(F.col("a").alias("u"), F.col("b").alias("v")), False))
        after = _state(edges)
        if after == before:
            break
        before = after
    leaves = edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return leaves.unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
