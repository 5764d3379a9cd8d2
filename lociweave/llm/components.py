"""Connected components of links, by alternating large and small stars.

Every round is a partial-aggregated minimum and a join back; nothing is gathered per component.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .runtime import discard, materialize


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Hang every neighbour of a node (the larger ones, or all with smaller ids) on the node's smallest."""
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else edges
    least = materialize(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), "least")
    joined = both.join(least, "u")
    if large:
        out = joined.where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
    done = materialize(out.where("u <> v").distinct(), "star")
    discard(least)
    return done


def components(links: DataFrame) -> DataFrame:
    """node, component (its smallest node), for every node that a link (a, b) touches."""
    edges = materialize(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "links")
    before = None
    while True:
        wide = _star(edges, True)
        new = _star(wide.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")), False)
        discard(wide)
        now = new.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        discard(edges)
        edges = new
        if now == before:
            break
        before = now
    ends = edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return ends.union(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
