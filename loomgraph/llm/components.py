"""Connected components of an edge table, by alternating large-star and small-star steps.

Each step is one aggregation and one join on narrow rows; stars shrink to depth one
in a number of rounds that grows with the logarithm of the input.  Nothing is
collected but a count and a checksum of the edges, which tell when they stand still.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import stage


def _star(pairs: DataFrame, large: bool) -> DataFrame:
    """Hang a node's neighbours (the larger ones, or the smaller ones and itself) on the smallest of all."""
    least = pairs.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
    joined = pairs.join(least, "u")
    if large:
        return joined.filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    own = least.filter("u > m").select("u", F.col("m").alias("v"))
    return joined.filter("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(own)


def components(edges: DataFrame) -> DataFrame:
    """Rows (node, root) of every node in ``edges`` (u, v) but the roots; root is the smallest node of its component."""
    now = stage(edges.filter("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "cc")
    seen = None
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        wide = stage(_star(both, True).distinct(), "cc-large")
        now = stage(_star(wide.filter("u > v"), False).filter("u > v").distinct(), "cc-small")
        r = now.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
        if (r.n, r.s) == seen:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
        seen = (r.n, r.s)
