"""Connected components of an edge table by alternating stars, each round written to the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from airframe.llm.common import stored


def components(edges: DataFrame) -> DataFrame:
    """``(node, component)`` for every end of an edge ``(u, v)``; the component is its smallest node.

    A large star ties every larger neighbour to the smallest one, a small star every smaller one; both are
    aggregates joined back, so a hub is split by a skew join. A round never adds edges, a few rounds reach
    stars. Loops and repeated edges don't matter; NULL ends are left out; no edges give no rows.
    """
    high, low = F.greatest("u", "v"), F.least("u", "v")
    now = edges.where("u IS NOT NULL AND v IS NOT NULL AND u <> v").select(high.alias("u"), low.alias("v")).distinct()
    now, mark = stored(now, "edges"), None
    while True:
        new = sign(now)
        if new == mark:
            break
        mark = new
        now = stored(small_star(large_star(now)), "edges")
    own = now.groupBy(F.col("v").alias("node")).agg(F.first("v").alias("component"))
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(own)


def large_star(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def small_star(edges: DataFrame) -> DataFrame:
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    tied = edges.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return tied.union(least.select("u", F.col("m").alias("v"))).distinct()


def sign(edges: DataFrame) -> tuple:
    """Count and checksum of an edge table."""
    total = F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))
    return tuple(edges.agg(F.count(F.lit(1)), total).first())
