"""Connected components by alternating large-star and small-star steps.

The aggregates are written before they are joined, so that a hub's edges can be
split; no component meets in one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.operators.common import cut


def connected(edges: DataFrame) -> DataFrame:
    """``node, root`` for every node of ``edges(a, b)``; a component's root is its least node."""
    stars = cut(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    state = None
    while True:
        now = tuple(stars.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first())
        if now == state or not now[0]:
            break
        state = now
        both = stars.union(stars.select("b", "a")).toDF("u", "v")
        least = cut(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()
        large = cut(large)
        low = cut(large.groupBy("a").agg(F.min("b").alias("m")))
        small = large.join(low, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).union(low.select("a", "m"))
        stars = cut(small.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    roots = stars.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    return stars.toDF("node", "root").union(roots)
