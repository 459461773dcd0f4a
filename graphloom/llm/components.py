"""Connected components of an edge list that stays distributed.

Alternating large-star and small-star steps (Kiveris et al., "Connected
Components in MapReduce and Beyond", 2014).  Every step is a partial
aggregation and an equi-join.  The aggregate is written first: it is then
broadcast if its size allows, or both sides of the join are dealt anew and a
hub's edges are split by the skew join.  No component meets in one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import cut


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select(F.col("b"), F.col("a"))).toDF("u", "v")
    least = cut(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")))
    return both.join(least, "u").where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))


def _small_star(edges: DataFrame) -> DataFrame:
    least = cut(edges.groupBy("a").agg(F.min("b").alias("m")))
    near = edges.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return near.union(least.select("a", F.col("m").alias("b")))


def _digest(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first())


def connected_components(edges: DataFrame) -> DataFrame:
    """``(node, root)`` for every node of ``edges(a bigint, b bigint)``; root is the least node.

    Self edges, repeated edges and either direction are allowed; an empty edge
    list gives an empty result.
    """
    stars = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    stars = cut(stars)
    before = _digest(stars)
    while before[0]:
        stars = cut(_small_star(_large_star(stars).distinct()).distinct())
        now = _digest(stars)
        if now == before:
            break
        before = now
    roots = stars.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    return stars.select(F.col("a").alias("node"), F.col("b").alias("root")).union(roots)
