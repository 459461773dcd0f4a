"""Divide and conquer: labels of parts brought together, and the blocks that a rank would own."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom.functions.numeric import xlnx
from graphloom.operators.blockmodel import marginals, neighbor_weights
from graphloom.operators.common import cut
from graphloom.operators.entropy import merge_delta
from graphloom.operators.merge import best_merges


def concatenated(parts: DataFrame) -> DataFrame:
    """``v, b`` from ``parts(part, v, b)``: each part's labels shifted by the sizes of those before it.

    Only one row for each part meets in a task.
    """
    sizes = parts.groupBy("part").agg((F.max("b") + 1).alias("size"))
    before = sizes.select("part", (F.sum("size").over(Window.orderBy("part")) - F.col("size")).alias("before"))
    return parts.join(F.broadcast(before), "part").select("v", (F.col("b") + F.col("before")).cast("long").alias("b"))


def cross_merges(matrix: DataFrame, first: DataFrame, second: DataFrame) -> DataFrame:
    """``block, into, de``: every block of ``first(b)`` with the best block of ``second(b)`` for it.

    Pairs that share an edge or a neighbour are scored from their cells.  The
    change of any other pair depends on the two blocks' degrees and loops alone,
    so one block, the smallest, stands for all of ``second`` that have the same.
    For a pair that does share something this is an upper bound, as x ln x is
    superadditive, so that the least of both is exact.
    """
    one, two = cut(first.select(F.col("b").alias("block")).distinct()), cut(second.select(F.col("b").alias("into")).distinct())
    near = cut(neighbor_weights(matrix).where("b <> nb").select("b", "nb").distinct())
    ours, theirs = near.join(one.toDF("b"), "b", "left_semi").toDF("block", "x"), near.join(two.toDF("b"), "b", "left_semi").toDF("into", "x")
    adjacent = ours.withColumnRenamed("x", "into").join(two, "into", "left_semi").select("block", "into")
    related = cut(adjacent.union(ours.join(theirs, "x").select("block", "into")).where("block <> into").distinct())

    ends = marginals(matrix, 1).toDF("b", "o").join(marginals(matrix, 0).toDF("b", "i"), "b", "full")
    terms = cut(ends.join(matrix.where("r = c").select(F.col("r").alias("b"), F.col("w").alias("s")), "b", "left").na.fill(0))
    mine = one.join(terms.toDF("block", "o1", "i1", "s1"), "block", "left").na.fill(0)
    classes = cut(two.join(terms.toDF("into", "o2", "i2", "s2"), "into", "left").na.fill(0).groupBy("o2", "i2", "s2").agg(F.min("into").alias("into")))
    change = lambda x, y: xlnx(F.col(x) + F.col(y)) - xlnx(F.col(x)) - xlnx(F.col(y))
    others = mine.crossJoin(classes).where("block <> into").select("block", "into", (change("o1", "o2") + change("i1", "i2") - change("s1", "s2")).alias("de"))
    return best_merges(best_merges(merge_delta(matrix, related)).unionByName(best_merges(others)))


def global_labels(local: DataFrame, mapping: DataFrame) -> DataFrame:
    """``v, b`` from labels in local ids ``(local_v, b)`` and ``mapping(v, local_v)``."""
    return mapping.join(local, "local_v").select("v", "b")


def two_hop(matrix: DataFrame, owned: DataFrame) -> DataFrame:
    """``b``: the owned blocks and all that are adjacent to one."""
    ends = matrix.select(F.col("r").alias("b"), F.col("c").alias("x")).union(matrix.select("c", "r"))
    near = ends.join(owned.select(F.col("b").alias("x")), "x", "left_semi").select("b")
    return owned.select("b").union(near).distinct()


def radius_matrix(matrix: DataFrame, inside: DataFrame) -> DataFrame:
    """Cells whose row and column are both inside."""
    return matrix.join(inside.select(F.col("b").alias("r")), "r", "left_semi").join(inside.select(F.col("b").alias("c")), "c", "left_semi").select("r", "c", "w")


def distributed_blocks(block_table: DataFrame, parts: int, mode: str = "none") -> DataFrame:
    """``b, part``: the blocks dealt to ``parts`` owners, by id (``none``), or forth and back by size or degree."""
    from graphloom.operators.mcmc import snake_buckets

    if mode == "none":
        return block_table.select("b", F.pmod(F.col("b"), F.lit(parts)).cast("long").alias("part"))
    if mode not in ("size", "degree"):
        raise ValueError(f"no way {mode!r} to deal blocks")
    score = "size" if mode == "size" else "d"
    return snake_buckets(block_table, score, "b", parts).select("b", F.col("bucket").alias("part"))


def distributed_vertices(edges: DataFrame, assignment: DataFrame, block_table: DataFrame, parts: int, mode: str = "degree") -> DataFrame:
    """``v, part``: the vertices dealt forth and back by their degree, or by their block's."""
    from graphloom.operators.graph import degrees
    from graphloom.operators.mcmc import snake_buckets

    if mode == "degree":
        scored = assignment.select("v").join(degrees(edges).select("v", F.col("k").alias("score")), "v", "left").na.fill(0)
    elif mode == "block_degree":
        scored = assignment.join(block_table.select("b", F.col("d").alias("score")), "b").select("v", "score")
    else:
        raise ValueError(f"no way {mode!r} to deal vertices")
    return snake_buckets(scored, "score", "v", parts).select("v", F.col("bucket").alias("part"))
