"""Proposals: which block a vertex or a block might join."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.functions.randomness import race, uniform
from graphloom.operators.blockmodel import neighbor_weights


def proposal_distribution(edges: DataFrame, assignment: DataFrame, matrix: DataFrame) -> DataFrame:
    """``v, b, p``: the probability that a vertex is proposed each block.

    A neighbour is drawn by edge weight, then a block among its block's
    neighbours by weight; a vertex's loop makes it its own neighbour once.
    """
    near = edges.select(F.col("src").alias("v"), F.col("dst").alias("u"), "w").unionAll(edges.where("src <> dst").select(F.col("dst"), F.col("src"), "w"))
    first = near.join(assignment.select(F.col("v").alias("u"), F.col("b").alias("nb")), "u").groupBy("v", "nb").agg(F.sum("w").alias("w"))
    first = first.join(first.groupBy("v").agg(F.sum("w").alias("k")), "v").select("v", "nb", (F.col("w") / F.col("k")).alias("p1"))
    weights = neighbor_weights(matrix)
    second = weights.join(weights.groupBy("b").agg(F.sum("w").alias("all")), "b").select(F.col("b").alias("nb"), F.col("nb").alias("to"), (F.col("w") / F.col("all")).alias("p2"))
    return first.join(second, "nb").groupBy("v", F.col("to").alias("b")).agg(F.sum(F.col("p1") * F.col("p2")).alias("p"))


def propose_moves(edges: DataFrame, assignment: DataFrame, matrix: DataFrame, num_blocks: int, seed: int) -> DataFrame:
    """``v, b_from, b_to``: one proposal for every labelled vertex, drawn by exponential races.

    Islands are proposed any other block, evenly.  A proposal may be the
    vertex's own block.  Labels must run from 0 to ``num_blocks`` - 1.
    """
    near = edges.select(F.col("src").alias("v"), F.col("dst").alias("u"), "w").unionAll(edges.where("src <> dst").select(F.col("dst"), F.col("src"), "w"))
    drawn = near.groupBy("v").agg(F.min_by("u", F.struct(race(F.col("w"), uniform(seed, F.col("v"), F.col("u"))), "u")).alias("u"))
    through = drawn.join(assignment.select(F.col("v").alias("u"), F.col("b").alias("nb")), "u").select("v", "nb")
    weights = neighbor_weights(matrix).select(F.col("b").alias("nb"), F.col("nb").alias("to"), "w")
    picked = through.join(weights, "nb").groupBy("v").agg(F.min_by("to", F.struct(race(F.col("w"), uniform(seed + 1, F.col("v"), F.col("to"))), "to")).alias("to"))
    other = F.floor(uniform(seed + 2, F.col("v")) * (num_blocks - 1)).cast("long")
    anywhere = other + F.when(other >= F.col("b"), 1).otherwise(0)
    return assignment.where("b is not null").join(picked, "v", "left").select("v", F.col("b").alias("b_from"), F.coalesce("to", anywhere).alias("b_to"))


def propose_merges(matrix: DataFrame, block_ids: DataFrame, num_blocks: int, proposals: int, seed: int) -> DataFrame:
    """``block, into``: up to ``proposals`` distinct other blocks for each block, drawn two steps away by weight.

    Blocks without neighbours, and those whose neighbour has no other, are
    proposed any other block.
    """
    weights = neighbor_weights(matrix)
    first = weights.where("b <> nb").select(F.col("b").alias("block"), "nb", "w")
    tries = F.explode(F.sequence(F.lit(0), F.lit(proposals - 1))).alias("k")
    key = F.col("nb") * proposals + F.col("k")
    step = first.select("*", tries).groupBy("block", "k").agg(F.min_by("nb", F.struct(race(F.col("w"), uniform(seed, F.col("block"), key)), "nb")).alias("nb"))
    second = weights.select(F.col("b").alias("nb"), F.col("nb").alias("into"), "w")
    key = F.col("into") * proposals + F.col("k")
    drawn = step.join(second, "nb").where("into <> block").groupBy("block", "k").agg(F.min_by("into", F.struct(race(F.col("w"), uniform(seed + 1, F.col("block"), key)), "into")).alias("into"))
    every = block_ids.select(F.col("b").alias("block"), tries)
    other = F.floor(uniform(seed + 2, F.col("block"), F.col("k")) * (num_blocks - 1)).cast("long")
    anywhere = other + F.when(other >= F.col("block"), 1).otherwise(0)
    return every.join(drawn, ["block", "k"], "left").select("block", F.coalesce("into", anywhere).alias("into")).distinct()
