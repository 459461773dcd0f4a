"""The split phase: two halves of each block, scored by what the split saves."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.functions.numeric import lbinom, lfactorial
from graphloom.functions.randomness import race, uniform
from graphloom.operators import blockmodel as bm
from graphloom.operators import graph
from graphloom.operators.common import cut, first_n, numbered
from graphloom.operators.description import block_term, edge_term, edges_dl


def random_sides(assignment: DataFrame, trials: int, seed: int) -> DataFrame:
    """``trial, b, v, side``: each vertex on side 1 with a share between 20 and 80 in 100, drawn for each block and trial."""
    every = assignment.where("b is not null").select("v", "b", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(trials - 1).cast("long"))).alias("trial"))
    share = 0.2 + 0.6 * uniform(seed, F.col("b"), F.col("trial"))
    return every.select("trial", "b", "v", (uniform(seed + 1, F.col("v"), F.col("trial")) < share).cast("long").alias("side"))


def seeds_by_degree(edges: DataFrame, assignment: DataFrame) -> DataFrame:
    """``b, v, side``: the two vertices of largest degree of each block, ties by id."""
    deg = assignment.where("b is not null").join(graph.degrees(edges).select("v", "k"), "v", "left").select("b", "v", F.coalesce("k", F.lit(0)).alias("k"))
    rank = lambda: F.min(F.struct((-F.col("k")).alias("k"), "v")).alias("x")
    first = cut(deg.groupBy("b").agg(rank()).select("b", F.col("x.v").alias("v")))
    second = deg.join(first.select("v"), "v", "left_anti").groupBy("b").agg(rank()).select("b", F.col("x.v").alias("v"))
    return first.select("b", "v", F.lit(0).cast("long").alias("side")).unionByName(second.select("b", "v", F.lit(1).cast("long").alias("side")))


def seeds_random(assignment: DataFrame, seed: int) -> DataFrame:
    """``b, v, side``: two vertices of each block by a seeded hash; a block of one has one."""
    return _two_least(assignment.where("b is not null").select("b", "v", uniform(seed, F.col("v")).alias("key")))


def seeds_degree_weighted(edges: DataFrame, assignment: DataFrame, seed: int) -> DataFrame:
    """``b, v, side``: two vertices of each block, drawn one after the other with probability proportional to their degrees; islands come last."""
    deg = assignment.where("b is not null").join(graph.degrees(edges).select("v", "k"), "v", "left")
    key = F.coalesce(race(F.coalesce("k", F.lit(0)), uniform(seed, F.col("v"))), F.lit(1e300))
    return _two_least(deg.select("b", "v", key.alias("key")))


def _two_least(keyed: DataFrame) -> DataFrame:
    """The two rows of each block with the least ``key``, ties by id; sides 0 and 1."""
    least = lambda frame: frame.groupBy("b").agg(F.min(F.struct("key", "v")).alias("x")).select("b", F.col("x.v").alias("v"))
    keyed = cut(keyed)
    first = cut(least(keyed))
    second = least(keyed.join(first.select("v"), "v", "left_anti"))
    return first.select("b", "v", F.lit(0).cast("long").alias("side")).unionByName(second.select("b", "v", F.lit(1).cast("long").alias("side")))


def plain_snowball_sides(edges: DataFrame, assignment: DataFrame, seeds: DataFrame) -> DataFrame:
    """``b, v, side``: both seeds of each block grow by their neighbours in waves, whatever the weights; side 0 on a tie and for what no wave reaches."""
    return _grown(edges, assignment, seeds, F.when(F.col("side") == 1, 1).otherwise(2))


def single_snowball_sides(edges: DataFrame, assignment: DataFrame, seeds: DataFrame) -> DataFrame:
    """``b, v, side``: one snowball for each block, from its seed of side 1, which takes waves until half of the block is in it; the rest is side 0.

    Of the wave that would take more than half, the vertices with the smallest ids join.
    """
    inner = cut(_inner(edges, assignment))
    room = cut(assignment.where("b is not null").groupBy("b").agg(F.floor(F.count("*") / 2).cast("long").alias("half")))
    owned = cut(seeds.groupBy("b").agg(F.max_by("v", "side").alias("v")).select("b", "v"))
    while True:
        size = owned.groupBy("b").agg(F.count("*").alias("n"))
        open_blocks = room.join(size, "b").where("n < half").select("b", (F.col("half") - F.col("n")).alias("left"))
        reached = inner.join(owned.select(F.col("v").alias("nb")), "nb", "left_semi").select("b", "v").distinct().join(owned.select("v"), "v", "left_anti").join(open_blocks, "b")
        wave = cut(numbered(reached.select("b", "v", "left"), F.col("b"), F.col("v"), name="_n"))
        if wave.isEmpty():
            break
        starts = wave.groupBy("b").agg(F.min("_n").alias("_first"))
        owned = cut(owned.unionByName(wave.join(starts, "b").where("_n - _first < left").select("b", "v")))
    inside = owned.select("v", F.lit(1).cast("long").alias("side"))
    return assignment.where("b is not null").join(inside, "v", "left").select("b", "v", F.coalesce("side", F.lit(0)).cast("long").alias("side"))


def _inner(edges: DataFrame, assignment: DataFrame) -> DataFrame:
    known = assignment.where("b is not null")
    return graph.neighbors(edges).where("v <> nb").join(known, "v").join(known.select(F.col("v").alias("nb"), F.col("b").alias("b2")), "nb").where("b = b2").select("b", "v", "nb", "w")


def _grown(edges: DataFrame, assignment: DataFrame, seeds: DataFrame, rank: Column) -> DataFrame:
    inner = cut(_inner(edges, assignment))
    owned = cut(seeds.select("b", "v", "side"))
    while True:
        near = inner.join(owned.select(F.col("v").alias("nb"), "side"), "nb").groupBy("b", "v").agg(F.max(rank).alias("best"))
        wave = cut(near.join(owned.select("v"), "v", "left_anti").select("b", "v", (F.col("best") == 1).cast("long").alias("side")))
        if wave.isEmpty():
            break
        owned = cut(owned.unionByName(wave))
    rest = assignment.where("b is not null").join(owned.select("v"), "v", "left_anti").select("b", "v", F.lit(0).cast("long").alias("side"))
    return owned.unionByName(rest)


def snowball_sides(edges: DataFrame, assignment: DataFrame, seeds: DataFrame) -> DataFrame:
    """``b, v, side``: both seeds of each block grow in waves; a vertex joins the side with more edges, side 0 on a tie.

    What no wave reaches is on side 0.  All blocks grow at once.
    """
    inner = cut(_inner(edges, assignment))
    owned = cut(seeds.select("b", "v", "side"))
    while True:
        near = inner.join(owned.select(F.col("v").alias("nb"), "side"), "nb").groupBy("b", "v").agg(F.sum(F.when(F.col("side") == 1, F.col("w")).otherwise(-F.col("w"))).alias("lean"))
        wave = cut(near.join(owned.select("v"), "v", "left_anti").select("b", "v", (F.col("lean") > 0).cast("long").alias("side")))
        if wave.isEmpty():
            break
        owned = cut(owned.unionByName(wave))
    rest = assignment.where("b is not null").join(owned.select("v"), "v", "left_anti").select("b", "v", F.lit(0).cast("long").alias("side"))
    return owned.unionByName(rest)


def split_scores(edges: DataFrame, sides: DataFrame) -> DataFrame:
    """``trial, b, de``: the nonparametric length of each block's own subgraph in two parts, less that in one.

    Edges to other blocks don't count.  Trials that leave a side empty are left out.
    """
    source, target = sides.toDF("trial", "b", "src", "r"), sides.select("trial", F.col("b").alias("b2"), F.col("v").alias("dst"), F.col("side").alias("c"))
    inner = edges.join(source, "src").join(target, ["dst", "trial"]).where("b = b2").groupBy("trial", "b", "r", "c").agg(F.sum("w").cast("long").alias("w"))
    per = inner.groupBy("trial", "b").agg(F.sum("w").alias("e"), F.sum(edge_term(F.col("r"), F.col("c"), F.col("w"))).alias("cells"), *[F.sum(F.when(F.col(x) == s, F.col("w")).otherwise(0)).alias(f"{x}{s}") for x in "rc" for s in (0, 1)])
    sizes = sides.groupBy("trial", "b").agg(F.count("*").alias("n"), F.sum("side").cast("long").alias("n1")).withColumn("n0", F.col("n") - F.col("n1")).where("n0 > 0 and n1 > 0")
    joined = sizes.join(per, ["trial", "b"], "left").na.fill(0)
    e, n, n0, n1 = (F.col(c) for c in ("e", "n", "n0", "n1"))
    two = F.col("cells") + block_term(F.col("r0"), F.col("c0"), n0) + block_term(F.col("r1"), F.col("c1"), n1) + lbinom(n - 1, F.lit(1)) - lfactorial(n0) - lfactorial(n1) + edges_dl(F.lit(2), e)
    one = edge_term(F.lit(0), F.lit(0), e) + block_term(e, e, n) - lfactorial(n) + edges_dl(F.lit(1), e)
    return joined.select("trial", "b", (two - one).alias("de"))


def best_splits(scores: DataFrame) -> DataFrame:
    """``b, trial, de``: the best trial of each block, ties by the smallest."""
    best = scores.groupBy("b").agg(F.min(F.struct(F.round("de", 9).alias("de"), "trial")).alias("x"))
    return best.select("b", F.col("x.trial").alias("trial"), F.col("x.de").alias("de"))


def apply_splits(assignment: DataFrame, sides: DataFrame, best: DataFrame, num_blocks: int, wanted: int) -> DataFrame:
    """Labels after the ``wanted`` best splits; side 1 of each gets a new block.

    A random split seldom saves anything as it is; the sweeps that follow move
    the vertices to the sides they belong to, so a positive ``de`` counts too.
    """
    picked = numbered(first_n(best, wanted, F.col("de"), F.col("b")), F.col("de"), F.col("b"), name="_n")
    fresh = picked.select("b", "trial", (F.col("_n") + num_blocks).alias("new"))
    moved = sides.where("side = 1").join(fresh, ["b", "trial"]).select("v", F.col("new").alias("b_to"))
    return bm.moved(assignment, moved)
