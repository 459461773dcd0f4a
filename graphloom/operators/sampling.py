"""Samples of a graph, extension of their labels, and detached vertices."""

from __future__ import annotations

import itertools

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom.functions.randomness import uniform
from graphloom.operators import graph
from graphloom.operators.common import cut, first_n, numbered


def max_degree(edges: DataFrame, n: int) -> DataFrame:
    """``v``: the ``n`` vertices of largest degree, ties by id."""
    return graph.largest(cut(graph.degrees(edges).select("v", "k")), "k", "v", n).select("v")


def hash_random(vertices: DataFrame, n: int, seed: int) -> DataFrame:
    """``v``: ``n`` vertices in the order of a seeded hash."""
    return first_n(vertices.select("v", uniform(seed, F.col("v")).alias("u")), n, F.col("u"), F.col("v")).select("v")


def degree_product(edges: DataFrame, n: int) -> DataFrame:
    return graph.influential_by_edges(edges, n)


def round_robin(vertices: DataFrame, part: int, parts: int) -> DataFrame:
    if not 0 <= part < parts:
        raise ValueError("part must be one of parts")
    return vertices.where(F.pmod(F.col("v"), F.lit(parts)) == part)


def random_parts(vertices: DataFrame, parts: int, seed: int) -> DataFrame:
    """``v, part``: every vertex in a part drawn by a seeded hash."""
    return vertices.select("v", F.floor(uniform(seed, F.col("v")) * parts).cast("long").alias("part"))


def expansion(edges: DataFrame, n: int, seeds: DataFrame) -> DataFrame:
    """``v``: a snowball from ``seeds(v)`` by waves of the vertices with the most neighbours that are new.

    Each wave takes the share of the frontier that brings most new vertices, at
    most as many as are in the sample, so that the number of waves grows with
    the log of ``n``; when the frontier is empty, the largest vertex outside
    starts another snowball.
    """
    near = cut(graph.neighbors(edges).where("v <> nb").select("v", "nb").distinct())
    deg = cut(graph.degrees(edges).select("v", "k"))
    sample = cut(seeds.select("v").distinct())
    while (size := sample.count()) < n:
        frontier = near.join(sample, "v", "left_semi").select(F.col("nb").alias("v")).distinct().join(sample, "v", "left_anti")
        reach = near.join(frontier, "v", "left_semi").join(sample.withColumnRenamed("v", "nb"), "nb", "left_anti").join(frontier.withColumnRenamed("v", "nb"), "nb", "left_anti")
        scored = frontier.join(reach.groupBy("v").agg(F.count("*").alias("new")), "v", "left").select("v", F.coalesce("new", F.lit(0)).alias("new"))
        wave = cut(first_n(scored, min(n - size, max(1, size)), F.desc("new"), F.col("v")).select("v"))
        if wave.isEmpty():
            wave = deg.join(sample, "v", "left_anti").orderBy(F.desc("k"), "v").limit(1).select("v")
            if wave.isEmpty():
                break
        sample = cut(sample.unionByName(wave))
    return sample


def degree_product_snowball(edges: DataFrame, n: int, seeds: DataFrame) -> DataFrame:
    """``v``: a snowball from ``seeds(v)`` that follows the edges of the largest degree products out of the sample.

    As in ``expansion``, a wave is at most as large as the sample, and a new
    snowball starts at the largest vertex outside when nothing is adjacent.
    """
    out = graph.degree_products(edges).where("src <> dst")
    both = cut(out.select("src", "dst", "product").unionAll(out.select("dst", "src", "product")).toDF("v", "nb", "product"))
    deg = cut(graph.degrees(edges).select("v", "k"))
    sample = cut(seeds.select("v").distinct())
    while (size := sample.count()) < n:
        frontier = both.join(sample, "v", "left_semi").groupBy(F.col("nb").alias("v")).agg(F.max("product").alias("product")).join(sample, "v", "left_anti")
        wave = cut(first_n(frontier, min(n - size, max(1, size)), F.desc("product"), F.col("v")).select("v"))
        if wave.isEmpty():
            wave = deg.join(sample, "v", "left_anti").orderBy(F.desc("k"), "v").limit(1).select("v")
            if wave.isEmpty():
                break
        sample = cut(sample.unionByName(wave))
    return sample


def snowballs(edges: DataFrame, parts: int) -> DataFrame:
    """``v, part``: a disjoint cover, grown in waves from the ``parts`` largest vertices until a wave reaches nothing new.

    A vertex that several parts reach in one wave goes to the smallest part;
    what no part reaches is dealt by id.
    """
    deg = graph.degrees(edges)
    seeds = deg.orderBy(F.desc("k"), "v").limit(parts)
    near = cut(graph.neighbors(edges).where("v <> nb").select("v", "nb").distinct())
    owned = cut(seeds.select("v", (F.row_number().over(Window.orderBy(F.desc("k"), "v")) - 1).cast("long").alias("part")))
    edge = owned
    while True:
        wave = near.join(edge, "v").groupBy(F.col("nb").alias("v")).agg(F.min("part").alias("part"))
        edge = cut(wave.join(owned.select("v"), "v", "left_anti"))
        if edge.isEmpty():
            break
        owned = cut(owned.unionByName(edge))
    rest = deg.select("v").join(owned, "v", "left_anti").select("v", F.pmod(F.col("v"), F.lit(parts)).cast("long").alias("part"))
    return owned.unionByName(rest)


def local_ids(vertices: DataFrame) -> DataFrame:
    """``v, local_v``: dense ids in the order of the old ones."""
    return numbered(vertices.select("v").distinct(), F.col("v"), name="local_v").select("v", "local_v")


def subgraph(edges: DataFrame, vertices: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The induced subgraph in local ids, and the mapping."""
    mapping = cut(local_ids(vertices))
    return graph.relabelled(edges, mapping), mapping


def detached(edges: DataFrame) -> DataFrame:
    """``v``: vertices of degree over 1, which stay; the others are left for ``reattach``."""
    return graph.degrees(edges).where("k > 1").select("v")


def majority(edges: DataFrame, known: DataFrame) -> DataFrame:
    """``v, b`` for unlabelled neighbours of ``known(v, b)``: the block with most edges, ties by the smallest."""
    near = graph.neighbors(edges).where("v <> nb")
    votes = near.join(known.select(F.col("v").alias("nb"), "b"), "nb").groupBy("v", "b").agg(F.sum("w").alias("n"))
    top = votes.groupBy("v").agg(F.min(F.struct((-F.col("n")).alias("n"), "b")).alias("x"))
    return top.join(known.select("v"), "v", "left_anti").select("v", F.col("x.b").alias("b"))


def extend(edges: DataFrame, vertices: DataFrame, known: DataFrame, num_blocks: int, seed: int, rounds: int | None = 1) -> DataFrame:
    """``v, b`` for all ``vertices``: known labels, then the majority of labelled neighbours for up to ``rounds`` waves, or until one labels nothing new.

    What is left has no labelled neighbour, and without a bound on the waves no
    path to one, and is given a block by a seeded hash.
    """
    labelled = known.select("v", "b")
    for _ in itertools.count() if rounds is None else range(rounds):
        more = majority(edges, labelled)
        if rounds != 1:
            more = cut(more)
            if more.isEmpty():
                break
        labelled = labelled.unionByName(more)
        if rounds != 1:
            labelled = cut(labelled)
    anywhere = F.floor(uniform(seed, F.col("v")) * num_blocks).cast("long")
    return vertices.select("v").join(labelled, "v", "left").select("v", F.coalesce("b", anywhere).alias("b"))


def reattach(edges: DataFrame, vertices: DataFrame, known: DataFrame, num_blocks: int, seed: int) -> DataFrame:
    """``v, b`` for all ``vertices``: a detached vertex takes its only neighbour's block.

    Two detached vertices that hang together take the block drawn for the
    smaller of them; islands draw their own.
    """
    labelled = known.select("v", "b")
    hung = majority(edges, labelled)
    loose = vertices.select("v").join(labelled, "v", "left_anti").join(hung.select("v"), "v", "left_anti")
    pairs = graph.neighbors(edges).where("v <> nb").join(loose, "v", "left_semi").groupBy("v").agg(F.min("nb").alias("nb"))
    alone = loose.join(pairs, "v", "left").select("v", F.floor(uniform(seed, F.least("v", F.coalesce("nb", "v"))) * num_blocks).cast("long").alias("b"))
    return labelled.unionByName(hung).unionByName(alone)
