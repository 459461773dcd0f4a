"""The merge phase: score proposed merges, keep each block's best, and apply as many as wanted."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.operators import description
from graphloom.operators.blockmodel import neighbor_weights
from graphloom.operators.common import cut, first_n
from graphloom.operators.entropy import merge_delta


def all_pairs(block_ids: DataFrame) -> DataFrame:
    """Every block with every other.  For a few blocks, such as two combined parts; see ``adjacent_pairs`` otherwise."""
    ids = block_ids.select("b").distinct()
    return ids.select(F.col("b").alias("block")).crossJoin(F.broadcast(ids.select(F.col("b").alias("into")))).where("block <> into")


def adjacent_pairs(matrix: DataFrame) -> DataFrame:
    """Every block with each of its neighbours."""
    return neighbor_weights(matrix).where("b <> nb").select(F.col("b").alias("block"), F.col("nb").alias("into"))


def best_merges(scored: DataFrame) -> DataFrame:
    """``block, into, de``: the merge with the least ``de`` of each block; scores within 1e-9 tie, and the smallest block wins."""
    best = scored.groupBy("block").agg(F.min(F.struct(F.round("de", 9).alias("de"), "into")).alias("x"))
    return best.select("block", F.col("x.into").alias("into"), F.col("x.de").alias("de"))


def resolved(merges: DataFrame) -> DataFrame:
    """Follow chains of ``merges(block, into)`` to their ends, by pointer jumping.

    Merges are taken in the order of ``rank`` with the targets current at that
    time; one whose two blocks have met already does nothing.  That is: the
    links form groups, and each group's surviving block is its smallest.
    """
    pointers = cut(merges.select(F.greatest("block", "into").alias("block"), F.least("block", "into").alias("into")).distinct())
    from graphloom.operators.components import connected

    return connected(pointers.toDF("a", "b")).where("node <> root").select(F.col("node").alias("block"), F.col("root").alias("into"))


def chosen(best: DataFrame, wanted: int) -> DataFrame:
    """The ``wanted`` merges of least ``de``, ties by block; they may chain or meet."""
    return first_n(best, wanted, F.col("de"), F.col("block"))


def merge_step(matrix: DataFrame, candidates: DataFrame, wanted: int, block_table: DataFrame | None = None) -> DataFrame:
    """``block, into`` without chains, for about ``wanted`` fewer blocks, on scores that aren't renewed between merges.

    With ``block_table`` the merges are scored by the nonparametric length.
    """
    scored = merge_delta(matrix, candidates) if block_table is None else description.merge_delta(matrix, block_table, candidates)
    return resolved(chosen(best_merges(scored), wanted))
