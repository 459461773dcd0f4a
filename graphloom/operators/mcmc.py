"""The vertex phase: one asynchronous Gibbs sweep as a plan, and the rules for stopping."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom.functions.randomness import uniform
from graphloom.operators import blockmodel as bm
from graphloom.operators import description, entropy
from graphloom.operators.common import cut, numbered
from graphloom.operators.proposal import propose_moves


def guarded(moves: DataFrame, block_table: DataFrame) -> DataFrame:
    """Without the moves that would empty a block: of a block whose vertices all leave, the one that gains least stays.

    Per-block counts are aggregated first; only blocks that would empty are
    looked at vertex by vertex, for one minimum.
    """
    leaving = moves.groupBy("b_from").agg(F.count("*").alias("out"))
    gone = leaving.join(block_table.select(F.col("b").alias("b_from"), "size"), "b_from").where("out >= size").select("b_from")
    stays = moves.join(gone, "b_from").groupBy("b_from").agg(F.max(F.struct("de", "v")).alias("x")).select(F.col("x.v").alias("v"))
    return moves.join(stays, "v", "left_anti")


def gibbs_moves(
    edges: DataFrame, assignment: DataFrame, num_blocks: int, seed: int, greedy: bool = True, batch: tuple[int, int] = (0, 1),
    matrix: DataFrame | None = None, among: DataFrame | None = None, nonparametric: bool = False,
) -> DataFrame:
    """``v, b_from, b_to, de`` of the accepted moves of one sweep against the model as it is.

    ``batch`` (k, n) takes the vertices whose hash falls in the k-th of n
    parts, for sweeps that renew the model between parts; ``among`` only its
    own vertices.  ``matrix`` is the labels' block matrix, if the caller has it.
    ``nonparametric`` judges by the nonparametric length, without a correction
    for the way back.
    """
    matrix = cut(bm.block_matrix(edges, assignment)) if matrix is None else matrix
    table = cut(bm.blocks(matrix, assignment))
    proposed = propose_moves(edges, assignment, matrix, num_blocks, seed).where("b_from <> b_to").select("v", "b_to")
    if among is not None:
        proposed = proposed.join(among.select("v"), "v", "left_semi")
    if batch[1] > 1:
        proposed = proposed.where(F.pmod(F.xxhash64("v"), F.lit(batch[1])) == batch[0])
    proposed = cut(proposed)
    if nonparametric:
        scored = description.move_delta(edges, assignment, matrix, table, proposed)
    else:
        scored = entropy.move_delta(edges, assignment, matrix, table, proposed)
    ratio = F.lit(1.0)
    if not greedy and not nonparametric:
        scored = scored.join(entropy.hastings(edges, assignment, matrix, table, proposed, num_blocks), ["v", "b_to"])
        ratio = F.col("hastings")
    kept = scored.where(entropy.accepted(F.round("de", 9), ratio, uniform(seed + 3, F.col("v")), greedy))
    return guarded(cut(kept.select("v", "b_from", "b_to", F.round("de", 9).alias("de"))), table)


def snake_buckets(frame: DataFrame, score: str, key: str, buckets: int) -> DataFrame:
    """``key, score, bucket``: rows dealt in turn, forth and back, from the largest ``score`` down, ties by ``key``."""
    ranked = numbered(frame.select(key, score), F.desc(score), F.col(key), name="_rank")
    place = F.pmod(F.col("_rank"), F.lit(2 * buckets))
    return ranked.select(key, score, F.when(place < buckets, place).otherwise(2 * buckets - 1 - place).cast("long").alias("bucket"))


def contiguous_buckets(frame: DataFrame, weight: str, key: str, buckets: int) -> DataFrame:
    """``key, weight, bucket``: consecutive rows in ``key`` order with about equal sums of ``weight``.

    Rows are range-partitioned; only one sum for each partition meets in a task.
    """
    dealt = cut(frame.select(key, weight).repartitionByRange(key).withColumn("_part", F.spark_partition_id()))
    sums = dealt.groupBy("_part").agg(F.sum(weight).alias("_sum"))
    before = sums.select("_part", (F.sum("_sum").over(Window.orderBy("_part")) - F.col("_sum")).alias("_before"))
    everything = sums.agg(F.sum("_sum")).first()[0] or 1
    within = F.sum(weight).over(Window.partitionBy("_part").orderBy(key)) - F.col(weight)
    place = dealt.withColumn("_within", within).join(F.broadcast(before), "_part")
    bucket = F.least(F.lit(buckets - 1), F.floor((F.col("_before") + F.col("_within")) * buckets / everything))
    return place.select(key, weight, bucket.cast("long").alias("bucket"))


def low_degree_neighbors(matrix: DataFrame, block_table: DataFrame, most: int) -> DataFrame:
    """``b, n``: how many of a block's neighbours have a degree of at most ``most``; 0 for blocks without any."""
    from graphloom.operators.blockmodel import neighbor_sets

    low = block_table.where(F.col("d") <= most).select(F.col("b").alias("nb"))
    counts = neighbor_sets(matrix).where("b <> nb").join(low, "nb", "left_semi").groupBy("b").agg(F.count("*").alias("n"))
    return block_table.select("b").join(counts, "b", "left").select("b", F.coalesce("n", F.lit(0)).alias("n"))


def by_neighbors(matrix: DataFrame, block_table: DataFrame, buckets: int) -> DataFrame:
    """``b, n, bucket``: blocks dealt forth and back by how many others they touch, most first."""
    from graphloom.operators.blockmodel import neighbor_sets

    counts = neighbor_sets(matrix).where("b <> nb").groupBy("b").agg(F.count("*").alias("n"))
    return snake_buckets(block_table.select("b").join(counts, "b", "left").na.fill(0), "n", "b", buckets)


def imbalance(frame: DataFrame, bucket: str, weight: str) -> DataFrame:
    """One row: ``buckets, heaviest, mean, imbalance`` (heaviest over mean) of the buckets' sums."""
    sums = frame.groupBy(bucket).agg(F.sum(weight).cast("double").alias("x"))
    return sums.agg(F.count("*").alias("buckets"), F.max("x").alias("heaviest"), F.avg("x").alias("mean"), (F.max("x") / F.avg("x")).alias("imbalance"))


def early_stop(changes: list[float], initial: float, bracketed: bool) -> bool:
    """Whether a run of sweeps stalls: no change at all, or the mean fall of the last three under a share of the initial length."""
    if changes and changes[-1] == 0:
        return True
    return len(changes) > 3 and -sum(changes[-3:]) / 3 < (1e-4 if bracketed else 5e-4) * initial
