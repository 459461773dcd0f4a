"""Nonparametric description length, with and without degree correction."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.functions.numeric import lbinom, lfactorial
from graphloom.functions.partitions import log_partitions_col
from graphloom.operators.graph import degrees


def edge_term(r: Column, c: Column, w: Column, undirected: bool = False) -> Column:
    plain = -lfactorial(w)
    return F.when(r == c, plain - w * math.log(2)).otherwise(plain) if undirected else plain


def block_term(d_out: Column, d_in: Column, size: Column, degree_corrected: bool = False, undirected: bool = False) -> Column:
    if degree_corrected:
        return lfactorial(d_out) if undirected else lfactorial(d_out) + lfactorial(d_in)
    ends = d_out if undirected else d_out + d_in
    return F.when(size > 0, ends * F.ln(size)).otherwise(F.lit(0.0))


def sparse_entropy(matrix: DataFrame, block_table: DataFrame, edges: DataFrame | None = None, degree_corrected: bool = False, undirected: bool = False) -> DataFrame:
    """One row: ``s``; the vertices' own terms come in with degree correction."""
    cells = matrix.select(edge_term(F.col("r"), F.col("c"), F.col("w"), undirected).alias("x"))
    ends = block_table.select(block_term(F.col("d_out"), F.col("d_in"), F.col("size"), degree_corrected, undirected).alias("x"))
    parts = cells.unionAll(ends)
    if degree_corrected:
        parts = parts.unionAll(degrees(edges).select((-lfactorial(F.col("k_in")) - lfactorial(F.col("k_out"))).alias("x")))
    return parts.agg(F.sum("x").alias("s"))


def partition_dl(block_table: DataFrame) -> DataFrame:
    """One row: ``dl`` of the labels; blocks without vertices don't count."""
    one = block_table.where("size > 0").agg(F.sum("size").cast("long").alias("n"), F.count("*").alias("b"), F.sum(lfactorial(F.col("size"))).alias("inner"))
    return one.select((lbinom(F.col("n") - 1, F.col("b") - 1) + lfactorial(F.col("n")) - F.col("inner") + F.ln(F.col("n").cast("double"))).alias("dl"))


def edges_dl(num_blocks: Column, edges: Column, undirected: bool = False) -> Column:
    cells = num_blocks * (num_blocks + 1) / 2 if undirected else num_blocks * num_blocks
    return lbinom(cells + edges - 1, edges)


def degree_dl(block_table: DataFrame, histogram: DataFrame, undirected: bool = False) -> DataFrame:
    """One row: ``dl`` of the degrees, given the blocks' degree sums; the partition counts come from distinct pairs."""
    sides = ["d_out"] if undirected else ["d_out", "d_in"]
    wanted = block_table.select(F.explode(F.array(*sides)).alias("n"), F.col("size").alias("k"))
    counts = wanted.groupBy("n", "k").agg(F.count("*").alias("times"))
    shares = counts.select((F.col("times") * log_partitions_col(F.col("n"), F.col("k"))).alias("x"))
    kept = histogram.where("side = 'out'") if undirected else histogram
    inner = kept.select((-lfactorial(F.col("n"))).alias("x"))
    whole = block_table.select((len(sides) * lfactorial(F.col("size"))).alias("x"))
    return shares.unionAll(inner).unionAll(whole).agg(F.sum("x").alias("dl"))


def mdl(matrix: DataFrame, block_table: DataFrame, edges: DataFrame | None = None, histogram: DataFrame | None = None, degree_corrected: bool = False, undirected: bool = False) -> DataFrame:
    """One row: ``sparse_entropy, partition_dl, degree_dl, edges_dl, mdl``."""
    parts = sparse_entropy(matrix, block_table, edges, degree_corrected, undirected).toDF("sparse_entropy").crossJoin(F.broadcast(partition_dl(block_table).toDF("partition_dl")))
    deg = degree_dl(block_table, histogram, undirected).toDF("degree_dl") if degree_corrected else matrix.sparkSession.range(1).select(F.lit(0.0).alias("degree_dl"))
    sums = matrix.agg(F.sum("w").cast("double").alias("e"))
    number = block_table.where("size > 0").agg(F.count("*").alias("b"))
    joined = parts.crossJoin(F.broadcast(deg)).crossJoin(F.broadcast(sums)).crossJoin(F.broadcast(number))
    last = edges_dl(F.col("b"), F.col("e"), undirected)
    return joined.select("sparse_entropy", "partition_dl", "degree_dl", last.alias("edges_dl"), (F.col("sparse_entropy") + F.col("partition_dl") + F.col("degree_dl") + last).alias("mdl"))


def _counts(block_table: DataFrame) -> DataFrame:
    """One row: vertices ``n``, blocks with vertices ``nb``, edges ``e``."""
    return block_table.where("size > 0").agg(F.sum("size").cast("double").alias("n"), F.count("*").cast("double").alias("nb"), F.sum("d_out").cast("double").alias("e"))


def _fewer_blocks(n: Column, nb: Column, e: Column) -> Column:
    """What the terms that depend on the number of blocks change by when there is one less."""
    return lbinom(n - 1, nb - 2) - lbinom(n - 1, nb - 1) + edges_dl(nb - 1, e) - edges_dl(nb, e)


def move_delta(edges: DataFrame, assignment: DataFrame, matrix: DataFrame, block_table: DataFrame, moves: DataFrame) -> DataFrame:
    """``v, b_from, b_to, de``: the change of the length without degree correction for each of ``moves(v, b_to)``.

    A vertex that is alone leaves one block less.
    """
    from graphloom.operators.entropy import _ends, move_cells

    cells = move_cells(edges, assignment, moves).join(matrix, ["r", "c"], "left").select("v", "b_to", "dw", F.coalesce("w", F.lit(0)).alias("w"))
    by_cell = cells.groupBy("v", "b_to").agg(F.sum(lfactorial(F.col("w")) - lfactorial(F.col("w") + F.col("dw"))).alias("cells"))
    labelled = moves.select("v", "b_to").join(assignment.select("v", F.col("b").alias("b_from")), "v").where("b_from <> b_to")
    d = block_table.select("b", "d_out", "d_in", "size")
    joined = labelled.join(by_cell, ["v", "b_to"], "left").join(_ends(edges), "v", "left").join(d.toDF("b_from", "o1", "i1", "s1"), "b_from").join(d.toDF("b_to", "o2", "i2", "s2"), "b_to").crossJoin(F.broadcast(_counts(block_table)))
    ko, ki = F.coalesce("k_out", F.lit(0)), F.coalesce("k_in", F.lit(0))
    ends = (
        block_term(F.col("o1") - ko, F.col("i1") - ki, F.col("s1") - 1) - block_term(F.col("o1"), F.col("i1"), F.col("s1"))
        + block_term(F.col("o2") + ko, F.col("i2") + ki, F.col("s2") + 1) - block_term(F.col("o2"), F.col("i2"), F.col("s2"))
    )
    sizes = F.ln(F.col("s1").cast("double")) - F.ln(F.col("s2") + 1.0)
    gone = F.when(F.col("s1") == 1, _fewer_blocks(F.col("n"), F.col("nb"), F.col("e"))).otherwise(0.0)
    return joined.select("v", "b_from", "b_to", (F.coalesce("cells", F.lit(0.0)) + ends + sizes + gone).alias("de"))


def merge_delta(matrix: DataFrame, block_table: DataFrame, merges: DataFrame) -> DataFrame:
    """``block, into, de``: the change of the length without degree correction for each of ``merges(block, into)``."""
    from graphloom.operators.entropy import merge_cells

    cells = merge_cells(matrix, merges)
    new = cells.groupBy("block", "into", "nr", "nc").agg(F.sum("w").alias("w"), F.sum(lfactorial(F.col("w"))).alias("old"))
    change = new.groupBy("block", "into").agg(F.sum(F.col("old") - lfactorial(F.col("w"))).alias("cells"))
    d = block_table.select("b", "d_out", "d_in", "size")
    joined = merges.select("block", "into").join(change, ["block", "into"], "left").join(d.toDF("block", "o1", "i1", "s1"), "block").join(d.toDF("into", "o2", "i2", "s2"), "into").crossJoin(F.broadcast(_counts(block_table)))
    ends = block_term(F.col("o1") + F.col("o2"), F.col("i1") + F.col("i2"), F.col("s1") + F.col("s2")) - block_term(F.col("o1"), F.col("i1"), F.col("s1")) - block_term(F.col("o2"), F.col("i2"), F.col("s2"))
    sizes = lfactorial(F.col("s1")) + lfactorial(F.col("s2")) - lfactorial(F.col("s1") + F.col("s2"))
    return joined.select("block", "into", (F.coalesce("cells", F.lit(0.0)) + ends + sizes + _fewer_blocks(F.col("n"), F.col("nb"), F.col("e"))).alias("de"))
