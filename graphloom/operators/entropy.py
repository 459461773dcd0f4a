"""Parametric description length.

With ``f(x) = x ln x`` the log-likelihood of a blockmodel is the sum of f over
the cells less that over the blocks' out- and in-degrees.  A move or a merge
thus changes only the terms of the cells and the four degrees it touches, and
nothing else is read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.functions.numeric import h, xlnx
from graphloom.operators.blockmodel import cells_sum, marginals

f = xlnx


def log_likelihood(matrix: DataFrame) -> DataFrame:
    """One row: ``e`` (edges) and ``l``."""
    cells = matrix.agg(F.sum("w").cast("long").alias("e"), F.sum(f(F.col("w"))).alias("cells"))
    rows, columns = (marginals(matrix, axis).agg(F.sum(f(F.col("w"))).alias(name)) for axis, name in ((1, "rows"), (0, "columns")))
    return cells.crossJoin(F.broadcast(rows)).crossJoin(F.broadcast(columns)).select("e", (F.col("cells") - F.col("rows") - F.col("columns")).alias("l"))


def log_likelihood_undirected(matrix: DataFrame) -> DataFrame:
    """One row: ``l`` with halved cells and degrees, for a symmetric matrix."""
    rows = marginals(matrix, 1).toDF("r", "dr")
    columns = marginals(matrix, 0).toDF("c", "dc")
    joined = matrix.join(rows, "r").join(columns, "c")
    w = F.col("w") / 2
    return joined.agg((0.5 * F.sum(w * F.ln(w / (F.col("dr") / 2 * F.col("dc") / 2)))).alias("l"))


def model_cost(edges: Column, vertices: Column, num_blocks: Column) -> Column:
    """Description length of the model itself: ``E h(B^2/E) + V ln B``."""
    e, v, b = edges.cast("double"), vertices.cast("double"), num_blocks.cast("double")
    return e * h(b * b / e) + v * F.ln(b)


def null_cost(edges: Column) -> Column:
    """Description length of a graph in one block."""
    e = edges.cast("double")
    return e * h(1 / e) + e * F.ln(e)


def mdl(matrix: DataFrame, vertices: int, num_blocks: int) -> DataFrame:
    """One row: ``e, l, mdl, null_mdl, normalized``; ``num_blocks`` counts empty blocks too."""
    one = log_likelihood(matrix)
    cost = model_cost(F.col("e"), F.lit(vertices), F.lit(num_blocks)) - F.col("l")
    return one.select("e", "l", cost.alias("mdl"), null_cost(F.col("e")).alias("null_mdl"), (cost / null_cost(F.col("e"))).alias("normalized"))


def _degree_change(old: Column, change: Column) -> Column:
    return f(old + change) - f(old)


def merge_cells(matrix: DataFrame, merges: DataFrame) -> DataFrame:
    """``block, into, r, c, w, nr, nc``: every cell that a merge touches, once, and where it goes."""
    ends = F.explode(F.when(F.col("r") == F.col("c"), F.array("r")).otherwise(F.array("r", "c")))
    incident = matrix.select(ends.alias("b"), "r", "c", "w")
    either = merges.select("block", "into", F.explode(F.array("block", "into")).alias("b"))
    touched = either.join(incident, "b").select("block", "into", "r", "c", "w").distinct()
    to = lambda c: F.when(F.col(c) == F.col("block"), F.col("into")).otherwise(F.col(c))
    return touched.select("*", to("r").alias("nr"), to("c").alias("nc"))


def merge_delta(matrix: DataFrame, merges: DataFrame) -> DataFrame:
    """``block, into, de``: the rise of the description length's data part for each of ``merges(block, into)``."""
    cells = merge_cells(matrix, merges)
    new = cells.groupBy("block", "into", "nr", "nc").agg(F.sum("w").alias("w"), F.sum(f(F.col("w"))).alias("old"))
    change = new.groupBy("block", "into").agg(F.sum(f(F.col("w")) - F.col("old")).alias("cells"))
    out, into = marginals(matrix, 1), marginals(matrix, 0)
    both = out.toDF("b", "o").join(into.toDF("b", "i"), "b", "full").select("b", F.coalesce("o", F.lit(0)).alias("o"), F.coalesce("i", F.lit(0)).alias("i"))
    first, second = both.toDF("block", "o1", "i1"), both.toDF("into", "o2", "i2")
    joined = merges.select("block", "into").join(change, ["block", "into"], "left").join(first, "block", "left").join(second, "into", "left")
    zero = {c: F.coalesce(F.col(c), F.lit(0)) for c in ("o1", "i1", "o2", "i2")}
    degrees = sum((f(zero[a] + zero[b]) - f(zero[a]) - f(zero[b]) for a, b in (("o1", "o2"), ("i1", "i2"))), F.lit(0.0))
    return joined.select("block", "into", (degrees - F.coalesce("cells", F.lit(0.0))).alias("de"))


def move_cells(edges: DataFrame, assignment: DataFrame, moves: DataFrame) -> DataFrame:
    """``v, b_from, b_to, r, c, dw``: the cells that each of ``moves(v, b_to)`` changes, without zero changes."""
    labelled = moves.join(assignment.select("v", F.col("b").alias("b_from")), "v").where("b_from <> b_to")
    other = assignment.select(F.col("v").alias("u"), F.col("b").alias("b_u"))
    out = edges.where("src <> dst").select(F.col("src").alias("v"), F.col("dst").alias("u"), "w", F.lit(True).alias("out"))
    into = edges.where("src <> dst").select(F.col("dst").alias("v"), F.col("src").alias("u"), "w", F.lit(False).alias("out"))
    near = labelled.join(out.unionAll(into), "v").join(other, "u")
    cell = lambda b, sign: F.struct(F.when(F.col("out"), F.col(b)).otherwise(F.col("b_u")).alias("r"), F.when(F.col("out"), F.col("b_u")).otherwise(F.col(b)).alias("c"), (F.col("w") * sign).alias("dw"))
    changes = near.select("v", "b_from", "b_to", F.explode(F.array(cell("b_from", -1), cell("b_to", 1))).alias("x"))
    loops = labelled.join(edges.where("src = dst").select(F.col("src").alias("v"), "w"), "v")
    diagonal = lambda b, sign: F.struct(F.col(b).alias("r"), F.col(b).alias("c"), (F.col("w") * sign).alias("dw"))
    own = loops.select("v", "b_from", "b_to", F.explode(F.array(diagonal("b_from", -1), diagonal("b_to", 1))).alias("x"))
    return changes.unionAll(own).groupBy("v", "b_from", "b_to", "x.r", "x.c").agg(F.sum("x.dw").cast("long").alias("dw")).where("dw <> 0")


def _ends(edges: DataFrame) -> DataFrame:
    from graphloom.operators.graph import degrees

    return degrees(edges).select("v", "k_out", "k_in")


def move_delta(edges: DataFrame, assignment: DataFrame, matrix: DataFrame, block_table: DataFrame, moves: DataFrame, cells: DataFrame | None = None) -> DataFrame:
    """``v, b_from, b_to, de`` for every move that changes a label; an island's move costs nothing."""
    changed = cells if cells is not None else move_cells(edges, assignment, moves)
    looked = changed.join(matrix, ["r", "c"], "left").select("v", "b_to", "dw", F.coalesce("w", F.lit(0)).alias("w"))
    by_cell = looked.groupBy("v", "b_to").agg(F.sum(f(F.col("w") + F.col("dw")) - f(F.col("w"))).alias("cells"))
    labelled = moves.select("v", "b_to").join(assignment.select("v", F.col("b").alias("b_from")), "v").where("b_from <> b_to")
    d = block_table.select("b", "d_out", "d_in")
    joined = labelled.join(by_cell, ["v", "b_to"], "left").join(_ends(edges), "v", "left").join(d.toDF("b_from", "o1", "i1"), "b_from", "left").join(d.toDF("b_to", "o2", "i2"), "b_to", "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    degrees = (
        _degree_change(zero("o1"), -zero("k_out")) + _degree_change(zero("i1"), -zero("k_in")) + _degree_change(zero("o2"), zero("k_out")) + _degree_change(zero("i2"), zero("k_in"))
    )
    return joined.select("v", "b_from", "b_to", (degrees - F.coalesce("cells", F.lit(0.0))).alias("de"))


def hastings(edges: DataFrame, assignment: DataFrame, matrix: DataFrame, block_table: DataFrame, moves: DataFrame, num_blocks: int) -> DataFrame:
    """``v, b_to, hastings``: how likely the way back is proposed against the way there; 1 for islands.

    A vertex's loop counts once among its neighbours.
    """
    labelled = moves.select("v", "b_to").join(assignment.select("v", F.col("b").alias("b_from")), "v").where("b_from <> b_to")
    near = edges.select(F.col("src").alias("v"), F.col("dst").alias("u"), "w").unionAll(edges.where("src <> dst").select(F.col("dst"), F.col("src"), "w"))
    counts = labelled.join(near, "v").join(assignment.select(F.col("v").alias("u"), F.col("b").alias("x")), "u").groupBy("v", "b_from", "b_to", "x").agg(F.sum("w").alias("n"))
    cells = move_cells(edges, assignment, moves)
    sums = cells_both(matrix)
    change = cells.where("r = b_from or c = b_from").select("v", "b_to", F.when(F.col("r") == F.col("b_from"), F.col("c")).otherwise(F.col("r")).alias("x"), F.when(F.col("r") == F.col("c"), F.col("dw") * 2).otherwise(F.col("dw")).alias("dw"))
    change = change.groupBy("v", "b_to", "x").agg(F.sum("dw").alias("dw"))
    diagonal = cells.where("r = c").select("v", "b_to", F.col("r").alias("x"), F.col("dw").alias("own"))
    d = block_table.select(F.col("b").alias("x"), "d")
    joined = (
        counts.join(sums.toDF("b_to", "x", "w_to"), ["b_to", "x"], "left")
        .join(sums.toDF("b_from", "x", "w_from"), ["b_from", "x"], "left")
        .join(change, ["v", "b_to", "x"], "left").join(diagonal, ["v", "b_to", "x"], "left").join(d, "x").join(_ends(edges), "v")
    )
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    k = F.col("k_out") + F.col("k_in")
    after = F.col("d") + F.when(F.col("x") == F.col("b_from"), -k - zero("own")).when(F.col("x") == F.col("b_to"), k - zero("own")).otherwise(0)
    forward = F.sum(F.col("n") * (zero("w_to") + 1) / (F.col("d") + num_blocks))
    backward = F.sum(F.col("n") * (zero("w_from") + zero("dw") + 1) / (after + num_blocks))
    ratios = joined.groupBy("v", "b_to").agg((backward / forward).alias("hastings"))
    return labelled.select("v", "b_to").join(ratios, ["v", "b_to"], "left").select("v", "b_to", F.coalesce("hastings", F.lit(1.0)).alias("hastings"))


def cells_both(matrix: DataFrame) -> DataFrame:
    """``b, x, w``: both cells between two blocks together; a diagonal cell twice."""
    return cells_sum(matrix, matrix.select(F.col("c").alias("r"), F.col("r").alias("c"), "w")).select(F.col("r").alias("b"), F.col("c").alias("x"), "w")


def accepted(de: Column, ratio: Column, u: Column, greedy: bool = True) -> Column:
    """Greedy: only what lowers the description length; else by Metropolis-Hastings with an exponent of 3."""
    return de < 0 if greedy else u <= F.least(F.lit(1.0), F.exp(F.least(F.lit(700.0), -3 * de)) * ratio)
