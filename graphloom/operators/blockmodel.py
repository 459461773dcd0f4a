"""The blockmodel: counts of edges between blocks, and the sparse matrix operations on them.

``matrix(r, c, w)`` holds no zero rows; one relation serves rows and columns.
``assignment(v, b)``; null labels are unknown.  ``blocks(b, d_out, d_in, d, size)``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.operators.common import cut, numbered
from graphloom.operators.graph import degrees


def identity_assignment(vertices: DataFrame) -> DataFrame:
    """Every vertex in a block of its own."""
    return vertices.select("v", F.col("v").alias("b"))


def block_matrix(edges: DataFrame, assignment: DataFrame) -> DataFrame:
    """Edges counted by the blocks of their ends; edges with an unlabelled end are left out."""
    known = assignment.where("b is not null")
    source, target = known.toDF("src", "r"), known.toDF("dst", "c")
    return edges.join(source, "src").join(target, "dst").groupBy("r", "c").agg(F.sum("w").cast("long").alias("w"))


def blocks(matrix: DataFrame, assignment: DataFrame) -> DataFrame:
    """Degrees and sizes of all blocks that have a vertex; ``d`` counts an inner edge once."""
    cells = F.array(F.struct(F.col("r").alias("b"), F.col("w").alias("o"), F.lit(0).cast("long").alias("i")), F.struct(F.col("c").alias("b"), F.lit(0).cast("long").alias("o"), F.col("w").alias("i")))
    own = F.when(F.col("r") == F.col("c"), F.col("w")).otherwise(0)
    ends = matrix.select(F.explode(cells).alias("x"), own.alias("own")).select("x.b", "x.o", "x.i", (F.col("own") * (F.col("x.o") > 0).cast("long")).alias("own"))
    sums = ends.groupBy("b").agg(F.sum("o").alias("o"), F.sum("i").alias("i"), F.sum("own").alias("own"))
    sizes = assignment.where("b is not null").groupBy("b").agg(F.count("*").alias("size"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long")
    return sizes.join(sums, "b", "left").select("b", zero("o").alias("d_out"), zero("i").alias("d_in"), (zero("o") + zero("i") - zero("own")).alias("d"), "size")


def degree_histogram(edges: DataFrame, assignment: DataFrame) -> DataFrame:
    """``b, side, k, n``: how many vertices of a block have an out- or in-degree."""
    deg = degrees(edges).join(assignment.where("b is not null"), "v", "right")
    sides = F.explode(F.array(F.struct(F.lit("out").alias("side"), F.coalesce("k_out", F.lit(0)).alias("k")), F.struct(F.lit("in").alias("side"), F.coalesce("k_in", F.lit(0)).alias("k"))))
    return deg.select("b", sides.alias("x")).groupBy("b", "x.side", "x.k").agg(F.count("*").alias("n"))


def compact(assignment: DataFrame) -> DataFrame:
    """Labels as dense numbers from 0, in the order of the old ones."""
    old = assignment.where("b is not null").select("b").distinct()
    dense = numbered(old, F.col("b"), name="new").select("b", "new")
    return assignment.join(dense, "b", "left").select("v", F.col("new").alias("b"))


def merged(assignment: DataFrame, merges: DataFrame) -> DataFrame:
    """Labels after ``merges(block, into)``, which must not chain (see ``merge.resolved``)."""
    return assignment.join(merges.select(F.col("block").alias("b"), "into"), "b", "left").select("v", F.coalesce("into", "b").alias("b"))


def moved(assignment: DataFrame, moves: DataFrame) -> DataFrame:
    """Labels after ``moves(v, b_to)``; vertices without a move keep theirs."""
    return assignment.join(moves.select("v", "b_to"), "v", "left").select("v", F.coalesce("b_to", "b").alias("b"))


# matrix operations


def cells_sum(*parts: DataFrame) -> DataFrame:
    """The sum of matrices or deltas, without zero cells."""
    total = parts[0]
    for part in parts[1:]:
        total = total.unionByName(part)
    return total.groupBy("r", "c").agg(F.sum("w").cast("long").alias("w")).where("w <> 0")


def negated(matrix: DataFrame) -> DataFrame:
    return matrix.select("r", "c", (-F.col("w")).alias("w"))


def row(matrix: DataFrame, b: int) -> DataFrame:
    return matrix.where(F.col("r") == b).select("c", "w")


def column(matrix: DataFrame, b: int) -> DataFrame:
    return matrix.where(F.col("c") == b).select("r", "w")


def dense_row(matrix: DataFrame, b: int, size: int) -> DataFrame:
    """All ``size`` cells of a row, zeros too."""
    every = matrix.sparkSession.range(size).toDF("c")
    return every.join(row(matrix, b), "c", "left").select("c", F.coalesce("w", F.lit(0)).cast("long").alias("w"))


def dense_column(matrix: DataFrame, b: int, size: int) -> DataFrame:
    every = matrix.sparkSession.range(size).toDF("r")
    return every.join(column(matrix, b), "r", "left").select("r", F.coalesce("w", F.lit(0)).cast("long").alias("w"))


def without(matrix: DataFrame, r: list[int] | None = None, c: list[int] | None = None) -> DataFrame:
    """The matrix without some rows and columns."""
    kept = matrix
    if r:
        kept = kept.where(~F.col("r").isin(r))
    if c:
        kept = kept.where(~F.col("c").isin(c))
    return kept


def replaced(matrix: DataFrame, cells: DataFrame, r: list[int] | None = None, c: list[int] | None = None) -> DataFrame:
    """Rows and columns overwritten by ``cells``."""
    return without(matrix, r, c).unionByName(cells.where("w <> 0"))


def looked_up(pairs: DataFrame, matrix: DataFrame, name: str = "w") -> DataFrame:
    """``pairs(r, c, ...)`` with the cell's weight, 0 where there is none."""
    return pairs.join(matrix.select("r", "c", F.col("w").alias("_w")), ["r", "c"], "left").withColumn(name, F.coalesce("_w", F.lit(0)).cast("long")).drop("_w")


def neighbor_weights(matrix: DataFrame) -> DataFrame:
    """``b, nb, w``: a block's weight to and from each neighbour, inner edges once."""
    back = matrix.where("r <> c").select(F.col("c").alias("b"), F.col("r").alias("nb"), "w")
    return matrix.select(F.col("r").alias("b"), F.col("c").alias("nb"), "w").unionAll(back).groupBy("b", "nb").agg(F.sum("w").cast("long").alias("w"))


def neighbor_sets(matrix: DataFrame) -> DataFrame:
    return neighbor_weights(matrix).select("b", "nb")


def distinct_edges(matrix: DataFrame) -> DataFrame:
    """``b, n``: cells in a block's row and column, the diagonal once."""
    ends = matrix.select(F.explode(F.when(F.col("r") == F.col("c"), F.array("r")).otherwise(F.array("r", "c"))).alias("b"))
    return ends.groupBy("b").agg(F.count("*").alias("n"))


def marginals(matrix: DataFrame, axis: int) -> DataFrame:
    """Sums over rows (axis 0, by column) or over columns (axis 1, by row)."""
    key = "c" if axis == 0 else "r"
    return matrix.groupBy(F.col(key).alias("b")).agg(F.sum("w").cast("long").alias("w"))


def totals(matrix: DataFrame) -> DataFrame:
    """One row: ``edges, trace, cells, interblock`` (the share of edges between blocks)."""
    inner = F.sum(F.when(F.col("r") == F.col("c"), F.col("w")).otherwise(0)).cast("long")
    edges = F.sum("w").cast("long")
    return matrix.agg(edges.alias("edges"), inner.alias("trace"), F.count("*").alias("cells"), ((edges - inner) / edges).alias("interblock"))


def size_variation(assignment: DataFrame) -> DataFrame:
    """One row: the population variance of block sizes over the largest that their mean and range allow."""
    sizes = assignment.where("b is not null").groupBy("b").agg(F.count("*").cast("double").alias("size"))
    top, low, mean = F.max("size"), F.min("size"), F.avg("size")
    bound = (top - low) * (top - mean) / 4
    return sizes.agg(F.when(bound > 0, F.var_pop("size") / bound).otherwise(F.lit(0.0)).alias("variation"))


def difficulty(matrix: DataFrame, assignment: DataFrame) -> DataFrame:
    """One row: harmonic mean of the size variation and the share of edges between blocks."""
    both = size_variation(assignment).crossJoin(F.broadcast(totals(matrix).select("interblock")))
    a, b = F.col("variation"), F.col("interblock")
    return both.select(F.when(a + b > 0, 2 * a * b / (a + b)).otherwise(F.lit(0.0)).alias("difficulty"))


def same_relation(a: DataFrame, b: DataFrame) -> bool:
    """Whether two relations hold the same rows as often."""
    both = a.withColumn("_n", F.lit(1)).union(b.withColumn("_n", F.lit(-1)))
    return both.groupBy(a.columns).agg(F.sum("_n").alias("_n")).where("_n <> 0").isEmpty()


def valid(edges: DataFrame, assignment: DataFrame, matrix: DataFrame, block_table: DataFrame) -> bool:
    """Whether a carried model equals one built anew from its labels."""
    fresh = cut(block_matrix(edges, assignment))
    return same_relation(fresh, matrix.select("r", "c", "w")) and same_relation(blocks(fresh, assignment), block_table)
