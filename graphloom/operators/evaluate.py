"""Scores of labels against truth, from the contingency table ``(b, t, n)``."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.functions.numeric import pairs, xlnx


def contingency(assignment: DataFrame, truth: DataFrame) -> DataFrame:
    """Vertices by block and true block; those without either are left out."""
    return assignment.where("b is not null").join(truth.where("t is not null and t >= 0"), "v").groupBy("b", "t").agg(F.count("*").alias("n"))


def _sums(table: DataFrame) -> DataFrame:
    """Cells and both marginals in one pass: ``kind`` 0 for cells, 1 for a block's row, 2 for a truth's column, 3 for all."""
    return table.cube("b", "t").agg(F.sum("n").cast("long").alias("n"), F.grouping_id().alias("kind"))


def pairwise(table: DataFrame, vertices: int | None = None) -> DataFrame:
    """One row: ``rand, precision, recall, f1``, over pairs of vertices.

    ``vertices`` counts those without truth too, for the Rand index.  Recall is
    against the blocks' pairs, precision against the truth's; scores of no
    pairs are 0.
    """
    kinds = _sums(table)
    part = lambda k, x: F.coalesce(F.sum(F.when(F.col("kind") == k, x)), F.lit(0.0))
    n, square = F.col("n"), F.col("n").cast("double") * F.col("n")
    one = kinds.agg(
        part(0, pairs(n)).alias("c"), part(1, pairs(n)).alias("r"), part(2, pairs(n)).alias("k"),
        part(0, square).alias("cc"), part(1, square).alias("rr"), part(2, square).alias("kk"), part(3, n.cast("double")).alias("all"),
    )
    total = F.lit(float(vertices)) if vertices is not None else F.col("all")
    ratio = lambda a, b: F.when(b > 0, a / b).otherwise(F.lit(0.0))
    recall, precision = ratio(F.col("c"), F.col("r")), ratio(F.col("c"), F.col("k"))
    rand = ratio(F.col("c") + (total * total + F.col("cc") - F.col("rr") - F.col("kk")) / 2, pairs(total))
    return one.select(rand.alias("rand"), precision.alias("precision"), recall.alias("recall"), ratio(2 * precision * recall, precision + recall).alias("f1"))


def nmi(table: DataFrame) -> DataFrame:
    """One row: ``nmi``, mutual information over the geometric mean of the entropies; 0 where either is 0."""
    kinds = _sums(table)
    part = lambda k: F.coalesce(F.sum(F.when(F.col("kind") == k, xlnx(F.col("n")))), F.lit(0.0))
    one = kinds.agg(part(0).alias("c"), part(1).alias("r"), part(2).alias("k"), F.coalesce(F.sum(F.when(F.col("kind") == 3, F.col("n"))), F.lit(0)).cast("double").alias("n"))
    n = F.col("n")
    first, second = F.ln(n) - F.col("r") / n, F.ln(n) - F.col("k") / n
    mutual = F.ln(n) + (F.col("c") - F.col("r") - F.col("k")) / n
    return one.select(F.when((n > 0) & (first > 1e-12) & (second > 1e-12), mutual / F.sqrt(first * second)).otherwise(F.lit(0.0)).alias("nmi"))


def best_matching(gain: np.ndarray) -> list[int]:
    """The column for each row that maximises the sum, by shortest augmenting paths with potentials; -1 for none.

    The rows are the shorter side, so nothing is padded to a square.
    """
    if gain.shape[0] > gain.shape[1]:
        found = [-1] * gain.shape[0]
        for column, row in enumerate(best_matching(gain.T)):
            found[row] = column
        return found
    rows, columns = gain.shape
    top = gain.max(initial=0)
    u, v = np.zeros(rows), np.zeros(columns)
    owner = np.full(columns, -1)
    for row in range(rows):
        least, came, done = np.full(columns, np.inf), np.full(columns, -1), np.zeros(columns, bool)
        at, column = row, -1
        while at != -1:
            reduced = top - gain[at] - u[at] - v + (0 if column < 0 else least[column])
            better = ~done & (reduced < least)
            least[better], came[better] = reduced[better], column
            column = int(np.argmin(np.where(done, np.inf, least)))
            done[column] = True
            at = int(owner[column])
        shortest = least[column]
        u[row] += shortest
        for other in np.flatnonzero(done):
            if other != column:
                u[owner[other]] += shortest - least[other]
            v[other] += least[other] - shortest
        while column != -1:
            before = int(came[column])
            owner[column] = row if before < 0 else owner[before]
            column = before
    found = [-1] * rows
    for column, row in enumerate(owner):
        if row >= 0:
            found[int(row)] = column
    return found


def accuracy(table: DataFrame) -> float:
    """Share of vertices whose block is matched to their true block, for the best one-to-one matching.

    Blocks and true blocks meet only where they share a vertex, so the matching
    falls into the connected components of the contingency table: each is
    solved in a task of its own, and none is gathered on the driver.
    """
    from graphloom.operators.common import cut
    from graphloom.operators.components import connected

    dense = cut(table.select("b", "t", "n"))
    ends = dense.select((F.col("b") * 2).alias("a"), (F.col("t") * 2 + 1).alias("c"))
    parts = connected(ends.toDF("a", "b")).select(F.col("node").alias("_node"), "root")
    grouped = dense.join(parts, F.col("b") * 2 == F.col("_node")).select("root", "b", "t", "n")
    matched = grouped.groupBy("root").applyInArrow(_matched, "root long, matched long")
    one = matched.agg(F.coalesce(F.sum("matched"), F.lit(0)).alias("m")).crossJoin(dense.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"))).first()
    return one.m / one.n if one.n else 0.0


def _matched(group: pa.Table) -> pa.Table:
    rows, columns = (np.unique(group[c].to_numpy(), return_inverse=True) for c in ("b", "t"))
    gain = np.zeros((len(rows[0]), len(columns[0])))
    gain[rows[1], columns[1]] = group["n"].to_numpy()
    total = sum(int(gain[k, c]) for k, c in enumerate(best_matching(gain)) if c >= 0)
    return pa.table({"root": [group["root"][0].as_py()], "matched": [total]}, schema=pa.schema([("root", pa.int64()), ("matched", pa.int64())]))


def scores(edges: DataFrame, assignment: DataFrame, truth: DataFrame, vertices: int) -> DataFrame:
    """One row: the pairwise scores, ``nmi`` and the description length ``true_mdl`` of the truth as labels."""
    from graphloom.operators.blockmodel import block_matrix
    from graphloom.operators.common import cut
    from graphloom.operators.entropy import mdl

    table = cut(contingency(assignment, truth))
    labels = truth.where("t is not null and t >= 0").select("v", F.col("t").alias("b"))
    length = mdl(block_matrix(edges, labels), vertices, labels.select("b").distinct().count()).select(F.col("mdl").alias("true_mdl"))
    return pairwise(table, vertices).crossJoin(F.broadcast(nmi(table))).crossJoin(F.broadcast(length))
