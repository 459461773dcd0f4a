"""Edges and vertices: ``edges(src, dst, w)`` with whole numbers, a multigraph where ``w`` counts parallel edges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.operators.common import cut, first_n


def weighted(edges: DataFrame) -> DataFrame:
    """Parallel edges as one row with their number."""
    return edges.groupBy("src", "dst").agg(F.sum("w").cast("long").alias("w"))


def deduplicated(edges: DataFrame) -> DataFrame:
    """Every distinct edge once, with weight 1."""
    return edges.select("src", "dst").distinct().withColumn("w", F.lit(1).cast("long"))


def symmetrised(edges: DataFrame) -> DataFrame:
    """Both directions of every edge; a loop stays one edge."""
    return edges.unionByName(edges.where("src <> dst").select(F.col("dst").alias("src"), F.col("src").alias("dst"), "w"))


def add_edge(edges: DataFrame, src: int, dst: int, w: int = 1) -> DataFrame:
    return edges.unionByName(edges.sparkSession.createDataFrame([(src, dst, w)], "src long, dst long, w long"))


def endpoints(edges: DataFrame) -> DataFrame:
    """One row for each end of each edge: ``v, k_out, k_in, loop``; the scan is read once."""
    ends = F.array(
        F.struct(F.col("src").alias("v"), F.col("w").alias("k_out"), F.lit(0).cast("long").alias("k_in"), (F.col("src") == F.col("dst")).alias("loop")),
        F.struct(F.col("dst").alias("v"), F.lit(0).cast("long").alias("k_out"), F.col("w").alias("k_in"), (F.col("src") == F.col("dst")).alias("loop")),
    )
    return edges.select(F.explode(ends).alias("x")).select("x.*")


def degrees(edges: DataFrame) -> DataFrame:
    """``v, k_out, k_in, k, has_self`` of every vertex with an edge; a vertex's loops count once in ``k``."""
    per = endpoints(edges).groupBy("v").agg(F.sum("k_out").cast("long").alias("k_out"), F.sum("k_in").cast("long").alias("k_in"), F.max("loop").alias("has_self"))
    return per.select("v", "k_out", "k_in", (F.col("k_out") + F.col("k_in") - F.col("has_self").cast("long")).alias("k"), "has_self")


def vertex_count(edges: DataFrame) -> int:
    """Vertices of a graph whose ids run from 0."""
    return int(edges.agg(F.max(F.greatest("src", "dst"))).first()[0] or -1) + 1


def neighbors(edges: DataFrame) -> DataFrame:
    """The bag of neighbours ``v, nb, w``: out and in, so that reciprocal neighbours come twice."""
    return edges.select(F.col("src").alias("v"), F.col("dst").alias("nb"), "w").unionAll(edges.select(F.col("dst"), F.col("src"), "w"))


def islands(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """Vertices without an edge."""
    return vertices.join(endpoints(edges).select("v").distinct(), "v", "left_anti")


def largest(frame: DataFrame, score: str, key: str, n: int) -> DataFrame:
    """The ``n`` rows with the largest whole-number ``score``, ties by the smallest ``key``.

    The score's histogram gives the score at which the n-th row stands; all
    rows over it are taken, and only those that tie at it are sorted.
    """
    if n <= 0:
        return frame.limit(0)
    counts = frame.groupBy(score).agg(F.count("*").alias("c"))
    running = counts.select(score, "c", F.sum("c").over(Window.orderBy(F.desc(score))).alias("upto"))
    at = running.where(F.col("upto") >= n).orderBy(F.desc(score)).limit(1).first()
    if at is None:
        return frame
    ties = frame.where(F.col(score) == at[score])
    room = n - (at["upto"] - at["c"])
    return frame.where(F.col(score) > at[score]).unionByName(ties if room >= at["c"] else first_n(ties, room, F.col(key)))


def high_low(edges: DataFrame, fraction: float) -> DataFrame:
    """``v, k, is_high``: the share ``fraction`` of vertices with the largest degrees is high."""
    deg = cut(degrees(edges).select("v", "k"))
    n = deg.count()
    high = largest(deg, "k", "v", -int(-(fraction * n) // 1)).select("v", F.lit(True).alias("is_high"))
    return deg.join(high, "v", "left").select("v", "k", F.coalesce("is_high", F.lit(False)).alias("is_high"))


def degree_products(edges: DataFrame) -> DataFrame:
    """``src, dst, w, product`` of the ends' degrees; tasks hold degrees, and the edges pass by."""
    edges = cut(edges.select("src", "dst", "w"))
    deg = degrees(edges).select("v", "k")
    source, target = (deg.toDF(end, f"k_{end}").hint("shuffle_hash") for end in ("src", "dst"))
    return edges.join(source, "src").join(target, "dst").select("src", "dst", "w", (F.col("k_src") * F.col("k_dst")).alias("product"))


def edge_order() -> list[Column]:
    return [F.desc("product"), F.col("src"), F.col("dst")]


def top_edges(edges: DataFrame, n: int) -> DataFrame:
    """The ``n`` edges of the largest degree products, a report."""
    return degree_products(edges).orderBy(*edge_order()).limit(n)


def influential_by_edges(edges: DataFrame, n: int) -> DataFrame:
    """The first ``n`` distinct ends met while edges are walked by falling degree product, sources before targets.

    An end is first met on an edge of its largest product, so only edges that
    reach the ``n``-th largest of these are put in order.
    """
    products = cut(degree_products(edges).select("src", "dst", "product"))
    best = products.select(F.explode(F.array("src", "dst")).alias("v"), "product").groupBy("v").agg(F.max("product").alias("product"))
    least = first_n(best.select("product"), n, F.desc("product")).agg(F.min("product")).first()[0]
    ends = products.where(F.col("product") >= F.lit(least).cast("long")).select(F.posexplode(F.array("src", "dst")).alias("side", "v"), "product", "src", "dst")
    first = cut(ends.groupBy("v").agg(F.min(F.struct((-F.col("product")).alias("product"), "src", "dst", "side")).alias("first")))
    return first_n(first, n, F.col("first"), F.col("v")).select("v")


def induced(edges: DataFrame, vertices: DataFrame) -> DataFrame:
    """Edges with both ends in ``vertices(v)``."""
    kept = vertices.select("v").distinct()
    return edges.join(kept.withColumnRenamed("v", "src"), "src", "left_semi").join(kept.withColumnRenamed("v", "dst"), "dst", "left_semi").select("src", "dst", "w")


def relabelled(edges: DataFrame, mapping: DataFrame) -> DataFrame:
    """Edges among the keys of ``mapping(v, local_v)``, in local ids."""
    source, target = mapping.select(F.col("v").alias("src"), F.col("local_v").alias("s")), mapping.select(F.col("v").alias("dst"), F.col("local_v").alias("d"))
    return edges.join(source, "src").join(target, "dst").select(F.col("s").alias("src"), F.col("d").alias("dst"), "w")


def modularity(edges: DataFrame, assignment: DataFrame) -> DataFrame:
    """Directed modularity ``q`` as one row; parallel edges count once as adjacency, with their number in the degrees."""
    from graphloom.operators.blockmodel import block_matrix

    total = edges.agg(F.sum("w").alias("e"))
    cells = block_matrix(edges, assignment)
    inner = block_matrix(deduplicated(edges), assignment).where("r = c").select(F.col("r").alias("b"), F.col("w").alias("a"))
    out, into = cells.groupBy(F.col("r").alias("b")).agg(F.sum("w").alias("o")), cells.groupBy(F.col("c").alias("b")).agg(F.sum("w").alias("i"))
    each = out.join(into, "b", "full").join(inner, "b", "left").crossJoin(F.broadcast(total))
    a, o, i, e = (F.coalesce(F.col(c), F.lit(0)).cast("double") for c in ("a", "o", "i", "e"))
    return each.agg(F.sum(a / e - o * i / (e * e)).alias("q"))


def consecutive(events: DataFrame, group: str, order: list[str], value: str) -> DataFrame:
    """``src, dst``: each row's ``value`` and that of the row after it in its group, without gathering a group.

    Rows are range-partitioned by group and order.  Inside a partition the next
    row is a window function; a partition's last row of a group finds its
    successor among the partitions' first rows, of which there is one for each
    partition and group in it.
    """
    keys = [group, *order]
    dealt = cut(events.select(*dict.fromkeys([*keys, value])).repartitionByRange(*keys).withColumn("_part", F.spark_partition_id()))
    within = Window.partitionBy("_part", group).orderBy(*order)
    ahead = dealt.select("_part", group, F.col(value).alias("src"), F.lead(value).over(within).alias("dst"))
    first = dealt.groupBy("_part", group).agg(F.min_by(value, F.struct(*order)).alias("first"))
    after = first.select("_part", group, F.lead("first").over(Window.partitionBy(group).orderBy("_part")).alias("after"))
    joined = ahead.join(after, ["_part", group], "left")
    return joined.select("src", F.coalesce("dst", "after").alias("dst")).where("dst is not null")
