"""Edge lists, Matrix Market files and truth labels; results as JSON and CSV.

On disk ids run from 1, in memory from 0.
"""

from __future__ import annotations

from dataclasses import asdict

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

EDGES = "src long, dst long, w long"


def exists(spark: SparkSession, path: str) -> bool:
    """Whether ``path`` is there, in any file system that Spark reads."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where)


def resolve(spark: SparkSession, path: str) -> str:
    """The edge list that stands behind ``path``, itself or with .tsv or .mtx after it."""
    for found in (path + ".tsv", path + ".mtx", path):
        if exists(spark, found):
            return found
    raise FileNotFoundError(f"neither {path}.tsv nor {path}.mtx")


def _fields(lines: DataFrame) -> DataFrame:
    return lines.select(F.split(F.trim(F.regexp_replace("value", r"\s+", " ")), " ").alias("x")).where("x[0] <> ''")


def read_edge_list(spark: SparkSession, path: str) -> DataFrame:
    """``src, dst, w`` from lines of two or more whitespace-separated fields; the third is not a weight and isn't read."""
    fields = _fields(spark.read.text(path))
    number = lambda k: (F.get("x", F.lit(k)).cast("long") - 1)
    return fields.select(number(0).alias("src"), number(1).alias("dst"), F.lit(1).cast("long").alias("w"))


def read_matrix_market(spark: SparkSession, path: str) -> DataFrame:
    """A square coordinate matrix as edges; a symmetric one in both directions, loops once.

    The header is the first line; the size line is the first that is neither
    empty nor a comment, however many of those stand before it.
    """
    lines = spark.read.text(path)
    head = lines.first()
    if head is None or not head.value.startswith("%%MatrixMarket"):
        raise ValueError("no Matrix Market header")
    kind = head.value.lower().split()
    if kind[2] != "coordinate":
        raise ValueError("only coordinate matrices are read")
    # its text may occur again as an entry, so the size line is told by its place
    numbered = lines.where(~F.startswith("value", F.lit("%")) & (F.trim("value") != "")).withColumn("_at", F.monotonically_increasing_id())
    size = numbered.agg(F.min(F.struct("_at", "value")).alias("x")).first().x
    if size is None:
        raise ValueError("no size line")
    rows, columns, _ = map(int, size["value"].split()[:3])
    if rows != columns:
        raise ValueError("the matrix isn't square")
    at = size["_at"]
    fields = _fields(numbered.where(F.col("_at") != at).select("value"))
    edges = fields.select((F.get("x", F.lit(0)).cast("long") - 1).alias("src"), (F.get("x", F.lit(1)).cast("long") - 1).alias("dst"), F.lit(1).cast("long").alias("w"))
    if kind[-1] == "symmetric":
        from graphloom.operators.graph import symmetrised

        return symmetrised(edges)
    return edges


def read_truth(spark: SparkSession, path: str) -> DataFrame:
    """``v, t`` from lines of vertex and block, both from 1."""
    fields = _fields(spark.read.text(path))
    return fields.select((F.get("x", F.lit(0)).cast("long") - 1).alias("v"), (F.get("x", F.lit(1)).cast("long") - 1).alias("t"))


def read_graph(spark: SparkSession, path: str, directed: bool = True, dedup: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``edges``, ``vertices(v)`` from 0 to the largest id, and ``truth(v, t)``.

    Truth stands in ``<path>_truePartition.tsv``; without that file every
    vertex has truth 0, and a vertex that isn't listed has null.
    """
    from graphloom.operators import graph

    file = resolve(spark, path)
    first = spark.read.text(file).limit(1).collect()
    edges = read_matrix_market(spark, file) if first and first[0].value.startswith("%%MatrixMarket") else read_edge_list(spark, file)
    if not directed:
        edges = graph.symmetrised(edges)
    if dedup:
        edges = graph.deduplicated(edges)
    vertices = spark.range(graph.vertex_count(edges)).toDF("v")
    stem = file.removesuffix(".tsv").removesuffix(".mtx")
    if exists(spark, f"{stem}_truePartition.tsv"):
        truth = vertices.join(read_truth(spark, f"{stem}_truePartition.tsv"), "v", "left")
    else:
        truth = vertices.select("v", F.lit(0).cast("long").alias("t"))
    return edges, vertices, truth


def write_labels(fit, path: str) -> None:
    """``vertex, block`` lines, both from 1."""
    fit.assignment.select(F.concat_ws("\t", F.col("v") + 1, F.col("b") + 1).alias("value")).write.mode("overwrite").text(path)


def result_row(fit, config, runtime: float, edges: int, vertices: int, scores: dict | None = None) -> dict:
    """What is known of a finished fit, without the labels, as one flat row."""
    last = fit.profile[-1] if fit.profile else {}
    totals = {f"total_{k}": float(sum(p.get(k, 0) for p in fit.profile)) for k in ("mcmc_iterations", "mcmc_moves", "block_merge_time", "mcmc_time")}
    return {
        "runtime": runtime, "num_edges": edges, "num_vertices": vertices, "num_blocks": fit.num_blocks, "mdl": fit.mdl, "iterations": int(last.get("iteration", 0)),
        **totals, **{k: str(v) for k, v in asdict(config).items()}, **{k: float(v) for k, v in (scores or {}).items()},
    }


def append_json(spark: SparkSession, row: dict, path: str) -> None:
    spark.createDataFrame([row]).coalesce(1).write.mode("append").json(path)


def append_profile(spark: SparkSession, profile: list[dict], path: str) -> None:
    """One CSV row for each iteration, and a row numbered -1 with the sums of the counters and times."""
    if not profile:
        return
    names = list(dict.fromkeys(k for p in profile for k in p))
    sums = {k: sum(p.get(k, 0) for p in profile) if k.endswith(("_time", "_moves", "_iterations")) else profile[-1].get(k, 0) for k in names} | {"iteration": -1}
    rows = [tuple(float(p.get(k, 0)) for k in names) for p in (*profile, sums)]
    spark.createDataFrame(rows, ", ".join(f"{k} double" for k in names)).coalesce(1).write.mode("append").csv(path, header=True)
