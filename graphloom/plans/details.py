"""Queries of the smaller operators: files and sinks, matrix access, splits, parts and balancing, numeric functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.functions import partitions
from graphloom.functions.randomness import uniform_sql
from graphloom.operators import blockmodel as bm
from graphloom.operators import combine, entropy, evaluate, graph, mcmc, proposal, sampling, split
from graphloom.operators.common import cut, shared_dir
from graphloom.plans import fit as fitting
from graphloom.plans.catalogue import _DEGREES, _MODEL, _MOVE_CELLS, _MOVES, _NATION, _TRADE, _nation_model, _trade_model, query
from graphloom.sources import files
from graphloom.sources import tables as src

# files


def _folder(spark: SparkSession, name: str) -> str:
    import uuid

    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def _lines(frame: DataFrame, *columns: str) -> DataFrame:
    return frame.select(F.concat_ws("\t", *[F.col(c).cast("string") for c in columns]).alias("value"))


def _nation_files(spark: SparkSession, sf: str) -> str:
    """An edge list and its truth, as files with ids from 1."""
    path = _folder(spark, "graph")
    edges = src.nations(spark, sf).select((F.col("src") + 1).alias("src"), (F.col("dst") + 1).alias("dst"), "w")
    _lines(edges, "src", "dst", "w").coalesce(1).write.text(f"{path}.tsv")
    truth = src.nation_regions(spark, sf).select((F.col("v") + 1).alias("v"), (F.col("b") + 1).alias("b"))
    _lines(truth, "v", "b").coalesce(1).write.text(f"{path}_truePartition.tsv")
    return path


@query(f"WITH {_NATION} SELECT src, dst, CAST(1 AS BIGINT) AS w FROM e")
def edge_list_file(spark: SparkSession, sf: str) -> DataFrame:
    return files.read_graph(spark, _nation_files(spark, sf))[0]


@query(f"WITH {_NATION} SELECT src, dst, CAST(1 AS BIGINT) AS w FROM e UNION ALL SELECT dst, src, CAST(1 AS BIGINT) FROM e WHERE src <> dst")
def edge_list_file_undirected(spark: SparkSession, sf: str) -> DataFrame:
    return files.read_graph(spark, _nation_files(spark, sf), directed=False)[0]


@query(f"WITH {_NATION} SELECT v, b AS t FROM a")
def truth_file(spark: SparkSession, sf: str) -> DataFrame:
    return files.read_graph(spark, _nation_files(spark, sf))[2].select("v", "t")


def _matrix_file(spark: SparkSession, sf: str, kind: str, cells: DataFrame) -> DataFrame:
    path = f"{_folder(spark, 'matrix')}.mtx"
    body = _lines(cells.select((F.col("src") + 1).alias("src"), (F.col("dst") + 1).alias("dst"), "w"), "src", "dst", "w")
    head = spark.createDataFrame([(0, f"%%MatrixMarket matrix coordinate integer {kind}\n% a comment\n\n25 25 {cells.count()}")], "place int, value string")
    body.withColumn("place", F.lit(1)).unionByName(head).repartition(1).sortWithinPartitions("place").select("value").write.text(path)
    return files.read_graph(spark, path.removesuffix(".mtx"))[0]


@query(f"WITH {_NATION} SELECT src, dst, CAST(1 AS BIGINT) AS w FROM e")
def matrix_market_file(spark: SparkSession, sf: str) -> DataFrame:
    return _matrix_file(spark, sf, "general", src.nations(spark, sf))


@query(f"WITH {_NATION} SELECT src, dst, CAST(1 AS BIGINT) AS w FROM e WHERE src >= dst UNION ALL SELECT dst, src, CAST(1 AS BIGINT) FROM e WHERE src > dst")
def matrix_market_file_symmetric(spark: SparkSession, sf: str) -> DataFrame:
    return _matrix_file(spark, sf, "symmetric", src.nations(spark, sf).where("src >= dst"))


def _known_fit(spark: SparkSession, sf: str) -> fitting.Fit:
    labels = src.nation_regions(spark, sf)
    return fitting.Fit(labels, 5, 12.5, [{"iteration": 1, "num_blocks": 9, "mdl": 20.0, "mcmc_moves": 4}, {"iteration": 2, "num_blocks": 5, "mdl": 12.5, "mcmc_moves": 3}])


@query(f"WITH {_NATION} SELECT v + 1 AS vertex, b + 1 AS block FROM a")
def written_labels(spark: SparkSession, sf: str) -> DataFrame:
    path = _folder(spark, "labels")
    files.write_labels(_known_fit(spark, sf), path)
    return spark.read.schema("vertex long, block long").option("sep", "\t").csv(path)


@query("SELECT CAST(5 AS BIGINT) AS num_blocks, CAST(12.5 AS DOUBLE) AS mdl, CAST(2 AS BIGINT) AS iterations, CAST(7 AS DOUBLE) AS total_mcmc_moves, (SELECT count(*) FROM nation) AS num_vertices, 'hybrid_mcmc' AS algorithm")
def written_results(spark: SparkSession, sf: str) -> DataFrame:
    path, found = _folder(spark, "results"), _known_fit(spark, sf)
    files.append_json(spark, files.result_row(found, fitting.Config(), 1.0, 600, found.assignment.count()), path)
    return spark.read.json(path).select("num_blocks", "mdl", "iterations", "total_mcmc_moves", "num_vertices", "algorithm")


@query("SELECT CAST(x AS DOUBLE) AS iteration, CAST(y AS DOUBLE) AS num_blocks, CAST(z AS DOUBLE) AS mdl, CAST(m AS DOUBLE) AS mcmc_moves FROM (VALUES (1, 9, 20.0, 4), (2, 5, 12.5, 3), (-1, 5, 12.5, 7)) t(x, y, z, m)")
def written_profile(spark: SparkSession, sf: str) -> DataFrame:
    path = _folder(spark, "profile")
    files.append_profile(spark, _known_fit(spark, sf).profile, path)
    return spark.read.schema("iteration double, num_blocks double, mdl double, mcmc_moves double").option("header", True).csv(path)


# matrix access


@query(f"WITH {_TRADE}, {_MODEL} SELECT r, coalesce(w, 0) AS w FROM range(25) g(r) LEFT JOIN (SELECT r, w FROM m WHERE c = 4) USING (r)")
def matrix_dense_column(spark: SparkSession, sf: str) -> DataFrame:
    return bm.dense_column(_trade_model(spark, sf)[2], 4, 25)


@query(f"WITH {_TRADE}, {_MODEL} SELECT 'row' AS side, c AS b, w FROM m WHERE r = 7 UNION ALL SELECT 'column', r, w FROM m WHERE c = 7")
def matrix_row_and_column(spark: SparkSession, sf: str) -> DataFrame:
    matrix = _trade_model(spark, sf)[2]
    out, into = bm.row(matrix, 7).toDF("b", "w"), bm.column(matrix, 7).toDF("b", "w")
    return out.select(F.lit("row").alias("side"), "b", "w").unionByName(into.select(F.lit("column").alias("side"), "b", "w"))


@query(f"WITH {_TRADE}, {_MODEL} SELECT * FROM m WHERE r NOT IN (1, 2) AND c <> 3")
def matrix_without(spark: SparkSession, sf: str) -> DataFrame:
    return bm.without(_trade_model(spark, sf)[2], r=[1, 2], c=[3])


@query(f"WITH {_TRADE}, {_MODEL} SELECT * FROM m WHERE r <> 1 UNION ALL SELECT 1, c, 2 * c FROM range(1, 5) g(c)")
def matrix_with_row_set(spark: SparkSession, sf: str) -> DataFrame:
    cells = spark.range(5).select(F.lit(1).cast("long").alias("r"), F.col("id").alias("c"), (2 * F.col("id")).alias("w"))
    return bm.replaced(_trade_model(spark, sf)[2], cells, r=[1])


@query(f"WITH {_TRADE}, {_MODEL} SELECT p.r, p.c, coalesce(m.w, 0) AS w FROM (SELECT x.i AS r, y.i AS c FROM range(20, 30) x(i), range(0, 25, 6) y(i)) p LEFT JOIN m USING (r, c)")
def matrix_lookup(spark: SparkSession, sf: str) -> DataFrame:
    pairs = spark.range(20, 30).select(F.col("id").alias("r"), F.explode(F.array(*[F.lit(k).cast("long") for k in range(0, 25, 6)])).alias("c"))
    return bm.looked_up(pairs, _trade_model(spark, sf)[2])


@query(f"WITH {_NATION}, {_MODEL} SELECT DISTINCT b, nb FROM (SELECT r AS b, c AS nb FROM m UNION ALL SELECT c, r FROM m)")
def block_neighbor_sets(spark: SparkSession, sf: str) -> DataFrame:
    return bm.neighbor_sets(_nation_model(spark, sf)[2])


@query(f"WITH {_NATION}, {_MOVES}, a2 AS (SELECT v, CASE WHEN v < 12 THEN b_to ELSE b_from END AS b FROM mv) SELECT x.b AS r, y.b AS c, CAST(sum(w) AS BIGINT) AS w FROM e JOIN a2 x ON src = x.v JOIN a2 y ON dst = y.v GROUP BY ALL")
def matrix_after_a_move(spark: SparkSession, sf: str) -> DataFrame:
    """The carried matrix with the changed cells of moves made one after the other, twelve of them."""
    edges, labels, matrix = _nation_model(spark, sf)
    edges, matrix = cut(edges), cut(matrix)
    for v in range(12):
        move = labels.where(F.col("v") == v).select("v", ((F.col("b") + 1) % 5).alias("b_to"))
        cells = entropy.move_cells(edges, labels, move).select("r", "c", F.col("dw").alias("w"))
        matrix, labels = cut(bm.cells_sum(matrix, cells)), cut(bm.moved(labels, move))
    return matrix


@query("SELECT true AS whole, false AS changed")
def model_validity(spark: SparkSession, sf: str) -> DataFrame:
    edges, labels, matrix = _nation_model(spark, sf)
    table = bm.blocks(matrix, labels)
    other = bm.moved(labels, labels.where("v = 3").select("v", ((F.col("b") + 1) % 5).alias("b_to")))
    return spark.createDataFrame([(bm.valid(edges, labels, matrix, table), bm.valid(edges, other, matrix, table))], "whole boolean, changed boolean")


@query(f"WITH {_NATION}, s AS (SELECT src, dst, w FROM e UNION ALL SELECT dst, src, w FROM e WHERE src <> dst), m AS (SELECT x.b AS r, y.b AS c, CAST(sum(w) AS DOUBLE) AS w FROM s JOIN a x ON src = x.v JOIN a y ON dst = y.v GROUP BY ALL), o AS (SELECT r, sum(w) AS d FROM m GROUP BY r), i AS (SELECT c, sum(w) AS d FROM m GROUP BY c) SELECT round(0.5 * sum(w / 2 * ln(w / 2 / (o.d / 2 * i.d / 2))), 3) AS l FROM m JOIN o USING (r) JOIN i USING (c)")
def undirected_likelihood(spark: SparkSession, sf: str) -> DataFrame:
    edges, labels, _ = _nation_model(spark, sf)
    matrix = bm.block_matrix(graph.symmetrised(edges), labels)
    return entropy.log_likelihood_undirected(matrix).select(F.round("l", 3).alias("l"))


@query(f"WITH {_NATION}, {_MODEL}, {_MOVES}, {_MOVE_CELLS} SELECT v, CAST(count(*) AS BIGINT) AS cells, CAST(sum(dw) AS BIGINT) AS total FROM dl GROUP BY v")
def move_cells_sum_to_zero(spark: SparkSession, sf: str) -> DataFrame:
    edges, labels, _ = _nation_model(spark, sf)
    cells = entropy.move_cells(edges, labels, labels.select("v", ((F.col("b") + 1) % 5).alias("b_to")))
    return cells.groupBy("v").agg(F.count("*").alias("cells"), F.sum("dw").alias("total"))


# proposals, splits, parts

_NW = "nw AS (SELECT b, nb, sum(w) AS w FROM (SELECT r AS b, c AS nb, w FROM m UNION ALL SELECT c, r, w FROM m WHERE r <> c) GROUP BY ALL)"


@query(f"""WITH {_TRADE}, {_MODEL}, {_NW}, tr AS (SELECT k FROM range(4) g(k)),
s1 AS (SELECT block, k, nb FROM (SELECT nw.b AS block, k, nb, row_number() OVER (PARTITION BY nw.b, k ORDER BY -ln({uniform_sql(13, 'nw.b', '(nb * 4 + k)')}) / w, nb) AS n FROM nw, tr WHERE nw.b <> nb) WHERE n = 1),
s2 AS (SELECT block, k, x AS into_ FROM (SELECT block, k, nw.nb AS x, row_number() OVER (PARTITION BY block, k ORDER BY -ln({uniform_sql(14, 'block', '(nw.nb * 4 + k)')}) / nw.w, nw.nb) AS n FROM s1 JOIN nw ON nw.b = s1.nb WHERE nw.nb <> block) WHERE n = 1)
SELECT DISTINCT block, into_ AS "into" FROM s2""")
def merge_proposals(spark: SparkSession, sf: str) -> DataFrame:
    _, labels, matrix = _trade_model(spark, sf)
    return proposal.propose_merges(cut(matrix), labels.select("b").distinct(), 25, 4, 13)


@query(f"WITH {_TRADE}, {_DEGREES}, rk AS (SELECT a.b, a.v, row_number() OVER (PARTITION BY a.b ORDER BY coalesce(k, 0) DESC, a.v) AS n FROM a LEFT JOIN deg USING (v)) SELECT b, v, n - 1 AS side FROM rk WHERE n <= 2")
def split_seeds_by_degree(spark: SparkSession, sf: str) -> DataFrame:
    return split.seeds_by_degree(src.trade(spark, sf), src.trade_nations(spark, sf))


@query(f"WITH {_TRADE}, rk AS (SELECT b, v, row_number() OVER (PARTITION BY b ORDER BY {uniform_sql(31, 'v')}, v) AS n FROM a) SELECT b, v, n - 1 AS side FROM rk WHERE n <= 2")
def split_seeds_random(spark: SparkSession, sf: str) -> DataFrame:
    return split.seeds_random(src.trade_nations(spark, sf), 31)


@query(f"WITH {_TRADE}, {_DEGREES}, rk AS (SELECT a.b, a.v, row_number() OVER (PARTITION BY a.b ORDER BY CASE WHEN k > 0 THEN -ln({uniform_sql(32, 'a.v')}) / k ELSE 1e300 END, a.v) AS n FROM a LEFT JOIN deg USING (v)) SELECT b, v, n - 1 AS side FROM rk WHERE n <= 2")
def split_seeds_degree_weighted(spark: SparkSession, sf: str) -> DataFrame:
    return split.seeds_degree_weighted(src.trade(spark, sf), src.trade_nations(spark, sf), 32)


@query(f"WITH {_TRADE}, best AS (SELECT * FROM (VALUES (3, 1, -4.0), (8, 0, -9.0), (11, 1, 2.0), (20, 0, -9.0)) t(b, trial, de)), pk AS (SELECT b, trial, row_number() OVER (ORDER BY de, b) - 1 AS n FROM best ORDER BY de, b LIMIT 3), sd AS (SELECT j AS trial, b, v, CASE WHEN {uniform_sql(22, 'v', 'j')} < 0.2 + 0.6 * {uniform_sql(21, 'b', 'j')} THEN 1 ELSE 0 END AS side FROM a, range(2) g(j)) SELECT a.v, CAST(coalesce(25 + pk.n, a.b) AS BIGINT) AS b FROM a LEFT JOIN sd JOIN pk ON pk.b = sd.b AND pk.trial = sd.trial AND sd.side = 1 ON sd.v = a.v")
def applied_splits(spark: SparkSession, sf: str) -> DataFrame:
    labels = src.trade_nations(spark, sf)
    best = spark.createDataFrame([(3, 1, -4.0), (8, 0, -9.0), (11, 1, 2.0), (20, 0, -9.0)], "b long, trial long, de double")
    return split.apply_splits(labels, cut(split.random_sides(labels, 2, 21)), best, 25, 3)


@query("SELECT b, trial, de FROM (SELECT *, row_number() OVER (PARTITION BY b ORDER BY de, trial) AS n FROM (SELECT CAST(c_nationkey AS BIGINT) AS b, c_custkey % 10 AS trial, round(min(c_acctbal), 2) AS de FROM customer GROUP BY ALL)) WHERE n = 1")
def best_split_per_block(spark: SparkSession, sf: str) -> DataFrame:
    scores = src.table(spark, sf, "customer").groupBy(F.col("c_nationkey").cast("long").alias("b"), (F.col("c_custkey") % 10).alias("trial")).agg(F.round(F.min("c_acctbal"), 2).alias("de"))
    return split.best_splits(scores)


@query(f"WITH {_TRADE} SELECT v, CAST(floor({uniform_sql(41, 'v')} * 6) AS BIGINT) AS part FROM a")
def random_partition(spark: SparkSession, sf: str) -> DataFrame:
    return sampling.random_parts(src.trade_nations(spark, sf).select("v"), 6, 41)


@query(f"WITH {_TRADE}, kn AS (SELECT v, b FROM a WHERE v % 5 = 0), vt AS (SELECT n.v, kn.b, sum(w) AS n FROM (SELECT src AS v, dst AS u, w FROM e UNION ALL SELECT dst, src, w FROM e) n JOIN kn ON kn.v = n.u WHERE n.v <> n.u GROUP BY ALL) SELECT v, b FROM (SELECT *, row_number() OVER (PARTITION BY v ORDER BY n DESC, b) AS k FROM vt) WHERE k = 1 AND v NOT IN (SELECT v FROM kn)")
def majority_labels(spark: SparkSession, sf: str) -> DataFrame:
    return sampling.majority(src.trade(spark, sf), src.trade_nations(spark, sf).where("v % 5 = 0"))


# balance

_RUN = "rw AS (SELECT v, k, sum(k) OVER (ORDER BY v) - k AS before, sum(k) OVER () AS total FROM deg)"


@query(f"WITH {_TRADE}, {_DEGREES}, {_RUN} SELECT v, k, CAST(least(7, floor(before * 8 / total)) AS BIGINT) AS bucket FROM rw")
def edge_balanced_buckets(spark: SparkSession, sf: str) -> DataFrame:
    return mcmc.contiguous_buckets(graph.degrees(src.trade(spark, sf)).select("v", "k"), "k", "v", 8)


@query(f"WITH {_TRADE}, {_DEGREES}, {_RUN}, s AS (SELECT least(7, floor(before * 8 / total)) AS bucket, CAST(sum(k) AS DOUBLE) AS x FROM rw GROUP BY ALL) SELECT count(*) AS buckets, max(x) AS heaviest, round(avg(x), 6) AS mean, round(max(x) / avg(x), 6) AS imbalance FROM s")
def bucket_imbalance(spark: SparkSession, sf: str) -> DataFrame:
    found = mcmc.imbalance(edge_balanced_buckets(spark, sf), "bucket", "k")
    return found.select("buckets", "heaviest", F.round("mean", 6).alias("mean"), F.round("imbalance", 6).alias("imbalance"))


@query(f"WITH {_NATION}, {_MODEL}, ns AS (SELECT DISTINCT b, nb FROM (SELECT r AS b, c AS nb FROM m UNION ALL SELECT c, r FROM m) WHERE b <> nb) SELECT k.b, count(ns.nb) AS n FROM k LEFT JOIN (SELECT ns.* FROM ns JOIN k z ON z.b = ns.nb WHERE z.d <= 1000000 AND z.b % 2 = 0) ns ON ns.b = k.b GROUP BY k.b")
def low_degree_block_neighbors(spark: SparkSession, sf: str) -> DataFrame:
    _, labels, matrix = _nation_model(spark, sf)
    table = bm.blocks(matrix, labels).withColumn("d", F.when(F.col("b") % 2 == 0, F.col("d")).otherwise(F.lit(2_000_000)))
    return mcmc.low_degree_neighbors(matrix, table, 1_000_000)


@query(f"WITH {_TRADE}, {_MODEL}, ns AS (SELECT b, count(DISTINCT nb) AS n FROM (SELECT r AS b, c AS nb FROM m UNION ALL SELECT c, r FROM m) WHERE b <> nb GROUP BY b), rk AS (SELECT k.b, coalesce(n, 0) AS n, row_number() OVER (ORDER BY coalesce(n, 0) DESC, k.b) - 1 AS i FROM k LEFT JOIN ns USING (b)) SELECT b, n, CASE WHEN i % 8 < 4 THEN i % 8 ELSE 7 - i % 8 END AS bucket FROM rk")
def blocks_by_neighbors(spark: SparkSession, sf: str) -> DataFrame:
    _, labels, matrix = _trade_model(spark, sf)
    return mcmc.by_neighbors(matrix, bm.blocks(matrix, labels), 4)


@query(f"WITH {_TRADE}, {_MODEL}, ins AS (SELECT CAST(2 AS BIGINT) AS b UNION SELECT c FROM m WHERE r = 2 UNION SELECT r FROM m WHERE c = 2) SELECT m.* FROM m WHERE r IN (SELECT b FROM ins) AND c IN (SELECT b FROM ins)")
def two_hop_matrix(spark: SparkSession, sf: str) -> DataFrame:
    _, labels, matrix = _trade_model(spark, sf)
    matrix = cut(matrix)
    return combine.radius_matrix(matrix, combine.two_hop(matrix, labels.where("b = 2").select("b").distinct()))


# scores and functions


@query("SELECT round(1.0 * i / 100, 2) AS x, round(s, 9) AS y FROM (SELECT i, (SELECT sum(pow(i / 100.0, k) / (k * k)) FROM range(1, 4000) g(k)) AS s FROM range(0, 100) r(i))")
def dilogarithm(spark: SparkSession, sf: str) -> DataFrame:
    x = [k / 100 for k in range(100)]
    return spark.createDataFrame([(round(a, 2), round(float(b), 9)) for a, b in zip(x, partitions.dilog(x), strict=True)], "x double, y double")


@query("""WITH RECURSIVE p(n, k, ways) AS (SELECT 0, 0, [CASE WHEN i = 0 THEN CAST(1 AS HUGEINT) ELSE 0 END FOR i IN range(0, 25)]
  UNION ALL SELECT 0, k + 1, list_transform(range(0, 25), lambda t: list_sum(list_transform(range(0, CAST(floor(t / (k + 1)) AS BIGINT) + 1), lambda j: ways[t - j * (k + 1) + 1]))) FROM p WHERE k < 8)
SELECT CAST(t AS BIGINT) AS n, CAST(k AS BIGINT) AS parts, round(ln(CAST(ways[t + 1] AS DOUBLE)), 9) AS log_ways FROM p, range(1, 25) g(t) WHERE k > 0""")
def partition_counts(spark: SparkSession, sf: str) -> DataFrame:
    pairs = spark.range(1, 25).select(F.col("id").alias("n"), F.explode(F.sequence(F.lit(1).cast("long"), F.lit(8).cast("long"))).alias("parts"))
    return pairs.select("n", "parts", F.round(partitions.log_partitions_col(F.col("n"), F.col("parts")), 9).alias("log_ways"))


@query("SELECT * FROM (VALUES ('no change', true), ('falls', false), ('stalls', true), ('stalls after the bracket', false), ('too short', false)) t(case_, stops)")
def early_stop_rule(spark: SparkSession, sf: str) -> DataFrame:
    cases = {"no change": ([-1.0, 0.0], False), "falls": ([-9.0, -8.0, -7.0, -6.0], False), "stalls": ([-9.0, -0.01, -0.02, -0.01], False), "stalls after the bracket": ([-9.0, -0.02, -0.02, -0.02], True), "too short": ([-0.01, -0.01, -0.01], False)}
    return spark.createDataFrame([(name, mcmc.early_stop(changes, 100.0, bracketed)) for name, (changes, bracketed) in cases.items()], "case_ string, stops boolean")


# fits as plans


def _planted_fit(spark: SparkSession, run) -> DataFrame:
    edges, truth = src.planted(spark, 24, 2, 8, 0.95, 3)
    found = run(edges, truth)
    scores = evaluate.pairwise(cut(evaluate.contingency(found.assignment, truth)))
    return scores.select(F.lit(found.num_blocks).cast("long").alias("num_blocks"), F.round(F.lit(found.mdl), 4).alias("mdl"), F.round("f1", 6).alias("f1"))


@query()
def fit_as_plans(spark: SparkSession, sf: str) -> DataFrame:
    """The bottom-up search with every phase as plans, on a planted graph."""
    return _planted_fit(spark, lambda e, t: fitting.fit(e, fitting.Config(seed=3, local_edges=0, sweeps=1)))


@query()
def fit_top_down_as_plans(spark: SparkSession, sf: str) -> DataFrame:
    return _planted_fit(spark, lambda e, t: fitting.fit_top_down(fitting.prepared(e, fitting.Config()), t.select("v"), fitting.Config(seed=3, algorithm="async_gibbs", sweeps=1, trials=2)))


@query()
def divide_and_conquer_fit(spark: SparkSession, sf: str) -> DataFrame:
    return _planted_fit(spark, lambda e, t: fitting.divide_and_conquer(e, 2, fitting.Config(seed=3, algorithm="async_gibbs", sweeps=1)))
