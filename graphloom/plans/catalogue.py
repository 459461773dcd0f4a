"""Every query of the graph engine, with its SQL oracle beside it.

All queries are deterministic: random draws are hashes of a seed and keys that
any SQL engine can repeat.  Doubles are rounded on both sides.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.functions.randomness import uniform_sql
from graphloom.operators import blockmodel as bm
from graphloom.operators import combine, description, entropy, evaluate, graph, mcmc, merge, proposal, sampling, split
from graphloom.operators.common import cut
from graphloom.plans import fit as fitting
from graphloom.plans.search import MergeSearch, Point
from graphloom.sources import tables as src
from graphloom.streaming.edges import edge_windows

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

# Graphs as SQL.  e: edges; a: labels; t: truth; m: block matrix; k: block degrees.
_TRADE = f"""e AS (
  SELECT l_suppkey AS src, {src.CUSTOMERS} + o_custkey AS dst, count(*) AS w FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY ALL),
a AS (SELECT s_suppkey AS v, CAST(s_nationkey AS BIGINT) AS b FROM supplier UNION ALL SELECT {src.CUSTOMERS} + c_custkey, CAST(c_nationkey AS BIGINT) FROM customer),
t AS (SELECT v, CAST(n_regionkey AS BIGINT) AS t FROM a JOIN nation ON n_nationkey = b)"""
_NATION = f"""tr AS (SELECT * FROM (WITH {_TRADE} SELECT x.b AS src, y.b AS dst, CAST(sum(w) AS BIGINT) AS w FROM e JOIN a x ON src = x.v JOIN a y ON dst = y.v GROUP BY x.b, y.b)),
e AS (SELECT * FROM tr),
a AS (SELECT CAST(n_nationkey AS BIGINT) AS v, CAST(n_regionkey AS BIGINT) AS b FROM nation)"""
_USER = "e AS (SELECT src, dst, count(*) AS w FROM (SELECT user_id AS src, lead(user_id) OVER (PARTITION BY event_type ORDER BY ts, event_id) AS dst FROM events) WHERE dst IS NOT NULL GROUP BY ALL)"
_MODEL = """m AS (SELECT x.b AS r, y.b AS c, CAST(sum(w) AS BIGINT) AS w FROM e JOIN a x ON src = x.v JOIN a y ON dst = y.v GROUP BY ALL),
o AS (SELECT r AS b, CAST(sum(w) AS BIGINT) AS x FROM m GROUP BY r), i AS (SELECT c AS b, CAST(sum(w) AS BIGINT) AS x FROM m GROUP BY c),
k AS (SELECT s.b, coalesce(o.x, 0) AS d_out, coalesce(i.x, 0) AS d_in, coalesce(o.x, 0) + coalesce(i.x, 0) - coalesce(g.w, 0) AS d, s.size
      FROM (SELECT b, count(*) AS size FROM a WHERE b IS NOT NULL GROUP BY b) s LEFT JOIN o USING (b) LEFT JOIN i USING (b) LEFT JOIN m g ON g.r = s.b AND g.c = s.b)"""
_DEGREES = """ends AS (SELECT src AS v, w AS o, 0 AS i, src = dst AS l FROM e UNION ALL SELECT dst, 0, w, src = dst FROM e),
deg AS (SELECT v, CAST(sum(o) AS BIGINT) AS k_out, CAST(sum(i) AS BIGINT) AS k_in, CAST(sum(o) + sum(i) - max(CAST(l AS INT)) AS BIGINT) AS k, bool_or(l) AS has_self FROM ends GROUP BY v)"""
_NEAR = "near AS (SELECT src AS v, dst AS u, w FROM e UNION ALL SELECT dst, src, w FROM e WHERE src <> dst)"
_F = lambda x: f"(CASE WHEN ({x}) > 0 THEN ({x}) * ln({x}) ELSE 0 END)"


def query(oracle: str | None = None) -> Callable[[Query], Query]:
    def register(function: Query) -> Query:
        QUERIES[function.__name__] = function
        if oracle:
            ORACLES[function.__name__] = oracle
        return function

    return register


# graphs


@query(f"WITH {_USER}, {_DEGREES} SELECT * FROM deg")
def graph_degrees(spark: SparkSession, sf: str) -> DataFrame:
    return graph.degrees(src.users(spark, sf))


@query(f"WITH {_TRADE}, f AS (SELECT * FROM e WHERE src % 3 = 0) SELECT a.v FROM a WHERE a.v NOT IN (SELECT src FROM f) AND a.v NOT IN (SELECT dst FROM f)")
def vertex_islands(spark: SparkSession, sf: str) -> DataFrame:
    """Suppliers and customers without an edge in the graph of every third supplier."""
    return graph.islands(src.trade_nations(spark, sf).select("v"), src.trade(spark, sf).where("src % 3 = 0"))


@query(f"WITH {_TRADE}, {_DEGREES} SELECT v, k, row_number() OVER (ORDER BY k DESC, v) <= ceil(0.075 * (SELECT count(*) FROM deg)) AS is_high FROM deg")
def high_low_split(spark: SparkSession, sf: str) -> DataFrame:
    return graph.high_low(src.trade(spark, sf), 0.075)


@query(f"WITH {_TRADE}, {_DEGREES} SELECT src, dst, w, x.k * y.k AS product FROM e JOIN deg x ON src = x.v JOIN deg y ON dst = y.v ORDER BY product DESC, src, dst LIMIT 100")
def edge_degree_product_topk(spark: SparkSession, sf: str) -> DataFrame:
    return graph.top_edges(src.trade(spark, sf), 100)


@query("SELECT DISTINCT l_suppkey AS src, l_partkey AS dst, CAST(1 AS BIGINT) AS w FROM lineitem")
def edges_dedup(spark: SparkSession, sf: str) -> DataFrame:
    lines = src.table(spark, sf, "lineitem")
    return graph.deduplicated(lines.select(F.col("l_suppkey").alias("src"), F.col("l_partkey").alias("dst")))


@query(f"WITH {_USER} SELECT src, dst, CAST(sum(w) AS BIGINT) AS w FROM (SELECT * FROM e UNION ALL SELECT dst, src, w FROM e WHERE src <> dst) GROUP BY ALL")
def edges_symmetrised(spark: SparkSession, sf: str) -> DataFrame:
    return graph.weighted(graph.symmetrised(src.users(spark, sf)))


@query("""WITH l AS (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem)
SELECT x.l_partkey AS src, y.l_partkey AS dst, count(*) AS w FROM l x JOIN l y ON x.l_orderkey = y.l_orderkey AND x.l_partkey < y.l_partkey GROUP BY ALL""")
def part_pairs(spark: SparkSession, sf: str) -> DataFrame:
    return src.parts(spark, sf)


@query(f"WITH {_USER} SELECT * FROM e")
def consecutive_users(spark: SparkSession, sf: str) -> DataFrame:
    return src.users(spark, sf)


@query(f"""WITH {_TRADE}, {_MODEL},
s AS (SELECT CAST(sum(w) AS DOUBLE) AS e FROM e),
d AS (SELECT x.b, count(*) AS n FROM e JOIN a x ON src = x.v JOIN a y ON dst = y.v WHERE x.b = y.b GROUP BY x.b)
SELECT round(sum(coalesce(d.n, 0) / s.e - k.d_out * CAST(k.d_in AS DOUBLE) / (s.e * s.e)), 6) AS q FROM k LEFT JOIN d USING (b), s""")
def modularity(spark: SparkSession, sf: str) -> DataFrame:
    return graph.modularity(src.trade(spark, sf), src.trade_nations(spark, sf)).select(F.round("q", 6).alias("q"))


# blockmodels


def _trade_model(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    edges, labels = src.trade(spark, sf), src.trade_nations(spark, sf)
    return edges, labels, bm.block_matrix(edges, labels)


def _nation_model(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The trade between nations is written once: models and moves read it again and again."""
    edges, labels = cut(src.nations(spark, sf)), src.nation_regions(spark, sf)
    return edges, labels, bm.block_matrix(edges, labels)


@query(f"WITH {_TRADE}, {_MODEL} SELECT * FROM m")
def block_matrix(spark: SparkSession, sf: str) -> DataFrame:
    return _trade_model(spark, sf)[2]


@query(f"WITH {_TRADE}, {_MODEL} SELECT * FROM k")
def block_degrees(spark: SparkSession, sf: str) -> DataFrame:
    _, labels, matrix = _trade_model(spark, sf)
    return bm.blocks(matrix, labels)


@query(f"WITH {_TRADE} SELECT b, count(*) AS size FROM a GROUP BY b")
def block_sizes(spark: SparkSession, sf: str) -> DataFrame:
    return src.trade_nations(spark, sf).groupBy("b").agg(F.count("*").alias("size"))


@query(f"""WITH {_TRADE}, {_DEGREES}, z AS (SELECT a.b, coalesce(k_out, 0) AS o, coalesce(k_in, 0) AS i FROM a LEFT JOIN deg USING (v))
SELECT b, 'out' AS side, o AS k, count(*) AS n FROM z GROUP BY b, o UNION ALL SELECT b, 'in', i, count(*) FROM z GROUP BY b, i""")
def degree_histogram(spark: SparkSession, sf: str) -> DataFrame:
    return bm.degree_histogram(src.trade(spark, sf), src.trade_nations(spark, sf))


@query(f"WITH {_TRADE}, {_MODEL} SELECT b, nb, CAST(sum(w) AS BIGINT) AS w FROM (SELECT r AS b, c AS nb, w FROM m UNION ALL SELECT c, r, w FROM m WHERE r <> c) GROUP BY ALL")
def block_neighbor_weights(spark: SparkSession, sf: str) -> DataFrame:
    return bm.neighbor_weights(_trade_model(spark, sf)[2])


@query(f"WITH {_TRADE}, {_MODEL} SELECT b, count(*) AS n FROM (SELECT r AS b FROM m UNION ALL SELECT c FROM m WHERE r <> c) GROUP BY b")
def block_distinct_edges(spark: SparkSession, sf: str) -> DataFrame:
    return bm.distinct_edges(_trade_model(spark, sf)[2])


@query(f"""WITH {_TRADE}, {_MODEL}
SELECT CAST(sum(w) AS BIGINT) AS edges, CAST(sum(CASE WHEN r = c THEN w ELSE 0 END) AS BIGINT) AS trace, count(*) AS cells, round(sum(CASE WHEN r <> c THEN w ELSE 0 END) / CAST(sum(w) AS DOUBLE), 6) AS interblock FROM m""")
def block_totals(spark: SparkSession, sf: str) -> DataFrame:
    return bm.totals(_trade_model(spark, sf)[2]).withColumn("interblock", F.round("interblock", 6))


@query(f"WITH {_TRADE}, {_MODEL} SELECT c, coalesce(w, 0) AS w FROM range(25) g(c) LEFT JOIN (SELECT c, w FROM m WHERE r = 3) USING (c)")
def matrix_dense_row(spark: SparkSession, sf: str) -> DataFrame:
    return bm.dense_row(_trade_model(spark, sf)[2], 3, 25)


@query(f"""WITH {_TRADE}, {_MODEL}
SELECT r, c, CAST(sum(w) AS BIGINT) AS w FROM (SELECT * FROM m UNION ALL SELECT c, r, -w FROM m) GROUP BY r, c HAVING sum(w) <> 0""")
def matrix_subtract(spark: SparkSession, sf: str) -> DataFrame:
    matrix = _trade_model(spark, sf)[2]
    return bm.cells_sum(matrix, bm.negated(matrix).select(F.col("c").alias("r"), F.col("r").alias("c"), "w"))


_VARIATION = "v AS (SELECT CASE WHEN (max(n) - min(n)) * (max(n) - avg(n)) > 0 THEN var_pop(n) / ((max(n) - min(n)) * (max(n) - avg(n)) / 4) ELSE 0 END AS x FROM (SELECT CAST(count(*) AS DOUBLE) AS n FROM a GROUP BY b))"


@query(f"WITH {_TRADE}, {_VARIATION} SELECT round(x, 6) AS variation FROM v")
def block_size_variation(spark: SparkSession, sf: str) -> DataFrame:
    return bm.size_variation(src.trade_nations(spark, sf)).select(F.round("variation", 6).alias("variation"))


@query(f"""WITH {_TRADE}, {_MODEL}, {_VARIATION}, i2 AS (SELECT sum(CASE WHEN r <> c THEN w ELSE 0 END) / CAST(sum(w) AS DOUBLE) AS y FROM m)
SELECT round(2 * x * y / (x + y), 6) AS difficulty FROM v, i2""")
def difficulty_score(spark: SparkSession, sf: str) -> DataFrame:
    _, labels, matrix = _trade_model(spark, sf)
    return bm.difficulty(matrix, labels).select(F.round("difficulty", 6).alias("difficulty"))


@query(f"WITH {_TRADE} SELECT v, dense_rank() OVER (ORDER BY b * 7 % 100) - 1 AS b FROM a")
def compact_labels(spark: SparkSession, sf: str) -> DataFrame:
    return bm.compact(src.trade_nations(spark, sf).select("v", (F.col("b") * 7 % 100).alias("b")))


# description lengths

_LIKE = f"like_ AS (SELECT (SELECT sum({_F('w')}) FROM m) - (SELECT sum({_F('x')}) FROM o) - (SELECT sum({_F('x')}) FROM i) AS l, (SELECT CAST(sum(w) AS DOUBLE) FROM m) AS e)"


def _mdl_sql(graph_sql: str, vertices: int | str, blocks: int) -> str:
    return f"""WITH {graph_sql}, {_MODEL}, {_LIKE}, z AS (SELECT e, l, {blocks * blocks} / e AS x, 1 / e AS y FROM like_),
g AS (SELECT e, l, e * ((1 + x) * ln(1 + x) - x * ln(x)) + {vertices} * ln({blocks}.0) - l AS mdl, e * ((1 + y) * ln(1 + y) - y * ln(y)) + e * ln(e) AS n FROM z)
SELECT CAST(e AS BIGINT) AS e, round(l, 3) AS l, round(mdl, 3) AS mdl, round(n, 3) AS null_mdl, round(mdl / n, 6) AS normalized FROM g"""


def _rounded(one: DataFrame) -> DataFrame:
    return one.select("e", *[F.round(c, 3).alias(c) for c in ("l", "mdl", "null_mdl")], F.round("normalized", 6).alias("normalized"))


@query(_mdl_sql(_NATION, 25, 5))
def block_mdl(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(entropy.mdl(_nation_model(spark, sf)[2], 25, 5))


@query(_mdl_sql(_TRADE, "(SELECT count(*) FROM a)", 25))
def trade_mdl(spark: SparkSession, sf: str) -> DataFrame:
    _, labels, matrix = _trade_model(spark, sf)
    return _rounded(entropy.mdl(matrix, labels.count(), 25))


@query(f"""WITH {_TRADE}, {_MODEL},
s AS (SELECT (SELECT -sum(lgamma(w + 1)) FROM m) + (SELECT sum((d_out + d_in) * ln(size)) FROM k) AS s),
p AS (SELECT n, b, inner_, lgamma(n) - lgamma(b) - lgamma(n - b + 1) + lgamma(n + 1) - inner_ + ln(n) AS dl FROM (SELECT sum(size) AS n, count(*) AS b, sum(lgamma(size + 1)) AS inner_ FROM k)),
x AS (SELECT CAST(sum(w) AS DOUBLE) AS e FROM m),
d AS (SELECT lgamma(b * b + e) - lgamma(e + 1) - lgamma(b * b) AS dl FROM p, x)
SELECT round(s.s, 3) AS sparse_entropy, round(p.dl, 3) AS partition_dl, CAST(0 AS DOUBLE) AS degree_dl, round(d.dl, 3) AS edges_dl, round(s.s + p.dl + d.dl, 3) AS mdl FROM s, p, d""")
def np_mdl(spark: SparkSession, sf: str) -> DataFrame:
    _, labels, matrix = _trade_model(spark, sf)
    one = description.mdl(matrix, bm.blocks(matrix, labels))
    return one.select(*[F.round(c, 3).alias(c) for c in one.columns])


@query()
def np_degree_corrected_mdl(spark: SparkSession, sf: str) -> DataFrame:
    edges, labels, matrix = _trade_model(spark, sf)
    one = description.mdl(matrix, bm.blocks(matrix, labels), edges, bm.degree_histogram(edges, labels), degree_corrected=True)
    return one.select(*[F.round(c, 3).alias(c) for c in one.columns])


_PAIRS = """pr AS (SELECT x.b AS block, y.b AS into_ FROM k x, k y WHERE x.b <> y.b),
cl AS (SELECT block, into_, CASE WHEN r = block THEN into_ ELSE r END AS nr, CASE WHEN c = block THEN into_ ELSE c END AS nc, w FROM pr JOIN m ON r IN (block, into_) OR c IN (block, into_))"""
_LB = lambda n, k: f"(CASE WHEN {n} = 0 OR {k} = 0 OR {k} > {n} THEN 0 ELSE lgamma({n} + 1) - lgamma({k} + 1) - lgamma({n} - {k} + 1) END)"
_FEWER = f"""nn AS (SELECT CAST(sum(size) AS DOUBLE) AS n, CAST(count(*) AS DOUBLE) AS nb, CAST(sum(d_out) AS DOUBLE) AS e FROM k),
fw AS (SELECT {_LB('(n - 1)', '(nb - 2)')} - {_LB('(n - 1)', '(nb - 1)')} + {_LB('((nb - 1) * (nb - 1) + e - 1)', 'e')} - {_LB('(nb * nb + e - 1)', 'e')} AS x FROM nn)"""


@query(f"""WITH {_TRADE}, {_MODEL}, {_PAIRS}, {_FEWER},
nw AS (SELECT block, into_, nr, nc, sum(w) AS w, sum(lgamma(w + 1)) AS old FROM cl GROUP BY block, into_, nr, nc),
dc AS (SELECT block, into_, sum(old - lgamma(w + 1)) AS cells FROM nw GROUP BY block, into_)
SELECT block, into_ AS "into", round(cells + (x.d_out + y.d_out + x.d_in + y.d_in) * ln(x.size + y.size) - (x.d_out + x.d_in) * ln(x.size) - (y.d_out + y.d_in) * ln(y.size)
  + lgamma(x.size + 1) + lgamma(y.size + 1) - lgamma(x.size + y.size + 1) + fw.x, 3) AS de FROM dc JOIN k x ON x.b = block JOIN k y ON y.b = into_, fw""")
def np_merge_delta_all_pairs(spark: SparkSession, sf: str) -> DataFrame:
    _, labels, matrix = _trade_model(spark, sf)
    matrix = cut(matrix)
    found = description.merge_delta(matrix, bm.blocks(matrix, labels), merge.all_pairs(labels))
    return found.select("block", "into", F.round("de", 3).alias("de"))


_MERGE_SQL = f"""{_PAIRS},
nw AS (SELECT block, into_, nr, nc, sum(w) AS w, sum({_F('w')}) AS old FROM cl GROUP BY block, into_, nr, nc),
dc AS (SELECT block, into_, sum({_F('w')} - old) AS cells FROM nw GROUP BY block, into_),
md AS (SELECT dc.block, dc.into_, round({_F('x.d_out + y.d_out')} - {_F('x.d_out')} - {_F('y.d_out')} + {_F('x.d_in + y.d_in')} - {_F('x.d_in')} - {_F('y.d_in')} - cells, 4) AS de
  FROM dc JOIN k x ON x.b = dc.block JOIN k y ON y.b = dc.into_)"""


@query(f"WITH {_TRADE}, {_MODEL}, {_MERGE_SQL} SELECT block, into_ AS \"into\", de FROM md")
def merge_delta_mdl_all_pairs(spark: SparkSession, sf: str) -> DataFrame:
    _, labels, matrix = _trade_model(spark, sf)
    scored = entropy.merge_delta(cut(matrix), merge.all_pairs(labels))
    return scored.select("block", "into", F.round("de", 4).alias("de"))


_BEST_SQL = "bs AS (SELECT block, into_, de FROM (SELECT *, row_number() OVER (PARTITION BY block ORDER BY de, into_) AS n FROM md) WHERE n = 1)"


def _trade_best(spark: SparkSession, sf: str) -> DataFrame:
    _, labels, matrix = _trade_model(spark, sf)
    scored = entropy.merge_delta(cut(matrix), merge.all_pairs(labels))
    return merge.best_merges(scored.select("block", "into", F.round("de", 4).alias("de")))


@query(f"WITH {_TRADE}, {_MODEL}, {_MERGE_SQL}, {_BEST_SQL} SELECT block, into_ AS \"into\", de FROM bs")
def best_merge_per_block(spark: SparkSession, sf: str) -> DataFrame:
    return _trade_best(spark, sf)


@query(f"""WITH RECURSIVE {_TRADE}, {_MODEL}, {_MERGE_SQL}, {_BEST_SQL},
tk AS (SELECT block, into_ FROM bs ORDER BY de, block LIMIT 10),
sy AS (SELECT block AS x, into_ AS y FROM tk UNION SELECT into_, block FROM tk),
rc(x, y) AS (SELECT x, y FROM sy UNION SELECT rc.x, sy.y FROM rc JOIN sy ON rc.y = sy.x)
SELECT x AS block, min(y) AS "into" FROM rc GROUP BY x HAVING min(y) < x""")
def apply_best_merges(spark: SparkSession, sf: str) -> DataFrame:
    return merge.resolved(merge.chosen(_trade_best(spark, sf), 10))


_MOVES = "mv AS (SELECT v, b AS b_from, (b + 1) % 5 AS b_to FROM a)"
_MOVE_CELLS = """ch AS (
  SELECT mv.v, b_from, b_to, b_from AS r, u.b AS c, -w AS dw FROM mv JOIN e ON src = mv.v AND dst <> mv.v JOIN a u ON u.v = dst
  UNION ALL SELECT mv.v, b_from, b_to, b_to, u.b, w FROM mv JOIN e ON src = mv.v AND dst <> mv.v JOIN a u ON u.v = dst
  UNION ALL SELECT mv.v, b_from, b_to, u.b, b_from, -w FROM mv JOIN e ON dst = mv.v AND src <> mv.v JOIN a u ON u.v = src
  UNION ALL SELECT mv.v, b_from, b_to, u.b, b_to, w FROM mv JOIN e ON dst = mv.v AND src <> mv.v JOIN a u ON u.v = src
  UNION ALL SELECT mv.v, b_from, b_to, b_from, b_from, -w FROM mv JOIN e ON src = mv.v AND dst = mv.v
  UNION ALL SELECT mv.v, b_from, b_to, b_to, b_to, w FROM mv JOIN e ON src = mv.v AND dst = mv.v),
dl AS (SELECT v, b_from, b_to, r, c, CAST(sum(dw) AS BIGINT) AS dw FROM ch GROUP BY ALL HAVING sum(dw) <> 0)"""
_MOVE_DE = f"""dg AS (SELECT mv.*, coalesce((SELECT sum(w) FROM e WHERE src = mv.v), 0) AS ko, coalesce((SELECT sum(w) FROM e WHERE dst = mv.v), 0) AS ki FROM mv WHERE b_from <> b_to),
cs AS (SELECT v, sum({_F('coalesce(m.w, 0) + dw')} - {_F('coalesce(m.w, 0)')}) AS cells FROM dl LEFT JOIN m ON m.r = dl.r AND m.c = dl.c GROUP BY v),
de AS (SELECT dg.v, b_from, b_to,
  {_F('x.d_out - ko')} - {_F('x.d_out')} + {_F('x.d_in - ki')} - {_F('x.d_in')} + {_F('y.d_out + ko')} - {_F('y.d_out')} + {_F('y.d_in + ki')} - {_F('y.d_in')} - coalesce(cells, 0) AS de
  FROM dg LEFT JOIN cs USING (v) JOIN k x ON x.b = b_from JOIN k y ON y.b = b_to)"""


def _next_region(labels: DataFrame) -> DataFrame:
    return labels.select("v", ((F.col("b") + 1) % 5).alias("b_to"))


@query(f"WITH {_NATION}, {_MODEL}, {_MOVES}, {_MOVE_CELLS}, {_MOVE_DE} SELECT v, b_from, b_to, round(de, 4) AS de FROM de")
def vertex_move_delta_mdl(spark: SparkSession, sf: str) -> DataFrame:
    edges, labels, matrix = _nation_model(spark, sf)
    edges, matrix = cut(edges), cut(matrix)
    scored = entropy.move_delta(edges, labels, matrix, bm.blocks(matrix, labels), _next_region(labels))
    return scored.select("v", "b_from", "b_to", F.round("de", 4).alias("de"))


@query(f"""WITH {_NATION}, {_MODEL}, {_MOVES}, {_MOVE_CELLS}, {_FEWER},
dg AS (SELECT mv.*, coalesce((SELECT sum(w) FROM e WHERE src = mv.v), 0) + coalesce((SELECT sum(w) FROM e WHERE dst = mv.v), 0) AS kk FROM mv WHERE b_from <> b_to),
cs AS (SELECT v, sum(lgamma(coalesce(m.w, 0) + 1) - lgamma(coalesce(m.w, 0) + dw + 1)) AS cells FROM dl LEFT JOIN m ON m.r = dl.r AND m.c = dl.c GROUP BY v)
SELECT dg.v, b_from, b_to, round(coalesce(cells, 0) + (CASE WHEN x.size > 1 THEN (x.d_out + x.d_in - kk) * ln(x.size - 1) ELSE 0 END) - (x.d_out + x.d_in) * ln(x.size)
  + (y.d_out + y.d_in + kk) * ln(y.size + 1) - (y.d_out + y.d_in) * ln(y.size) + ln(x.size) - ln(y.size + 1) + CASE WHEN x.size = 1 THEN fw.x ELSE 0 END, 3) AS de
FROM dg LEFT JOIN cs USING (v) JOIN k x ON x.b = b_from JOIN k y ON y.b = b_to, fw""")
def np_move_delta(spark: SparkSession, sf: str) -> DataFrame:
    edges, labels, matrix = _nation_model(spark, sf)
    edges, matrix = cut(edges), cut(matrix)
    found = description.move_delta(edges, labels, matrix, bm.blocks(matrix, labels), _next_region(labels))
    return found.select("v", "b_from", "b_to", F.round("de", 3).alias("de"))


@query(f"WITH {_NATION}, {_MOVES}, {_MOVE_CELLS} SELECT * FROM dl")
def vertex_move_cells(spark: SparkSession, sf: str) -> DataFrame:
    edges, labels, _ = _nation_model(spark, sf)
    return entropy.move_cells(edges, labels, _next_region(labels))


@query(f"""WITH {_NATION}, {_MODEL}, {_MOVES}, {_MOVE_CELLS}, {_NEAR},
cn AS (SELECT mv.v, b_from, b_to, x.b AS x, sum(w) AS n FROM mv JOIN near ON near.v = mv.v JOIN a x ON x.v = near.u GROUP BY ALL),
nm AS (SELECT mv.v, g.r, g.c, g.w + coalesce(dl.dw, 0) AS w FROM mv CROSS JOIN m g LEFT JOIN dl ON dl.v = mv.v AND dl.r = g.r AND dl.c = g.c),
kk AS (SELECT mv.v, z.b AS x, (SELECT coalesce(sum(w), 0) FROM nm WHERE nm.v = mv.v AND r = z.b) + (SELECT coalesce(sum(w), 0) FROM nm WHERE nm.v = mv.v AND c = z.b)
       - coalesce((SELECT w FROM nm WHERE nm.v = mv.v AND r = z.b AND c = z.b), 0) AS d FROM mv, k z),
tt AS (SELECT cn.v, b_to, n, (coalesce((SELECT w FROM m WHERE r = b_to AND c = cn.x), 0) + coalesce((SELECT w FROM m WHERE r = cn.x AND c = b_to), 0) + 1) / CAST(z.d + 5 AS DOUBLE) AS fw,
       (coalesce((SELECT w FROM nm WHERE nm.v = cn.v AND r = b_from AND c = cn.x), 0) + coalesce((SELECT w FROM nm WHERE nm.v = cn.v AND r = cn.x AND c = b_from), 0) + 1) / CAST(kk.d + 5 AS DOUBLE) AS bw
  FROM cn JOIN k z ON z.b = cn.x JOIN kk ON kk.v = cn.v AND kk.x = cn.x)
SELECT v, b_to, round(sum(n * bw) / sum(n * fw), 6) AS hastings FROM tt GROUP BY v, b_to""")
def hastings_correction(spark: SparkSession, sf: str) -> DataFrame:
    edges, labels, matrix = _nation_model(spark, sf)
    edges, matrix = cut(edges), cut(matrix)
    found = entropy.hastings(edges, labels, matrix, bm.blocks(matrix, labels), _next_region(labels), 5)
    return found.select("v", "b_to", F.round("hastings", 6).alias("hastings"))


# proposals and sweeps


@query(f"""WITH {_NATION}, {_MODEL}, {_NEAR},
nw AS (SELECT b, nb, sum(w) AS w FROM (SELECT r AS b, c AS nb, w FROM m UNION ALL SELECT c, r, w FROM m WHERE r <> c) GROUP BY ALL),
p1 AS (SELECT near.v, x.b AS nb, sum(w) / CAST((SELECT sum(w) FROM near z WHERE z.v = near.v) AS DOUBLE) AS p FROM near JOIN a x ON x.v = near.u GROUP BY near.v, x.b),
p2 AS (SELECT b AS nb, nb AS b, w / CAST(sum(w) OVER (PARTITION BY b) AS DOUBLE) AS p FROM nw)
SELECT v, p2.b, round(sum(p1.p * p2.p), 6) AS p FROM p1 JOIN p2 USING (nb) GROUP BY v, p2.b""")
def proposal_distribution(spark: SparkSession, sf: str) -> DataFrame:
    edges, labels, matrix = _nation_model(spark, sf)
    return proposal.proposal_distribution(cut(edges), labels, cut(matrix)).select("v", "b", F.round("p", 6).alias("p"))


_PROPOSE = f"""nw AS (SELECT b, nb, sum(w) AS w FROM (SELECT r AS b, c AS nb, w FROM m UNION ALL SELECT c, r, w FROM m WHERE r <> c) GROUP BY ALL),
d1 AS (SELECT v, u FROM (SELECT v, u, row_number() OVER (PARTITION BY v ORDER BY -ln({uniform_sql(11, 'v', 'u')}) / w, u) AS n FROM near) WHERE n = 1),
d2 AS (SELECT v, nw.nb AS b_to, row_number() OVER (PARTITION BY v ORDER BY -ln({uniform_sql(12, 'v', 'nw.nb')}) / w, nw.nb) AS n FROM (SELECT d1.v, x.b FROM d1 JOIN a x ON x.v = d1.u) z JOIN nw USING (b))"""


@query(f"WITH {_NATION}, {_MODEL}, {_NEAR}, {_PROPOSE} SELECT d2.v, a.b AS b_from, b_to FROM d2 JOIN a USING (v) WHERE n = 1")
def proposed_moves(spark: SparkSession, sf: str) -> DataFrame:
    edges, labels, matrix = _nation_model(spark, sf)
    return proposal.propose_moves(cut(edges), labels, cut(matrix), 5, 11)


@query(f"""WITH {_NATION}, {_MODEL}, {_NEAR}, {_PROPOSE},
mv AS (SELECT d2.v, a.b AS b_from, b_to FROM d2 JOIN a USING (v) WHERE n = 1 AND a.b <> b_to), {_MOVE_CELLS}, {_MOVE_DE},
ac AS (SELECT v, b_from, b_to, round(de, 9) AS de FROM de WHERE round(de, 9) < 0),
gd AS (SELECT *, count(*) OVER (PARTITION BY b_from) AS gone, row_number() OVER (PARTITION BY b_from ORDER BY de DESC, v DESC) AS n FROM ac)
SELECT v, b_from, b_to, round(de, 4) AS de FROM gd JOIN k ON k.b = b_from WHERE gone < size OR n > 1""")
def gibbs_step(spark: SparkSession, sf: str) -> DataFrame:
    edges, labels, _ = _nation_model(spark, sf)
    return mcmc.gibbs_moves(cut(edges), labels, 5, 11).select("v", "b_from", "b_to", F.round("de", 4).alias("de"))


# scores

_BOTH = "ct AS (SELECT b, t, count(*) AS n FROM (SELECT v, b % 7 AS b FROM a) JOIN t USING (v) GROUP BY ALL), rs AS (SELECT b, sum(n) AS n FROM ct GROUP BY b), ks AS (SELECT t, sum(n) AS n FROM ct GROUP BY t), al AS (SELECT sum(n) AS n FROM ct)"


def _table(spark: SparkSession, sf: str) -> DataFrame:
    return evaluate.contingency(src.trade_nations(spark, sf).select("v", (F.col("b") % 7).alias("b")), src.trade_regions(spark, sf))


@query(f"WITH {_TRADE}, {_BOTH} SELECT b, t, n FROM ct")
def contingency(spark: SparkSession, sf: str) -> DataFrame:
    return _table(spark, sf)


@query(f"""WITH {_TRADE}, {_BOTH},
s AS (SELECT (SELECT sum(n * (n - 1) / 2.0) FROM ct) AS c, (SELECT sum(n * (n - 1) / 2.0) FROM rs) AS r, (SELECT sum(n * (n - 1) / 2.0) FROM ks) AS k, (SELECT sum(n * n) FROM ct) AS cc, (SELECT sum(n * n) FROM rs) AS rr, (SELECT sum(n * n) FROM ks) AS kk, (SELECT CAST(n AS DOUBLE) FROM al) AS n),
p AS (SELECT c / r AS re, c / k AS pr, (c + (n * n + cc - rr - kk) / 2) / (n * (n - 1) / 2) AS ra FROM s)
SELECT round(ra, 6) AS rand, round(pr, 6) AS precision, round(re, 6) AS recall, round(2 * pr * re / (pr + re), 6) AS f1 FROM p""")
def pairwise_scores(spark: SparkSession, sf: str) -> DataFrame:
    one = evaluate.pairwise(_table(spark, sf))
    return one.select(*[F.round(c, 6).alias(c) for c in one.columns])


@query(f"""WITH {_TRADE}, {_BOTH},
p AS (SELECT sum(ct.n / x * ln(ct.n * x / (CAST(rs.n AS DOUBLE) * ks.n))) AS mi FROM ct JOIN rs USING (b) JOIN ks USING (t), (SELECT CAST(n AS DOUBLE) AS x FROM al)),
h1 AS (SELECT -sum(n / x * ln(n / x)) AS h FROM rs, (SELECT CAST(n AS DOUBLE) AS x FROM al)), h2 AS (SELECT -sum(ks.n / x * ln(ks.n / x)) AS h FROM ks, (SELECT CAST(n AS DOUBLE) AS x FROM al))
SELECT round(mi / sqrt(h1.h * h2.h), 6) AS nmi FROM p, h1, h2""")
def nmi(spark: SparkSession, sf: str) -> DataFrame:
    return evaluate.nmi(_table(spark, sf)).select(F.round("nmi", 6).alias("nmi"))


@query(f"""WITH {_TRADE}, {_BOTH}, full_ AS (SELECT b.b, t.t, coalesce(ct.n, 0) AS n FROM range(7) b(b) CROSS JOIN range(5) t(t) LEFT JOIN ct ON ct.b = b.b AND ct.t = t.t),
m AS (SELECT max(f0.n + f1.n + f2.n + f3.n + f4.n) AS m FROM full_ f0, full_ f1, full_ f2, full_ f3, full_ f4
  WHERE f0.t = 0 AND f1.t = 1 AND f2.t = 2 AND f3.t = 3 AND f4.t = 4 AND f0.b NOT IN (f1.b, f2.b, f3.b, f4.b) AND f1.b NOT IN (f2.b, f3.b, f4.b) AND f2.b NOT IN (f3.b, f4.b) AND f3.b <> f4.b)
SELECT m / CAST((SELECT n FROM al) AS DOUBLE) AS accuracy FROM m""")
def matched_accuracy(spark: SparkSession, sf: str) -> DataFrame:
    return spark.createDataFrame([(float(evaluate.accuracy(_table(spark, sf))),)], "accuracy double")


# samples, extension, parts


@query(f"WITH {_TRADE}, {_DEGREES} SELECT v FROM deg ORDER BY k DESC, v LIMIT 300")
def sample_max_degree(spark: SparkSession, sf: str) -> DataFrame:
    return sampling.max_degree(src.trade(spark, sf), 300)


@query(f"WITH {_TRADE} SELECT v FROM a ORDER BY {uniform_sql(5, 'v')}, v LIMIT 300")
def sample_hash_random(spark: SparkSession, sf: str) -> DataFrame:
    return sampling.hash_random(src.trade_nations(spark, sf).select("v"), 300, 5)


@query(f"""WITH {_TRADE}, {_DEGREES},
rk AS (SELECT src, dst, row_number() OVER (ORDER BY x.k * y.k DESC, src, dst) AS n FROM e JOIN deg x ON src = x.v JOIN deg y ON dst = y.v),
fs AS (SELECT v, min(p) AS p FROM (SELECT src AS v, 2 * n AS p FROM rk UNION ALL SELECT dst, 2 * n + 1 FROM rk) GROUP BY v)
SELECT v FROM fs ORDER BY p, v LIMIT 300""")
def sample_degree_product(spark: SparkSession, sf: str) -> DataFrame:
    return sampling.degree_product(src.trade(spark, sf), 300)


@query(f"WITH {_TRADE} SELECT src, dst, w FROM e WHERE src % 4 = 1 AND dst % 4 = 1")
def round_robin_subgraph(spark: SparkSession, sf: str) -> DataFrame:
    vertices = src.trade_nations(spark, sf).select("v")
    return graph.induced(src.trade(spark, sf), sampling.round_robin(vertices, 1, 4))


@query(f"""WITH {_TRADE}, mp AS (SELECT v, row_number() OVER (ORDER BY v) - 1 AS l FROM a WHERE v % 4 = 1)
SELECT x.l AS src, y.l AS dst, w FROM e JOIN mp x ON src = x.v JOIN mp y ON dst = y.v""")
def local_subgraph(spark: SparkSession, sf: str) -> DataFrame:
    vertices = src.trade_nations(spark, sf).select("v")
    return sampling.subgraph(src.trade(spark, sf), sampling.round_robin(vertices, 1, 4))[0]


@query(f"WITH {_TRADE}, {_DEGREES}, kp AS (SELECT v FROM deg WHERE k > 1) SELECT src, dst, w FROM e WHERE src IN (SELECT v FROM kp) AND dst IN (SELECT v FROM kp)")
def detach_low_degree(spark: SparkSession, sf: str) -> DataFrame:
    edges = src.trade(spark, sf)
    return graph.induced(edges, sampling.detached(edges))


_KNOWN = "kn AS (SELECT v, b FROM a WHERE v % 3 = 0)"
_MAJOR = """vt AS (SELECT n.v, kn.b, sum(w) AS n FROM (SELECT src AS v, dst AS u, w FROM e UNION ALL SELECT dst, src, w FROM e) n JOIN kn ON kn.v = n.u WHERE n.v <> n.u GROUP BY ALL),
mj AS (SELECT v, b FROM (SELECT *, row_number() OVER (PARTITION BY v ORDER BY n DESC, b) AS k FROM vt) WHERE k = 1 AND v NOT IN (SELECT v FROM kn))"""


@query(f"WITH {_TRADE}, {_KNOWN}, {_MAJOR} SELECT a.v, coalesce(kn.b, mj.b, CAST(floor({uniform_sql(9, 'a.v')} * 25) AS BIGINT)) AS b FROM a LEFT JOIN kn USING (v) LEFT JOIN mj ON mj.v = a.v")
def extend_majority(spark: SparkSession, sf: str) -> DataFrame:
    labels = src.trade_nations(spark, sf)
    return sampling.extend(src.trade(spark, sf), labels.select("v"), labels.where("v % 3 = 0"), 25, 9)


@query(f"""WITH {_TRADE}, {_KNOWN}, {_MAJOR},
ls AS (SELECT v FROM a WHERE v NOT IN (SELECT v FROM kn) AND v NOT IN (SELECT v FROM mj)),
pr AS (SELECT v, min(u) AS u FROM (SELECT src AS v, dst AS u FROM e UNION ALL SELECT dst, src FROM e) WHERE v <> u GROUP BY v)
SELECT v, b FROM kn UNION ALL SELECT v, b FROM mj UNION ALL SELECT ls.v, CAST(floor({uniform_sql(9, 'least(ls.v, coalesce(pr.u, ls.v))')} * 25) AS BIGINT) FROM ls LEFT JOIN pr USING (v)""")
def reattach(spark: SparkSession, sf: str) -> DataFrame:
    labels = src.trade_nations(spark, sf)
    return sampling.reattach(src.trade(spark, sf), labels.select("v"), labels.where("v % 3 = 0"), 25, 9)


@query(f"""WITH {_TRADE}, p AS (SELECT v % 4 AS part, v, b FROM a), s AS (SELECT part, max(b) + 1 AS n FROM p GROUP BY part)
SELECT v, CAST(b + coalesce((SELECT sum(n) FROM s WHERE s.part < p.part), 0) AS BIGINT) AS b FROM p""")
def dnc_offset_concat(spark: SparkSession, sf: str) -> DataFrame:
    return combine.concatenated(src.trade_nations(spark, sf).select((F.col("v") % 4).alias("part"), "v", "b"))


@query(f"""WITH {_TRADE}, {_MODEL}, {_MERGE_SQL},
bs AS (SELECT block, into_, de FROM (SELECT *, row_number() OVER (PARTITION BY block ORDER BY de, into_) AS n FROM md WHERE block < 10 AND into_ >= 10) WHERE n = 1)
SELECT block, into_ AS "into", de FROM bs""")
def dnc_cross_best_merge(spark: SparkSession, sf: str) -> DataFrame:
    _, labels, matrix = _trade_model(spark, sf)
    ids = cut(labels.select("b").distinct())
    found = combine.cross_merges(cut(matrix), ids.where("b < 10"), ids.where("b >= 10"))
    return found.select("block", "into", F.round("de", 4).alias("de"))


@query(f"WITH {_TRADE}, {_MODEL} SELECT DISTINCT b FROM (SELECT CAST(3 AS BIGINT) AS b UNION ALL SELECT c FROM m WHERE r = 3 UNION ALL SELECT r FROM m WHERE c = 3)")
def two_hop_blocks(spark: SparkSession, sf: str) -> DataFrame:
    _, labels, matrix = _trade_model(spark, sf)
    return combine.two_hop(matrix, labels.where("b = 3").select("b").distinct())


@query(f"""WITH {_TRADE}, {_DEGREES}, rk AS (SELECT v, k, row_number() OVER (ORDER BY k DESC, v) - 1 AS n FROM deg)
SELECT v, k, CASE WHEN n % 16 < 8 THEN n % 16 ELSE 15 - n % 16 END AS bucket FROM rk""")
def snake_buckets(spark: SparkSession, sf: str) -> DataFrame:
    return mcmc.snake_buckets(graph.degrees(src.trade(spark, sf)), "k", "v", 8)


@query(f"""WITH {_TRADE}, {_MODEL}, rk AS (SELECT b, row_number() OVER (ORDER BY d DESC, b) - 1 AS n FROM k)
SELECT b, CASE WHEN n % 8 < 4 THEN n % 8 ELSE 7 - n % 8 END AS part FROM rk""")
def distributed_blocks(spark: SparkSession, sf: str) -> DataFrame:
    _, labels, matrix = _trade_model(spark, sf)
    return combine.distributed_blocks(bm.blocks(matrix, labels), 4, "degree")


@query(f"""WITH {_TRADE}, {_MODEL}, rk AS (SELECT a.v, row_number() OVER (ORDER BY k.d DESC, a.v) - 1 AS n FROM a JOIN k USING (b))
SELECT v, CASE WHEN n % 8 < 4 THEN n % 8 ELSE 7 - n % 8 END AS part FROM rk""")
def distributed_vertices(spark: SparkSession, sf: str) -> DataFrame:
    edges, labels, matrix = _trade_model(spark, sf)
    return combine.distributed_vertices(edges, labels, bm.blocks(matrix, labels), 4, "block_degree")


@query(f"""WITH {_TRADE},
sd AS (SELECT j AS trial, b, v, CASE WHEN {uniform_sql(22, 'v', 'j')} < 0.2 + 0.6 * {uniform_sql(21, 'b', 'j')} THEN 1 ELSE 0 END AS side FROM a, range(2) g(j)),
sz AS (SELECT trial, b, count(*) AS n, sum(side) AS n1, count(*) - sum(side) AS n0 FROM sd GROUP BY ALL),
cl AS (SELECT x.trial, x.b, x.side AS r, y.side AS c, sum(w) AS w FROM e JOIN sd x ON src = x.v JOIN sd y ON dst = y.v AND y.trial = x.trial AND y.b = x.b GROUP BY ALL),
pr AS (SELECT trial, b, sum(w) AS e, sum(-lgamma(w + 1)) AS cells, sum(CASE WHEN r = 0 THEN w ELSE 0 END) AS r0, sum(CASE WHEN r = 1 THEN w ELSE 0 END) AS r1, sum(CASE WHEN c = 0 THEN w ELSE 0 END) AS c0, sum(CASE WHEN c = 1 THEN w ELSE 0 END) AS c1 FROM cl GROUP BY ALL),
al AS (SELECT sz.trial, sz.b, n, n0, n1, coalesce(e, 0) AS e, coalesce(cells, 0) AS cells, coalesce(r0, 0) AS r0, coalesce(r1, 0) AS r1, coalesce(c0, 0) AS c0, coalesce(c1, 0) AS c1 FROM sz LEFT JOIN pr ON pr.trial = sz.trial AND pr.b = sz.b WHERE n0 > 0 AND n1 > 0)
SELECT trial, b, round(cells + (r0 + c0) * ln(n0) + (r1 + c1) * ln(n1) + (CASE WHEN n > 1 THEN ln(n - 1) ELSE 0 END) - lgamma(n0 + 1) - lgamma(n1 + 1) + (CASE WHEN e > 0 THEN lgamma(e + 4) - lgamma(e + 1) - lgamma(4) ELSE 0 END)
  - (-lgamma(e + 1) + 2 * e * ln(n) - lgamma(n + 1)), 4) AS de FROM al""")
def random_split_score(spark: SparkSession, sf: str) -> DataFrame:
    edges, labels, _ = _trade_model(spark, sf)
    scores = split.split_scores(cut(edges), cut(split.random_sides(labels, 2, 21)))
    return scores.select("trial", "b", F.round("de", 4).alias("de"))


# searches


@query()
def golden_section_path(spark: SparkSession, sf: str) -> DataFrame:
    """The numbers of blocks that the search visits when the best is at 37."""
    search, rows = MergeSearch(), []
    length = lambda b: abs(b - 37) ** 1.2 + 100
    point = Point(1000, length(1000))
    while True:
        step = search.next(point)
        rows.append((len(rows), point.blocks, float(point.mdl), step.target, step.done))
        if step.done:
            break
        point = Point(step.target, length(step.target))
    return spark.createDataFrame(rows, "step long, blocks long, mdl double, target long, done boolean")


@query(f"""WITH k AS (SELECT s.i AS src, g.k FROM range(300) s(i), range(12) g(k)),
d AS (SELECT src, CASE WHEN {uniform_sql(5, 'src', 'k')} < 0.85 THEN CAST(floor({uniform_sql(3, 'src', 'k')} * CAST(floor((300 - src % 6 - 1) / 6.0) AS DOUBLE)) AS BIGINT) * 6 + src % 6 ELSE CAST(floor({uniform_sql(4, 'src', 'k')} * 300) AS BIGINT) END AS dst FROM k)
SELECT src, dst, count(*) AS w FROM d GROUP BY src, dst""")
def planted_graph(spark: SparkSession, sf: str) -> DataFrame:
    return src.planted(spark, 300, 6, 12, 0.85, 3)[0]


def _scored(spark: SparkSession, found: fitting.Fit, truth: DataFrame) -> DataFrame:
    table = cut(evaluate.contingency(found.assignment, truth))
    scores = evaluate.pairwise(table).crossJoin(F.broadcast(evaluate.nmi(table)))
    return scores.select(F.lit(found.num_blocks).cast("long").alias("num_blocks"), F.round(F.lit(found.mdl), 4).alias("mdl"), F.round("f1", 6).alias("f1"), F.round("nmi", 6).alias("nmi"))


@query()
def planted_recovery(spark: SparkSession, sf: str) -> DataFrame:
    """The whole bottom-up search on a planted graph, scored against its truth."""
    edges, truth = src.planted(spark, 300, 6, 12, 0.85, 3)
    return _scored(spark, fitting.fit(edges, fitting.Config(seed=7)), truth)


@query()
def nation_communities(spark: SparkSession, sf: str) -> DataFrame:
    """Fit the trade between nations, counted over all order lines, and score the blocks against the regions."""
    found = fitting.fit(src.nations(spark, sf), fitting.Config(seed=7))
    return _scored(spark, found, src.nation_regions(spark, sf).withColumnRenamed("b", "t"))


@query()
def sampled_recovery(spark: SparkSession, sf: str) -> DataFrame:
    """Fit half of the vertices, of largest degree, and extend their labels."""
    edges, truth = src.planted(spark, 600, 4, 20, 0.9, 8)
    return _scored(spark, fitting.fit(edges, fitting.Config(seed=7, sample_fraction=0.5, sampler="max_degree")), truth)


_REGIONS = "a2 AS (SELECT v, t AS b FROM t), m2 AS (SELECT x.b AS r, y.b AS c, CAST(sum(w) AS DOUBLE) AS w FROM e JOIN a2 x ON src = x.v JOIN a2 y ON dst = y.v GROUP BY ALL)"


@query(f"""WITH {_TRADE}, {_BOTH.replace('b % 7 AS b', 'b')}, {_REGIONS},
x AS (SELECT CAST(n AS DOUBLE) AS x FROM al),
s AS (SELECT (SELECT sum(n * (n - 1) / 2.0) FROM ct) AS c, (SELECT sum(n * (n - 1) / 2.0) FROM rs) AS r, (SELECT sum(n * (n - 1) / 2.0) FROM ks) AS k, (SELECT sum(n * n) FROM ct) AS cc, (SELECT sum(n * n) FROM rs) AS rr, (SELECT sum(n * n) FROM ks) AS kk, x AS n FROM x),
p AS (SELECT c / r AS re, c / k AS pr, (c + (n * n + cc - rr - kk) / 2) / (n * (n - 1) / 2) AS ra FROM s),
mi AS (SELECT sum(ct.n / x * ln(ct.n * x / (CAST(rs.n AS DOUBLE) * ks.n))) AS mi FROM ct JOIN rs USING (b) JOIN ks USING (t), x),
h1 AS (SELECT -sum(n / x * ln(n / x)) AS h FROM rs, x), h2 AS (SELECT -sum(ks.n / x * ln(ks.n / x)) AS h FROM ks, x),
q AS (SELECT sum(w) AS e, (SELECT count(*) FROM (SELECT DISTINCT b FROM a2)) AS nb, (SELECT sum({_F('w')}) FROM m2) - (SELECT sum({_F('w')}) FROM (SELECT sum(w) AS w FROM m2 GROUP BY r)) - (SELECT sum({_F('w')}) FROM (SELECT sum(w) AS w FROM m2 GROUP BY c)) AS l FROM m2)
SELECT round(ra, 4) AS rand, round(pr, 4) AS precision, round(re, 4) AS recall, round(2 * pr * re / (pr + re), 4) AS f1, round(mi / sqrt(h1.h * h2.h), 4) AS nmi,
  round(e * ((1 + nb * nb / e) * ln(1 + nb * nb / e) - nb * nb / e * ln(nb * nb / e)) + (SELECT count(*) FROM a) * ln(nb) - l, 4) AS true_mdl FROM p, mi, h1, h2, q""")
def truth_scores(spark: SparkSession, sf: str) -> DataFrame:
    """The composite evaluation: nations against regions on the trade graph."""
    edges, labels = src.trade(spark, sf), src.trade_nations(spark, sf)
    one = evaluate.scores(edges, labels, src.trade_regions(spark, sf), labels.count())
    return one.select(*[F.round(c, 4).alias(c) for c in one.columns])


@query("""SELECT CAST(time_bucket(INTERVAL '1 day', ts) AS TIMESTAMP) AS start, event_type AS src, user_id % 10 AS dst, count(*) AS w FROM events GROUP BY ALL""")
def windowed_edges(spark: SparkSession, sf: str) -> DataFrame:
    """The streaming operator's windows over the whole table of events."""
    events = src.table(spark, sf, "events").select("ts", F.col("event_type").alias("src"), (F.col("user_id") % 10).alias("dst"))
    return edge_windows(events).withColumn("start", F.col("start").cast("timestamp_ntz"))


from graphloom.plans import details  # noqa: E402, F401  registers the queries of the smaller operators
