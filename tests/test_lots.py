"""What tasks hold: lots whose number grows with the rows, whatever the number of shuffle partitions."""

import os
import random
from collections import Counter
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from graphloom.operators import blockmodel as bm
from graphloom.operators import common, graph
from graphloom.plans import catalogue
from graphloom.sources import tables as src

DATA = "/root/testdata/sf0.001"


@pytest.fixture
def small_lots(monkeypatch):
    monkeypatch.setattr(common, "LOT", 100, raising=False)


def tasks(frame):
    """Rows of each task of ``frame`` that has any."""
    return [r["count"] for r in frame.groupBy(F.spark_partition_id()).count().collect()]


def lineitem(spark, folder, lines):
    spark.createDataFrame(lines, "l_orderkey long, l_partkey long, l_suppkey long").write.parquet(f"{folder}/lineitem.parquet")
    return str(folder)


@pytest.mark.parametrize("side", [1_000, 5])
def test_part_pairs_are_dealt_by_their_number(spark, tmp_path, monkeypatch, small_lots, side):
    monkeypatch.setattr(src, "SIDE", side, raising=False)
    rng = random.Random(1)
    lines = [(o, rng.randrange(60), 1) for o in range(300) for _ in range(4)] + [(300, p, 1) for p in range(50)] + [(None, 1, 1), (1, None, 1), (2, 7, 1), (2, 7, 1)]
    found = src.parts(spark, lineitem(spark, tmp_path, lines))
    of = {}
    for o, p, _ in lines:
        if o is not None and p is not None:
            of.setdefault(o, set()).add(p)
    want = Counter(pair for parts in of.values() for pair in combinations(sorted(parts), 2))
    assert {(r.src, r.dst): r.w for r in found.collect()} == want
    assert found.rdd.getNumPartitions() >= 30 and max(tasks(found)) <= 200


def test_part_pairs_of_no_lines(spark, tmp_path):
    assert src.parts(spark, lineitem(spark, tmp_path, [])).isEmpty()


def test_trade_is_dealt_by_its_lines(spark, tmp_path, small_lots):
    rng = random.Random(2)
    lines = [(rng.randrange(900), 1, rng.randrange(20)) for _ in range(3_000)] + [(None, 1, 1), (5_000, 1, 1)]
    orders = [(o, rng.randrange(40)) for o in range(1_000)] + [(7, 3), (None, 2)]
    spark.createDataFrame(orders, "o_orderkey int, o_custkey long").write.parquet(f"{tmp_path}/orders.parquet")
    found = src.trade(spark, lineitem(spark, tmp_path, lines))
    of = {}
    for o, c in orders:
        of.setdefault(o, []).append(c)
    want = Counter((s, c + src.CUSTOMERS) for o, _, s in lines if o is not None for c in of.get(o, []))
    assert {(r.src, r.dst): r.w for r in found.collect()} == want
    assert found.rdd.getNumPartitions() >= 30 and max(tasks(found)) <= 200


@pytest.mark.parametrize("few", [10_000, 0])
def test_influential_ends_put_few_edges_in_order(spark, monkeypatch, few):
    monkeypatch.setattr(common, "FEW", few)
    rng = random.Random(3)
    edges = sorted({(min(rng.randrange(200), rng.randrange(200)), 200 + rng.randrange(60)) for _ in range(1_500)} | {(v, v) for v in range(0, 200, 9)})
    k = Counter(v for e in edges for v in e)
    k.subtract(a for a, b in edges if a == b)
    met = list(dict.fromkeys(v for a, b in sorted(edges, key=lambda e: (-k[e[0]] * k[e[1]], e)) for v in (a, b)))
    ordered = []
    monkeypatch.setattr(graph, "first_n", lambda frame, *rest: ordered.append(frame.count()) or common.first_n(frame, *rest))
    frame = spark.createDataFrame([(a, b, 1) for a, b in edges], "src long, dst long, w long").cache()
    for n in (0, 1, 30, 500):
        assert sorted(r.v for r in graph.influential_by_edges(frame, n).collect()) == sorted(met[:n])
        assert n == 500 or ordered[-1] <= 2 * n + 20 < len(met)


def test_a_model_is_checked_by_one_reading_of_its_edges(spark):
    edges = spark.createDataFrame([(v, (v * 7) % 30, 1 + v % 3) for v in range(30)], "src long, dst long, w long").cache()
    labels = spark.range(30).select(F.col("id").alias("v"), (F.col("id") % 4).alias("b"))
    matrix = common.cut(bm.block_matrix(edges, labels))
    table = common.cut(bm.blocks(matrix, labels))
    read = spark.sparkContext.accumulator(0)

    def passing(row):
        read.add(1)
        return row

    assert bm.valid(spark.createDataFrame(edges.rdd.map(passing), edges.schema), labels, matrix, table)
    assert read.value == 30
    assert not bm.valid(edges, labels.select("v", F.when(F.col("v") == 3, 0).otherwise(F.col("b")).cast("long").alias("b")), matrix, table)


def test_same_relation_counts_rows_and_nulls(spark):
    frame = lambda *rows: spark.createDataFrame([(r, 1) for r in rows], "a long, b long")
    assert bm.same_relation(frame(1, None, 1), frame(None, 1, 1).toDF("x", "y")) and bm.same_relation(frame(), frame())
    assert not bm.same_relation(frame(1, 1, None), frame(1, None)) and not bm.same_relation(frame(1), frame(1, None))


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables here")
def test_models_of_nations_read_the_lines_once(spark):
    edges, _, matrix = catalogue._nation_model(spark, DATA)
    assert not [f for frame in (edges, matrix) for f in frame.inputFiles() if "lineitem" in f]
