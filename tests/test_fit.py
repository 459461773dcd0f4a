"""Searches, fits, files and streams."""

import json
import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphloom.operators import evaluate
from graphloom.operators.mcmc import early_stop
from graphloom.plans import fit as fitting
from graphloom.plans.kernel import Model
from graphloom.plans.search import MergeSearch, Point, SplitSearch
from graphloom.sources import files
from graphloom.sources.tables import planted
from graphloom.streaming.edges import block_windows, edge_windows, event_stream, maintain


def score(found, truth):
    return evaluate.pairwise(evaluate.contingency(found.assignment, truth)).first().f1


@pytest.mark.parametrize("best", [1, 2, 7, 37, 400, 999])
def test_merge_search_finds_the_best(best):
    search = MergeSearch()
    point, seen = Point(1000, abs(1000 - best) + 5.0), 0
    while not (step := search.next(point)).done:
        point, seen = Point(step.target, abs(step.target - best) + 5.0), seen + 1
        assert seen < 60
    assert abs(search.points[1].blocks - best) <= 1


@pytest.mark.parametrize("best", [1, 2, 9, 50])
def test_split_search_finds_the_best(best):
    search = SplitSearch(1000)
    point, seen = Point(1, abs(1 - best) + 5.0), 0
    while not (step := search.next(point)).done:
        point, seen = Point(step.target, abs(step.target - best) + 5.0), seen + 1
        assert seen < 60
    assert abs(search.points[1].blocks - best) <= 1


def test_searches_end_when_targets_are_missed():
    search, point = MergeSearch(), Point(50, 10.0)
    for _ in range(200):
        step = search.next(point)
        if step.done:
            break
        point = Point(50, 10.0)
    assert step.done


def test_early_stop():
    assert early_stop([-1.0, 0.0], 100, False)
    assert not early_stop([-9.0, -8.0, -7.0], 100, False)
    assert early_stop([-9.0, -0.01, -0.01, -0.01], 100, False)
    assert not early_stop([-9.0, -0.02, -0.02, -0.02], 100, True)


def test_greedy_sweeps_never_raise_the_length():
    rng = random.Random(1)
    edges = [(rng.randrange(30), rng.randrange(30), rng.randrange(1, 3)) for _ in range(200)]
    model = Model(edges, 30, [v % 6 for v in range(30)])
    lengths = [model.mdl()]
    for _ in range(5):
        model.sweep(list(range(30)), rng)
        lengths.append(model.mdl())
    assert all(b <= a + 1e-6 for a, b in zip(lengths, lengths[1:], strict=False))
    carried = ([dict(r) for r in model.rows], list(model.d_out), list(model.d_in), list(model.size))
    fresh = Model(edges, 30, model.labels)
    assert fresh.mdl() == pytest.approx(model.mdl())
    assert sorted(sum(r.values()) for r in carried[0]) == sorted(sum(r.values()) for r in fresh.rows)


def test_fit_recovers_a_planted_partition(spark):
    edges, truth = planted(spark, 300, 6, 12, 0.85, 3)
    found = fitting.fit(edges, fitting.Config(seed=7))
    assert found.num_blocks == 6 and score(found, truth) == pytest.approx(1)
    assert found.profile and found.profile[-1]["iteration"] == len(found.profile)


def test_fit_by_plans(spark):
    edges, truth = planted(spark, 40, 2, 8, 0.9, 3)
    found = fitting.fit(edges, fitting.Config(seed=3, algorithm="async_gibbs", local_edges=0, sweeps=2))
    assert found.num_blocks == 2 and score(found, truth) == pytest.approx(1)


def test_sampled_and_detached_fit(spark):
    edges, truth = planted(spark, 200, 2, 12, 0.95, 3)
    found = fitting.fit(edges, fitting.Config(seed=3, sample_fraction=0.6, sampler="max_degree", detach=True))
    assert found.assignment.count() == 200 and score(found, truth) > 0.9


def test_divide_and_conquer(spark):
    edges, truth = planted(spark, 40, 2, 8, 0.9, 3)
    found = fitting.divide_and_conquer(edges, 2, fitting.Config(seed=3, algorithm="async_gibbs", sweeps=2))
    assert found.assignment.count() == 40 and score(found, truth) > 0.9


def test_top_down(spark):
    edges, truth = planted(spark, 40, 2, 8, 0.9, 3)
    config = fitting.Config(seed=3, algorithm="async_gibbs", sweeps=3, splitter="connectivity_snowball")
    found = fitting.fit_top_down(fitting.prepared(edges, config), truth.select("v"), config)
    assert found.assignment.count() == 40 and found.num_blocks >= 1


def test_config_is_checked():
    for wrong in ({"algorithm": "none"}, {"sample_fraction": 0}, {"num_subgraphs": 0}):
        with pytest.raises(ValueError):
            fitting.Config(**wrong)


def test_edge_list_and_truth(spark, tmp_path):
    (tmp_path / "g.tsv").write_text("1\t2\t9\n2  3 1\n\n3 3 1\n")
    (tmp_path / "g_truePartition.tsv").write_text("1 1\n3 2\n")
    edges, vertices, truth = files.read_graph(spark, str(tmp_path / "g"))
    assert sorted(map(tuple, edges.collect())) == [(0, 1, 1), (1, 2, 1), (2, 2, 1)]
    assert vertices.count() == 3 and sorted(map(tuple, truth.collect())) == [(0, 0), (1, None), (2, 1)]
    undirected = files.read_graph(spark, str(tmp_path / "g"), directed=False)[0]
    assert undirected.count() == 5
    with pytest.raises(FileNotFoundError):
        files.resolve(spark, str(tmp_path / "missing"))


def test_matrix_market(spark, tmp_path):
    (tmp_path / "m.mtx").write_text("%%MatrixMarket matrix coordinate pattern symmetric\n% by hand\n3 3 3\n1 1\n2 1\n3 2\n")
    edges, vertices, truth = files.read_graph(spark, str(tmp_path / "m"))
    assert sorted((r.src, r.dst) for r in edges.collect()) == [(0, 0), (0, 1), (1, 0), (1, 2), (2, 1)]
    assert {r.t for r in truth.collect()} == {0}
    (tmp_path / "bad.mtx").write_text("%%MatrixMarket matrix coordinate real general\n3 4 1\n1 1 1\n")
    with pytest.raises(ValueError):
        files.read_matrix_market(spark, str(tmp_path / "bad.mtx"))


def test_result_sinks(spark, tmp_path):
    edges, truth = planted(spark, 60, 2, 10, 0.9, 3)
    config = fitting.Config(seed=3)
    found = fitting.fit(edges, config)
    files.append_json(spark, files.result_row(found, config, 1.5, edges.count(), 60, {"f1": score(found, truth)}), str(tmp_path / "out"))
    row = json.loads(next((tmp_path / "out").glob("*.json")).read_text())
    assert row["num_blocks"] == found.num_blocks and row["algorithm"] == "hybrid_mcmc"
    files.append_profile(spark, found.profile, str(tmp_path / "csv"))
    lines = spark.read.csv(str(tmp_path / "csv"), header=True).collect()
    assert len(lines) == len(found.profile) + 1 and float(lines[-1]["iteration"]) == -1
    files.write_labels(found, str(tmp_path / "labels"))
    assert spark.read.text(str(tmp_path / "labels")).count() == 60


def test_stream_equals_table(spark, tmp_path):
    schema = T.StructType([T.StructField("ts", T.TimestampType()), T.StructField("src", T.LongType()), T.StructField("dst", T.LongType())])
    events = spark.range(200).select((F.lit(1_700_000_000) + F.col("id") * 1800).cast("timestamp").alias("ts"), (F.col("id") % 5).alias("src"), (F.col("id") % 3).alias("dst"))
    events.coalesce(1).write.parquet(str(tmp_path / "in"))
    last = spark.createDataFrame([("2030-01-01", 0, 0)], "ts string, src long, dst long").withColumn("ts", F.to_timestamp("ts"))
    last.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    labels = spark.range(5).select(F.col("id").alias("v"), (F.col("id") % 2).alias("b"))
    for name, of in (("edges", lambda x: edge_windows(x)), ("blocks", lambda x: block_windows(x, labels))):
        query = maintain(of(event_stream(spark, str(tmp_path / "in"), schema, 10)), str(tmp_path / name), str(tmp_path / f"{name}-state"))
        query.awaitTermination()
        query = maintain(of(event_stream(spark, str(tmp_path / "in"), schema, 10)), str(tmp_path / name), str(tmp_path / f"{name}-state"))
        query.awaitTermination()
        got = sorted(map(tuple, spark.read.parquet(str(tmp_path / name)).collect()))
        want = sorted(map(tuple, of(events).collect()))
        assert got == want


@pytest.mark.parametrize("options", [{"algorithm": "metropolis_hastings"}, {"algorithm": "async_gibbs", "batches": 3}, {"algorithm": "async_gibbs", "async_iterations": 2}, {"greedy": False, "sweeps": 30}, {"objective": "nonparametric"}, {"ordered": True, "directed": False}])
def test_options_recover_a_planted_partition(spark, options):
    edges, truth = planted(spark, 200, 3, 14, 0.95, 3)
    found = fitting.fit(edges, fitting.Config(seed=5, **options))
    assert score(found, truth) > 0.9


def test_mixed_search(spark):
    edges, truth = planted(spark, 40, 2, 8, 0.95, 3)
    config = fitting.Config(seed=3, algorithm="async_gibbs", sweeps=3, trials=3, mix=True)
    found = fitting.fit_top_down(fitting.prepared(edges, config), truth.select("v"), config)
    assert found.assignment.count() == 40
