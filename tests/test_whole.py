"""What a bound on the size or on the number of rounds must not change."""

import random

import pytest
from pyspark.sql import functions as F

from graphloom.operators import blockmodel as bm
from graphloom.operators import combine
from graphloom.operators.entropy import merge_delta
from graphloom.operators.merge import best_merges
from graphloom.plans import fit as fitting
from graphloom.sources.tables import planted


def test_sampled_labels_reach_the_end_of_a_long_chain(spark):
    edges, _ = planted(spark, 40, 2, 8, 0.9, 3)
    chain = spark.range(40, 70).select(F.when(F.col("id") == 40, 0).otherwise(F.col("id") - 1).cast("long").alias("src"), F.col("id").alias("dst"), F.lit(1).cast("long").alias("w"))
    found = fitting.fit(edges.select("src", "dst", "w").unionByName(chain), fitting.Config(seed=3, sample_fraction=0.4, sampler="max_degree"))
    labels = {r.v: r.b for r in found.assignment.collect()}
    assert len(set(labels.values())) > 1
    assert {labels[v] for v in range(40, 70)} == {labels[0]}


def test_cross_merges_are_the_best_of_all_pairs_at_any_size(spark, monkeypatch):
    monkeypatch.setattr(combine, "CROSS", 0, raising=False)
    rng = random.Random(4)
    cells = {(rng.randrange(38), rng.randrange(38)): rng.randint(1, 6) for _ in range(45)} | {(k, k): 3 for k in range(0, 36, 5)}
    matrix = spark.createDataFrame([(r, c, w) for (r, c), w in cells.items()], "r long, c long, w long").cache()
    one, two = spark.range(0, 20).toDF("b"), spark.range(20, 40).toDF("b")
    every = one.toDF("block").crossJoin(two.toDF("into"))
    want = {r.block: (r.into, round(r.de, 6)) for r in best_merges(merge_delta(matrix, every)).collect()}
    got = {r.block: (r.into, round(r.de, 6)) for r in combine.cross_merges(matrix, one, two).collect()}
    assert len(want) == 20 and got == want


def test_unknown_options_are_refused():
    for options in ({"splitter": "other"}, {"split_init": ""}, {"subgraph_partition": "none"}, {"mh_batches": 0}):
        with pytest.raises(ValueError):
            fitting.Config(**options)


@pytest.mark.parametrize("options", [{"algorithm": "metropolis_hastings", "greedy": False}, {"mh_fraction": 0.5}, {"objective": "nonparametric"}])
def test_sweeps_as_plans_lower_the_length_under_every_option(spark, options):
    edges, truth = planted(spark, 60, 2, 10, 0.95, 3)
    config = fitting.Config(sweeps=2, **options)
    whole = fitting.prepared(edges, config)
    labels = truth.select("v", F.when(F.col("v") % 7 == 0, 1 - F.col("t")).otherwise(F.col("t")).alias("b"))
    before = fitting._length(bm.block_matrix(whole, labels), labels, 60, 2, config)
    after, length, sweeps, moves = fitting.vertex_phase(whole, labels, 60, 2, config, 5, before, False)
    assert moves > 0 and length < before and 1 <= sweeps <= 2
    assert length == pytest.approx(fitting._length(bm.block_matrix(whole, after), after, 60, 2, config))


@pytest.mark.parametrize("objective", ["parametric", "nonparametric"])
def test_merges_as_plans_reach_the_target_in_rounds(spark, objective):
    edges, truth = planted(spark, 60, 2, 10, 0.95, 3)
    config = fitting.Config(objective=objective, local_cells=0)
    whole = fitting.prepared(edges, config)
    labels = truth.select("v", (F.col("v") % 6).alias("b"))
    merged, number = fitting.merge_phase(whole, labels, 6, 2, config, 3)
    assert number == 2
    pairs = {(r.b, r.t) for r in merged.join(truth, "v").select("b", "t").distinct().collect()}
    assert len(pairs) == 2


@pytest.mark.parametrize(("splitter", "seeds"), [("snowball", "random"), ("single_snowball", "degree_weighted"), ("connectivity_snowball", "high_degree")])
def test_sides_of_every_splitter(spark, splitter, seeds):
    edges, truth = planted(spark, 60, 2, 10, 0.95, 3)
    labels = truth.select("v", F.when(F.col("v") < 58, 0).otherwise(1).cast("long").alias("b"))
    sides = fitting._sides(edges, labels, fitting.Config(splitter=splitter, split_init=seeds, trials=2), 5)
    rows = sides.collect()
    trials = {r.trial for r in rows}
    assert trials == ({0} if seeds == "high_degree" else {0, 1})
    for trial in trials:
        own = [r for r in rows if r.trial == trial]
        assert sorted((r.b, r.v) for r in own) == sorted((r.b, r.v) for r in labels.collect())
        assert {r.side for r in own if r.b == 0} == {0, 1}
        if splitter == "single_snowball":
            assert sum(r.side for r in own if r.b == 0) == 29
