"""Graph, blockmodel and entropy operators against hand-computed values and brute force."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from graphloom.functions.partitions import dilog, log_partitions, partitions
from graphloom.functions.numeric import lbinom, lgamma
from graphloom.operators import blockmodel as bm
from graphloom.operators import combine, description, entropy, evaluate, graph, mcmc, merge, proposal, sampling, split
from graphloom.operators.components import connected
from graphloom.plans.kernel import Model

TOY = [(0, 0), (0, 1), (0, 2), (1, 2), (2, 3), (3, 1), (3, 2), (3, 5), (4, 1), (4, 6), (5, 4), (5, 5), (5, 6), (5, 7), (6, 4), (7, 3), (7, 9), (8, 5), (8, 7), (9, 10), (10, 7), (10, 8), (10, 10)]
LABELS = [0, 0, 0, 0, 1, 1, 1, 2, 2, 2, 2]
SIX = [0, 0, 0, 1, 2, 3, 3, 4, 5, 1, 5]


@pytest.fixture(scope="module")
def edges(spark):
    return spark.createDataFrame([(a, b, 1) for a, b in TOY], "src long, dst long, w long").cache()


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame(list(enumerate(LABELS)), "v long, b long").cache()


def rows(frame, *columns):
    return sorted(tuple(r) for r in frame.select(*columns).collect())


def test_degrees(edges):
    found = dict(rows(graph.degrees(edges), "v", "k"))
    assert [found[v] for v in range(11)] == [3, 4, 4, 5, 4, 6, 3, 5, 3, 2, 4]


def test_islands_and_high_degree(spark, edges):
    assert rows(graph.islands(spark.range(13).toDF("v"), edges), "v") == [(11,), (12,)]
    high = [v for v, x in rows(graph.high_low(edges, 0.3), "v", "is_high") if x]
    assert high == [1, 3, 5, 7]  # degrees 6, 5, 5 and the smallest of those with 4


def test_symmetrised_and_dedup(spark):
    e = spark.createDataFrame([(0, 1, 1), (0, 1, 1), (1, 1, 1)], "src long, dst long, w long")
    assert rows(graph.weighted(graph.symmetrised(e)), "src", "dst", "w") == [(0, 1, 2), (1, 0, 2), (1, 1, 1)]
    assert rows(graph.deduplicated(e), "src", "dst", "w") == [(0, 1, 1), (1, 1, 1)]


def test_block_matrix_and_degrees(edges, labels):
    m = bm.block_matrix(edges, labels)
    assert rows(m, "r", "c", "w") == [(0, 0, 7), (0, 1, 1), (1, 0, 1), (1, 1, 5), (1, 2, 1), (2, 0, 1), (2, 1, 1), (2, 2, 6)]
    assert rows(bm.blocks(m, labels), "b", "d_out", "d_in", "d", "size") == [(0, 8, 9, 10, 4), (1, 7, 7, 9, 3), (2, 8, 7, 9, 4)]
    assert bm.valid(edges, labels, m, bm.blocks(m, labels))
    one = bm.totals(m).first()
    assert (one.edges, one.trace, one.cells) == (23, 18, 8)
    assert rows(bm.neighbor_weights(m).where("b = 0"), "nb", "w") == [(0, 7), (1, 2), (2, 1)]
    assert rows(bm.dense_row(m, 0, 3), "c", "w") == [(0, 7), (1, 1), (2, 0)]
    assert rows(bm.distinct_edges(m), "b", "n") == [(0, 4), (1, 5), (2, 4)]


def test_six_block_neighbours(spark, edges):
    m = bm.block_matrix(edges, spark.createDataFrame(list(enumerate(SIX)), "v long, b long"))
    assert rows(bm.neighbor_sets(m).where("b = 1"), "nb") == [(0,), (3,), (4,), (5,)]


def test_mdl(edges, labels):
    one = entropy.mdl(bm.block_matrix(edges, labels), 11, 3).first()
    assert one.mdl == pytest.approx(92.58797747, abs=1e-7)
    assert one.null_mdl == pytest.approx(76.27329193, abs=1e-7)


def test_null_mdl_of_a_large_graph(spark):
    x = spark.range(1).select(entropy.null_cost(F.lit(5e12)).alias("x")).first().x
    assert x == pytest.approx(1.462023e14, rel=1e-5)


def test_modularity(edges, labels):
    assert graph.modularity(edges, labels).first().q == pytest.approx(0.448015123, abs=1e-8)


def test_move(spark, edges, labels):
    m = bm.block_matrix(edges, labels)
    moves = spark.createDataFrame([(7, 0)], "v long, b_to long")
    cells = rows(entropy.move_cells(edges, labels, moves), "r", "c", "dw")
    assert cells == [(0, 0, 1), (0, 2, 1), (1, 0, 1), (1, 2, -1), (2, 0, 1), (2, 2, -3)]
    assert entropy.move_delta(edges, labels, m, bm.blocks(m, labels), moves).first().de == pytest.approx(4.140978018, abs=1e-8)
    after = bm.moved(labels, moves)
    assert entropy.mdl(bm.block_matrix(edges, after), 11, 3).first().mdl == pytest.approx(96.728955493, abs=1e-8)


def test_every_move_equals_the_difference_and_the_kernel(spark, edges, labels):
    m = bm.block_matrix(edges, labels)
    table = bm.blocks(m, labels)
    moves = spark.createDataFrame([(v, (LABELS[v] + s) % 3) for v in range(11) for s in (1, 2)], "v long, b_to long")
    found = {(r.v, r.b_to): r.de for s in (1, 2) for r in entropy.move_delta(edges, labels, m, table, moves.where(F.col("b_to") == (F.element_at(F.array(*[F.lit(x) for x in LABELS]), (F.col("v") + 1).cast("int")) + s) % 3)).collect()}
    kernel = Model([(a, b, 1) for a, b in TOY], 11, LABELS)
    before = kernel.mdl()
    for (v, to), de in found.items():
        at = kernel.labels[v]
        cells = kernel.move_cells(v, to)
        assert de == pytest.approx(kernel.move_delta(v, to, cells), abs=1e-9)
        kernel.move(v, to, cells)
        assert kernel.mdl() - before == pytest.approx(de, abs=1e-9)
        kernel.move(v, at, kernel.move_cells(v, at))
    assert len(found) == 22


def test_hastings_equals_the_kernel(spark, edges, labels):
    m = bm.block_matrix(edges, labels)
    moves = spark.createDataFrame([(v, (LABELS[v] + 1) % 3) for v in range(11)], "v long, b_to long")
    found = dict(rows(entropy.hastings(edges, labels, m, bm.blocks(m, labels), moves, 3), "v", "hastings"))
    kernel = Model([(a, b, 1) for a, b in TOY], 11, LABELS)
    for v in range(11):
        to = (LABELS[v] + 1) % 3
        assert found[v] == pytest.approx(kernel.hastings(v, to, kernel.move_cells(v, to)), rel=1e-9)


def test_merge(spark, edges, labels):
    m = bm.block_matrix(edges, labels)
    scored = dict(((r.block, r.into), r.de) for r in entropy.merge_delta(m, merge.all_pairs(labels)).collect())
    assert scored[0, 1] == pytest.approx(4.664340586, abs=1e-8)
    before = entropy.log_likelihood(m).first().l
    for (b, into), de in scored.items():
        after = bm.block_matrix(edges, bm.merged(labels, spark.createDataFrame([(b, into)], "block long, into long")))
        assert before - entropy.log_likelihood(after).first().l == pytest.approx(de, abs=1e-9)
        kernel = Model([(x, y, 1) for x, y in TOY], 11, LABELS)
        assert kernel.merge_delta(b, into) == pytest.approx(de, abs=1e-9)


def test_resolved_merges_follow_chains(spark):
    chain = spark.createDataFrame([(5, 4), (4, 3), (3, 4), (9, 8)], "block long, into long")
    assert rows(merge.resolved(chain), "block", "into") == [(4, 3), (5, 3), (9, 8)]


def test_components_of_a_long_path(spark):
    n = 40
    path = spark.range(n).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    assert {r.root for r in connected(path).collect()} == {0}
    assert connected(path.where("a < 0")).count() == 0


def test_nonparametric(spark, edges, labels):
    m = bm.block_matrix(edges, labels)
    one = description.mdl(m, bm.blocks(m, labels)).first()
    assert one.sparse_entropy == pytest.approx(39.85008729, abs=1e-7)
    assert one.partition_dl == pytest.approx(15.55899848, abs=1e-7)
    assert one.edges_dl == pytest.approx(15.88094508, abs=1e-7)
    assert one.mdl == pytest.approx(71.29003084, abs=1e-7)
    corrected = description.sparse_entropy(m, bm.blocks(m, labels), edges, degree_corrected=True).first().s
    assert corrected == pytest.approx(19.12221267, abs=1e-7)


@pytest.mark.parametrize(("move", "expected"), [(None, 81.44696151), (6, 82.12655765)])
def test_nonparametric_of_six_blocks(spark, edges, move, expected):
    six = list(SIX)
    if move is not None:
        six[move] = 0
    a = spark.createDataFrame(list(enumerate(six)), "v long, b long")
    m = bm.block_matrix(edges, a)
    assert description.mdl(m, bm.blocks(m, a)).first().mdl == pytest.approx(expected, abs=1e-7)


def test_degree_dl_with_exact_counts(spark, edges, labels):
    m = bm.block_matrix(edges, labels)
    dl = description.degree_dl(bm.blocks(m, labels), bm.degree_histogram(edges, labels)).first().dl
    assert dl == pytest.approx(27.000101693, abs=1e-7)


def test_lgamma_and_lbinom(spark):
    values = [0.5, 1, 2, 3.7, 10, 15.9, 16, 100, 12345, 5e9]
    got = [r.x for r in spark.createDataFrame([(float(v),) for v in values], "v double").select(lgamma(F.col("v")).alias("x")).collect()]
    assert got == pytest.approx([math.lgamma(v) for v in values], rel=1e-12, abs=1e-11)
    one = spark.range(1).select(lbinom(F.lit(10), F.lit(3)).alias("a"), lbinom(F.lit(3), F.lit(9)).alias("b")).first()
    assert one.a == pytest.approx(math.log(120)) and one.b == 0


def test_partitions():
    assert [partitions(n, n) for n in (1, 5, 10, 20)] == [1, 7, 42, 627]
    assert float(dilog(np.array(1.0))) == pytest.approx(math.pi**2 / 6)
    assert float(dilog(np.array(0.5))) == pytest.approx(math.pi**2 / 12 - math.log(2) ** 2 / 2)
    for n, k in ((200, 200), (500, 40), (300, 20)):
        assert log_partitions(n, k) == pytest.approx(math.log(partitions(n, k)), rel=0.02)


TABLE = [[192, 0, 1, 3, 0, 100, 133, 48], [0, 232, 0, 0, 0, 1, 0, 0], [1, 0, 631, 112, 44, 97, 3, 1], [0, 0, 0, 245, 0, 1, 0, 5], [0, 0, 0, 0, 172, 75, 151, 6]]


def test_pairwise_scores(spark):
    cells = spark.createDataFrame([(b, t, n) for b, row in enumerate(TABLE) for t, n in enumerate(row) if n], "b long, t long, n long")
    one = evaluate.pairwise(cells).first()
    assert (one.rand, one.f1) == pytest.approx((0.841589, 0.620835), abs=1e-6)
    assert sorted((one.precision, one.recall)) == pytest.approx([0.508136, 0.797772], abs=1e-6)
    assert evaluate.accuracy(cells) == pytest.approx((192 + 232 + 631 + 245 + 172) / 2254)


def test_scores_of_edge_cases(spark):
    perfect = spark.createDataFrame([(0, 1, 5), (1, 0, 7)], "b long, t long, n long")
    assert evaluate.nmi(perfect).first().nmi == pytest.approx(1)
    assert evaluate.nmi(spark.createDataFrame([(0, 0, 5)], "b long, t long, n long")).first().nmi == 0
    empty = spark.createDataFrame([], "b long, t long, n long")
    assert evaluate.pairwise(empty).first().f1 == 0 and evaluate.accuracy(empty) == 0


def test_best_matching_against_brute_force():
    from itertools import permutations

    rng = np.random.default_rng(2)
    for _ in range(60):
        r, c = rng.integers(1, 6, 2)
        gain = rng.integers(0, 20, (r, c)).astype(float)
        found = evaluate.best_matching(gain)
        got = sum(gain[k, x] for k, x in enumerate(found) if x >= 0)
        wide = gain if r <= c else gain.T
        best = max(sum(wide[k, x] for k, x in enumerate(p)) for p in permutations(range(wide.shape[1]), wide.shape[0]))
        assert got == best
        assert len({x for x in found if x >= 0}) == sum(x >= 0 for x in found)


def test_max_degree_sample_and_subgraph(spark, edges):
    assert sorted(v for (v,) in rows(sampling.max_degree(edges, 4), "v")) == [1, 3, 5, 7]
    local, mapping = sampling.subgraph(edges, sampling.max_degree(edges, 4))
    assert rows(mapping, "v", "local_v") == [(1, 0), (3, 1), (5, 2), (7, 3)]
    assert rows(local, "src", "dst") == [(1, 0), (1, 2), (2, 2), (2, 3), (3, 1)]


def test_extend_and_reattach(spark):
    e = spark.createDataFrame([(0, 1, 1), (1, 2, 1), (2, 3, 1), (4, 5, 1)], "src long, dst long, w long")
    vertices = spark.range(7).toDF("v")
    known = spark.createDataFrame([(0, 1), (1, 1)], "v long, b long")
    once = dict(rows(sampling.extend(e, vertices, known, 2, 3), "v", "b"))
    assert once[2] == 1 and set(once) == set(range(7))
    waves = dict(rows(sampling.extend(e, vertices, known, 2, 3, rounds=5), "v", "b"))
    assert waves[3] == 1
    back = dict(rows(sampling.reattach(e, vertices, known, 2, 3), "v", "b"))
    assert back[2] == 1 and back[4] == back[5] and set(back) == set(range(7))


def test_snowballs_cover_all(edges):
    cover = rows(sampling.snowballs(edges, 3), "v", "part")
    assert [v for v, _ in cover] == list(range(11)) and {p for _, p in cover} <= {0, 1, 2}
    assert sampling.expansion(edges, 6, sampling.max_degree(edges, 1)).count() == 6


def test_buckets(spark):
    deg = spark.createDataFrame([(v, 100 - v) for v in range(20)], "v long, k long")
    found = dict(rows(mcmc.snake_buckets(deg, "k", "v", 4), "v", "bucket"))
    assert [found[v] for v in range(9)] == [0, 1, 2, 3, 3, 2, 1, 0, 0]
    sums = {}
    for _, k, b in rows(mcmc.contiguous_buckets(deg, "k", "v", 4), "v", "k", "bucket"):
        sums[b] = sums.get(b, 0) + k
    assert set(sums) == {0, 1, 2, 3} and max(sums.values()) - min(sums.values()) <= 200


def test_gibbs_never_empties_a_block_and_lowers_one_move_each(spark, edges, labels):
    a = spark.createDataFrame([(v, v % 6) for v in range(11)], "v long, b long")
    moves = mcmc.gibbs_moves(edges, a, 6, 5)
    after = bm.moved(a, moves)
    assert after.select("b").distinct().count() == 6
    assert all(r.de < 0 for r in moves.collect())
    loose = mcmc.gibbs_moves(edges, a, 6, 5, greedy=False)
    assert {r.v for r in moves.collect()} <= {r.v for r in proposal.propose_moves(edges, a, bm.block_matrix(edges, a), 6, 5).collect()}
    assert loose.count() >= 0


def test_proposals_follow_their_distribution(spark, edges, labels):
    m = bm.block_matrix(edges, labels)
    p = {(r.v, r.b): r.p for r in proposal.proposal_distribution(edges, labels, m).collect()}
    for v in range(11):
        assert sum(x for (u, _), x in p.items() if u == v) == pytest.approx(1)
    drawn = rows(proposal.propose_moves(edges, labels, m, 3, 4), "v", "b_to")
    assert len(drawn) == 11 and all(p.get(x, 0) > 0 for x in drawn)
    merges = rows(proposal.propose_merges(m, labels.select("b").distinct(), 3, 5, 4), "block", "into")
    assert all(a != b for a, b in merges) and {a for a, _ in merges} == {0, 1, 2}


def test_splits(spark, edges, labels):
    sides = split.random_sides(labels, 3, 9)
    best = split.best_splits(split.split_scores(edges, sides))
    after = split.apply_splits(labels, sides, best, 3, 2)
    assert after.select("b").distinct().count() == 3 + min(2, best.count())
    grown = split.snowball_sides(edges, labels, split.seeds_by_degree(edges, labels))
    assert rows(grown, "v") == [(v,) for v in range(11)]


def test_split_score_is_the_difference_of_lengths(spark, edges):
    whole = spark.createDataFrame([(v, 0) for v in range(11)], "v long, b long")
    sides = spark.createDataFrame([(0, 0, v, int(v > 4)) for v in range(11)], "trial long, b long, v long, side long")
    two = spark.createDataFrame([(v, int(v > 4)) for v in range(11)], "v long, b long")
    length = lambda a: description.mdl(bm.block_matrix(edges, a), bm.blocks(bm.block_matrix(edges, a), a)).first().mdl
    assert split.split_scores(edges, sides).first().de == pytest.approx(length(two) - length(whole), abs=1e-8)


def test_concatenated_and_two_hop(spark, edges, labels):
    parts = spark.createDataFrame([(0, 1, 0), (0, 2, 1), (1, 3, 0), (1, 4, 2)], "part long, v long, b long")
    assert rows(combine.concatenated(parts), "v", "b") == [(1, 0), (2, 1), (3, 2), (4, 4)]
    m = bm.block_matrix(edges, labels)
    owned = spark.createDataFrame([(0,)], "b long")
    assert rows(combine.two_hop(m, owned), "b") == [(0,), (1,), (2,)]
    assert rows(combine.radius_matrix(m, owned), "r", "c", "w") == [(0, 0, 7)]


def test_consecutive_matches_a_window(spark):
    rng = random.Random(4)
    data = [(g, rng.randrange(50), k, rng.randrange(6)) for k, g in enumerate(rng.choices("aab", k=300))]
    events = spark.createDataFrame(data, "g string, ts long, id long, u long").repartition(5)
    want = []
    for g in "ab":
        ordered = [u for _, _, _, u in sorted(x for x in data if x[0] == g)]
        want += list(zip(ordered, ordered[1:], strict=False))
    assert rows(graph.consecutive(events, "g", ["ts", "id"], "u"), "src", "dst") == sorted(want)


def test_nonparametric_changes(spark, edges, labels):
    m = bm.block_matrix(edges, labels)
    table = bm.blocks(m, labels)
    merged = dict(((r.block, r.into), r.de) for r in description.merge_delta(m, table, merge.all_pairs(labels)).collect())
    assert merged[0, 1] == pytest.approx(-4.273180636, abs=1e-7)
    kernel = Model([(a, b, 1) for a, b in TOY], 11, LABELS, nonparametric=True)
    before = kernel.mdl()
    assert before == pytest.approx(71.29003084, abs=1e-7)
    for (b, into), de in merged.items():
        other = Model([(x, y, 1) for x, y in TOY], 11, [into if x == b else x for x in LABELS], nonparametric=True)
        assert other.mdl() - before == pytest.approx(de, abs=1e-8)
    moves = spark.createDataFrame([(v, (LABELS[v] + 1) % 3) for v in range(11)], "v long, b_to long")
    for r in description.move_delta(edges, labels, m, table, moves).collect():
        cells = kernel.move_cells(r.v, r.b_to)
        assert r.de == pytest.approx(kernel.move_delta(r.v, r.b_to, cells), abs=1e-8)
        kernel.move(r.v, r.b_to, cells)
        assert kernel.mdl() - before == pytest.approx(r.de, abs=1e-8)
        kernel.move(r.v, r.b_from, kernel.move_cells(r.v, r.b_from))


def test_a_move_that_empties_a_block(spark, edges):
    alone = [0] * 10 + [1]
    a = spark.createDataFrame(list(enumerate(alone)), "v long, b long")
    m = bm.block_matrix(edges, a)
    move = spark.createDataFrame([(10, 0)], "v long, b_to long")
    de = description.move_delta(edges, a, m, bm.blocks(m, a), move).first().de
    one, two = (Model([(x, y, 1) for x, y in TOY], 11, x, nonparametric=True).mdl() for x in ([0] * 11, alone))
    assert de == pytest.approx(one - two, abs=1e-8)


def test_distribution_and_snowball(edges, labels):
    table = bm.blocks(bm.block_matrix(edges, labels), labels)
    assert rows(combine.distributed_blocks(table, 2), "b", "part") == [(0, 0), (1, 1), (2, 0)]
    assert rows(combine.distributed_blocks(table, 2, "degree"), "b", "part") == [(0, 0), (1, 1), (2, 1)]
    parts = [p for _, p in rows(combine.distributed_vertices(edges, labels, table, 2), "v", "part")]
    assert sorted(parts) == [0] * 5 + [1] * 6 or sorted(parts) == [0] * 6 + [1] * 5
    with pytest.raises(ValueError):
        combine.distributed_blocks(table, 2, "other")
    assert sampling.degree_product_snowball(edges, 6, sampling.max_degree(edges, 1)).count() == 6


def test_truth_scores(spark, edges, labels):
    truth = labels.withColumnRenamed("b", "t")
    one = evaluate.scores(edges, labels, truth, 11).first()
    assert (one.f1, one.nmi) == pytest.approx((1, 1)) and one.true_mdl == pytest.approx(92.58797747, abs=1e-7)
