"""Fitting a blockmodel: configuration and the driver loops.

Graphs of at most ``local_edges`` distinct edges are fitted by the sequential
kernel on the driver, after a count of the edges.  Larger ones run every phase
as plans over the edges, with the same options: the driver keeps only the
search's three points and the stopping history, and each step's labels are
written to the shared checkpoint folder.  What the kernel moves one by one, the
plans move in ``mh_batches`` batches with a renewed model between them, and
merges come in rounds with renewed scores.
"""

from __future__ import annotations

import math
import random
import time
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.operators import blockmodel as bm
from graphloom.operators import combine, description, entropy, graph, mcmc, merge, sampling, split
from graphloom.operators.common import cut
from graphloom.operators.proposal import propose_merges
from graphloom.plans.kernel import Model
from graphloom.plans.search import MergeSearch, Point, SplitSearch


@dataclass(frozen=True)
class Config:
    """Options of a fit; see the README for each."""

    algorithm: str = "hybrid_mcmc"  # async_gibbs, metropolis_hastings, hybrid_mcmc
    approximate_merges: bool = False
    async_iterations: int | None = None
    batches: int = 1
    detach: bool = False
    greedy: bool = True
    mh_fraction: float = 0.075  # the share of vertices, of largest degree, that hybrid_mcmc moves one by one
    mix: bool = False
    mh_batches: int = 2  # in which plans move the vertices that the kernel moves one by one
    objective: str = "parametric"  # or nonparametric, which isn't greedy
    dedup: bool = False
    ordered: bool = False
    sample_fraction: float = 1.0
    sampler: str = "random"  # max_degree, random, expansion_snowball, degree_product, degree_product_snowball
    splitter: str = "random"  # random, snowball, single_snowball, connectivity_snowball
    split_init: str = "high_degree"  # seeds of the snowballs: random, degree_weighted, high_degree
    num_subgraphs: int = 1
    subgraph_partition: str = "round_robin"  # or random, snowball
    directed: bool = True
    tag: str = "default tag"
    proposals: int = 10
    sweeps: int = 100
    seed: int = 1
    local_edges: int = 500_000
    local_cells: int = 500_000
    trials: int = 10

    def __post_init__(self) -> None:
        if self.algorithm not in ("async_gibbs", "metropolis_hastings", "hybrid_mcmc"):
            raise ValueError(f"no algorithm {self.algorithm!r}")
        if self.objective not in ("parametric", "nonparametric"):
            raise ValueError(f"no objective {self.objective!r}")
        if not 0 < self.sample_fraction <= 1:
            raise ValueError("sample_fraction is over 0 and at most 1")
        if self.splitter not in ("random", "snowball", "single_snowball", "connectivity_snowball"):
            raise ValueError(f"no splitter {self.splitter!r}")
        if self.split_init not in ("random", "degree_weighted", "high_degree"):
            raise ValueError(f"no seeds {self.split_init!r}")
        if self.subgraph_partition not in ("round_robin", "random", "snowball"):
            raise ValueError(f"no subgraph partition {self.subgraph_partition!r}")
        if self.mh_batches < 1:
            raise ValueError("mh_batches is at least 1")
        if self.num_subgraphs < 1:
            raise ValueError("num_subgraphs is at least 1")


@dataclass
class Fit:
    assignment: DataFrame  # v, b
    num_blocks: int
    mdl: float
    profile: list[dict]


def prepared(edges: DataFrame, config: Config) -> DataFrame:
    """The edges as they are fitted: symmetrised, deduplicated, parallel ones together."""
    if not config.directed:
        edges = graph.symmetrised(edges)
    return cut(graph.weighted(graph.deduplicated(edges) if config.dedup else edges))


# the sequential kernel


def _local_model(edges: DataFrame, vertices: DataFrame, config: Config) -> tuple[Model, list[int]]:
    ids = sorted(r.v for r in vertices.collect())
    place = {v: k for k, v in enumerate(ids)}
    rows = sorted((place[r.src], place[r.dst], r.w) for r in edges.collect())
    return Model(rows, len(ids), list(range(len(ids))), config.objective == "nonparametric"), ids


def _vertex_phase(model: Model, config: Config, rng: random.Random, initial: float, bracketed: bool, iteration: int = 0) -> tuple[int, int]:
    algorithm = config.algorithm
    if algorithm == "async_gibbs" and config.async_iterations is not None and iteration >= config.async_iterations:
        algorithm = "metropolis_hastings"
    greedy = config.greedy and config.objective == "parametric"
    order = sorted(range(model.vertices), key=lambda v: (-(model.k_out[v] + model.k_in[v]), v))
    high = {"metropolis_hastings": len(order), "async_gibbs": 0}.get(algorithm, int(-(-len(order) * config.mh_fraction // 1)))
    one_by_one, at_once = order[:high], order[high:]
    changes: list[float] = []
    moves = 0
    before = model.mdl()
    for _ in range(config.sweeps):
        if not config.ordered:
            rng.shuffle(one_by_one)
            rng.shuffle(at_once)
        moves += model.sweep(one_by_one, rng, greedy) + (model.gibbs(at_once, rng, greedy, config.batches) if at_once else 0)
        after = model.mdl()
        changes.append(after - before)
        before = after
        if mcmc.early_stop(changes, initial, bracketed):
            break
    return len(changes), moves


def fit_local(edges: DataFrame, vertices: DataFrame, config: Config, stop_at_bracket: bool = False) -> Fit:
    """The bottom-up search by the kernel."""
    model, ids = _local_model(edges, vertices, config)
    rng = random.Random(config.seed)
    initial = model.mdl()
    search, profile = MergeSearch(), []
    # one block for each vertex is a local optimum of the nonparametric length, so there it is only the start
    point = Point(model.blocks, math.inf if model.nonparametric else initial, list(model.labels))
    iteration = 0
    while True:
        step = search.next(point)
        if step.done or (stop_at_bracket and search.bracketed):
            best = search.points[0] if stop_at_bracket and search.points[0] else search.points[1]
            break
        model.rebuild(step.start.model)
        began = time.perf_counter()
        model.shrink(max(1, step.target), rng, config.proposals)
        merged = time.perf_counter()
        sweeps, moves = _vertex_phase(model, config, rng, initial, search.bracketed, iteration)
        iteration += 1
        point = Point(model.blocks, model.mdl(), list(model.labels))
        profile.append({"iteration": iteration, "num_blocks": point.blocks, "mdl": point.mdl, "normalized_mdl_v1": point.mdl / (model.null_mdl() or 1.0), "block_merge_time": merged - began, "mcmc_time": time.perf_counter() - merged, "mcmc_iterations": sweeps, "mcmc_moves": moves})
    labels = edges.sparkSession.createDataFrame(list(zip(ids, best.model, strict=True)), "v long, b long")
    return Fit(labels, best.blocks, best.mdl, profile)


# plans


def length_of(matrix: DataFrame, vertices: int, num_blocks: int, labels: DataFrame | None = None) -> float:
    """The description length; with ``labels`` the nonparametric one."""
    one = entropy.mdl(matrix, vertices, num_blocks) if labels is None else description.mdl(matrix, bm.blocks(matrix, labels))
    return float(one.first().mdl)


def _length(matrix: DataFrame, labels: DataFrame, vertices: int, num_blocks: int, config: Config) -> float:
    return length_of(matrix, vertices, num_blocks, labels if config.objective == "nonparametric" else None)


def merge_phase(edges: DataFrame, labels: DataFrame, num_blocks: int, target: int, config: Config, seed: int) -> tuple[DataFrame, int]:
    """Merge until at most ``target`` blocks are left.

    A block matrix of at most ``local_cells`` cells is merged by the kernel on
    the parametric length, each merge scored anew when its turn comes.  A
    larger one, or by the nonparametric length, is merged by plans in rounds,
    each of half of the merges that are left, scored anew between them; with
    ``approximate_merges`` in one round.
    """
    nonparametric = config.objective == "nonparametric"
    while num_blocks > target:
        matrix = cut(bm.block_matrix(edges, labels))
        if not nonparametric and not config.approximate_merges and num_blocks <= config.local_cells and matrix.limit(config.local_cells + 1).count() <= config.local_cells:
            cells = sorted((r.r, r.c, r.w) for r in matrix.collect())
            blocks = Model(cells, num_blocks, list(range(num_blocks)))
            blocks.shrink(target, random.Random(seed), config.proposals)
            into = labels.sparkSession.createDataFrame(list(enumerate(blocks.labels)), "b long, into long")
            return cut(labels.join(F.broadcast(into), "b").select("v", F.col("into").alias("b"))), blocks.blocks
        ids = labels.select("b").distinct()
        candidates = propose_merges(matrix, ids, num_blocks, config.proposals, seed)
        wanted = num_blocks - target
        wanted = wanted if config.approximate_merges else -(-wanted // 2)
        applied = cut(merge.merge_step(matrix, candidates, wanted, cut(bm.blocks(matrix, labels)) if nonparametric else None))
        labels = cut(bm.compact(bm.merged(labels, applied)))
        now = num_blocks - applied.count()
        if now == num_blocks:
            break
        num_blocks, seed = now, seed + 17
    return labels, num_blocks


def vertex_phase(edges: DataFrame, labels: DataFrame, vertices: int, num_blocks: int, config: Config, seed: int, initial: float, bracketed: bool, iteration: int = 0) -> tuple[DataFrame, float, int, int]:
    """Sweeps until the description length stalls: labels, length, sweeps, moves.

    The share of vertices of largest degree that the algorithm moves one by one
    is moved in ``mh_batches`` batches, the others in ``batches``; each batch is
    judged against the model that the last one left.
    """
    algorithm = config.algorithm
    if algorithm == "async_gibbs" and config.async_iterations is not None and iteration >= config.async_iterations:
        algorithm = "metropolis_hastings"
    share = {"metropolis_hastings": 1.0, "async_gibbs": 0.0}.get(algorithm, config.mh_fraction)
    nonparametric = config.objective == "nonparametric"
    greedy = config.greedy and not nonparametric
    everyone = [(None, k, config.mh_batches if share == 1 else config.batches) for k in range(config.mh_batches if share == 1 else config.batches)]
    if 0 < share < 1:
        high = cut(graph.largest(cut(graph.degrees(edges).select("v", "k")), "k", "v", math.ceil(vertices * share)).select("v"))
        low = cut(labels.select("v").join(high, "v", "left_anti"))
        everyone = [(high, k, config.mh_batches) for k in range(config.mh_batches)] + [(low, k, config.batches) for k in range(config.batches)]
    changes: list[float] = []
    total = 0
    matrix = cut(bm.block_matrix(edges, labels))
    before = _length(matrix, labels, vertices, num_blocks, config)
    for sweep in range(config.sweeps):
        moved = 0
        for place, (among, k, number) in enumerate(everyone):
            moves = cut(mcmc.gibbs_moves(edges, labels, num_blocks, seed + 31 * sweep + place, greedy, (k, number), matrix, among, nonparametric))
            if count := moves.count():
                labels = cut(bm.moved(labels, moves))
                matrix = cut(bm.block_matrix(edges, labels))
            moved += count
        after = _length(matrix, labels, vertices, num_blocks, config) if moved else before
        total += moved
        changes.append(after - before)
        before = after
        if mcmc.early_stop(changes, initial, bracketed):
            break
    return labels, before, len(changes), total


def fit_plans(edges: DataFrame, vertices: DataFrame, config: Config, stop_at_bracket: bool = False) -> Fit:
    """The bottom-up search with every phase as plans."""
    mapping = cut(sampling.local_ids(vertices))
    local = cut(graph.relabelled(edges, mapping))
    number = mapping.count()
    labels = cut(mapping.select(F.col("local_v").alias("v"), F.col("local_v").alias("b")))
    initial = _length(local.toDF("r", "c", "w"), labels, number, number, config)
    search, profile = MergeSearch(), []
    # one block for each vertex is a local optimum of the nonparametric length, so there it is only the start
    point = Point(number, math.inf if config.objective == "nonparametric" else initial, labels)
    iteration = 0
    while True:
        step = search.next(point)
        if step.done or (stop_at_bracket and search.bracketed):
            best = search.points[0] if stop_at_bracket and search.points[0] else search.points[1]
            break
        seed = config.seed + 1009 * iteration
        began = time.perf_counter()
        labels, blocks = merge_phase(local, step.start.model, step.start.blocks, max(1, step.target), config, seed)
        merged = time.perf_counter()
        labels, mdl, sweeps, moves = vertex_phase(local, labels, number, blocks, config, seed, initial, search.bracketed, iteration)
        iteration += 1
        point = Point(blocks, mdl, labels)
        profile.append({"iteration": iteration, "num_blocks": blocks, "mdl": point.mdl, "block_merge_time": merged - began, "mcmc_time": time.perf_counter() - merged, "mcmc_iterations": sweeps, "mcmc_moves": moves})
    named = combine.global_labels(best.model.withColumnRenamed("v", "local_v"), mapping)
    return Fit(named, best.blocks, best.mdl, profile)


def search_blocks(edges: DataFrame, vertices: DataFrame, config: Config, stop_at_bracket: bool = False) -> Fit:
    """Bottom-up, by the kernel if the graph is within ``local_edges``, else by plans."""
    small = edges.limit(config.local_edges + 1).count() <= config.local_edges and vertices.limit(config.local_edges + 1).count() <= config.local_edges
    return (fit_local if small else fit_plans)(edges, vertices, config, stop_at_bracket)


def _sides(edges: DataFrame, labels: DataFrame, config: Config, seed: int) -> DataFrame:
    """``trial, b, v, side``: proposals of two halves of each block, ``trials`` of them where they are drawn."""
    if config.splitter == "random":
        return split.random_sides(labels, config.trials, seed)
    grow = {"snowball": split.plain_snowball_sides, "single_snowball": split.single_snowball_sides, "connectivity_snowball": split.snowball_sides}[config.splitter]
    every = None
    for trial in range(1 if config.split_init == "high_degree" else config.trials):
        if config.split_init == "high_degree":
            seeds = split.seeds_by_degree(edges, labels)
        elif config.split_init == "random":
            seeds = split.seeds_random(labels, seed + trial)
        else:
            seeds = split.seeds_degree_weighted(edges, labels, seed + trial)
        one = grow(edges, labels, cut(seeds)).select(F.lit(trial).cast("long").alias("trial"), "b", "v", "side")
        every = one if every is None else every.unionByName(one)
    return every


def fit_top_down(edges: DataFrame, vertices: DataFrame, config: Config) -> Fit:
    """The divisive search: split, sweep, bracket.  All phases are plans."""
    labels = cut(vertices.select("v", F.lit(0).cast("long").alias("b")))
    number = vertices.count()
    initial = _length(bm.block_matrix(edges, labels), labels, number, 1, config)
    search, profile = SplitSearch(number), []
    point = Point(1, initial, labels)
    iteration = 0
    while True:
        step = search.next(point)
        if step.done or (config.mix and search.bracketed):
            break
        seed = config.seed + 1009 * iteration
        labels, blocks = step.start.model, step.start.blocks
        sides = cut(_sides(edges, labels, config, seed))
        best = cut(split.best_splits(split.split_scores(edges, sides)))
        labels = cut(bm.compact(split.apply_splits(labels, sides, best, blocks, step.target - blocks)))
        now = labels.agg(F.max("b")).first()[0] + 1
        if now == blocks:
            break
        labels, mdl, sweeps, moves = vertex_phase(edges, labels, number, now, config, seed, initial, search.bracketed, iteration)
        iteration += 1
        point = Point(now, mdl, labels)
        profile.append({"iteration": iteration, "num_blocks": now, "mdl": point.mdl, "mcmc_iterations": sweeps, "mcmc_moves": moves})
    best = search.points[1]
    if config.mix and search.bracketed:  # go on bottom-up from the bracket's model with most blocks
        merging = MergeSearch()
        for seen in search.points:
            if seen:
                merging.update(seen)
        point = max((p for p in search.points if p), key=lambda p: p.blocks)
        while not (step := merging.next(point)).done:
            iteration += 1
            seed = config.seed + 1009 * iteration
            labels, blocks = merge_phase(edges, step.start.model, step.start.blocks, max(1, step.target), config, seed)
            labels, mdl, sweeps, moves = vertex_phase(edges, labels, number, blocks, config, seed, initial, merging.bracketed)
            point = Point(blocks, mdl, labels)
            profile.append({"iteration": iteration, "num_blocks": blocks, "mdl": mdl, "mcmc_iterations": sweeps, "mcmc_moves": moves})
        best = merging.points[1]
    return Fit(best.model, best.blocks, best.mdl, profile)


def fit(edges: DataFrame, config: Config = Config(), vertices: DataFrame | None = None) -> Fit:
    """Fit the whole graph: prepare, detach and sample as configured, search, extend and reattach."""
    whole = prepared(edges, config)
    every = cut(vertices.select("v").distinct() if vertices is not None else graph.endpoints(whole).select("v").distinct())
    kept = every
    if config.detach:
        kept = cut(kept.join(sampling.detached(whole), "v", "left_semi"))
    inner = whole if kept is every else cut(graph.induced(whole, kept))
    if config.sample_fraction < 1:
        wanted = max(1, int(kept.count() * config.sample_fraction))
        if config.sampler == "max_degree":
            chosen = sampling.max_degree(inner, wanted)
        elif config.sampler == "degree_product":
            chosen = sampling.degree_product(inner, wanted)
        elif config.sampler == "expansion_snowball":
            chosen = sampling.expansion(inner, wanted, sampling.max_degree(inner, 1))
        elif config.sampler == "degree_product_snowball":
            chosen = sampling.degree_product_snowball(inner, wanted, sampling.max_degree(inner, 1))
        else:
            chosen = sampling.hash_random(kept, wanted, config.seed)
        chosen = cut(chosen)
        found = search_blocks(cut(graph.induced(inner, chosen)), chosen, config)
        labels = cut(sampling.extend(inner, kept, found.assignment, found.num_blocks, config.seed, rounds=None))
    else:
        found = search_blocks(inner, kept, config)
        labels = found.assignment
    if config.detach:
        labels = cut(sampling.reattach(whole, every, labels, found.num_blocks, config.seed))
    if labels is not found.assignment:
        found = replace(found, assignment=labels, mdl=_length(bm.block_matrix(whole, labels), labels, every.count(), found.num_blocks, config))
    return found


def divide_and_conquer(edges: DataFrame, parts: int, config: Config = Config()) -> Fit:
    """Fit ``parts`` subgraphs, bring their labels together, merge across parts and refine on the whole graph."""
    if parts < 1:
        raise ValueError("parts is at least 1")
    whole = prepared(edges, config)
    every = cut(graph.endpoints(whole).select("v").distinct())
    if config.subgraph_partition == "snowball":
        cover = cut(sampling.snowballs(whole, parts))
    elif config.subgraph_partition == "random":
        cover = cut(sampling.random_parts(every, parts, config.seed))
    else:
        cover = cut(every.select("v", F.pmod(F.col("v"), F.lit(parts)).cast("long").alias("part")))
    labelled = None
    for part in range(parts):
        own = cut(cover.where(F.col("part") == part).select("v"))
        found = search_blocks(cut(graph.induced(whole, own)), own, config, stop_at_bracket=True)
        named = found.assignment.select(F.lit(part).cast("long").alias("part"), "v", "b")
        labelled = named if labelled is None else labelled.unionByName(named)
    labels = cut(bm.compact(combine.concatenated(cut(labelled))))
    number, blocks = every.count(), labels.agg(F.max("b")).first()[0] + 1
    search = MergeSearch()
    initial = _length(bm.block_matrix(whole, labels), labels, number, blocks, config)
    labels, mdl, _, _ = vertex_phase(whole, labels, number, blocks, config, config.seed, initial, False)
    point, iteration = Point(blocks, mdl, labels), 0
    while not (step := search.next(point)).done:
        iteration += 1
        labels, blocks = merge_phase(whole, step.start.model, step.start.blocks, max(1, step.target), config, config.seed + iteration)
        labels, mdl, _, _ = vertex_phase(whole, labels, number, blocks, config, config.seed + iteration, initial, search.bracketed)
        point = Point(blocks, mdl, labels)
    best = search.points[1]
    return Fit(best.model, best.blocks, best.mdl, [])
