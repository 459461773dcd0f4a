import random

import numpy as np
import pyarrow as pa
import pytest

import corpus_pipeline
from graphloom.llm import similar
from graphloom.llm.common import table

WORDS = [f"word{k}" for k in range(900)]


def _edited(words: list[str], changes: int) -> str:
    """``words`` with ``changes`` words replaced, far apart, so that each changes five shingles."""
    out = list(words)
    for k in range(changes):
        out[5 + k * 9] = f"edit{k}"
    return " ".join(out)


def test_stage_takes_edited_copies_at_a_similarity_of_0_8(spark):
    rng, rows = random.Random(5), []
    for k in range(20):
        words = rng.sample(WORDS, 200)
        # 196 shingles: 4 changes leave 176 of 216 (0.81), 5 leave 171 of 221 (0.77)
        rows += [(10 * k, " ".join(words)), (10 * k + 1, _edited(words, 4)), (10 * k + 2, _edited(words, 7))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = {r.doc_id for r in corpus_pipeline.simhash_dedup(spark, docs, "").collect()}
    text = dict(rows)
    for k in range(20):
        one, two, three = (similar.shingles(text[10 * k + j].encode()) for j in range(3))
        alike = lambda x, y: len(set(x.tolist()) & set(y.tolist())) / len(set(x.tolist()) | set(y.tolist()))
        assert alike(one, two) >= 0.8 > alike(one, three)
        assert 10 * k in kept and 10 * k + 1 not in kept
        assert (10 * k + 2 in kept) == (alike(two, three) < 0.8)


def test_components_match_brute_force_over_a_table(spark, sf):
    docs = table(spark, sf, "documents").limit(600)
    sets = {r.doc_id: frozenset(similar.shingles((r.text or "").encode()).tolist()) for r in docs.select("doc_id", "text").collect()}
    parent = {i: i for i in sets}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    ids = sorted(sets)
    for n, i in enumerate(ids):
        for j in ids[n + 1 :]:
            both = len(sets[i] & sets[j])
            if sets[i] == sets[j] or both and both >= 0.8 * (len(sets[i]) + len(sets[j]) - both):
                a, b = sorted((root(i), root(j)))
                parent[b] = a
    found = {r.doc_id: r.component_id for r in similar.similar_components(docs).collect()}
    assert found == {i: root(i) for i in ids}


@pytest.mark.parametrize("seed", range(3))
def test_a_forest_joins_what_the_pairs_join_at_every_distance(seed):
    rng = random.Random(seed)
    prints = [rng.getrandbits(64) for _ in range(8)]
    prints += [p ^ sum(1 << rng.randrange(64) for _ in range(rng.randrange(12))) & (1 << 64) - 1 for p in prints for _ in range(6)]

    def joined(pairs):
        group = list(range(len(prints)))
        for a, b in pairs:
            group = [group[a] if g == group[b] else g for g in group]
        return {frozenset(k for k, g in enumerate(group) if g == x) for x in set(group)}

    edges = similar.spanning_forest(np.array(prints, np.uint64)[:, None], 18)
    apart = lambda a, b: (prints[a] ^ prints[b]).bit_count()
    for d in range(19):
        every = [(a, b) for a in range(len(prints)) for b in range(a) if apart(a, b) <= d]
        assert joined([e for e in edges if apart(*e) <= d]) == joined(every)


def test_large_groups_are_joined_across_lots():
    rng = random.Random(2)
    base = rng.getrandbits(64)
    rows = sorted((5, base ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)), k) for k in range(300))
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    batches = [pa.record_batch([pa.array([r[0] for r in part], pa.int64()), pa.array([r[2] for r in part], pa.int64()), pa.array([signed(r[1]) for r in part], pa.int64())], names=["key", "node", "w0"]) for part in (rows[k : k + 70] for k in range(0, 300, 70))]
    pairs = [(x["a"], x["b"]) for b in similar._forests(18, 32)(iter(batches)) for x in b.to_pylist()]
    group = list(range(300))
    for a, b in pairs:
        group = [group[a] if g == group[b] else g for g in group]
    assert len(set(group)) == 1 and len(pairs) < 400


@pytest.mark.parametrize(("lot", "step"), [(4, 3), (16, 7), (512, 1000)])
def test_keys_are_joined_like_whole_groups(lot, step):
    rng = random.Random(lot)
    centres = [rng.getrandbits(64) for _ in range(3)]
    rows = sorted((key, rng.choice(centres) ^ sum(1 << b for b in rng.sample(range(64), rng.randrange(4))), 1000 * key + k) for key in range(40) for k in range(rng.choice([1, 1, 2, 5, 30])))
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    batches = [pa.record_batch([pa.array([r[0] for r in part], pa.int64()), pa.array([r[2] for r in part], pa.int64()), pa.array([signed(r[1]) for r in part], pa.int64())], names=["key", "node", "w0"]) for part in (rows[k : k + step] for k in range(0, len(rows), step))]
    pairs = [(x["a"], x["b"]) for b in similar._forests(18, lot)(iter(batches)) for x in b.to_pylist()]
    fp = {r[2]: r[1] for r in rows}
    assert all(a // 1000 == b // 1000 and (fp[a] ^ fp[b]).bit_count() <= 18 for a, b in pairs)
    if lot > 30:
        for key in range(40):
            own = [r[2] for r in rows if r[0] == key]
            group = {x: x for x in own}
            for a, b in pairs:
                if a in group:
                    group = {x: group[a] if g == group[b] else g for x, g in group.items()}
            for x in own:
                assert all((group[x] == group[y]) or (fp[x] ^ fp[y]).bit_count() > 18 for y in own)


@pytest.mark.parametrize(("lot", "step"), [(4, 3), (8, 1000)])
def test_lots_of_a_key_lose_no_near_rows(lot, step):
    rng = random.Random(lot)
    centres = [rng.getrandbits(64) for _ in range(3)]
    rows = sorted({(key, rng.choice(centres) ^ sum(1 << b for b in rng.sample(range(64), rng.randrange(9)))): 1000 * key + k for key in range(10) for k in range(rng.choice([2, 20, 60]))}.items())
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    batches = [pa.record_batch([pa.array([r[0][0] for r in part], pa.int64()), pa.array([r[1] for r in part], pa.int64()), pa.array([signed(r[0][1]) for r in part], pa.int64())], names=["key", "node", "w0"]) for part in (rows[k : k + step] for k in range(0, len(rows), step))]
    pairs = [(x["a"], x["b"]) for b in similar._forests(12, lot)(iter(batches)) for x in b.to_pylist()]
    group = {r[1]: r[1] for r in rows}
    for a, b in pairs:
        group = {x: group[a] if g == group[b] else g for x, g in group.items()}
    near = [(x, y) for (k, p), x in rows for (j, q), y in rows if k == j and x < y and (p ^ q).bit_count() <= 12]
    assert near and all(group[x] == group[y] for x, y in near)
    assert len(pairs) < len(rows)


def _joined(nodes, pairs):
    """The least node of each node's component."""
    group = {x: x for x in nodes}
    for a, b in pairs:
        least = min(group[a], group[b])
        group = {x: least if g in (group[a], group[b]) else g for x, g in group.items()}
    return group


def _alike(sets):
    """All pairs of ``sets`` at 0.8 or more."""
    ids = sorted(sets)
    return [(i, j) for n, i in enumerate(ids) for j in ids[n + 1 :] if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])]


def _variants(seed, groups, each):
    """Texts of ``groups`` of the same 120 words; two of a group differ in 0 to 6 words, so many are near 0.8 on either side."""
    rng, rows = random.Random(seed), []
    for g in range(groups):
        base = rng.sample(WORDS, 120)
        for k in range(each):
            words = list(base)
            for at in rng.sample(range(0, 120, 12), rng.randrange(1, 4)):
                words[at] = f"v{g}x{k}x{at}"
            rows.append((1000 * g + k, " ".join(words)))
    return rows


def test_pairs_that_a_forest_passes_over_are_found(spark):
    rows = _variants(3, 8, 25)
    sets = {i: frozenset(similar.shingles(t.encode()).tolist()) for i, t in rows}
    found = similar.similar_components(spark.createDataFrame(rows, "doc_id long, text string"))
    assert {r.doc_id: r.component_id for r in found.collect()} == _joined(sets, _alike(sets))


def test_short_texts_are_found_whatever_their_fingerprints(spark):
    rng, rows = random.Random(4), []
    for k in range(120):
        words = rng.sample(WORDS, 8 + k % 4)
        # 4 to 7 shingles, and one more
        rows += [(10 * k, " ".join(words)), (10 * k + 1, " ".join([*words, "more"])), (10 * k + 2, " ".join(["before", "it", *words]))]
    sets = {i: frozenset(similar.shingles(t.encode()).tolist()) for i, t in rows}
    every = _alike(sets)
    assert len(every) == 120
    found = similar.similar_components(spark.createDataFrame(rows, "doc_id long, text string"))
    assert {r.doc_id: r.component_id for r in found.collect()} == _joined(sets, every)


@pytest.mark.parametrize(("tile_sets", "tile_hashes"), [(4, 1 << 18), (512, 1000), (512, 1 << 18)])
def test_tiles_join_what_is_left_apart(spark, tile_sets, tile_hashes):
    rows = _variants(7, 3, 30)
    arrays = {i: similar.shingles(t.encode()) for i, t in rows}
    sets = {i: frozenset(x.tolist()) for i, x in arrays.items()}
    every = _alike(sets)
    root = _joined(sets, every[::3])
    members = spark.createDataFrame([(i, len(sets[i]), i // 1000, root[i]) for i in sets], "node long, n long, clump long, root long")
    whole = spark.createDataFrame([(i, bytearray(x.tobytes())) for i, x in arrays.items()], "node long, hashes binary")
    pairs = [(r.a, r.b) for r in similar.clump_links(members, whole, 0.8, tile_sets, tile_hashes).collect()]
    assert set(pairs) <= {*every, *[(b, a) for a, b in every]}
    assert _joined(sets, [*root.items(), *pairs]) == _joined(sets, every) != root


def test_wide_prints_are_simhashes_word_by_word():
    found = similar.shingles(b" ".join(b"w%d" % (k * k % 97) for k in range(60)))
    bits = similar.wide_print(found)
    want = [2 * sum(int(h) >> k & 1 for h in found) > len(found) for k in range(64)]
    assert bits[:64].tolist() == want and len(bits) == 256 and not similar.wide_print(found[:0]).any()
    assert 60 < int((bits[64:] != np.tile(bits[:64], 3)).sum()) < 132


def test_odd_documents(spark, odd_docs, no_docs):
    kept = similar.drop_similar(odd_docs)
    assert kept.columns == odd_docs.columns
    assert sorted(r.doc_id for r in kept.collect() if r.doc_id is not None)[0] == 1
    assert similar.drop_similar(no_docs).count() == 0
