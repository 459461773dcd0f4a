"""Fingerprints and components against brute force."""

import random

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from graphloom.llm import simhash, similar
from graphloom.llm.components import connected_components
from graphloom.llm.queries import QUERIES


def brute_print(text):
    words = [w for w in __import__("re").split(r"[\x20\x09-\x0D]+", (text or "").translate({k: k + 32 for k in range(65, 91)})) if w]
    if not words:
        return 0
    shingles = [" ".join(words[k : k + 3]) for k in range(len(words) - 2)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(rows):
    """rows of (id, fingerprint); the least id that each row reaches."""
    group = list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            if (rows[a][1] ^ rows[b][1]).bit_count() <= 3 and group[a] != group[b]:
                old, new = group[a], group[b]
                group = [new if g == old else g for g in group]
    least = {}
    for (i, _), g in zip(rows, group, strict=True):
        least[g] = min([x for x in (i, least.get(g)) if x is not None], default=None)
    return [least[g] for g in group]


@pytest.mark.parametrize("text", [None, "", " \t\n", "one", "two words", "three little words", "Four Words ARE here", "a a a a a a", "é\x85ü \x1c x\x0by z", "W" * 5000])
def test_fingerprint(text):
    assert simhash.fingerprint((text or "").encode()) == brute_print(text)


def test_query_against_brute_force(spark, sf):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = {r.doc_id: r for r in QUERIES["op9_simhash"](spark, sf).collect()}
    rows = [(i, brute_print(t)) for i, t in sorted(docs.items())]
    for (i, fp), want in zip(rows, brute_components(rows), strict=True):
        assert (got[i].fingerprint, got[i].component_id) == (f"{fp:016x}", want)


def clustered(rng, size):
    """Fingerprints in dense clusters and chains, so that many links cross segments."""
    out = []
    while len(out) < size:
        fp = rng.getrandbits(64)
        for _ in range(rng.randrange(1, 12)):
            out.append(fp)
            for _ in range(rng.randrange(0, 5)):
                fp ^= 1 << rng.randrange(64)
    return out[:size]


@pytest.mark.parametrize("seed", range(4))
def test_components_of_planted_fingerprints(spark, seed):
    fps = clustered(random.Random(seed), 300)
    signed = np.array(fps, np.uint64).view(np.int64).tolist()
    frame = spark.createDataFrame([(x,) for x in signed], "fp long").repartition(4)
    roots = {r.node: r.root for r in connected_components(simhash.links(frame)).collect()}
    want = brute_components(list(enumerate(fps)))
    groups = {}
    for x, w in zip(signed, want, strict=True):
        groups.setdefault(roots.get(x, x), set()).add(w)
    assert all(len(g) == 1 for g in groups.values())
    assert len(groups) == len(set(want))


def test_a_key_may_span_batches():
    rng = random.Random(3)
    fps = [(7 << 32) | rng.getrandbits(5) for _ in range(200)]
    rows = sorted({(5, False, f) for f in fps[:50]} | {(9, True, f) for f in fps} | {(11, True, 1)}, key=lambda r: (r[0], not r[1]))
    batches = [pa.record_batch([pa.array([r[0] for r in part], pa.int64()), pa.array([r[2] for r in part], pa.int64()), pa.array([r[1] for r in part])], names=["key", "fp", "stored"]) for part in (rows[k : k + 3] for k in range(0, len(rows), 3))]
    found = [x for b in simhash._linker(3)(iter(batches)) for x in b.to_pylist()]
    nodes = {f for _, s, f in rows if s and f != 1}
    assert {x["a"] for x in found} | {x["b"] for x in found} == nodes and len({x["b"] for x in found}) == 1


def test_odd_rows(spark, odd_docs, no_docs):
    rows = simhash.near_duplicates(odd_docs).collect()
    assert len(rows) == odd_docs.count()
    assert [r.component_id for r in rows if r.doc_id in (1, 2)] == [1, 1, 1]
    zero = [r for r in rows if r.fingerprint == "0" * 16]
    assert {r.component_id for r in zero} == {3} and len(zero) == 4
    assert simhash.near_duplicates(no_docs).count() == 0


def test_one_document_of_each_group_stays(spark, odd_docs, no_docs):
    kept = simhash.drop_near_duplicates(odd_docs)
    assert kept.columns == odd_docs.columns and kept.dtypes == odd_docs.dtypes
    # 3, 4, 5 and the null text without an id have no words; of the rows without an id one has a text of its own
    ids = [r.doc_id for r in kept.collect()]
    assert sorted(i for i in ids if i is not None) == [1, 3, 6, 7, 8, 9, 10] and ids.count(None) == 1
    assert simhash.drop_near_duplicates(no_docs).count() == 0
    twice = odd_docs.where("doc_id = 2")
    assert simhash.drop_near_duplicates(twice).count() == 1


@pytest.mark.parametrize("drop", [simhash.drop_near_duplicates, similar.drop_similar])
def test_no_copy_returns_through_its_id(spark, drop):
    """Repeated, clashing and null ids, against brute force over rows."""
    rng = random.Random(11)
    texts = [" ".join(rng.choices([f"w{k}" for k in range(400)], k=30)) for _ in range(6)] + ["", None]
    rows = [(3, texts[0]), (5, texts[0]), (5, texts[1]), (None, texts[0]), (None, texts[2]), (None, texts[2]), (7, texts[1]), (7, texts[3]), (7, texts[3]), (None, texts[3]), (8, ""), (2, None), (9, texts[4]), (9, texts[5])]
    first = {}
    for i, t in rows:
        key = t or ""
        if key not in first or (i is not None and (first[key] is None or i < first[key])):
            first[key] = i
    kept = drop(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    assert sorted(((r.text or "", r.doc_id is None, r.doc_id) for r in kept), key=str) == sorted(((t, i is None, i) for t, i in first.items()), key=str)


def test_radius_is_checked(spark):
    with pytest.raises(ValueError):
        simhash.links(spark.range(3).select(F.col("id").alias("fp")), 4)
