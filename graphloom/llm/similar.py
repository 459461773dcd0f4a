"""Near copies at a similarity of shingle sets, by SimHash and multi-index hashing.

A pair of sets with a Jaccard similarity of 0.8 differs in about 15 of 100
bits of its SimHashes, far beyond what two segments of 64 bits can cover.  So
the fingerprint is four words long and cut into ``TABLES`` segments of
``SEGMENT`` bits.  Every set is entered in each segment table under its segment
and under those that have one bit more set: half of the Hamming ball of radius
1.  Two sets whose segments differ in a bit always meet, in two bits half of
the times.  A pair at 0.8 meets in some table with a chance of 0.98, one at
0.85 of 0.997, one at 0.9 of 0.9998.

Within a key the complete fingerprints are compared.  A key's candidates are
the minimum spanning forest of the pairs at most ``REACH`` bits apart: it joins
the same sets at every distance, so it holds each set's nearest, and it grows
with the key's sets, not with their pairs.  Every candidate pair is held
against the whole sets, and only what has the similarity is a link.  Equal sets
are one node from the start.

A forest's edge may fail where another pair across the same gap would not.  So
the components of all candidates, here called clumps, are searched whole: all
sets of a clump that the links found so far leave apart are held against each
other, in tiles of two lots, and no pair that meets within ``REACH`` is lost.
Rows grow with a clump's sets times its lots.

Sets of few shingles give coarse fingerprints, which meet less often.  Two of
them at 0.8 differ by one shingle that one has and the other hasn't, so those
of at most ``FEW`` are also looked up by what is left without each shingle.

Style: Arrow batches for fingerprints, distances and checks; grouping, joining
and the components are DataFrame operations.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import cut, small_batches
from graphloom.llm.components import connected_components
from graphloom.llm.simhash import SEED, _Forest, first_row, keep_rows, keyed, winners

SHINGLE = 5
LEAST = 0.8
#: Segment tables, and bits of a segment.  Wider segments keep a key's sets few in a larger corpus, and need more tables.
TABLES, SEGMENT = 12, 20
#: Bits of 256 that a candidate pair may differ in: a pair at 0.8 differs in more with a chance of 0.001.
REACH = 58
#: Rows of a key up to which its forest is a minimum one; of a larger key that holds within such lots, in the order of their first words.
LOT = 512
#: Shingles of a set up to which its neighbours are looked up: two of 9 at 0.8 may differ in one shingle each.
FEW = 8
#: Sets and hashes of a lot of a clump; a task holds two lots.
TILE_SETS, TILE_HASHES = 512, 1 << 18

_WORDS = 4
_MIX = np.array([0x9E3779B97F4A7C15 * k & 0xFFFFFFFFFFFFFFFF for k in range(_WORDS)], np.uint64)
_LANE = np.arange(8 * _WORDS, dtype=np.int64) * 256
_BITS = ((np.arange(256)[:, None] >> np.arange(8)) & 1).astype(np.int64)
_PLACES = 1 << np.arange(SEGMENT, dtype=np.int64)
_SLAB = 4096


def shingles(data: bytes, shingle: int = SHINGLE) -> np.ndarray:
    """Distinct hashes of a text's shingles, sorted; a text of fewer words is one shingle, one without words has none."""
    words = data.lower().split()
    if not words:
        return np.empty(0, np.uint64)
    joined = b" ".join(words)
    if len(words) <= shingle:
        return np.array([xxhash.xxh64_intdigest(joined, SEED)], np.uint64)
    lengths = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts = (ends - lengths).tolist()
    digest = xxhash.xxh64_intdigest
    return np.unique(np.fromiter((digest(joined[a:b], SEED) for a, b in zip(starts, ends[shingle - 1 :].tolist(), strict=False)), dtype=np.uint64, count=len(words) - shingle + 1))


def wide_print(found: np.ndarray) -> np.ndarray:
    """The bits of a set's fingerprint, 64 for each word; the first word is the SimHash of the hashes as they are."""
    counts = np.zeros(8 * _WORDS * 256, np.int64)
    for at in range(0, len(found), _SLAB):
        mixed = found[at : at + _SLAB, None] + _MIX
        mixed[:, 1:] = (mixed[:, 1:] ^ mixed[:, 1:] >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
        mixed[:, 1:] = (mixed[:, 1:] ^ mixed[:, 1:] >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
        mixed[:, 1:] ^= mixed[:, 1:] >> np.uint64(31)
        lanes = mixed.astype("<u8").view(np.uint8)
        counts += np.bincount((lanes + _LANE).ravel(), minlength=len(counts))
    return (counts.reshape(-1, 256) @ _BITS).ravel() * 2 > len(found)


def _set_id(found: np.ndarray) -> int:
    return int(np.uint64(xxhash.xxh3_64_intdigest(found.tobytes(), SEED)).view(np.int64))


def _signatures(shingle: int):
    kinds = (pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.int64()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            *keys, texts = batch.columns
            rows = []
            for t in texts:
                found = shingles(t.as_buffer().to_pybytes() if t.is_valid else b"", shingle)
                bits = wide_print(found)
                words = np.packbits(bits, bitorder="little").view("<i8").tolist()
                fewer = [_set_id(np.delete(found, k)) for k in range(len(found))] if len(found) <= FEW else []
                rows.append((_set_id(found), len(found), words, (bits[: TABLES * SEGMENT].reshape(TABLES, SEGMENT) @ _PLACES).tolist(), fewer))
            columns = list(zip(*rows, strict=True)) if rows else [()] * 5
            yield pa.record_batch([*keys, *[pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]], names=["doc_id", "one", "two", "node", "n", "words", "segments", "fewer"])

    return run


def _sets(shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [shingles(t.as_buffer().to_pybytes() if t.is_valid else b"", shingle) for t in batch.column(0)]
            yield pa.record_batch([pa.array([_set_id(x) for x in found], pa.int64()), pa.array([x.tobytes() for x in found], pa.binary())], names=["node", "hashes"])

    return run


def _checked(least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("x"), batch.column("y"), strict=True):
                one, two = (np.frombuffer(v.as_buffer(), np.uint64) for v in (x, y))
                both = len(np.intersect1d(one, two, assume_unique=True))
                keep.append(both >= least * (len(one) + len(two) - both))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def _apart(some: np.ndarray, others: np.ndarray) -> np.ndarray:
    """In how many bits rows of words differ."""
    return np.bitwise_count(some ^ others).sum(axis=-1, dtype=np.int64)


def spanning_forest(prints: np.ndarray, reach: int) -> list[tuple[int, int]]:
    """Edges of a minimum spanning forest of the pairs of ``prints`` (rows of words) at most ``reach`` bits apart, by Prim's steps."""
    far = 64 * prints.shape[1] + 1
    best, came = _apart(prints, prints[0]), np.zeros(len(prints), np.int64)
    best[0], edges = far, []
    out = np.ones(len(prints), bool)
    out[0] = False
    for _ in range(len(prints) - 1):
        at = int(np.argmin(best))
        if best[at] <= reach:
            edges.append((int(came[at]), at))
        out[at], best[at] = False, far
        apart = _apart(prints, prints[at])
        nearer = out & (apart < best)
        best[nearer], came[nearer] = apart[nearer], at
    return edges


def key_forest(prints: np.ndarray, reach: int, lot: int) -> list[tuple[int, int]]:
    """Edges that join what the pairs of ``prints`` at most ``reach`` bits apart join: minimum forests within lots of rows, then what is missing between them.

    Between lots a row is compared with those that nothing has reached yet, so
    a group of near copies costs little more than its size.
    """
    if len(prints) <= lot:
        return spanning_forest(prints, reach)
    edges = [(at + i, at + j) for at in range(0, len(prints), lot) for i, j in spanning_forest(prints[at : at + lot], reach)]
    group = _Forest()
    for i, j in edges:
        group.join(i, j)
    rest, left = np.arange(len(prints)), prints
    while len(rest) > 1:
        frontier, rest, left = [int(rest[0])], rest[1:], left[1:]
        while frontier and len(rest):
            at = frontier.pop()
            near = _apart(left, prints[at]) <= reach
            for other in rest[near].tolist():
                frontier.append(other)
                if group.root(at) != group.root(other):
                    group.join(at, other)
                    edges.append((at, other))
            rest, left = rest[~near], left[~near]
    return edges


def _whole_runs(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[list[np.ndarray]]:
    """The columns of rows sorted by the first ``keys`` ones, cut between rows that differ in these."""
    rest: list[list[np.ndarray]] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
        last = int(np.argmax(np.all([c == c[-1] for c in columns[:keys]], axis=0)))
        if rest and (last or any(x[0] != y[0] for x, y in zip(rest[0][:keys], columns[:keys], strict=True))):
            yield [np.concatenate(x) for x in zip(*rest, [c[:last] for c in columns], strict=True)]
            rest = []
        elif last:
            yield [c[:last] for c in columns]
        rest.append([c[last:] for c in columns])
    if rest:
        yield [np.concatenate(x) for x in zip(*rest, strict=True)]


def _keys_with(keys: np.ndarray, wanted) -> Iterator[slice]:
    """Runs of equal keys in which ``wanted(rows, other rows)`` holds for some pair of rows."""
    starts = np.concatenate([[0], np.flatnonzero(np.diff(keys)) + 1])
    ends = np.append(starts[1:], len(keys))
    found = np.zeros(len(keys), bool)
    for ahead in range(1, len(keys)):
        same = np.flatnonzero(keys[:-ahead] == keys[ahead:])
        if not len(same):
            break
        found[same] |= wanted(same, same + ahead)
    for k in np.unique(np.searchsorted(starts, np.flatnonzero(found), side="right") - 1).tolist():
        yield slice(int(starts[k]), int(ends[k]))


class _Pairs:
    """Distinct pairs, given out in batches of a bounded size."""

    def __init__(self) -> None:
        self.held: dict[tuple[int, int], None] = {}

    def add(self, x: int, y: int) -> None:
        self.held[min(x, y), max(x, y)] = None

    def out(self, least: int = 100_000) -> Iterator[pa.RecordBatch]:
        if len(self.held) >= least:
            yield pa.record_batch([pa.array([p[i] for p in self.held], pa.int64()) for i in (0, 1)], names=["a", "b"])
            self.held.clear()


def _forests(reach: int, lot: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows ``(key, node, words...)`` come sorted by key and words; what one key holds is 40 bytes a row."""
        pairs = _Pairs()
        for keys, nodes, *words in _whole_runs(batches, 1):
            prints = np.stack(words, axis=1).view(np.uint64)
            starts = np.concatenate([[0], np.flatnonzero(np.diff(keys)) + 1])
            sizes = np.diff(np.append(starts, len(keys)))
            runs = [np.arange(starts[k], starts[k] + sizes[k]) for k in np.flatnonzero(sizes > lot)]
            few = np.flatnonzero(np.repeat(sizes <= lot, sizes))
            if len(few):
                some = prints[few]
                runs += [few[x] for x in _keys_with(keys[few], lambda i, j: _apart(some[i], some[j]) <= reach)]  # noqa: B023
            for own in runs:
                for i, j in key_forest(prints[own], reach, lot):
                    pairs.add(int(nodes[own[i]]), int(nodes[own[j]]))
            yield from pairs.out()
        yield from pairs.out(0)

    return run


def candidates(reps: DataFrame, reach: int = REACH, lot: int = LOT) -> DataFrame:
    """Distinct pairs ``(a, b)`` of ``reps(node, words, segments)`` in the spanning forests of the segment tables' keys."""
    bit = lambda i: F.call_function("shiftleft", F.lit(1).cast("long"), i)
    ball = lambda s: F.concat(F.array(s), F.transform(F.filter(F.sequence(F.lit(0), F.lit(SEGMENT - 1)), lambda i: F.getbit(s, i) == 0), lambda i: s.bitwiseOR(bit(i))))
    keys = F.flatten(F.transform("segments", lambda s, t: F.transform(ball(s), lambda x: x.bitwiseOR(F.call_function("shiftleft", t.cast("long"), F.lit(SEGMENT))))))
    names = [f"w{k}" for k in range(_WORDS)]
    rows = reps.select("node", *[F.get("words", F.lit(k)).alias(n) for k, n in enumerate(names)], F.explode(keys).alias("key")).select("key", "node", *names).repartition("key")
    return rows.sortWithinPartitions("key", *names).mapInArrow(_forests(reach, lot), "a long, b long").distinct()


def tile_links(sets: list[np.ndarray], roots: np.ndarray, left: np.ndarray, right: np.ndarray, least: float) -> Iterator[tuple[int, int]]:
    """Links between the ``left`` and the ``right`` ones of ``sets`` that join what ``roots`` doesn't: a forest with the components of all of them."""
    group = np.unique(roots, return_inverse=True)[1]
    sizes = np.array([len(sets[k]) for k in right])
    hashes = np.concatenate([sets[k] for k in right])
    order = np.argsort(hashes, kind="stable")
    hashes, owner = hashes[order], np.repeat(np.arange(len(right)), sizes)[order]
    for at in left.tolist():
        if not (group != group[at]).any():
            continue
        begin, end = np.searchsorted(hashes, sets[at], "left"), np.searchsorted(hashes, sets[at], "right")
        many = end - begin
        places = np.repeat(begin - np.cumsum(many) + many, many) + np.arange(many.sum())
        both = np.bincount(owner[places], minlength=len(right))
        linked = right[both >= least * (len(sets[at]) + sizes - both)]
        while len(linked := linked[group[linked] != group[at]]):
            other = int(linked[0])
            yield at, other
            group[group == group[other]] = group[at]


def _tiles(least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows ``(clump, one, two, lot, root, node, hashes)`` come sorted by clump and tile."""
        for columns in _whole_runs(batches, 3):
            differ = np.any([np.diff(c) != 0 for c in columns[:3]], axis=0)
            edges = []
            for own in np.split(np.arange(len(differ) + 1), np.flatnonzero(differ) + 1):
                one, two, lot, root, node = (c[own] for c in columns[1:6])
                sets = [np.frombuffer(columns[6][k], np.uint64) for k in own]
                left, right = np.flatnonzero(lot == one[0]), np.flatnonzero(lot == two[0])
                if len(left) and len(right):
                    edges += [(node[i], node[j]) for i, j in tile_links(sets, root, left, right, least)]
            yield pa.record_batch([pa.array([e[i] for e in edges], pa.int64()) for i in (0, 1)], names=["a", "b"])

    return run


def one_apart(reps: DataFrame, least: float = LEAST) -> DataFrame:
    """Distinct pairs ``(a, b)`` of ``reps(node, n, fewer)`` of at most ``FEW`` shingles, of which one is the other without a shingle."""
    less = reps.where((F.col("n") <= FEW) & (F.col("n") - 1 >= least * F.col("n"))).select(F.col("node").alias("more"), F.explode("fewer").alias("node"))
    pairs = less.join(reps.where(F.col("n") < FEW).select("node"), "node")
    return pairs.select(F.least("node", "more").alias("a"), F.greatest("node", "more").alias("b")).distinct()


def clump_links(members: DataFrame, whole: DataFrame, least: float = LEAST, tile_sets: int = TILE_SETS, tile_hashes: int = TILE_HASHES) -> DataFrame:
    """Links ``(a, b)`` that join ``members(node, n, clump, root)`` of one clump and several roots, by their ``whole(node, hashes)`` sets.

    All pairs of a clump that differ in their root are held against each other,
    in tiles of two lots; the lots of the clump's largest root aren't held
    against each other.  A clump of two is one pair, which was checked.
    """
    number = lambda m, n: F.greatest(F.ceil(m / F.lit(tile_sets)), F.ceil(n / F.lit(tile_hashes)))
    groups = members.groupBy("clump", "root").agg(F.count("*").alias("m"), F.sum("n").alias("n"))
    clumps = groups.groupBy("clump").agg(F.sum("m").alias("m"), F.sum("n").alias("n"), F.count("*").alias("roots"), F.max(F.struct("m", "n", "root")).alias("top")).where("roots > 1 AND m > 2")
    small = (F.col("m") <= tile_sets) & (F.col("n") <= tile_hashes)
    first = F.when(small, 0).otherwise(number(F.col("top.m"), F.col("top.n")))
    rest = F.when(small, 1).otherwise(F.greatest(F.lit(1), number(F.col("m") - F.col("top.m"), F.col("n") - F.col("top.n"))))
    plan = cut(clumps.select("clump", F.col("top.root").alias("top"), first.cast("int").alias("first"), rest.cast("int").alias("rest")))
    draw = lambda of: F.pmod(F.xxhash64(F.lit("lot"), "node"), of).cast("int")
    lot = F.when((F.col("root") == F.col("top")) & (F.col("first") > 0), draw(F.greatest("first", F.lit(1)))).otherwise(F.col("first") + draw(F.col("rest")))
    dealt = members.select("node", "clump", "root").join(plan, "clump").withColumn("lot", lot)
    # two lots of the largest root have nothing to join
    others = F.filter(F.sequence(F.lit(0), F.col("first") + F.col("rest") - 1), lambda j: (F.col("lot") >= F.col("first")) | (j >= F.col("first")))
    tiles = dealt.select("clump", "lot", "root", "node", F.explode(others).alias("other")).select("clump", F.least("lot", "other").alias("one"), F.greatest("lot", "other").alias("two"), "lot", "root", "node")
    rows = tiles.join(whole, "node").select("clump", "one", "two", "lot", "root", "node", "hashes").repartition("clump", "one", "two")
    return rows.sortWithinPartitions("clump", "one", "two").mapInArrow(_tiles(least), "a long, b long")


def links(docs: DataFrame, reps: DataFrame, text_col: str = "text", id_col: str = "doc_id", shingle: int = SHINGLE, least: float = LEAST) -> DataFrame:
    """Edges ``(a, b)`` whose components are those of all pairs within a clump of candidates with a similarity of at least ``least``.

    The candidates are checked first, sizes before sets; what they leave apart
    in a clump is held against each other by ``clump_links``.
    """
    found = cut(candidates(reps).union(one_apart(reps, least)).distinct())
    nodes = cut(found.select(F.col("a").alias("node")).union(found.select("b")).distinct().join(reps.select("node", "n", "first"), "node"))
    wanted = nodes.select(*[F.col(f"first.{c}").alias(f"_{c}") for c in ("doc_id", "one", "two")])
    same = F.col("doc_id").eqNullSafe(F.col("_doc_id")) & (F.col("one") == F.col("_one")) & (F.col("two") == F.col("_two"))
    # a merge join at every size, as what is needed grows with the input
    texts = keyed(docs, id_col, text_col).join(wanted.hint("merge"), same, "left_semi").select("text")
    whole = cut(texts.mapInArrow(_sets(shingle), "node long, hashes binary").groupBy("node").agg(F.first("hashes").alias("hashes")))
    side = lambda node: nodes.select(F.col("node").alias(node), F.col("n").alias(f"n_{node}"))
    pairs = cut(found.join(side("a"), "a").join(side("b"), "b").where(F.least("n_a", "n_b") >= least * F.greatest("n_a", "n_b")).select("a", "b"))
    sets = lambda node, value: whole.select(F.col("node").alias(node), F.col("hashes").alias(value))
    checked = cut(pairs.join(sets("a", "x"), "a").join(sets("b", "y"), "b").mapInArrow(_checked(least), "a long, b long"))
    clumps, roots = cut(connected_components(found).withColumnRenamed("root", "clump")), cut(connected_components(checked))
    members = cut(nodes.select("node", "n").join(clumps, "node").join(roots, "node", "left").select("node", "n", "clump", F.coalesce("root", "node").alias("root")))
    return cut(members.where("node <> root").select(F.col("node").alias("a"), F.col("root").alias("b")).union(clump_links(members, whole, least)))


def _nodes(docs: DataFrame, id_col: str, text_col: str, shingle: int, least: float) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The rows' fingerprints, the distinct sets with their least rows, and the sets' components."""
    small_batches(docs.sparkSession)
    prints = cut(keyed(docs, id_col, text_col).mapInArrow(_signatures(shingle), "doc_id long, one long, two long, node long, n long, words array<long>, segments array<long>, fewer array<long>"))
    reps = cut(prints.groupBy("node").agg(first_row().alias("first"), F.first("n").alias("n"), F.first("words").alias("words"), F.first("segments").alias("segments"), F.first("fewer").alias("fewer")))
    return prints, reps, connected_components(links(docs, reps, text_col, id_col, shingle, least))


def similar_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, least: float = LEAST) -> DataFrame:
    """``(doc_id, component_id)`` for every row of ``docs``; the smallest id of the component, null if it has none.

    Null, empty and wordless texts are one component.  Repeated rows and ids
    each give their row, an empty table gives none, and of long texts all
    shingles are read.  Other columns are not read.
    """
    prints, reps, members = _nodes(docs, id_col, text_col, shingle, least)
    ids = reps.select("node", F.col("first.doc_id").alias("rep"))
    lowest = cut(members.join(ids, "node").groupBy("root").agg(F.min("rep").alias("least")))
    linked = members.join(lowest, "root").select("node", "least")
    # written first, so that both sides of the last join are dealt anew and a set of many copies can be split
    classes = cut(ids.join(linked, "node", "left").select("node", F.coalesce("least", "rep").alias("component_id")))
    return prints.select("doc_id", "node").join(classes, "node").select("doc_id", "component_id")


def drop_similar(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, least: float = LEAST) -> DataFrame:
    """``docs`` with one row of each component of links: that with the smallest id, rows without an id last; all columns as they are.

    What null, empty, repeated and long rows are is said at ``similar_components``.
    """
    prints, reps, members = _nodes(docs, id_col, text_col, shingle, least)
    return keep_rows(docs, prints.select("doc_id", "one", "two"), winners(reps, members), id_col, text_col)
