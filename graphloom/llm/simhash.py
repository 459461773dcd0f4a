"""SimHash near-duplicates, linked by multi-index hashing.

A fingerprint of 64 bits is cut into two segments of 32.  Two fingerprints
that differ in at most 3 bits differ in at most one bit of one segment, so
each segment table is probed with the segment itself and the Hamming ball of
radius 1 around it.  A pair at distance 1 in a segment is met from either side;
only the side whose bit is 0 probes, which halves the ball.  All fingerprints
that meet under a table key are compared over their full 64 bits.

What leaves a key's group is a spanning forest of its verified links, not its
pairs: a group of k fingerprints gives at most k - 1 edges, and the components
are the same.  Equal fingerprints are one node from the start.

``similar`` has the same search for a similarity instead of a radius.

Style: Arrow batches.  Counting 64 bits over every shingle is numpy's work;
grouping, joining and the components are DataFrame operations.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import cut, small_batches, table
from graphloom.llm.components import connected_components

SEGMENT_BITS = 32
RADIUS = 3
SHINGLE = 3
SEED = 42

_LANE = np.arange(8, dtype=np.int64) * 256
_BITS = ((np.arange(256)[:, None] >> np.arange(8)) & 1).astype(np.int64)


def fingerprint(data: bytes, shingle: int = SHINGLE) -> int:
    """The SimHash of one text as an unsigned integer; 0 for a text without words."""
    words = data.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= shingle:
        hashes = np.array([xxhash.xxh64_intdigest(joined, SEED)], dtype=np.uint64)
    else:
        lengths = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
        ends = np.cumsum(lengths + 1) - 1
        starts = (ends - lengths).tolist()
        digest = xxhash.xxh64_intdigest
        hashes = np.fromiter((digest(joined[a:b], SEED) for a, b in zip(starts, ends[shingle - 1 :].tolist(), strict=False)), dtype=np.uint64, count=len(words) - shingle + 1)
    lanes = hashes.astype("<u8").view(np.uint8).reshape(-1, 8)
    counts = np.bincount((lanes + _LANE).ravel(), minlength=2048).reshape(8, 256) @ _BITS
    bits = counts.ravel() * 2 > len(hashes)
    return int.from_bytes(np.packbits(bits, bitorder="little").tobytes(), "little")


def _fingerprints(shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            *keys, texts = batch.columns
            prints = np.fromiter((fingerprint(t.as_buffer().to_pybytes() if t.is_valid else b"", shingle) for t in texts), dtype=np.uint64, count=len(texts))
            yield pa.record_batch([*keys, pa.array(prints.view(np.int64))], names=["doc_id", "one", "two", "fp"])

    return run


def keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``(doc_id, one, two, text)``: every row's id and text, and two hashes of the text that tell rows of one id apart."""
    text = F.col(text_col).cast("binary")
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("one"), F.xxhash64(F.lit(1), text).alias("two"), text.alias("text"))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """``(doc_id, one, two, fp bigint)`` of every row, with the hashes of ``keyed``; null texts have fingerprint 0."""
    small_batches(docs.sparkSession)
    return keyed(docs, id_col, text_col).mapInArrow(_fingerprints(shingle), "doc_id long, one long, two long, fp long")


def _probes(fp: Column, table: int) -> Column:
    """``(key, stored)`` entries of one segment table; the table's number is in the key's upper half."""
    low = F.lit((1 << SEGMENT_BITS) - 1)
    segment = F.shiftrightunsigned(fp, SEGMENT_BITS) if table else fp.bitwiseAND(low)
    mark = F.lit(table << SEGMENT_BITS)
    flips = F.filter(F.sequence(F.lit(0), F.lit(SEGMENT_BITS - 1)), lambda i: F.getbit(segment, i) == 0)
    one = F.lit(1).cast("long")
    balls = F.transform(flips, lambda i: F.struct(segment.bitwiseOR(F.call_function("shiftleft", one, i)).bitwiseOR(mark).alias("key"), F.lit(False).alias("stored")))
    return F.concat(F.array(F.struct(segment.bitwiseOR(mark).alias("key"), F.lit(True).alias("stored"))), balls)


def _spanning(group: np.ndarray, radius: int) -> Iterator[tuple[int, int]]:
    """Edges of a spanning forest of the links (at most ``radius`` bits apart) among distinct ``group``."""
    rest = np.unique(group).view(np.uint64)  # counting bits takes a signed number's absolute value
    while len(rest) > 1:
        frontier, rest = [rest[0]], rest[1:]
        while frontier and len(rest):
            node = frontier.pop()
            near = np.bitwise_count(rest ^ node) <= radius
            if near.any():
                found = rest[near]
                rest = rest[~near]
                frontier.extend(found)
                for other in found.view(np.int64).tolist():
                    yield int(node.view(np.int64)), other


class _Forest:
    """Union-find over the links that one task has seen."""

    def __init__(self) -> None:
        self.parent: dict[int, int] = {}

    def root(self, x: int) -> int:
        top = x
        while (up := self.parent.get(top, top)) != top:
            top = up
        while (up := self.parent.get(x, x)) != top:
            self.parent[x], x = top, up
        return top

    def join(self, x: int, y: int) -> None:
        x, y = self.root(x), self.root(y)
        if x != y:
            self.parent[max(x, y)] = min(x, y)
            self.parent.setdefault(min(x, y), min(x, y))


def _linker(radius: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by key, a key's stored entries first; a key's rows may span batches."""
        forest = _Forest()

        def close(key: np.ndarray, fp: np.ndarray, stored: np.ndarray, last: bool) -> int:
            """Link the whole runs of equal keys; where the run that may go on starts."""
            starts = np.concatenate([[0], np.flatnonzero(np.diff(key)) + 1])
            ends = np.concatenate([starts[1:], [len(key)]])
            open_at = len(key) if last else int(starts[-1])
            # a run is of use only if its key is stored and something else meets it there
            for k in np.flatnonzero(stored[starts] & (ends - starts > 1) & (starts < open_at)):
                for x, y in _spanning(fp[starts[k] : ends[k]], radius):
                    forest.join(x, y)
            return open_at

        rest = None
        for batch in batches:
            if not batch.num_rows:
                continue
            columns = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
            if rest is not None:
                columns = [np.concatenate(x) for x in zip(rest, columns, strict=True)]
            at = close(*columns, last=False)
            rest = [c[at:] for c in columns]
        if rest is not None:
            close(*rest, last=True)
        pairs = [(x, r) for x in list(forest.parent) if x != (r := forest.root(x))]
        yield pa.record_batch([pa.array([p[i] for p in pairs], pa.int64()) for i in (0, 1)], names=["a", "b"])

    return run


def links(prints: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Edges ``(a, b)`` whose components are those of all links among distinct ``prints.fp``.

    ``radius`` may be 0 to 3: with two segments a ball of radius 1 finds every
    pair up to 3 bits apart.  For a wider search see ``similar.links``.
    """
    if not 0 <= radius <= 3:
        raise ValueError("two segments with balls of radius 1 cover at most 3 differing bits")
    entries = F.concat(_probes(F.col("fp"), 0), _probes(F.col("fp"), 1))
    probes = prints.select("fp").distinct().select("fp", F.explode(entries).alias("e")).select("e.key", "fp", "e.stored")
    return probes.repartition("key").sortWithinPartitions("key", F.desc("stored")).mapInArrow(_linker(radius), "a long, b long")


def first_row() -> Column:
    """The least of a group's rows, by id, those without one last, then by the text's hashes."""
    return F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "one", "two"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """``(doc_id, fingerprint, component_id)`` for every row of ``docs``.

    Texts are lower-cased in A-Z and cut at ASCII white space; null, empty and
    wordless texts have fingerprint zero, which links like any other.  A text
    of fewer than ``shingle`` words is one shingle, and of a long one all are
    read.  ``component_id`` is the smallest id of the component; null ids are
    passed over for it, and a component without any other id has null.
    Repeated rows and repeated ids each give their row, an empty table gives
    none.  Other columns of ``docs`` are not read.
    """
    prints = cut(fingerprints(docs, id_col, text_col, shingle).select("doc_id", "fp"))
    reps = cut(prints.groupBy("fp").agg(F.min("doc_id").alias("rep")))
    members = connected_components(links(reps, radius)).withColumnRenamed("node", "fp")
    least = cut(members.join(reps, "fp").groupBy("root").agg(F.min("rep").alias("least")))
    linked = members.join(least, "root").select("fp", "least")
    # written first, so that both sides of the last join are dealt anew and a fingerprint of many copies can be split
    classes = cut(reps.join(linked, "fp", "left").select("fp", F.coalesce("least", "rep").alias("component_id")))
    return prints.join(classes, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def winners(reps: DataFrame, members: DataFrame) -> DataFrame:
    """The least row of each component, from ``reps(node, first)`` (the least row of each node) and ``members(node, root)``."""
    joined = reps.select("node", "first").join(members, "node", "left")
    return joined.groupBy(F.coalesce("root", "node").alias("root")).agg(F.min("first").alias("first")).select("first.doc_id", "first.one", "first.two")


def keep_rows(docs: DataFrame, prints: DataFrame, kept: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that ``kept(doc_id, one, two)`` names, all columns as they are.

    A row is known by its id and its text's hashes, so another text of the same
    id, or another row without an id, doesn't come back with it; of rows that
    repeat both, one stays.  ``prints`` holds the same three columns of every
    row.  The texts are shuffled once; nothing is collected.
    """
    names = ["doc_id", "one", "two"]
    chosen = cut(kept.select(*[F.col(c).alias(f"_{c}") for c in names]))
    repeated = not prints.groupBy(*names).count().where("count > 1").isEmpty()
    text = F.col(f"`{text_col}`").cast("binary")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.xxhash64(text).alias("one"), F.xxhash64(F.lit(1), text).alias("two"))
    # a merge join at every size: what is kept grows with the input, and a key of many rows can be split
    same = F.col("doc_id").eqNullSafe(F.col("_doc_id")) & (F.col("one") == F.col("_one")) & (F.col("two") == F.col("_two"))
    left = rows.join(chosen.hint("merge"), same, "left_semi")
    return (left.dropDuplicates(names) if repeated else left).select("row.*")


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """``docs`` with one row of each component of fingerprints: that with the smallest id, rows without an id last; all columns as they are.

    Null, empty and wordless texts are one component, with whatever is linked
    to fingerprint zero.  An empty table stays empty.
    """
    prints = cut(fingerprints(docs, id_col, text_col, shingle))
    reps = cut(prints.groupBy(F.col("fp").alias("node")).agg(first_row().alias("first")))
    members = connected_components(links(reps.select(F.col("node").alias("fp")), radius))
    return keep_rows(docs, prints, winners(reps, members), id_col, text_col)


def op9_simhash(spark, sf_dir: str) -> DataFrame:
    """``near_duplicates`` over all of ``documents``."""
    return near_duplicates(table(spark, sf_dir, "documents"))
