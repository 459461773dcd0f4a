"""Quality classifier: a byte-level convolutional network in numpy.

Learned filters of 12 bytes run over the whole text at every second byte.  Each
filter is a table of one value for each of its places and each byte value, so
a convolution is a sum of looked-up rows.  Chunks of 256 bytes that overlap by
half take each filter's maximum; the mean and the maximum over all chunks of a
document are combined into one probability.

The network learns by Adam on a bounded, class-balanced sample of labelled
rows.  Scores are shifted so that the balanced decision falls on 0.3.

Style: Arrow batches; one pass over the whole texts, nothing is shuffled but
the labels.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import small_batches, table
from graphloom.llm.langid import held_out, labelled_sample

WIDTH, STRIDE, FILTERS = 12, 2, 24
HALF = 128  # bytes; a chunk is two halves
STEPS = HALF // STRIDE
#: Labelled rows of each class that the network learns from, and the longest text among them in bytes.
SAMPLE = 1500
SAMPLE_TEXT = 1 << 14
EPOCHS, BATCH, RATE = 14, 32, 0.01
THRESHOLD = 0.3
#: Bytes that are scored at once; a longer text is read in slabs of as many, carrying the sums.
SLAB = 1 << 18


class Network(NamedTuple):
    filters: np.ndarray  # place, byte, filter
    bias: np.ndarray
    mean: np.ndarray
    most: np.ndarray
    base: np.ndarray


class Batch(NamedTuple):
    """Texts one after another, each padded by zero bytes to whole halves."""

    data: np.ndarray
    first: np.ndarray  # of each chunk: its two halves
    second: np.ndarray
    starts: np.ndarray  # of each text: its first chunk
    chunks: np.ndarray  # of each text: how many


def layout(texts: list[bytes]) -> Batch:
    halves = [max(1, -(-(len(t) + WIDTH) // HALF)) for t in texts]
    data = np.zeros(sum(halves) * HALF + WIDTH, np.uint8)
    at = 0
    first, second, chunks = [], [], []
    for text, n in zip(texts, halves, strict=True):
        data[at * HALF : at * HALF + len(text)] = np.frombuffer(text, np.uint8)
        own = np.arange(at, at + max(1, n - 1))
        first.append(own)
        second.append(np.minimum(own + 1, at + n - 1))
        chunks.append(len(own))
        at += n
    count = np.array(chunks)
    return Batch(data, np.concatenate(first), np.concatenate(second), np.concatenate([[0], np.cumsum(count)[:-1]]), count)


def _convolve(net: Network, data: np.ndarray) -> np.ndarray:
    """Filter responses, as half, step in the half and filter."""
    out = net.filters[0][data[: len(data) - WIDTH : STRIDE]]
    for k in range(1, WIDTH):
        out += net.filters[k][data[k : len(data) - WIDTH + k : STRIDE]]
    return out.reshape(-1, STEPS, FILTERS)


def _forward(net: Network, batch: Batch) -> tuple:
    responses = _convolve(net, batch.data)
    half = responses.max(axis=1)
    a, b = half[batch.first], half[batch.second]
    hidden = np.maximum(np.maximum(a, b) + net.bias, 0)
    mean = np.add.reduceat(hidden, batch.starts, axis=0) / batch.chunks[:, None]
    most = np.maximum.reduceat(hidden, batch.starts, axis=0)
    return responses, half, a >= b, hidden, mean, most, mean @ net.mean + most @ net.most + net.base[0]


def logits(net: Network, texts: list[bytes]) -> np.ndarray:
    """One number for each text, over all its bytes."""
    return _forward(net, layout(texts))[-1].astype(np.float64)


def _gradients(net: Network, batch: Batch, slope: np.ndarray, passed: tuple) -> Network:
    """Of the loss, given its slope at each text's logit; only the maxima pass anything on."""
    responses, half, left, hidden, mean, most, _ = passed
    doc = np.repeat(np.arange(len(batch.chunks)), batch.chunks)
    at_most = hidden == most[doc]
    at_most = at_most / np.add.reduceat(at_most, batch.starts, axis=0, dtype=np.float64)[doc]
    down = slope[doc][:, None] * (net.mean / batch.chunks[doc][:, None] + at_most * net.most) * (hidden > 0)
    to_half = np.zeros_like(half, dtype=np.float64)
    np.add.at(to_half, batch.first, down * left)
    np.add.at(to_half, batch.second, down * ~left)
    row, filt = np.nonzero(to_half)
    where = row * HALF + responses.argmax(axis=1)[row, filt] * STRIDE
    value = to_half[row, filt]
    flat = [((k * 256 + batch.data[where + k].astype(np.int64)) * FILTERS + filt) for k in range(WIDTH)]
    filters = np.bincount(np.concatenate(flat), np.tile(value, WIDTH), minlength=net.filters.size).reshape(net.filters.shape)
    return Network(filters, down.sum(axis=0), (slope[:, None] * mean).sum(axis=0), (slope[:, None] * most).sum(axis=0), np.array([slope.sum()]))


def train(texts: list[bytes], labels: list[int], seed: int = 7) -> Network:
    """Fit by Adam, both classes weighing the same; with one class or none, a network that says 0.5 everywhere."""
    rng = np.random.default_rng(seed)
    net = Network(
        rng.normal(0, 0.2, (WIDTH, 256, FILTERS)).astype(np.float32), np.zeros(FILTERS, np.float32),
        rng.normal(0, 0.2, FILTERS).astype(np.float32), np.zeros(FILTERS, np.float32), np.zeros(1, np.float32),
    )
    y = np.array(labels)
    if len(set(labels)) < 2:
        return net._replace(mean=np.zeros(FILTERS, np.float32))
    weight = np.where(y == 1, len(y) / (2 * (y == 1).sum()), len(y) / (2 * (y == 0).sum()))
    first, second = [np.zeros(p.shape) for p in net], [np.zeros(p.shape) for p in net]
    step = 0
    for epoch in range(EPOCHS):
        order = rng.permutation(len(texts))
        rate = RATE * (1 - 0.9 * epoch / EPOCHS)
        for at in range(0, len(order), BATCH):
            rows = order[at : at + BATCH]
            batch = layout([texts[k] for k in rows])
            passed = _forward(net, batch)
            slope = (1 / (1 + np.exp(-np.clip(passed[-1], -30, 30))) - y[rows]) * weight[rows] / len(rows)
            step += 1
            for k, (p, g) in enumerate(zip(net, _gradients(net, batch, slope, passed), strict=True)):
                first[k] += 0.1 * (g - first[k])
                second[k] += 0.001 * (g * g - second[k])
                p -= (rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
                if k != 4:
                    p *= 1 - rate * 1e-3
    return net


def long_logit(net: Network, text: bytes, slab: int = SLAB) -> float:
    """What ``logits`` gives for one text, in memory for ``slab`` bytes of it at once.

    A chunk is two halves, so the last half of a slab is carried to the next.
    """
    halves = max(1, -(-(len(text) + WIDTH) // HALF))
    each = max(1, slab // HALF)
    total, most = np.zeros(FILTERS), np.full(FILTERS, -np.inf)
    before = np.empty((0, FILTERS), np.float32)
    for at in range(0, halves, each):
        upto = min(halves, at + each)
        data = np.zeros((upto - at) * HALF + WIDTH, np.uint8)
        part = np.frombuffer(text, np.uint8)[at * HALF : upto * HALF + WIDTH]
        data[: len(part)] = part
        half = np.concatenate([before, _convolve(net, data).max(axis=1)])
        chunks = np.maximum(half[:-1], half[1:]) if len(half) > 1 else half if halves == 1 else half[:0]
        if len(chunks):
            hidden = np.maximum(chunks + net.bias, 0)
            total += hidden.sum(axis=0, dtype=np.float64)
            most = np.maximum(most, hidden.max(axis=0))
        before = half[-1:]
    return float(total / max(1, halves - 1) @ net.mean + most @ net.most + net.base[0])


def scores(net: Network, texts: list[bytes]) -> np.ndarray:
    """Probabilities of label 1, in slabs of a bounded number of bytes, of many texts or of one."""
    out = np.empty(len(texts))
    at = 0
    while at < len(texts):
        if len(texts[at]) >= SLAB:
            out[at] = long_logit(net, texts[at])
            at += 1
            continue
        upto, size = at, 0
        while upto < len(texts) and len(texts[upto]) < SLAB and (size == 0 or size + len(texts[upto]) < SLAB):
            size += len(texts[upto]) + HALF
            upto += 1
        out[at:upto] = logits(net, texts[at:upto])
        at = upto
    return 1 / (1 + np.exp(-np.clip(out + math.log(THRESHOLD / (1 - THRESHOLD)), -700, 700)))


def fit_quality(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Network:
    """Learn ``labels.quality`` from rows that aren't held out.

    Labels that are neither 0 nor 1 are passed over; an id with both takes the
    lower one.  The sampled ids are bounded by ``sample``, so they are sent to
    the text's readers.
    """
    known = labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"), 5, 0))
    known = known.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("quality").alias("quality"))
    ids = labelled_sample(known, "quality", "doc_id", sample)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where(F.octet_length("text") <= SAMPLE_TEXT)
    known = texts.join(F.broadcast(ids), "doc_id").select("draw", "doc_id", "quality", F.col("text").cast("binary").alias("text"))
    rows = sorted((bytes(r.text), int(r.quality)) for r in known.orderBy("draw", "doc_id", "text").limit(8 * sample).collect())
    return train([t for t, _ in rows], [q for _, q in rows])


def predict_quality(docs: DataFrame, net: Network) -> DataFrame:
    """``doc_id, score`` for every row; null texts score as empty ones.

    Whole texts are read, long ones in slabs.  Repeated rows score alike, null
    ids stay null, an empty table gives no rows, and no other column is read.
    """
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t or b"" for t in batch.column("text").to_pylist()]
            yield pa.record_batch([batch.column("doc_id"), pa.array(scores(net, texts), pa.float64())], names=["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text")).mapInArrow(run, "doc_id long, score double")


def op4_quality(spark, sf_dir: str) -> DataFrame:
    """``predict_quality`` over all of ``documents``, learned from ``labels`` without the held-out rows."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    net = fit_quality(docs, table(spark, sf_dir, "labels"))
    return predict_quality(docs, net).select("doc_id", held_out(F.col("doc_id"), 5, 0).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
