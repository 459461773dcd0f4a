"""Language identification as inference of a mixture of languages.

A language's model is its distribution of hashed byte trigrams, learned from a
bounded sample of labelled rows.  A text is cut into short windows of trigrams;
expectation-maximisation finds the shares of the languages that make the
windows likeliest.  Which languages are in a text at all is chosen by penalised
likelihood: languages join in the order of their shares, each set is fitted on
its own, and the set stops growing when the likelihood no longer gains more
than a language costs.

Style: Arrow batches; one pass over the whole texts, and all documents of a
batch are fitted at once in numpy.  Nothing is shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import cut, small_batches, table

BINS_BITS = 15
WINDOW = 48
ROUNDS = 12
#: Overlapping trigrams aren't independent; their log-likelihoods count this much.
TEMPER = 1 / 3
#: What a language costs, in units of the log of the number of windows.
COST = 2.0
#: Labelled rows of each language that the models are learned from, and the longest text among them in bytes.
SAMPLE = 500
SAMPLE_TEXT = 1 << 16
UNKNOWN = "und"
#: Characters of a text, and numbers of an array, that are worked on at once.
SLAB, CELLS = 1 << 18, 1 << 22

_LETTER = regex.compile(r"\p{L}")
#: ASCII letters and bytes of other characters stay, all else separates.
_MAP = np.array([b if b >= 0x80 or 0x61 <= b <= 0x7A else 0x20 for b in range(256)], np.uint8)


class Model(NamedTuple):
    langs: tuple[str, ...]
    #: log-probabilities, one row for each hash of a trigram and one column for each language
    table: np.ndarray


def _codes(data: bytes) -> np.ndarray:
    data = _MAP[np.frombuffer(data, np.uint8)]
    codes = data[:-2].astype(np.uint32) | data[1:-1].astype(np.uint32) << 8 | data[2:].astype(np.uint32) << 16
    codes = codes[(data[:-2] != 0x20) | (data[1:-1] != 0x20)]
    return ((codes * np.uint32(0x9E3779B1)) >> np.uint32(32 - BINS_BITS)).astype(np.intp)


def trigrams(text: str) -> np.ndarray:
    """Hashes of the text's byte trigrams, lower case, with a space at either end; runs of separators give none."""
    return np.concatenate(list(_trigram_slabs(text)))


def _trigram_slabs(text: str) -> Iterator[np.ndarray]:
    """``trigrams`` in pieces of the text, each with the two bytes before it."""
    before = b" "
    for at in range(0, len(text), SLAB):
        last = at + SLAB >= len(text)
        data = before + text[at : at + SLAB].lower().encode("utf-8", "replace") + (b" " if last else b"")
        yield _codes(data)
        before = data[-2:]
    if not text:
        yield _codes(b"  ")


def learn(rows: list[tuple[str, str]]) -> Model:
    """Smoothed trigram models from ``(lang, text)`` rows; without rows a model of no language."""
    counts: dict[str, np.ndarray] = {}
    for lang, text in rows:
        counts.setdefault(lang, np.zeros(1 << BINS_BITS))
        counts[lang] += np.bincount(trigrams(text), minlength=1 << BINS_BITS)
    langs = tuple(sorted(counts))
    if not langs:
        return Model((), np.zeros((1 << BINS_BITS, 0), np.float32))
    stack = np.stack([counts[x] for x in langs], axis=1) + 0.05
    return Model(langs, np.log(stack / stack.sum(axis=0)).astype(np.float32))


def windows(model: Model, text: str) -> np.ndarray:
    """How likely each window is in each language, against its likeliest; one row for each window."""
    step = max(1, CELLS // max(1, len(model.langs)) // WINDOW) * WINDOW
    out, rest = [], np.empty(0, np.intp)

    def take(grams: np.ndarray) -> None:
        for at in range(0, len(grams), step):
            part = grams[at : at + step]
            logs = np.add.reduceat(model.table[part], np.arange(0, len(part), WINDOW), axis=0) * np.float32(TEMPER)
            out.append(np.exp(logs - logs.max(axis=1, keepdims=True)))

    for grams in _trigram_slabs(text):
        held = np.concatenate([rest, grams])
        whole = len(held) // WINDOW * WINDOW
        take(held[:whole])
        rest = held[whole:]
    take(rest)
    return np.concatenate(out)


def _mixture(weight: np.ndarray, starts: np.ndarray, counts: np.ndarray, shares: np.ndarray, rounds: int) -> tuple[np.ndarray, np.ndarray]:
    """EM over all documents at once: their shares, and the log-likelihood that the shares give.

    A batch of many documents is small; a document that is alone may be long
    and is worked through in slabs of its windows.
    """
    if len(counts) == 1:
        step = max(1, CELLS // weight.shape[1])
        slabs = [weight[at : at + step] for at in range(0, len(weight), step)]
        for _ in range(rounds):
            total = np.zeros(weight.shape[1])
            for slab in slabs:
                part = slab * shares[0]
                total += (part / np.maximum(part.sum(axis=1, keepdims=True), 1e-300)).sum(axis=0)
            shares = total[None] / counts[0]
        return shares, np.array([sum(float(np.log(np.maximum(slab @ shares[0], 1e-300)).sum()) for slab in slabs)])
    doc = np.repeat(np.arange(len(counts)), counts)
    for _ in range(rounds):
        part = weight * shares[doc]
        part /= np.maximum(part.sum(axis=1, keepdims=True), 1e-300)
        shares = np.add.reduceat(part, starts, axis=0) / counts[:, None]
    fit = np.log(np.maximum((weight * shares[doc]).sum(axis=1), 1e-300))
    return shares, np.add.reduceat(fit, starts)


def mixtures(model: Model, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """For texts with letters: the shares of all languages, and those of the chosen set (0 for the others)."""
    each = [windows(model, text) for text in texts]
    n = np.array([len(x) for x in each])
    weight = each[0] if len(each) == 1 else np.concatenate(each)
    starts = np.concatenate([[0], np.cumsum(n)[:-1]])
    number = len(model.langs)
    everything, _ = _mixture(weight, starts, n, np.full((len(n), number), 1 / number), ROUNDS)
    order = np.argsort(-everything, axis=1, kind="stable")
    rank = np.argsort(order, axis=1, kind="stable")
    chosen = np.zeros_like(everything)
    best = np.full(len(n), -np.inf)
    growing = np.ones(len(n), bool)
    for size in range(1, number + 1):
        # only the documents whose set still grows are fitted again
        which = np.flatnonzero(growing)
        if not len(which):
            break
        inside = np.where(rank[which] < size, np.maximum(everything[which], 1e-6), 0)
        inside /= inside.sum(axis=1, keepdims=True)
        sub = n[which]
        begins = np.concatenate([[0], np.cumsum(sub)[:-1]])
        kept = weight if len(which) == len(n) else weight[np.repeat(growing, n)]
        shares, fit = _mixture(kept, begins, sub, inside, ROUNDS if size > 1 else 0)
        value = fit - COST * size * np.log(sub + 1)
        better = value > best[which]
        chosen[which[better]], best[which[better]] = shares[better], value[better]
        growing[which[~better]] = False
    return everything, chosen


def identify(model: Model, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
    """The language with the largest share in the chosen set, and its share among all languages."""
    langs, scores = [UNKNOWN] * len(texts), np.zeros(len(texts))
    known = [k for k, t in enumerate(texts) if t and model.langs and _LETTER.search(t)]
    at = 0
    while at < len(known):
        # slabs of a bounded number of characters, whatever the batch holds
        upto, size = at, 0
        while upto < len(known) and (size == 0 or size + len(texts[known[upto]]) < 1 << 20):
            size += len(texts[known[upto]])
            upto += 1
        part = known[at:upto]
        everything, chosen = mixtures(model, [texts[k] for k in part])
        top = chosen.argmax(axis=1)
        for row, k in enumerate(part):
            langs[k], scores[k] = model.langs[top[row]], everything[row, top[row]]
        at = upto
    return langs, np.clip(scores, 0, 1)


def held_out(doc_id: Column, of: int, remainder: int) -> Column:
    """Whether the crc32 of the id as text leaves ``remainder``; null ids don't."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(of)) == remainder, F.lit(False))


def _draw(*keys: str) -> Column:
    return F.pmod(F.xxhash64(F.lit("sample"), *keys), F.lit(1 << 20))


def labelled_sample(rows: DataFrame, label: str, key: str, each: int) -> DataFrame:
    """About ``each`` rows of each of a few labels, with their ``draw``, a hash of ``key``; never over twice as many in all, and always the same."""
    counts = {r[0]: r[1] for r in rows.groupBy(label).agg(F.count("*").alias("n")).collect()}
    keep = F.lit(False)
    for value, n in counts.items():
        share = min(1.0, each / n)
        keep = keep | ((F.col(label) == value) & (F.col("draw") < int(share * (1 << 20)) + 1))
    return rows.withColumn("draw", _draw(key)).where(keep).orderBy("draw", key, label).limit(2 * each * max(1, len(counts)))


def fit_languages(docs: DataFrame, sample: int = SAMPLE) -> Model:
    """Learn every label from rows with text and ``lang`` that aren't held out; null ids take part.

    A language has about ``sample`` rows of at most ``SAMPLE_TEXT`` bytes, or
    the starts of longer ones if it has no others, drawn by a hash of id and
    text; the same table gives the same model.
    """
    rows = docs.where(F.col("text").isNotNull() & F.col("lang").isNotNull() & ~held_out(F.col("doc_id"), 4, 2)).select("doc_id", "lang", "text")
    short = F.octet_length("text") <= SAMPLE_TEXT
    counts = cut(rows.groupBy("lang").agg(F.count(F.when(short, 1)).alias("n_short"), F.count("*").alias("n")))
    # a label's longer rows are counted only if it has no others
    share = F.least(F.lit(1.0), F.lit(sample) / F.when(F.col("n_short") > 0, F.col("n_short")).otherwise(F.col("n")))
    chosen = rows.withColumn("draw", _draw("doc_id", "text")).join(F.broadcast(counts), "lang").where((short | (F.col("n_short") == 0)) & (F.col("draw") < (share * (1 << 20)).cast("long") + 1))
    # four bytes a character at most
    starts = chosen.select("draw", "lang", F.when(short, F.col("text")).otherwise(F.substring("text", 1, SAMPLE_TEXT // 4)).alias("text"))
    bounded = starts.orderBy("draw", "lang", "text").limit(2 * sample * max(1, counts.count()))
    return learn(sorted((r.lang, r.text) for r in bounded.collect()))


def predict_languages(docs: DataFrame, model: Model) -> DataFrame:
    """``doc_id, lang_pred, score`` for every row; ``und`` and 0 for null and empty texts and those without a letter (Unicode's category L).

    Whole texts are read, long ones in slabs.  Of languages with equal shares
    the first by name is taken.  Repeated rows give equal rows, null ids stay
    null, an empty table gives no rows, and no other column is read.
    """
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, scores = identify(model, batch.column("text").to_pylist())
            yield pa.record_batch([batch.column("doc_id"), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names=["doc_id", "lang_pred", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, lang_pred string, score double")


def drop_unidentified(docs: DataFrame, model: Model, least: float = 0.0, text_col: str = "text") -> DataFrame:
    """``docs`` without the rows whose language is ``und`` or whose score is under ``least``; all columns as they are, whatever their names.

    A model of no language can't tell any, so that only null and empty texts
    and those without a letter go.  Repeated rows stay or go together, null ids
    and very long texts are treated like any, and an empty table stays empty.
    """
    small_batches(docs.sparkSession)
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(at).to_pylist()
            if not model.langs:
                yield batch.filter(pa.array([bool(t and _LETTER.search(t)) for t in texts], pa.bool_()))
                continue
            langs, scores = identify(model, texts)
            yield batch.filter(pa.array([x != UNKNOWN and s >= least for x, s in zip(langs, scores, strict=True)], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def op10_langid(spark, sf_dir: str) -> DataFrame:
    """``predict_languages`` over all of ``documents``, learned from the rows that aren't held out."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    found = predict_languages(docs, fit_languages(docs))
    return found.select("doc_id", held_out(F.col("doc_id"), 4, 2).alias("held_out"), "lang_pred", "score")
