"""Media columns: audio stored as WAV bytes, and log-mel features as fixed-shape Arrow tensors.

A payload is stored losslessly as 8-bit mono samples in a WAV container, one
binary value per row of a Parquet table in the shared folder, and read back
from there.  Features: polyphase resampling by 5/8, overlapped windowed frames,
log-mel filterbanks, and energy segmentation with hysteresis (a segment opens
above one threshold and closes below a lower one).  The frames of a row are
stored as an Arrow stream of fixed-shape tensors, each with its time span, and
the segments as pairs of times.

Style: Arrow batches; the signal processing is numpy's.  Nothing is shuffled.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import scratch, small_batches, table

RATE = 16_000
UP, DOWN = 5, 8
TAPS = 16  # of each phase
FRAME, HOP, MELS = 256, 128, 32
#: Frames in one tensor.
SPAN = 32
OPEN_DB, CLOSE_DB = 3.0, -3.0  # against the row's median frame energy
BLOCK = 64
#: Samples that are worked on at once, a multiple of ``DOWN``.
SLAB = 1 << 18

STORED = "doc_id long, n_bytes long, media binary"
FEATURES = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, segments array<struct<start_s:double,end_s:double>>, tensors binary"


def padded(data: bytes) -> bytes:
    """``data`` with zero bytes up to a positive multiple of 64."""
    return data + bytes(max(BLOCK, -(-len(data) // BLOCK) * BLOCK) - len(data))


def to_wav(samples: bytes, rate: int = RATE) -> bytes:
    """Unsigned 8-bit mono samples as a WAV file."""
    fmt = struct.pack("<4sIHHIIHH", b"fmt ", 16, 1, 1, rate, rate, 1, 8)
    pad = b"\0" * (len(samples) % 2)
    return struct.pack("<4sI4s", b"RIFF", 4 + len(fmt) + 8 + len(samples) + len(pad), b"WAVE") + fmt + struct.pack("<4sI", b"data", len(samples)) + samples + pad


def from_wav(media: bytes) -> tuple[bytes, int]:
    """The samples and the rate of an 8-bit mono WAV file; unknown chunks are passed over."""
    if media[:4] != b"RIFF" or media[8:12] != b"WAVE":
        raise ValueError("no WAV file")
    at, rate = 12, 0
    while at + 8 <= len(media):
        kind, length = struct.unpack_from("<4sI", media, at)
        if kind == b"fmt ":
            form, channels, rate, _, _, bits = struct.unpack_from("<HHIIHH", media, at + 8)
            if (form, channels, bits) != (1, 1, 8):
                raise ValueError("no 8-bit mono samples")
        elif kind == b"data":
            return media[at + 8 : at + 8 + length], rate
        at += 8 + length + length % 2
    raise ValueError("no samples")


@cache
def _phases() -> np.ndarray:
    """The low-pass filter's polyphase components, one row for each phase."""
    n = np.arange(UP * TAPS) - (UP * TAPS - 1) / 2
    cutoff = 1 / max(UP, DOWN)
    taps = np.sinc(n * cutoff) * np.hamming(UP * TAPS)
    taps *= UP / taps.sum()
    return np.ascontiguousarray(taps.reshape(TAPS, UP).T[:, ::-1])


def resample(x: np.ndarray, before: np.ndarray | None = None) -> np.ndarray:
    """``x`` at 5/8 of its rate, after the ``TAPS`` - 1 samples ``before`` it (silence if None); each output sample is one phase's dot product."""
    count = -(-len(x) * UP // DOWN)
    ahead = np.concatenate([np.zeros(TAPS - 1) if before is None else before, x, np.zeros(TAPS + DOWN)])
    windows = np.lib.stride_tricks.sliding_window_view(ahead, TAPS)
    out = np.empty(-(-count // UP) * UP)
    for k, taps in enumerate(_phases()[np.arange(UP) * DOWN % UP]):
        first = k * DOWN // UP
        out[k::UP] = windows[first::DOWN][: len(out) // UP] @ taps
    return out[:count]


@cache
def _mel() -> np.ndarray:
    """Triangular filters, evenly spaced in mel, over the spectrum's bins."""
    rate = RATE * UP / DOWN
    mel = lambda f: 2595 * np.log10(1 + f / 700)
    edges = 700 * (10 ** (np.linspace(0, mel(rate / 2), MELS + 2) / 2595) - 1)
    bins = np.fft.rfftfreq(FRAME, 1 / rate)
    rise = (bins[:, None] - edges[:-2]) / (edges[1:-1] - edges[:-2])
    fall = (edges[2:] - bins[:, None]) / (edges[2:] - edges[1:-1])
    return np.maximum(0, np.minimum(rise, fall))


@cache
def _window() -> np.ndarray:
    return np.hanning(FRAME)


def _frames(whole: np.ndarray) -> np.ndarray:
    frames = np.lib.stride_tricks.sliding_window_view(whole, FRAME)[::HOP]
    power = np.abs(np.fft.rfft(frames * _window(), axis=1)) ** 2
    return np.log(power @ _mel() + 1e-6)


def log_mel(x: np.ndarray) -> np.ndarray:
    """Overlapped frames of ``x``, zero-padded at the end to a whole frame, as log-mel energies."""
    count = max(1, -(-max(0, len(x) - FRAME) // HOP) + 1)
    whole = np.zeros((count - 1) * HOP + FRAME)
    whole[: len(x)] = x
    return _frames(whole)


def payload_mel(payload: bytes, slab: int = SLAB) -> np.ndarray:
    """``log_mel(resample(...))`` of 8-bit samples, ``slab`` of them at once; what a frame or a filter still needs is carried on."""
    samples = np.frombuffer(payload, np.uint8)
    before, rest, out = np.zeros(TAPS - 1), np.empty(0), []
    for at in range(0, len(samples), slab):
        x = (samples[at : at + slab].astype(np.float64) - 128) / 128
        held = np.concatenate([rest, resample(x, before)])
        before = np.concatenate([before, x])[-(TAPS - 1) :]
        if at + slab >= len(samples):
            out.append(log_mel(held))
        elif len(held) >= FRAME + HOP:
            count = (len(held) - FRAME) // HOP  # the last whole frame is left, so that the end is padded as it would be
            out.append(_frames(held[: (count - 1) * HOP + FRAME]))
            rest = held[count * HOP :]
        else:
            rest = held
    return np.concatenate(out) if out else log_mel(rest)


def hysteresis(db: np.ndarray, high: float, low: float) -> list[tuple[int, int]]:
    """Runs of frames that stay at or over ``low`` and reach ``high`` somewhere, ends exclusive."""
    over = np.concatenate([[False], db >= low, [False]])
    edges = np.flatnonzero(over[1:] != over[:-1])
    return [(int(a), int(b)) for a, b in zip(edges[::2], edges[1::2], strict=True) if db[a:b].max() >= high]


def tensor_type() -> pa.FixedShapeTensorType:
    return pa.fixed_shape_tensor(pa.float32(), [SPAN, MELS])


@cache
def _schema() -> pa.Schema:
    return pa.schema([("span", tensor_type()), ("frames", pa.int32()), ("start_s", pa.float64()), ("end_s", pa.float64())])


def pack_tensors(mel: np.ndarray) -> bytes:
    """The frames as an Arrow stream of tensors of fixed shape; the last is padded with zeros, ``frames`` says how far it goes."""
    count = -(-len(mel) // SPAN)
    whole = np.zeros((count * SPAN, MELS), np.float32)
    whole[: len(mel)] = mel
    storage = pa.FixedSizeListArray.from_arrays(pa.array(whole.ravel()), SPAN * MELS)
    starts = np.arange(count) * SPAN
    used = np.minimum(len(mel) - starts, SPAN)
    second = HOP * DOWN / UP / RATE
    batch = pa.record_batch([pa.ExtensionArray.from_storage(tensor_type(), storage), pa.array(used.astype(np.int32)), pa.array(starts * second), pa.array((starts + used) * second)], schema=_schema())
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, _schema()) as out:
        out.write_batch(batch)
    return sink.getvalue().to_pybytes()


def unpack_tensors(data: bytes) -> pa.Table:
    return pa.ipc.open_stream(data).read_all()


def features(media: bytes) -> tuple[bytes, str, list[tuple[float, float]], bytes]:
    """The payload read back, a digest of the features, the segments' times in seconds and the tensors."""
    payload, _ = from_wav(media)
    mel = payload_mel(payload)
    db = 10 * np.log10(np.exp(mel).sum(axis=1))
    middle = float(np.median(db))
    found = hysteresis(db, middle + OPEN_DB, middle + CLOSE_DB)
    second = HOP * DOWN / UP / RATE
    rounded = np.round(mel * 1000).astype("<i4")
    feature = f"{len(mel)}x{MELS}:{len(found)}:{zlib.crc32(rounded.tobytes()):08x}"
    return payload, feature, [(a * second, b * second) for a, b in found], pack_tensors(mel)


def _store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [t or b"" for t in batch.column(1).to_pylist()]
        yield pa.record_batch([batch.column(0), pa.array([len(t) for t in texts], pa.int64()), pa.array([to_wav(padded(t)) for t in texts], pa.binary())], names=["doc_id", "n_bytes", "media"])


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for media in batch.column("media"):
            media = media.as_py()
            payload, feature, segments, tensors = features(media)
            rows.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-BLOCK:]), len(media), hashlib.sha256(media).hexdigest(), feature, [{"start_s": a, "end_s": b} for a, b in segments], tensors))
        columns = list(zip(*rows, strict=True)) if rows else [()] * 8
        kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.list_(pa.struct([("start_s", pa.float64()), ("end_s", pa.float64())])), pa.binary())
        yield pa.record_batch(
            [batch.column("doc_id"), batch.column("n_bytes"), *[pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]],
            names=["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "segments", "tensors"],
        )


def store_media(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write every text's bytes as WAV to a table at ``path`` and read the table back.

    Null and empty texts are stored as 64 zero samples, repeated rows as often
    as they come, long texts whole; an empty table gives an empty one, null ids
    stay null, and other columns are not read.
    """
    small_batches(docs.sparkSession)
    few = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text"))
    few.mapInArrow(_store, STORED).write.option("compression", "zstd").parquet(path)
    return docs.sparkSession.read.schema(STORED).parquet(path)


def audio_features(media: DataFrame) -> DataFrame:
    """Features of a table as ``store_media`` writes it, one row per row; equal bytes give equal values.

    ``segments`` are times in seconds, ``tensors`` an Arrow stream (``unpack_tensors``).
    """
    small_batches(media.sparkSession)
    return media.mapInArrow(_extract, FEATURES)


def op7_media(spark, sf_dir: str) -> DataFrame:
    """``audio_features`` over all of ``documents``, stored and read back; the segments and tensors follow the digests."""
    media = store_media(table(spark, sf_dir, "documents"), scratch(spark, "media"))
    return audio_features(media)
