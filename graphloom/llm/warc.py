"""WARC archives compressed by a dictionary of their own.

Each task writes archives of a bounded size to the shared folder.  A
Zstandard dictionary is trained on the archive's records and stands, itself
compressed, in a leading skippable frame (magic 0x184D2A5D); every record is
one frame after it, so that a reader can start at any record's offset.  Of
equal payloads the one with the smallest id is a ``response``; the others are
``revisit`` records that refer to it and keep its HTTP header.

An archive is written under a name of its attempt and moved to its place when
whole.  The manifest, written as a table, lists the archives of the attempts
that succeeded, so a lost executor's leftovers are never read.

Style: Arrow batches; the container format is imperative work on a stream of
records.  Payloads are shuffled once, by digest.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
import uuid
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import cut, scratch, small_batches, table

#: Bytes of records, before compression, in one archive.
ARCHIVE_BYTES = 16 << 20
DICT_BYTES = 64 << 10
#: Bytes of an archive's records that its dictionary is trained on, taken at even steps.
TRAIN_BYTES = 4 << 20
#: Payloads that occur more than once and are sent to all tasks, of about 100 bytes each; more are joined by a shuffle.
SENT = 200_000
#: Bytes of archives that one task reads.
TASK_BYTES = 256 << 20
LEVEL = 6
DATE = "2000-01-01T00:00:00Z"
DICT_MAGIC = 0x184D2A5D
ZSTD_MAGIC = 0xFD2FB528
ID = "urn:x-page:"

MANIFEST = "path string, records long, raw_bytes long, bytes long, dict_bytes long"
RECORDS = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string, archive string, archive_offset long, payload binary"


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _uri(url: str) -> str:
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url)


def _record(headers: list[tuple[str, str]], block: bytes) -> bytes:
    lines = ["WARC/1.1", *[f"{k}: {v}" for k, v in headers], f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(lines).encode() + block + b"\r\n\r\n"


def _name(page_id: int | None) -> str:
    return f"<{ID}{'-' if page_id is None else page_id}>"


def make_record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, revisit: bool) -> bytes:
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    headers = [("WARC-Type", "revisit" if revisit else "response"), ("WARC-Record-ID", _name(page_id)), ("WARC-Date", DATE)]
    if url is not None:
        headers.append(("WARC-Target-URI", _uri(url)))
    headers.append(("WARC-Payload-Digest", f"sha1:{payload_digest(payload)}"))
    if revisit:
        headers += [("WARC-Refers-To", _name(refers_to)), ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")]
    headers.append(("Content-Type", "application/http; msgtype=response"))
    return _record(headers, http if revisit else http + payload)


def _info() -> bytes:
    return _record([("WARC-Type", "warcinfo"), ("WARC-Record-ID", "<urn:x-info:0>"), ("WARC-Date", DATE), ("Content-Type", "application/warc-fields")], b"format: WARC File Format 1.1\r\n")


def train(records: list[bytes], dict_bytes: int = DICT_BYTES, train_bytes: int = TRAIN_BYTES) -> bytes:
    """A dictionary from ``records``, of which those at even steps are read up to ``train_bytes``.

    Too few or too small records can't be trained on; their bytes are then the
    dictionary as they are.
    """
    total = sum(map(len, records))
    step = max(1, -(-total // train_bytes))
    chosen = records[::step]
    if len(chosen) >= 8 and sum(map(len, chosen)) >= 8 * dict_bytes:
        try:
            return zstandard.train_dictionary(dict_bytes, chosen, k=512, d=8, f=18, accel=2).as_bytes()
        except zstandard.ZstdError:
            pass
    return b"".join(chosen)[:dict_bytes]


def write_archive(records: list[bytes]) -> tuple[bytes, int]:
    """A whole archive in memory, and its dictionary's size."""
    records = [_info(), *records]
    raw = train(records)
    held = zstandard.ZstdCompressor(level=19).compress(raw)
    packer = zstandard.ZstdCompressor(level=LEVEL, dict_data=zstandard.ZstdCompressionDict(raw), write_checksum=True, write_content_size=True)
    return b"".join([struct.pack("<II", DICT_MAGIC, len(held)), held, *map(packer.compress, records)]), len(raw)


class Record(NamedTuple):
    offset: int
    headers: dict[str, str]
    block: bytes


def read_archive(source, chunk: int = 1 << 20) -> Iterator[Record]:
    """The records of an archive from a file-like ``source``, one in memory at a time."""
    buffer, start = b"", 0  # start: the archive's offset of buffer[0]

    def more() -> bool:
        nonlocal buffer
        got = source.read(chunk)
        buffer += got
        return bool(got)

    while len(buffer) < 8 and more():
        pass
    magic, length = struct.unpack_from("<II", buffer)
    if magic != DICT_MAGIC:
        raise ValueError("the archive doesn't start with a dictionary frame")
    while len(buffer) < 8 + length:
        if not more():
            raise ValueError("the archive ends in its dictionary")
    raw = buffer[8 : 8 + length]
    if struct.unpack_from("<I", raw)[0] == ZSTD_MAGIC:
        raw = zstandard.ZstdDecompressor().decompress(raw)
    unpacker = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(raw))
    at = 8 + length
    while True:
        if at == len(buffer):
            start, buffer, at = start + at, b"", 0
            if not more():
                return
        frame, offset, parts = unpacker.decompressobj(), start + at, []
        while not frame.eof:
            if at == len(buffer):
                start, buffer, at = start + at, b"", 0
                if not more():
                    raise ValueError("the archive ends in a record")
            piece = buffer[at : at + (32 << 10)]
            parts.append(frame.decompress(piece))
            at += len(piece) - len(frame.unused_data)
        whole = b"".join(parts)
        head, _, block = whole.partition(b"\r\n\r\n")
        lines = head.decode().split("\r\n")
        headers = dict(line.split(": ", 1) for line in lines[1:])
        size = int(headers["Content-Length"])
        if lines[0] != "WARC/1.1" or block[size:] != b"\r\n\r\n":
            raise ValueError(f"no whole record at {offset}")
        yield Record(offset, headers, block[:size])


def _filesystem(path: str):
    """pyarrow's file system for ``path`` and the path in it; Hadoop's names for S3 are understood."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(re.sub(r"^s3[an]://", "s3://", path))


def _writer(folder: str, archive_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = _filesystem(folder)
        held: list[bytes] = []
        size = 0

        def flush() -> pa.RecordBatch:
            nonlocal held, size
            data, dict_bytes = write_archive(held)
            name = f"{uuid.uuid4().hex}.warc.zst"
            with system.open_output_stream(f"{base}/.{name}.part", compression=None) as out:
                out.write(data)
            system.move(f"{base}/.{name}.part", f"{base}/{name}")
            row = pa.record_batch([[f"{folder}/{name}"], [len(held)], [size], [len(data)], [dict_bytes]], names=["path", "records", "raw_bytes", "bytes", "dict_bytes"])
            held, size = [], 0
            return row

        for batch in batches:
            for page_id, url, payload, first in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                record = make_record(page_id, url, payload or b"", first, first is not None)
                held.append(record)
                size += len(record)
                if size >= archive_bytes:
                    yield flush()
        if held:
            yield flush()

    return run


def write_warc(pages: DataFrame, folder: str, min_bytes: int = 0, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Write a record for every row of ``pages(page_id, url, html)`` to archives in ``folder``; the manifest.

    A null html has an empty payload, a null url no target.  Payloads of at
    least ``min_bytes`` that are equal are one response, that with the smallest
    id, and revisits; rows that repeat the smallest id are all responses.  If
    all ids of equal payloads are null, all are responses.  An empty table
    writes no archive.  Other columns are not read.
    """
    spark = pages.sparkSession
    small_batches(spark)
    system, base = _filesystem(folder)
    system.create_dir(base, recursive=True)
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary").alias("payload"))
    keyed = rows.withColumn("key", F.concat_ws(":", F.sha1("payload"), F.octet_length("payload")))
    # written first, so that its size is known: few are sent to the payloads, many are merged with them, where a payload of many pages can be split
    firsts = cut(keyed.where(F.octet_length("payload") >= min_bytes).groupBy("key").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1").select("key", "first"))
    sent = F.broadcast(firsts) if firsts.count() <= SENT else firsts.hint("merge")
    marked = keyed.join(sent, "key", "left").select("page_id", "url", "payload", F.when(F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first")), F.col("first")).alias("first"))
    manifest = f"{folder}/manifest"
    marked.mapInArrow(_writer(folder, archive_bytes), MANIFEST).write.parquet(manifest)
    return spark.read.schema(MANIFEST).parquet(manifest)


def _reader(keep_payload: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url", "archive", "archive_offset", "payload"]
        kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary())

        def number(name: str | None) -> int | None:
            found = re.fullmatch(rf"<{ID}(-?[0-9]+)>", name or "")
            return int(found[1]) if found else None

        for batch in batches:
            for path in batch.column("path").to_pylist():
                system, file = _filesystem(path)
                rows: list[tuple] = []
                held = 0
                with system.open_input_stream(file, compression=None) as source:
                    for r in read_archive(source):
                        kind, digest = r.headers["WARC-Type"], r.headers.get("WARC-Payload-Digest", "").removeprefix("sha1:")
                        if kind == "warcinfo":
                            continue
                        http, _, payload = r.block.partition(b"\r\n\r\n")
                        length = int(re.search(rb"\r\nContent-Length: ([0-9]+)", http)[1])
                        if kind == "response" and (len(payload) != length or payload_digest(payload) != digest):
                            raise ValueError(f"the record at {r.offset} of {path} isn't what was written")
                        rows.append((number(r.headers["WARC-Record-ID"]), length, digest, kind, number(r.headers.get("WARC-Refers-To")), r.headers.get("WARC-Target-URI"), path, r.offset, payload if keep_payload and kind == "response" else None))
                        held += len(rows[-1][-1] or b"") + 300
                        if held > 4 << 20:
                            yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)
                            rows, held = [], 0
                if rows:
                    yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    return run


def read_warc(manifest: DataFrame, payloads: bool = True, task_bytes: int = TASK_BYTES) -> DataFrame:
    """Every record of the manifest's archives, digests checked.

    A task reads its archives one after another, a record at a time: about
    ``task_bytes`` of them, or fewer where that leaves cores without work.
    An empty manifest has no records.
    """
    size = manifest.agg(F.count("*").alias("n"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes")).first()
    least = 4 * manifest.sparkSession.sparkContext.defaultParallelism
    tasks = max(1, min(size.n, max(least, -(-size.bytes // task_bytes))))
    return manifest.select("path").repartition(tasks).mapInArrow(_reader(payloads), RECORDS)


def op1_warc(spark, sf_dir: str) -> DataFrame:
    """``write_warc`` over all of ``pages``, read back by ``read_warc``."""
    manifest = write_warc(table(spark, sf_dir, "pages"), scratch(spark, "warc"))
    return read_warc(manifest, payloads=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


_SQL_DIGEST = """(SELECT list_aggregate(list_transform(range(0, 32), lambda k: 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'[
    1 + CAST(substr(bits, 5 * k + 1, 1) AS INT) * 16 + CAST(substr(bits, 5 * k + 2, 1) AS INT) * 8 + CAST(substr(bits, 5 * k + 3, 1) AS INT) * 4
      + CAST(substr(bits, 5 * k + 4, 1) AS INT) * 2 + CAST(substr(bits, 5 * k + 5, 1) AS INT)]), 'string_agg', ''))"""

OP1_SQL = f"""
WITH p AS (SELECT page_id, url, coalesce(html, '') AS html FROM pages),
h AS (SELECT *, sha1(html) AS hex, CAST(strlen(html) AS BIGINT) AS n FROM p),
b AS (SELECT *, array_to_string(list_transform(range(1, 41), lambda k: ['0000','0001','0010','0011','0100','0101','0110','0111','1000','1001','1010','1011','1100','1101','1110','1111'][strpos('0123456789abcdef', substr(hex, k, 1))]), '') AS bits FROM h),
f AS (SELECT hex, n, min(page_id) AS first FROM h GROUP BY hex, n)
SELECT page_id, b.n AS payload_bytes, {_SQL_DIGEST} AS payload_digest,
       CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id = first THEN NULL ELSE first END AS refers_to
FROM b JOIN f ON b.hex = f.hex AND b.n = f.n
"""
