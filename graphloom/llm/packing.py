"""Best-fit packing of token sequences with swap-based local search.

Documents are tokenized, closed by one end id and cut into pieces only if they
are longer than a sequence.  Whole sequences need no packing; the other pieces are
dealt into groups of a bounded number by a hash of their place, and each group is packed on its own:
best-fit decreasing first, then a local search that moves a piece, exchanges
one piece for one, or two for one, between underfull bins whenever that raises
the sum of squared fills, until no bin can be emptied any more.  A group of
thousands of pieces loses at most a fraction of a sequence against packing all
at once.

Style: Arrow batches.  The tokenizer is a library, and the local search is
imperative work on one bounded group.  What is shuffled is a row of numbers for
each piece, never text or ids.
"""

from __future__ import annotations

import bisect
import json
import os
import re
import struct
import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import cut, small_batches, table

LENGTH = 2048
END_ID = 0
#: Pieces in a group on average.
GROUP = 8000
#: Chunks, and words, whose ids a worker keeps in each of two generations.
CACHE = 250_000

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"

_WHOLE_LATIN = re.compile(r"[!-~\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+").fullmatch
_WORDS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z\u00df-\u00f6\u00f8-\u00ff]+|[0-9]|[^a-z0-9\u00df-\u00f6\u00f8-\u00ff]+").findall


class _Generations:
    """A mapping of bounded size: what wasn't used since the last turn but one is dropped."""

    def __init__(self, size: int) -> None:
        self.size = size
        self.new: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def turn(self) -> None:
        if len(self.new) > self.size:
            self.old, self.new = self.new, {}


class CachedTokenizer:
    """Token ids of whole texts, from the ids of their space-separated chunks.

    No token spans a space, newline, tab or carriage return in a tokenizer that
    drops white space, so a text's ids are its chunks' ids in order.  Chunks
    repeat; their ids are kept.  If the tokenizer's own rules are those of the
    49k-word vocabulary (lower case; letters, single digits, other signs), a
    new chunk of ASCII and Latin letters is cut into words here, whose ids are
    kept as well; any other chunk goes through the whole tokenizer.
    """

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.chunks = _Generations(CACHE)
        self.words = _Generations(CACHE)
        rules = json.loads(self.tokenizer.to_str())
        split = {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True}
        byte_level = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}
        normal = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]
        self.plain = rules["normalizer"] == {"type": "Sequence", "normalizers": normal} and rules["pre_tokenizer"] == {"type": "Sequence", "pretokenizers": [split, byte_level]} and not rules["post_processor"]
        self.marks = [t["content"] for t in rules["added_tokens"]]
        self.model = self.tokenizer.model
        # the byte-level alphabet: printable Latin-1 stands for itself, the other bytes for the characters from U+0100
        itself = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        other = iter(range(0x100, 0x200))
        self.alphabet = {chr(b): chr(b if b in itself else next(other)) for b in range(256)}

    def _word(self, word: str) -> bytes:
        if (ids := self.words.old.get(word)) is None:
            spelled = word if word.isascii() else "".join(map(self.alphabet.__getitem__, word.encode().decode("latin-1")))
            ids = b"".join(t.id.to_bytes(4, "little") for t in self.model.tokenize(spelled))
        self.words.new[word] = ids
        return ids

    def _chunk(self, chunk: str) -> bytes:
        if (ids := self.chunks.old.get(chunk)) is None:
            known = self.words.new
            body, end = (chunk, "") if chunk.isalpha() else (chunk[:-1], chunk[-1:])
            if self.plain and body.isalpha() and max(body) <= "\u00ff" and (not end or end in ".,;:!?"):
                word = body.lower()  # the common case: a word, perhaps with one sign after it
                ids = known[word] if word in known else self._word(word)
                if end:
                    ids += known[end] if end in known else self._word(end)
            elif self.plain and _WHOLE_LATIN(chunk) and not any(m in chunk for m in self.marks):
                ids = b"".join([known[w] if w in known else self._word(w) for w in _WORDS(chunk.lower())])
            elif chunk:
                ids = struct.pack(f"<{len(x := self.tokenizer.encode(chunk, add_special_tokens=False).ids)}I", *x)
            else:
                ids = b""
        self.chunks.new[chunk] = ids
        return ids

    def encode(self, text: str) -> bytes:
        """The text's ids as little-endian unsigned 32-bit numbers, without an end id."""
        for space in "\n\t\r":
            if space in text:
                text = text.replace(space, " ")
        chunks, known = text.split(" "), self.chunks.new
        try:
            out = b"".join([known[c] for c in chunks])
        except KeyError:
            out = b"".join([known[c] if c in known else self._chunk(c) for c in chunks])
            self.chunks.turn()
            self.words.turn()
        return out


@cache
def _tokenizer(path: str) -> CachedTokenizer:
    """One for each worker process, so that what it has learned outlives a task."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return CachedTokenizer(path)


def _pieces(path: str, length: int, end_id: int):
    end = end_id.to_bytes(4, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = _tokenizer(path)
        for batch in batches:
            docs, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            rows: list[tuple] = []
            for doc, text in zip(docs, texts, strict=True):
                ids = (tokenizer.encode(text) if text else b"") + end
                for k, at in enumerate(range(0, len(ids), 4 * length)):
                    part = ids[at : at + 4 * length]
                    rows.append((doc, k, at // 4, len(part) // 4, zlib.crc32(part)))
            columns = list(zip(*rows, strict=True)) if rows else [()] * 5
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.record_batch([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return run


def token_pieces(docs: DataFrame, path: str, length: int = LENGTH, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32``: every document as pieces of at most ``length`` ids; null texts are empty."""
    small_batches(docs.sparkSession)
    few = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return few.mapInArrow(_pieces(path, length, end_id), PIECES)


def best_fit(lengths: np.ndarray, capacity: int) -> list[list[int]]:
    """Best-fit decreasing: each piece, longest first, into the fullest bin it fits."""
    order = np.argsort(-lengths, kind="stable")
    bins: list[list[int]] = []
    open_bins: list[tuple[int, int]] = []  # (room, bin), sorted
    for k in order:
        size = int(lengths[k])
        at = bisect.bisect_left(open_bins, (size, -1))
        if at == len(open_bins):
            bins.append([int(k)])
            room, number = capacity - size, len(bins) - 1
        else:
            room, number = open_bins.pop(at)
            bins[number].append(int(k))
            room -= size
        if room > 0:
            bisect.insort(open_bins, (room, number))
    return bins


def local_search(lengths: np.ndarray, bins: list[list[int]], capacity: int, rounds: int = 20) -> list[list[int]]:
    """Raise the sum of squared fills by moves, one-for-one and two-for-one exchanges until no bin empties.

    Only underfull bins take part.  The emptiest bin is the donor: each of its
    pieces tries to move into a bin, to be exchanged for a smaller piece, or
    for two pieces that are smaller together, so that the receiver gets fuller
    and the donor emptier; squared fill rises with every step, so the search
    ends.  ``rounds`` bounds the donors that are tried without a bin emptying.
    """
    size = lengths.tolist()
    bins = [list(b) for b in bins]
    fill = [sum(size[k] for k in b) for b in bins]
    under = sorted((k for k in range(len(bins)) if fill[k] < capacity), key=lambda k: fill[k])
    # no packing has fewer bins than the pieces fill, or than there are pieces over half a bin
    floor = max(-(-sum(size) // capacity), sum(2 * x > capacity for x in size))
    used, tries = len(bins), 0
    while len(under) > 1 and used > floor and tries < rounds:
        donor = under[min(tries, len(under) - 1)]
        tries += 1
        better = True
        while better and bins[donor]:
            better = False
            for k in sorted(bins[donor], key=lambda k: -size[k]):
                step = _step(size, bins, fill, under, donor, k, capacity)
                if step is None:
                    continue
                other, back = step
                bins[donor].remove(k)
                for j in back:
                    bins[other].remove(j)
                bins[other].append(k)
                bins[donor].extend(back)
                moved = size[k] - sum(size[j] for j in back)
                fill[other] += moved
                fill[donor] -= moved
                better = True
                break
        if not bins[donor]:
            used, tries = used - 1, 0
        under = sorted((k for k in under if bins[k] and fill[k] < capacity), key=lambda k: fill[k])
    return [b for b in bins if b]


def _step(size: list[int], bins: list[list[int]], fill: list[int], under: list[int], donor: int, k: int, capacity: int) -> tuple[int, list[int]] | None:
    """The bin that takes piece ``k`` and the pieces it gives back, so that it gets as full as it can."""
    best: tuple[int, int, list[int]] | None = None
    for other in under:
        if other == donor or not bins[other]:
            continue
        room = capacity - fill[other]
        if size[k] <= room:  # a move
            gains = (size[k], [])
        else:
            least = size[k] - room  # what must come back at least
            if least >= size[k]:
                continue
            gains = _exchange(size, bins[other], least, size[k])
            if gains is None:
                continue
        gain, back = gains
        # squared fill rises only if the receiver ends above where the donor stood
        if fill[other] + gain <= fill[donor]:
            continue
        left = capacity - fill[other] - gain
        if best is None or left < best[0]:
            best = (left, other, back)
            if left == 0:
                break
    return None if best is None else (best[1], best[2])


def _exchange(size: list[int], pieces: list[int], least: int, most: int) -> tuple[int, list[int]] | None:
    """One piece, or two, whose sum is as small as possible in ``[least, most)``, with the gain ``most - sum``."""
    found: tuple[int, list[int]] | None = None
    by_size = sorted(pieces, key=lambda j: size[j])
    sizes = [size[j] for j in by_size]
    at = bisect.bisect_left(sizes, least)
    if at < len(sizes) and sizes[at] < most:
        found = (sizes[at], [by_size[at]])
    low, high = 0, len(sizes) - 1
    while low < high:
        total = sizes[low] + sizes[high]
        if total < least:
            low += 1
        else:
            if total < most and (found is None or total < found[0]):
                found = (total, [by_size[low], by_size[high]])
            high -= 1
    return None if found is None else (most - found[0], found[1])


def pack(lengths: np.ndarray, capacity: int = LENGTH) -> list[list[int]]:
    """Bins of piece numbers, none over ``capacity``; full pieces have a bin of their own."""
    whole = np.flatnonzero(lengths >= capacity)
    rest = np.flatnonzero(lengths < capacity)
    part = lengths[rest]
    bins = local_search(part, best_fit(part, capacity), capacity) if len(rest) else []
    return [[int(k)] for k in whole] + [[int(rest[k]) for k in b] for b in bins]


def _packer(capacity: int):
    def run(group: pa.Table) -> pa.Table:
        order = group.sort_by([("doc_id", "ascending"), ("piece", "ascending"), ("length", "ascending")])
        lengths = order["length"].to_numpy()
        number = int(order["bucket"][0].as_py())
        sequence, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
        for at, members in enumerate(pack(lengths, capacity)):
            upto = 0
            for k in members:
                sequence[k], offset[k] = (number << 32) + at, upto
                upto += int(lengths[k])
        kept = order.select(["doc_id", "piece", "start", "length", "ids_crc32"])
        return kept.append_column("sequence_id", pa.array(sequence)).append_column("offset", pa.array(offset))

    return run


def pack_documents(docs: DataFrame, path: str, length: int = LENGTH, end_id: int = END_ID, group: int = GROUP, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: ``doc_id, piece, start, length, ids_crc32, sequence_id, offset``.

    Null and empty texts are one piece that holds the end id.  Repeated rows
    and repeated or null ids each give their pieces.  An empty table gives
    none.  A piece as long as a sequence is one, whatever its document's
    length, and takes no part in the packing.  Other columns are not read.
    """
    pieces = cut(token_pieces(docs, path, length, end_id, id_col, text_col))
    place = F.monotonically_increasing_id()
    whole = pieces.where(F.col("length") >= length).select("*", (-1 - place).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    rest = pieces.where(F.col("length") < length)
    groups = max(1, -(-rest.count() // group))
    # rows that share an id are told apart by the place they were read at, so no id makes a large group
    dealt = rest.select("*", F.pmod(F.xxhash64("doc_id", "piece", place), F.lit(groups)).alias("bucket"))
    packed = dealt.groupBy("bucket").applyInArrow(_packer(length), PIECES + ", sequence_id long, offset long")
    return whole.unionByName(packed)


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op6_packing(spark, sf_dir: str) -> DataFrame:
    """``pack_documents`` over all of ``documents``."""
    return pack_documents(table(spark, sf_dir, "documents"), tokenizer_path())
