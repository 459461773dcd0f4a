"""Benchmark decontamination by a hash set of normalised test n-grams.

A window is ``n`` consecutive words of a benchmark item (an item of fewer words
is one window).  Every window of every document is hashed and looked up in the
set of window hashes; a lookup that succeeds is verified against the window's
words.  The set travels as a literal of the plan, behind a check of its number
and bytes.

Of a larger benchmark a bitmap of the hashes travels instead, a row of at most
``MAX_BITS`` bits.  Only places that it lets through leave their document, as
hashes, and only documents that have such places are shuffled; they are
verified in a join with the windows, and what the bitmap lets through by chance
falls out there.  The result is the same.

Style: DataFrame functions only.  The scan is one pass over the text without
a shuffle; only the ids of matching windows and documents are exchanged.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import BETWEEN_WORDS, ascii_lower, cut, let, spaced_words, table

WINDOW = 10
#: Bounds of the hash set that is sent with the plan.
MAX_WINDOWS = 50_000
MAX_BYTES = 8 << 20
#: Bits of the bitmap for a window, and of all of it (16 MB).
BITS_EACH, MAX_BITS = 32, 1 << 27

_HIT = "array<struct<at:bigint,len:bigint,gram:string>>"


def _words(text: Column) -> Column:
    spaced = spaced_words(text)
    return let(spaced, lambda s: F.when(s == "", F.array().cast("array<string>")).otherwise(F.split(s, " ")))


def benchmark_windows(bench: DataFrame, n: int = WINDOW, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """``(gram, len, hash, items)``: every distinct window with the ids of the items that hold it."""
    words = bench.select(F.col(id_col).alias("item"), _words(F.col(text_col)).alias("words")).where(F.size("words") > 0)
    size = F.size("words")
    length = F.least(size, F.lit(n))
    at = words.select("item", "words", length.alias("len"), F.explode(F.sequence(F.lit(1), size - length + 1)).alias("at"))
    piece = F.slice("words", F.col("at"), F.col("len"))
    grams = at.select("item", F.col("len").cast("long").alias("len"), F.array_join(piece, " ").alias("gram"), F.xxhash64(piece).alias("hash"))
    return grams.groupBy("gram", "len", "hash").agg(F.collect_set("item").alias("items"))


def _scan(words: Column, lengths: list[int], wanted) -> Column:
    """The windows of ``words`` that ``wanted(length, piece)`` lets through, as an array of hits."""

    def of(length: int) -> Column:
        starts = F.when(F.size(words) >= length, F.sequence(F.lit(1), F.size(words) - (length - 1))).otherwise(F.array().cast("array<int>"))
        kept = F.filter(starts, lambda i: wanted(length, F.slice(words, i, length)))
        return F.transform(kept, lambda i: F.struct((i - 1).cast("long").alias("at"), F.lit(length).cast("long").alias("len"), F.array_join(F.slice(words, i, length), " ").alias("gram")))

    return F.concat(F.array().cast(_HIT), *map(of, lengths))


def scan(docs: DataFrame, windows: DataFrame, text_col: str = "text", max_windows: int = MAX_WINDOWS, max_bytes: int = MAX_BYTES) -> DataFrame:
    """``(row, n_words, hits)``: each row of ``docs`` as a struct with its verified window hits, in order of place."""
    size = windows.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.octet_length("gram") + 16), F.lit(0)).alias("b"), F.collect_set("len").alias("lens")).first()
    lengths = sorted(size.lens)
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(text_col).cast("string").alias("text"))
    if size.n <= max_windows and size.b <= max_bytes:
        found = windows.select("len", "hash", "gram").collect()
        hashes = {k: sorted({r.hash for r in found if r.len == k}) for k in lengths}
        grams = {k: sorted(r.gram for r in found if r.len == k) for k in lengths}

        def wanted(k: int, piece: Column) -> Column:
            return F.xxhash64(piece).isin(hashes[k]) & F.array_join(piece, " ").isin(grams[k])

        both = let(_words(F.col("text")), lambda w: F.struct(F.size(w).cast("long").alias("n"), F.array_sort(_scan(w, lengths, wanted)).alias("hits")))
        return rows.select("row", both.alias("x")).select("row", F.col("x.n").alias("n_words"), F.col("x.hits").alias("hits"))

    # beyond the bound: what the bitmap lets through is verified in a join
    bits = min(MAX_BITS, 1 << max(10, (size.n * BITS_EACH - 1).bit_length()))
    words = windows.select(F.pmod(F.col("hash"), F.lit(bits)).alias("at")).select((F.col("at") / 64).cast("long").alias("word"), F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod("at", F.lit(64)).cast("int")).alias("bit"))
    every = windows.sparkSession.range(bits // 64).toDF("word").join(words.groupBy("word").agg(F.bit_or("bit").alias("bit")), "word", "left")
    bitmap = cut(every.agg(F.transform(F.array_sort(F.collect_list(F.struct("word", F.coalesce("bit", F.lit(0)).alias("bit")))), lambda x: x["bit"]).alias("bitmap")))

    def places(words: Column, bitmap: Column) -> Column:
        def of(length: int) -> Column:
            starts = F.when(F.size(words) >= length, F.sequence(F.lit(1), F.size(words) - (length - 1))).otherwise(F.array().cast("array<int>"))
            hashed = F.transform(starts, lambda i: F.struct((i - 1).cast("long").alias("at"), F.lit(length).cast("long").alias("len"), F.xxhash64(F.slice(words, i, length)).alias("hash")))
            return F.filter(hashed, lambda x: let(F.pmod(x["hash"], F.lit(bits)), lambda h: F.getbit(F.get(bitmap, (h / 64).cast("int")), F.pmod(h, F.lit(64)).cast("int")) == 1))

        return F.concat(F.array().cast("array<struct<at:bigint,len:bigint,hash:bigint>>"), *map(of, lengths))

    # the bitmap is one row of a checked size
    scanned = rows.crossJoin(F.broadcast(bitmap)).select("row", "text", let(_words(F.col("text")), lambda w: F.struct(F.size(w).cast("long").alias("n_words"), places(w, F.col("bitmap")).alias("places"))).alias("x"))
    kept = cut(scanned.select("row", "x.n_words", "x.places", F.when(F.size("x.places") > 0, F.col("text")).alias("text")))
    clean = kept.where(F.size("places") == 0).select("row", "n_words", F.array().cast(_HIT).alias("hits"))
    marked = cut(kept.where(F.size("places") > 0).withColumn("uid", F.monotonically_increasing_id()))
    each = marked.select("uid", _words(F.col("text")).alias("words"), "places").select("uid", F.explode(F.transform("places", lambda x: F.struct(x["at"].alias("at"), x["len"].alias("len"), x["hash"].alias("hash"), F.array_join(F.slice("words", (x["at"] + 1).cast("int"), x["len"].cast("int")), " ").alias("gram")))).alias("x"))
    grams = windows.select(F.col("hash").alias("_hash"), F.col("gram").alias("_gram"))
    hits = each.join(grams.hint("shuffle_hash"), (F.col("x.hash") == F.col("_hash")) & (F.col("x.gram") == F.col("_gram")), "left_semi")
    hits = hits.groupBy("uid").agg(F.array_sort(F.collect_list(F.struct("x.at", "x.len", "x.gram"))).cast(_HIT).alias("hits"))
    joined = marked.select("row", "n_words", "uid").join(hits, "uid", "left").select("row", "n_words", F.coalesce("hits", F.array().cast(_HIT)).alias("hits"))
    return clean.unionByName(joined)


def _covered(hits: Column) -> Column:
    """How many words the hits cover, each counted once."""
    zero = F.lit(0).cast("long")

    def step(state: Column, hit: Column) -> Column:
        end = hit["at"] + hit["len"]
        more = F.greatest(zero, end - F.greatest(hit["at"], state["upto"]))
        return F.struct((state["n"] + more).alias("n"), F.greatest(state["upto"], end).alias("upto"))

    return F.aggregate(hits, F.struct(zero.alias("n"), zero.alias("upto")), step, lambda s: s["n"])


def contamination(docs: DataFrame, bench: DataFrame, n: int = WINDOW, id_col: str = "doc_id", **bounds) -> DataFrame:
    """Per row of ``docs``: ``doc_id, n_words, n_hit, n_items, items_sha256, contaminated``.

    Null and empty texts have no words and hit nothing; items without words are
    never hit; null item ids don't count as items; ties don't arise, as every
    hit counts.  Repeated rows each give their row, null ids stay null, long
    texts are read whole, an empty table gives no rows and an empty benchmark
    no hits.  Other columns are not read.
    """
    windows = benchmark_windows(bench, n)
    found = scan(docs.select(F.col(id_col).alias("doc_id"), "text"), windows, **bounds)
    rows = found.select(
        F.monotonically_increasing_id().alias("uid"), F.col("row.doc_id").alias("doc_id"), "n_words", _covered(F.col("hits")).alias("n_hit"),
        F.array_distinct(F.transform("hits", lambda h: h["gram"])).alias("grams"),
    )
    named = rows.select("uid", "doc_id", "n_words", "n_hit", F.explode_outer("grams").alias("gram")).join(windows.select("gram", "items"), "gram", "left")
    items = F.array_distinct(F.flatten(F.collect_set("items")))
    per = named.groupBy("uid").agg(F.first("doc_id").alias("doc_id"), F.first("n_words").alias("n_words"), F.first("n_hit").alias("n_hit"), items.alias("items"))
    listed = F.array_join(F.array_sort(F.transform("items", lambda i: i.cast("string"))), ",")
    return per.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(listed, 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def decontaminate(docs: DataFrame, bench: DataFrame, n: int = WINDOW, mode: str = "documents", text_col: str = "text", **bounds) -> DataFrame:
    """``docs`` without contaminated rows (``documents``) or without the hit words (``spans``).

    All columns are kept as they are, whatever their names; ``spans`` changes
    only ``text_col``: hit words go, with what stands between two of them.
    Null texts stay null, empty ones empty, repeated rows stay or go together,
    long texts are read whole, and an empty table or benchmark changes nothing.
    """
    found = scan(docs, benchmark_windows(bench, n), text_col, **bounds)
    if mode == "documents":
        return found.where(F.size("hits") == 0).select("row.*")
    if mode != "spans":
        raise ValueError("mode is 'documents' or 'spans'")
    return found.select(*[(_without_hits() if c == text_col else F.col(f"row.`{c}`")).alias(c) for c in docs.columns])


def _without_hits() -> Column:
    """The text without its hit words; a gap goes if the words on both its sides do."""
    text = F.col("row.text")
    return F.when(F.size("hits") == 0, text).otherwise(
        let(
            F.struct(F.split(text, r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", -1).alias("gaps"), F.regexp_extract_all(text, F.lit(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"), F.lit(0)).alias("words")),
            lambda s: let(
                F.array_distinct(F.flatten(F.transform("hits", lambda h: F.sequence(h["at"], h["at"] + h["len"] - 1)))),
                lambda hit: F.concat(
                    F.element_at(s["gaps"], 1),
                    F.array_join(
                        F.transform(
                            s["words"],
                            lambda w, i: F.when(
                                F.array_contains(hit, i.cast("long")),
                                F.when(F.array_contains(hit, i.cast("long") + 1), "").otherwise(F.get(s["gaps"], i + 1)),
                            ).otherwise(F.concat(w, F.get(s["gaps"], i + 1))),
                        ),
                        "",
                    ),
                ),
            ),
        )
    )


def op3_decontaminate(spark, sf_dir: str) -> DataFrame:
    """``contamination`` of all of ``documents`` by all of ``benchmark``."""
    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


_SQL_WORDS = r"""regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"""

OP3_SQL = f"""
WITH items AS (SELECT item_id, {_SQL_WORDS} AS w FROM benchmark),
wins AS (
  SELECT DISTINCT item_id, least(len(w), {WINDOW}) AS k, array_to_string(w[p:p + least(len(w), {WINDOW}) - 1], ' ') AS gram
  FROM (SELECT item_id, w, unnest(generate_series(1, len(w) - least(len(w), {WINDOW}) + 1)) AS p FROM items WHERE len(w) > 0)
),
d AS (SELECT row_number() OVER () AS uid, doc_id, {_SQL_WORDS} AS w FROM documents),
lens AS (SELECT DISTINCT k FROM wins),
grams AS (
  SELECT uid, p, k, array_to_string(w[p:p + k - 1], ' ') AS gram
  FROM (SELECT uid, w, k, unnest(generate_series(1, len(w) - k + 1)) AS p FROM d, lens WHERE len(w) >= k)
),
hits AS (SELECT uid, p, wins.k, item_id FROM grams JOIN wins ON grams.gram = wins.gram AND grams.k = wins.k),
covered AS (SELECT uid, count(DISTINCT x) AS n_hit FROM (SELECT uid, unnest(generate_series(p, p + k - 1)) AS x FROM hits) GROUP BY uid),
found AS (SELECT uid, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS ids FROM (SELECT DISTINCT uid, CAST(item_id AS VARCHAR) AS i FROM hits) GROUP BY uid)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN covered USING (uid) LEFT JOIN found USING (uid)
"""
