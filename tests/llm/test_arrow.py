"""The operators that run in Arrow batches: archives, quality, pages, packing, media and languages."""

import hashlib
import io
import struct
import wave
import zlib
from collections import defaultdict

import numpy as np
import pytest
import zstandard
from pyspark.sql import functions as F

from graphloom.llm import html, langid, media, packing, quality, warc
from graphloom.llm.queries import QUERIES

# archives


def pages(spark):
    rows = [(3, "http://a/1", "<p>same</p>"), (1, "http://a/2", "<p>same</p>"), (2, None, "<p>same</p>"), (4, "http://b c\n/", None), (5, "u", ""), (6, "u", "é" * 5000), (None, "u", "<p>same</p>"), (7, "u", "only"), (7, "u", "only")]
    return spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({"key": F.lit(1), "first": F.lit(2), "payload": F.lit(3), "n": F.lit(4)})


@pytest.mark.parametrize("sent", [warc.SENT, 0])
def test_archive_round_trip(spark, tmp_path, monkeypatch, sent):
    monkeypatch.setattr(warc, "SENT", sent)
    manifest = warc.write_warc(pages(spark), str(tmp_path / "w"))
    got = sorted(((r.page_id, r.record_type, r.refers_to, r.payload_bytes, r.payload and bytes(r.payload)) for r in warc.read_warc(manifest).collect()), key=str)
    same = len("<p>same</p>")
    want = [(1, "response", None, same, b"<p>same</p>"), (2, "revisit", 1, same, None), (3, "revisit", 1, same, None), (4, "response", None, 0, b""), (5, "revisit", 4, 0, None), (6, "response", None, 10000, "é".encode() * 5000), (7, "response", None, 4, b"only"), (7, "response", None, 4, b"only"), (None, "revisit", 1, same, None)]
    assert [(*g[:4], g[4] or None) for g in got] == sorted([(*w[:4], w[4] or None) for w in want], key=str)


def test_small_payloads_are_all_responses(spark, tmp_path):
    manifest = warc.write_warc(pages(spark), str(tmp_path / "w"), min_bytes=5)
    kinds = {(r.page_id, r.record_type) for r in warc.read_warc(manifest).collect()}
    assert {(4, "response"), (5, "response"), (3, "revisit")} <= kinds


def test_no_pages(spark, tmp_path):
    manifest = warc.write_warc(pages(spark).limit(0), str(tmp_path / "w"))
    assert warc.read_warc(manifest).count() == 0


def test_archive_format(spark, tmp_path):
    records = [warc.make_record(k, f"http://x/{k}", (b"<html><body><nav>menu</nav><p>page %d</p>" % k) * 20, None, False) for k in range(800)]
    data, dict_bytes = warc.write_archive(records)
    magic, length = struct.unpack_from("<II", data)
    assert magic == 0x184D2A5D
    raw = zstandard.ZstdDecompressor().decompress(data[8 : 8 + length])
    assert len(raw) == dict_bytes and raw[:4] == struct.pack("<I", 0xEC30A437)  # a trained dictionary
    found = list(warc.read_archive(io.BytesIO(data), chunk=777))
    assert len(found) == 801 and found[0].headers["WARC-Type"] == "warcinfo"
    # each record is a frame that can be read alone, from its offset
    alone = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(raw)).decompressobj().decompress(data[found[5].offset :])
    assert alone == records[4]
    plain = sum(len(zstandard.ZstdCompressor(level=6).compress(r)) for r in records)
    assert len(data) < plain
    with pytest.raises(ValueError):
        list(warc.read_archive(io.BytesIO(data[:-30])))
    with pytest.raises(ValueError):
        list(warc.read_archive(io.BytesIO(data[8 + length :])))


def test_warc_query(spark, sf):
    source = {r.page_id: (r.html or "").encode() for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    rows = QUERIES["op1_warc"](spark, sf).collect()
    assert len(rows) == len(source)
    for r in rows:
        assert (r.payload_bytes, r.payload_digest) == (len(source[r.page_id]), warc.payload_digest(source[r.page_id]))


# quality


def test_quality_on_held_out_rows(spark, sf):
    sf = sf.replace("sf0.001", "sf0.01")
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    rows = QUERIES["op4_quality"](spark, sf).collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in rows)
    held = [(r.predicted, labels[r.doc_id]) for r in rows if r.held_out and r.doc_id in labels]
    assert sum(a == b for a, b in held) / len(held) >= 0.85


def test_gradients_against_differences():
    rng = np.random.default_rng(3)
    net = quality.Network(rng.normal(0, 0.3, (quality.WIDTH, 256, quality.FILTERS)).astype(np.float64), rng.normal(0, 0.1, quality.FILTERS), rng.normal(0, 1, quality.FILTERS), rng.normal(0, 1, quality.FILTERS), np.zeros(1))
    batch = quality.layout([b"some text here " * 30, b"x", b""])
    y = np.array([1.0, 0.0, 1.0])

    def loss(n):
        z = quality._forward(n, batch)[-1]
        return float(np.sum(np.log1p(np.exp(z)) - y * z))

    passed = quality._forward(net, batch)
    slope = 1 / (1 + np.exp(-passed[-1])) - y
    grads = quality._gradients(net, batch, slope, passed)
    for which, at in ((0, (2, ord("t"), 3)), (0, (0, ord("e"), 7)), (1, (4,)), (2, (5,)), (3, (6,)), (4, (0,))):
        up, down = [[p.copy() for p in net] for _ in range(2)]
        up[which][at] += 1e-5
        down[which][at] -= 1e-5
        assert (loss(quality.Network(*up)) - loss(quality.Network(*down))) / 2e-5 == pytest.approx(float(grads[which][at]), abs=1e-4)


def test_scores_cover_whole_texts_and_odd_rows(spark, odd_docs, no_docs):
    good, bad = [b"plain words of a text here. " * k for k in range(3, 40)], [b"$$$ %%% ### junk!!! " * k for k in range(3, 40)]
    net = quality.train(good + bad, [1] * len(good) + [0] * len(bad))
    clean = b"plain words of a text here. " * 400
    late = clean + b"$$$ %%% ### junk!!! " * 2000
    assert quality.scores(net, [clean])[0] > 0.5 > quality.scores(net, [late])[0]
    alone = quality.scores(net, [late])[0]
    assert quality.scores(net, [clean, late, b""])[1] == pytest.approx(alone, rel=1e-4)
    assert quality.scores(net, []).shape == (0,)
    rows = quality.predict_quality(odd_docs, net).collect()
    assert len(rows) == odd_docs.count() and all(0 <= r.score <= 1 for r in rows)
    assert quality.predict_quality(no_docs, net).count() == 0
    assert quality.scores(quality.train([], []), [b"x"])[0] == pytest.approx(0.3)
    labels = spark.createDataFrame([(1, 1), (2, None), (None, 1), (7, 5)], "doc_id long, quality int")
    assert quality.scores(quality.fit_quality(odd_docs, labels), [b"x"])[0] == pytest.approx(0.3)


def test_long_texts_score_in_slabs_as_they_do_at_once():
    rng = np.random.default_rng(4)
    net = quality.train([bytes(rng.integers(32, 90, 300, dtype=np.uint8)) for _ in range(40)], [k % 2 for k in range(40)])
    for size in (0, 1, 115, 116, 117, 127, 128, 129, 244, 245, 1000, 5000, 8191):
        text = bytes(rng.integers(0, 256, size, dtype=np.uint8))
        for slab in (128, 256, 1024):
            assert quality.long_logit(net, text, slab) == pytest.approx(float(quality.logits(net, [text])[0]), rel=1e-4, abs=1e-5), (size, slab)


def test_responses_against_brute_force():
    """The network as its docstring has it, byte by byte."""
    rng = np.random.default_rng(5)
    net = quality.train([bytes(rng.integers(32, 90, 300, dtype=np.uint8)) for _ in range(20)], [k % 2 for k in range(20)])
    for size in (3, 200, 700):
        text = bytes(rng.integers(0, 256, size, dtype=np.uint8))
        halves = max(1, -(-(size + quality.WIDTH) // quality.HALF))
        data = text + bytes(halves * quality.HALF + quality.WIDTH - size)
        best = [[max(sum(float(net.filters[k][data[h * quality.HALF + at + k]][f]) for k in range(quality.WIDTH)) for at in range(0, quality.HALF, quality.STRIDE)) for f in range(quality.FILTERS)] for h in range(halves)]
        chunks = [[max(a, b) for a, b in zip(best[h], best[min(h + 1, halves - 1)], strict=True)] for h in range(max(1, halves - 1))]
        hidden = np.maximum(np.array(chunks) + net.bias, 0)
        want = hidden.mean(axis=0) @ net.mean + hidden.max(axis=0) @ net.most + net.base[0]
        assert float(quality.logits(net, [text])[0]) == pytest.approx(float(want), rel=1e-4, abs=1e-4)


def _peak_mb(function, *args):
    import tracemalloc

    tracemalloc.start()
    try:
        function(*args)
        return tracemalloc.get_traced_memory()[1] / 1e6
    finally:
        tracemalloc.stop()


def test_memory_for_very_long_texts():
    net = quality.train([b"good words"] * 4 + [b"$$$$"] * 4, [1] * 4 + [0] * 4)
    text = "words of many languages, les mots et die Wörter. " * (16 << 20 >> 6)
    data = text.encode()
    assert _peak_mb(quality.scores, net, [data]) < 100
    model = langid.learn([(f"l{k}", "".join(chr(97 + (k * j) % 26) for j in range(400))) for k in range(100)])
    assert _peak_mb(langid.identify, model, [text[: 4 << 20]]) < 250
    assert _peak_mb(media.features, media.to_wav(media.padded(data))) < 250


# pages

PAGE = """<!DOCTYPE html><html><head><title>t</title><style>p{}</style></head><body><header class="site-header"><h1>My Site</h1><a href=/>home</a></header>
<div id="cookie-notice">We use cookies to improve your experience on this site. Please accept all of them.</div>
<div class="layout"><div class="sidebar"><p>Popular posts this week are many and good to read for all.</p></div>
<div class="content"><h2>Title of it</h2><p>First para with <a href=x>link words</a> &amp; more&nbsp;text he<b>re</b>.</p><div class="advertisement">Buy now cheap stuff</div><p>Second
 para.<form><label>Name</label><input></form><script>if (a<b) "</p>"</script><aside>side words</aside><blockquote>Quoted text</blockquote><!-- no --></div>
<section class="comments"><p>Great article, I liked it a lot, thanks for sharing it with all of us here.</p></section></div><footer>&copy; 2020 all rights</footer></body></html>"""
ARTICLE = "Title of it First para with link words & more text here. Second para. Quoted text"


def test_article_without_marks():
    weights = html.learn([])
    assert html.extract(PAGE, weights) == ARTICLE
    assert html.extract(PAGE.replace('<div class="content">', "<main>"), weights) == ARTICLE


def test_names_of_containers():
    weights = html.learn([])
    for container in ('<div class="layout has-sidebar">', '<div class="page with-ads">', '<div id="comments-and-all">'):
        assert html.extract(PAGE.replace('<div class="layout">', container), weights) == ARTICLE
    assert html.extract(f'<body><div class="sidebar"><main>{"<p>words of it</p>" * 3}</main></div><footer>end</footer>', weights) == "words of it words of it words of it"
    table = "<table><tr><td>c1</td><td>c2</td></tr></table>"
    assert html.extract(f"<body><article>{table}<p>words of the article</p>{table}</article><p>end</p></body>", weights) == "c1 c2 words of the article c1 c2"
    assert html.extract('<body><div class="widget"><p>only this here</p></div>', weights) == "only this here"


@pytest.mark.parametrize("page", ["", "<", "<p", "<!--", "<script>", "</p></div>", "<p class='x", "&amp", "<nav>menu</nav>", "<b><i></b></i>", "\x00<p>\x00"])
def test_broken_pages(page):
    assert isinstance(html.extract(page, html.learn([])), str)


def test_quotes_that_never_close_take_linear_time():
    assert isinstance(html.extract("<a href=\"" * 3000 + "x", html.learn([])), str)


def test_pages_query(spark, sf):
    import html as entities
    import re

    source = {r.page_id: r for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    for r in QUERIES["op5_html"](spark, sf).collect():
        inner = re.search(r"<article>(.*)</article>", source[r.page_id].html, re.S)[1]
        assert r.text == " ".join(entities.unescape(re.sub(r"<[^>]*>", " ", inner)).split())
        assert (r.url, r.n_chars) == (source[r.page_id].url, len(r.text))


def test_pages_odd_rows(spark):
    rows = [(1, None, None), (None, "u", ""), (2, "u", PAGE), (2, "u", PAGE)]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({"text": F.lit(1), "n_chars": F.lit(2)})
    got = html.extract_pages(frame, html.fit_html(frame)).collect()
    assert sorted(r.text for r in got) == ["", "", ARTICLE, ARTICLE]
    assert html.extract_pages(frame.limit(0), html.fit_html(frame.limit(0))).count() == 0


def _learned(sf, sample=150):
    import pyarrow.parquet as pq

    pages = pq.read_table(f"{sf}/pages.parquet").column("html").to_pylist()
    return html.learn(pages[:sample]), pages


def test_learned_weights_find_articles_that_nothing_marks_or_names(sf):
    import html as entities
    import re

    sf = sf.replace("sf0.001", "sf0.01")
    weights, pages = _learned(sf)
    constant = html.Weights({"plain": 1.0, "link": 0.0}, {}, -0.5)
    right = dict.fromkeys(("learned", "constant"), 0)
    held_out = pages[150:]
    for page in held_out:
        inner = re.search(r"<article>(.*)</article>", page, re.S)[1]
        want = " ".join(entities.unescape(re.sub(r"<[^>]*>", " ", inner)).split())
        bare = re.sub(r"<(/?)(?:article|nav|footer)\b", r"<\1div", re.sub(r' class="[^"]*"', "", page))
        right["learned"] += html.extract(bare, weights) == want
        right["constant"] += html.extract(bare, constant) == want
    assert right["learned"] >= 0.95 * len(held_out) and right["constant"] < 0.5 * len(held_out)
    assert weights.words["plain"] > 0 and all(w < 0 for w in weights.tags.values())


def test_names_that_only_contain_another_elements_word(sf):
    weights, _ = _learned(sf)
    page = "<body><nav><a href=/>home</a></nav><main><h2 id='the-search-for-life'>The search for life</h2><p>It goes on and on.</p><section id='legal-history'><p>A long legal history is told here.</p></section></main><footer>end</footer></body>"
    assert html.extract(page, weights) == "The search for life It goes on and on. A long legal history is told here."
    shared = "<body><div class='entry-content share-enabled'><p>A story of many words that goes on for a while.</p><p>And some more of it.</p></div><div class='other'>One line.</div><div class='share-buttons'><p>Share this now with all of your friends and relatives everywhere please</p></div></body>"
    assert html.extract(shared, weights) == "A story of many words that goes on for a while. And some more of it."


def test_every_marked_article_stays(sf):
    weights, _ = _learned(sf)
    page = "<body><div>An advert of some words</div><article><p>The first article has some words.</p></article><div>Between them an advert</div><article><p>The second one has other words.</p></article><ol class='comment-list'><li><article class='comment'><p>I liked both of them very much indeed.</p></article></li></ol></body>"
    assert html.extract(page, weights) == "The first article has some words. The second one has other words."


def test_long_pages_and_ties(sf):
    weights, _ = _learned(sf)
    words = "some words of a paragraph. " * 40
    page = "<body><nav><a href=/>home</a></nav><article>" + f"<p>{words}</p>" * 4000 + "</article><footer>end</footer></body>"
    assert html.extract(page, weights) == " ".join((words * 4000).split())
    twice = "<body><div><div><p>one region of words</p></div></div><hr><div><div><p>two region of words</p></div></div></body>"
    assert html.extract(twice, html.Weights({"plain": 1.0, "link": 0.0}, {"hr": -99.0}, -1.0)) == "one region of words"


# packing


def test_pack_is_whole_and_tight():
    rng = np.random.default_rng(1)
    for lengths in (rng.integers(1, 2049, 600), np.minimum(2048, rng.lognormal(6, 1, 900).astype(int) + 1), np.array([2048] * 3 + [1]), np.array([], int), np.full(50, 1024)):
        bins = packing.pack(lengths)
        assert sorted(k for b in bins for k in b) == list(range(len(lengths)))
        assert all(lengths[b].sum() <= 2048 for b in bins)
        assert len(bins) <= -(-lengths.sum() // 2048) * 1.02 + 2


def test_local_search_needs_fewer_bins_than_best_fit_alone():
    rng = np.random.default_rng(8)
    saved = 0
    for _ in range(6):
        lengths = rng.integers(300, 1100, 400)
        alone = packing.best_fit(lengths, 2048)
        saved += len(alone) - len(packing.local_search(lengths, alone, 2048))
    assert saved > 0


def test_whole_sequences_are_routed_around_the_packer(spark):
    rows = [(1, "word " * 9000), (2, "a few words"), (None, "word " * 2500), (1, "word " * 9000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = packing.pack_documents(docs, packing.tokenizer_path()).collect()
    whole = [r for r in got if r.length == 2048]
    assert len(whole) == 9 and len({r.sequence_id for r in whole}) == 9 and all(r.offset == 0 and r.sequence_id < 0 for r in whole)
    assert {r.sequence_id for r in got if r.length < 2048}.isdisjoint({r.sequence_id for r in whole})


def test_local_search_empties_bins():
    lengths = np.array([6, 4, 6, 4, 5, 5])
    start = [[0], [1], [2], [3], [4], [5]]
    found = packing.local_search(lengths, start, 10)
    assert len(found) == 3 and all(lengths[b].sum() == 10 for b in found)
    # only an exchange of one for two helps here
    lengths = np.array([7, 3, 3, 4, 3])
    found = packing.local_search(lengths, [[0], [1, 2, 4], [3]], 10)
    assert len(found) == 2


def test_cached_ids_are_the_tokenizers():
    cached = packing.CachedTokenizer(packing.tokenizer_path())
    assert cached.plain
    for text in ("", "a b", "Don't I'LL they've", "THE!!", "x²½ £ß ÿ", "a<|endoftext|>b <|startoftext|>", "日本 語🙂", "é İ ŉ ǅ Σς", "a\x1cb\x85c　d\xa0e", "\t\n\r  ", "ab12.5", "«été»"):
        want = cached.tokenizer.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(cached.encode(text), "<u4").tolist() == want, text


def check_pieces(rows, texts):
    tokenizer = packing.CachedTokenizer(packing.tokenizer_path()).tokenizer
    by, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        by[r.doc_id].append(r)
        sequences[r.sequence_id].append((r.offset, r.length))
    for doc, copies in texts.items():
        want = []
        for text in copies:
            ids = np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
            want += [(k, a, len(ids[a : a + 2048]), zlib.crc32(ids[a : a + 2048].tobytes())) for k, a in enumerate(range(0, len(ids), 2048))]
        assert sorted((r.piece, r.start, r.length, r.ids_crc32) for r in by[doc]) == sorted(want)
    for places in sequences.values():
        upto = 0
        for offset, length in sorted(places):
            assert offset == upto
            upto += length
        assert upto <= 2048
    return len(sequences)


def test_packing_query(spark, sf):
    texts = {r.doc_id: [r.text] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = QUERIES["op6_packing"](spark, sf).collect()
    assert check_pieces(rows, texts) <= -(-sum(r.length for r in rows) // 2048) + 2


def test_packing_odd_rows(spark, odd_docs, no_docs):
    texts = defaultdict(list)
    for r in odd_docs.collect():
        texts[r.doc_id].append(r.text)
    check_pieces(packing.pack_documents(odd_docs, packing.tokenizer_path(), group=5).collect(), texts)
    assert packing.pack_documents(no_docs, packing.tokenizer_path()).count() == 0


# media


def test_wav_is_read_by_others_and_back():
    data = media.padded(b"hello")
    assert len(data) == 64 and len(media.padded(b"")) == 64 and len(media.padded(b"x" * 64)) == 64 and len(media.padded(b"x" * 65)) == 128
    with wave.open(io.BytesIO(media.to_wav(data))) as w:
        assert (w.getnchannels(), w.getsampwidth(), w.readframes(64)) == (1, 1, data)
    assert media.from_wav(media.to_wav(data)) == (data, media.RATE)
    with pytest.raises(ValueError):
        media.from_wav(b"RIFFxxxxWAVE")


def test_resampling_keeps_a_tone():
    tone = lambda n, rate: np.sin(2 * np.pi * 440 * n / rate)
    got = media.resample(tone(np.arange(8000), 16000))
    delay = (media.UP * media.TAPS - 1) / 2 / media.UP
    want = tone(np.arange(len(got)) * media.DOWN / media.UP - delay, 16000)
    assert len(got) == 5000 and np.abs(got - want)[100:-100].max() < 0.01


def test_hysteresis():
    db = np.array([0, 5, 1, -1, 4, -9, 1, 2, -9, 9.0])
    assert media.hysteresis(db, 3, -2) == [(0, 5), (9, 10)]
    assert media.hysteresis(np.array([]), 3, -2) == []


def test_tensors_have_one_shape():
    payload = media.padded(bytes(range(256)) * 80)
    back, feature, segments, data = media.features(media.to_wav(payload))
    table = media.unpack_tensors(data)
    assert back == payload and table.schema.field("span").type == media.tensor_type()
    assert sum(table["frames"].to_pylist()) == int(feature.split("x")[0])
    spans = list(zip(table["start_s"].to_pylist(), table["end_s"].to_pylist(), strict=True))
    assert all(a < b for a, b in spans) and all(x[1] == pytest.approx(y[0]) for x, y in zip(spans, spans[1:], strict=False))


def check_media(rows, texts):
    seen = {}
    for r in rows:
        payload = media.padded(texts[r.n_bytes, r.doc_id])
        assert (r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
        assert (r.media_bytes, r.media_sha256) == (len(media.to_wav(payload)), hashlib.sha256(media.to_wav(payload)).hexdigest())
        assert seen.setdefault(payload, r.feature) == r.feature


@pytest.mark.parametrize("size", [64, 448, 512, 4096, 4160, 20032])
def test_features_against_brute_force(size):
    """Resampling by its sum over the filter's taps, frames by a discrete Fourier sum, and slabs of any size alike."""
    rng = np.random.default_rng(size)
    payload = bytes(rng.integers(0, 256, size, dtype=np.uint8))
    x = (np.frombuffer(payload, np.uint8) - 128.0) / 128
    taps = np.empty(media.UP * media.TAPS)
    taps.reshape(media.TAPS, media.UP)[:] = media._phases()[:, ::-1].T
    y = [sum(taps[k] * x[(8 * j - k) // 5] for k in range(8 * j % 5, len(taps), 5) if 0 <= (8 * j - k) // 5 < len(x)) for j in range(-(-len(x) * 5 // 8))]
    assert media.resample(x) == pytest.approx(np.array(y))
    count = max(1, -(-max(0, len(y) - 256) // 128) + 1)
    y = np.array(y + [0.0] * ((count - 1) * 128 + 256 - len(y)))
    waves = np.exp(-2j * np.pi * np.outer(np.arange(129), np.arange(256)) / 256)
    want = [np.log(np.abs(waves @ (y[k * 128 : k * 128 + 256] * np.hanning(256))) ** 2 @ media._mel() + 1e-6) for k in range(count)]
    for slab in (64, 1024, 1 << 18):
        assert media.payload_mel(payload, slab) == pytest.approx(np.array(want), abs=1e-6)


def test_media_query(spark, sf):
    texts = {(len((r.text or "").encode()), r.doc_id): (r.text or "").encode() for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    check_media(QUERIES["op7_media"](spark, sf).collect(), texts)


def test_media_odd_rows(odd_docs, no_docs, tmp_path):
    rows = media.audio_features(media.store_media(odd_docs, str(tmp_path / "m"))).collect()
    assert len(rows) == odd_docs.count()
    check_media(rows, {(len((r.text or "").encode()), r.doc_id): (r.text or "").encode() for r in odd_docs.collect()})
    assert media.audio_features(media.store_media(no_docs, str(tmp_path / "e"))).count() == 0


# languages


def test_languages_on_held_out_rows(spark, sf):
    sf = sf.replace("sf0.001", "sf0.01")
    truth = {r.doc_id: r.lang for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = QUERIES["op10_langid"](spark, sf).collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 for r in rows)
    held = [r.lang_pred == truth[r.doc_id] for r in rows if r.held_out]
    assert sum(held) / len(held) >= 0.98


ENGLISH, GERMAN = "the cat and the dog went with their friend to this house when they thought of that. ", "der Hund und die Katze gehen nicht mit auf das Haus, weil sie schon immer zwischen ihnen sind. "


def test_mixtures():
    model = langid.learn([("en", ENGLISH * 9), ("de", GERMAN * 9)])
    everything, chosen = langid.mixtures(model, [ENGLISH * 20, GERMAN * 20, (ENGLISH * 10 + GERMAN * 10)])
    en, de = model.langs.index("en"), model.langs.index("de")
    assert chosen[0, de] == 0 and chosen[1, en] == 0
    assert 0.3 < chosen[2, en] < 0.7 and chosen[2].sum() == pytest.approx(1)
    # the same alone or in a batch
    assert np.allclose(langid.mixtures(model, [ENGLISH * 20])[0], everything[:1])


def test_mixtures_against_brute_force():
    """EM over windows as the docstring has it, one window and one language at a time."""
    import math

    rows = [("en", "the house and the garden with the small tree "), ("de", "das Haus und der Garten mit dem kleinen Baum "), ("fr", "la maison et le jardin avec le petit arbre ")]
    model = langid.learn([(lang, text * 20) for lang, text in rows])
    for text in ("the garden", rows[0][1] * 6 + rows[2][1] * 4, "maison und tree " * 30):
        grams = langid.trigrams(text)
        shares = [1 / 3] * 3
        cut = [grams[k : k + langid.WINDOW] for k in range(0, len(grams), langid.WINDOW)]
        logs = [[sum(float(model.table[g][k]) for g in w) * langid.TEMPER for k in range(3)] for w in cut]
        weight = [[math.exp(x - max(row)) for x in row] for row in logs]
        for _ in range(langid.ROUNDS):
            parts = [[w * s / sum(a * b for a, b in zip(row, shares, strict=True)) for w, s in zip(row, shares, strict=True)] for row in weight]
            shares = [sum(p[k] for p in parts) / len(parts) for k in range(3)]
        alone, _ = langid.mixtures(model, [text])
        many, _ = langid.mixtures(model, [text, rows[1][1]])
        assert alone[0] == pytest.approx(shares, abs=1e-3) and many[0] == pytest.approx(shares, abs=1e-3)


def test_what_is_a_letter():
    model = langid.learn([("en", "some words of a text"), ("de", "einige Wörter")])
    assert langid.identify(model, ["½ ² Ⅷ ① 12 _ !", "", None, "x", "ª", "日"])[0][:3] == ["und"] * 3
    assert "und" not in langid.identify(model, ["x", "ª", "日", "Ⅷ x"])[0]


def test_languages_beyond_two_hundred_are_learned(spark):
    rows = [(k, f"lang{k:03d}", "".join(chr(97 + (k * j * j + j) % 26) for j in range(300))) for k in range(230)]
    docs = spark.createDataFrame(rows, "doc_id long, lang string, text string")
    assert len(langid.fit_languages(docs).langs) > 150


def test_slabs_of_a_text_give_its_trigrams(monkeypatch):
    text = "Ein Text über dies & das, ÉTÉ. " * 20
    whole = langid.trigrams(text)
    monkeypatch.setattr(langid, "SLAB", 7)
    assert langid.trigrams(text).tolist() == whole.tolist()


def test_languages_odd_rows(odd_docs, no_docs):
    model = langid.fit_languages(odd_docs)
    got = {(r.doc_id, r.lang_pred) for r in langid.predict_languages(odd_docs, model).collect()}
    assert {(3, "und"), (4, "und"), (5, "und"), (6, "und"), (None, "und")} <= got and (8, "fr") in got
    kept = langid.drop_unidentified(odd_docs, model)
    assert kept.dtypes == odd_docs.dtypes and {r.doc_id for r in kept.collect()} == {1, 2, 7, 8, 9, 10, None}
    nothing = langid.fit_languages(no_docs)
    assert nothing.langs == () and langid.identify(nothing, ["words", None])[0] == ["und", "und"]
    assert langid.predict_languages(no_docs, model).count() == 0


def test_pipeline(spark, sf, odd_docs, no_docs, tmp_path):
    import corpus_pipeline

    odd_docs.select("doc_id", "text", "lang", "source", "n_chars").write.parquet(str(tmp_path / "odd" / "documents.parquet"))
    spark.read.parquet(f"{sf}/benchmark.parquet").write.parquet(str(tmp_path / "odd" / "benchmark.parquet"))
    assert [n for n, _ in corpus_pipeline.STAGES][:2] == ["language_id", "simhash_dedup"]
    rows = corpus_pipeline.run(spark, str(tmp_path / "odd")).collect()
    assert {r.doc_id for r in rows} == {1, 7, 8, 9, 10, None}
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    clean = {r.doc_id for r in docs.collect()}
    packed = corpus_pipeline.run(spark, sf).collect()
    assert {r.doc_id for r in packed} <= clean and len({r.doc_id for r in packed}) > 0.75 * len(clean)
    empty = no_docs.select("doc_id", "text", "lang", "source", "n_chars")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, sf).count() == 0
