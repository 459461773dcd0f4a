"""License scans, decontamination and personal data, against SQL and brute force."""

import glob
import hashlib
import os
import random
import re
from collections import Counter

import duckdb
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from graphloom.llm import decontaminate, licenses, pii
from graphloom.llm.queries import ORACLES, QUERIES
from graphloom.llm.spans import blocks, find_all, piece

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
UPPER = {k: k + 32 for k in range(65, 91)}


def words(text):
    return WORD.findall((text or "").translate(UPPER))


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_oracle(spark, sf, name):
    con = duckdb.connect()
    for f in glob.glob(f"{sf}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    got, want = QUERIES[name](spark, sf).toArrow(), con.sql(ORACLES[name]).to_arrow_table()
    columns = sorted(want.column_names)
    assert sorted(got.column_names) == columns
    count = lambda t: Counter(zip(*[t[c].to_pylist() for c in columns], strict=True))
    assert count(got) == count(want)


def test_no_python_in_native_plans(spark, odd_docs):
    bench = spark.createDataFrame([(1, "fox jumps over the lazy dog")], "item_id long, text string")
    model = pii.fit([])
    for frame in (licenses.scan_licenses(odd_docs), decontaminate.contamination(odd_docs, bench), odd_docs.select(pii.find_pii(odd_docs, model))):
        assert not re.search("Python|Pandas|Arrow", frame._jdf.queryExecution().executedPlan().toString())


# places of matches


def test_find_all_places(spark):
    texts = ["", "aXbXX", "XX", "é🙂Xa X", "none"]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select("t", find_all(F.col("t"), "X+").alias("m")).collect()
    for r in got:
        assert [(m.start, m.end, m.value) for m in r.m] == [(m.start(), m.end(), m[0]) for m in re.finditer("X+", r.t)]


# licenses

CASES = {
    "Released under the MIT License.": (1, "mit", "mit"),
    "Licensed under CC BY-NC 4.0.": (0, "", "cc-by-nc-4.0"),
    "Licensed under the Apache License, Version 2.0.": (1, "apache", "apache,apache-2.0"),
    "This work is licensed under the GNU General Public License, version 3.": (1, "gpl", "gpl,gpl-3.0"),
    "SPDX-License-Identifier: BSD-3-Clause": (0, "", "bsd-3-clause"),
    "Mozilla Public License 2.0 and mit license; MIT LICENSE": (2, "mit", "mit,mpl-2.0"),
    "mit der Lizenz und mit dem Server": (0, "", ""),
    "submit license mitlicense": (0, "", ""),
    "nothing here": (0, "", ""),
}


def test_license_rules(spark, tmp_path):
    assert len(licenses.rules()) >= 200
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(CASES)], "doc_id long, text string")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: r for r in QUERIES["op2_licenses"](spark, str(tmp_path)).collect()}
    for k, (n, base, labels) in enumerate(CASES.values()):
        assert (got[k].n_base, got[k].base_labels, got[k].labels) == (n, base, labels)
        assert 0 <= got[k].score <= 1 and (got[k].score > 0) == bool(labels)


def test_contained_detections_are_suppressed(spark):
    docs = spark.createDataFrame([(1, "licensed under the Apache License, Version 2.0")], "doc_id long, text string")
    found = licenses.scan_licenses(docs).first().found
    assert len(found) == 1 and (found[0].start, found[0].end, found[0].label) == (0, 8, "apache-2.0")


def test_license_odd_rows(odd_docs, no_docs):
    rows = licenses.scan_licenses(odd_docs).collect()
    assert len(rows) == odd_docs.count() and {r.n_words for r in rows if r.doc_id in (3, 4, 5)} == {0}
    assert [r.n_words for r in rows if r.doc_id == 6] == [1]
    assert licenses.scan_licenses(no_docs).count() == 0


# decontamination


def brute_contamination(docs, bench, n=10):
    windows = []
    for item, text in bench:
        w = words(text)
        k = min(n, len(w))
        windows += [(item, tuple(w[a : a + k])) for a in range(len(w) - k + 1)] if w else []
    out = []
    for doc, text in docs:
        w, hit, items = words(text), set(), set()
        for item, window in windows:
            for a in range(len(w) - len(window) + 1):
                if tuple(w[a : a + len(window)]) == window:
                    hit.update(range(a, a + len(window)))
                    items |= {item} - {None}
        listed = ",".join(sorted(map(str, items)))
        out.append((doc, len(w), len(hit), len(items), hashlib.sha256(listed.encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


@pytest.mark.parametrize("bounds", [{}, {"max_windows": 0}, {"max_bytes": 0}])
def test_contamination_against_brute_force(spark, bounds):
    rng = random.Random(5)
    say = lambda k: " ".join(rng.choice("ab cd E f gé".split()) for _ in range(k))
    bench = [(1, say(14)), (2, say(30)), (3, "cd E f"), (4, None), (5, ""), (None, say(12)), (3, "cd, e; F"), (6, "gé")]
    docs = [(k, say(rng.randrange(40))) for k in range(25)] + [(98, f"x {bench[0][1]} y {bench[1][1]} z"), (99, None), (99, ""), (None, "CD e... f"), (100, bench[1][1]), (100, bench[1][1])]
    got = decontaminate.contamination(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(bench, "item_id long, text string"), **bounds)
    assert sorted(map(tuple, got.collect()), key=str) == brute_contamination(docs, bench)


@pytest.mark.parametrize("bounds", [{}, {"max_windows": 0}])
def test_decontaminate_odd_rows(spark, odd_docs, no_docs, bounds):
    bench = spark.createDataFrame([(1, "brown fox jumps over the lazy dog near the river bank today")], "item_id long, text string")
    kept = decontaminate.decontaminate(odd_docs, bench, **bounds)
    assert kept.dtypes == odd_docs.dtypes and kept.count() == odd_docs.count() - 3
    spans = decontaminate.decontaminate(odd_docs, bench, mode="spans", **bounds)
    assert spans.columns == odd_docs.columns and spans.count() == odd_docs.count()
    assert {r.text for r in spans.where("doc_id in (1, 2)").collect()} == {"The quick ."}
    assert decontaminate.decontaminate(no_docs, bench, **bounds).count() == 0
    nothing = bench.limit(0)
    assert decontaminate.decontaminate(odd_docs, nothing).count() == odd_docs.count()
    with pytest.raises(ValueError):
        decontaminate.decontaminate(odd_docs, bench, mode="other")


# personal data

BASE = (("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"))


def luhn(digits):
    return sum(d if k % 2 == 0 else d * 2 - 9 * (d > 4) for k, d in enumerate(map(int, reversed(digits)))) % 10 == 0


def brute_spans(text):
    out = []
    for kind, form in BASE:
        for m in re.finditer(form, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            ok = {"email": True, "ip": kind != "ip" or all(int(p) <= 255 for p in m[0].split(".")), "card": 13 <= len(digits) <= 19 and luhn(digits), "phone": 9 <= len(digits) <= 15}[kind]
            if ok:
                out.append(f"{kind}:{m.start()}:{m.end()}")
    return out


def base_spans(spark, texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    model = pii.fit([])
    got = docs.select("doc_id", pii.find_pii(docs, model).alias("s")).collect()
    return {r.doc_id: [f"{pii.KINDS[s.kind]}:{s.start}:{s.end}" for s in r.s if s.base] for r in got}


HAND = [
    None, "", "a@b.c", "a@b", "a@b@c.de f@g.h.", "x a.b+c@d-e.f.gh, i@j.k_l@m.no", "@@a@b.c", "1.2.3.4.5.6.7.8", "256.1.1.1 0255.1.1.1 1.2.3.4000", "4111 1111 1111 1111", "4111-1111-1111-1112 378282246310005",
    "+1 (702) 555-0742 and +49 30 123456", "+1+2 345 678 901", "+12345678 +1234567890123456", "é🙂 4111111111111111é a@b.co🙂", "1 " * 40, "9" * 3000, "1.1." * 800, "a" * 3000 + "@", "+1" + " " * 2000, "a@" + "b." * 500 + "c",
]


def test_base_spans_by_hand(spark):
    got = base_spans(spark, HAND)
    for k, text in enumerate(HAND):
        assert got[k] == brute_spans(text), text


def test_base_spans_fuzzed(spark):
    @settings(max_examples=6, deadline=None, derandomize=True)
    @given(st.lists(st.text(st.sampled_from("0123456789.@+- ()aZ_%é5411"), max_size=40), min_size=60, max_size=60))
    def check(texts):
        got = base_spans(spark, texts)
        for k, text in enumerate(texts):
            assert got[k] == brute_spans(text), text

    check()


def test_query_against_brute_force(spark, sf):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    for r in QUERIES["op8_pii"](spark, sf).collect():
        want = brute_spans(docs[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(",".join(want).encode()).hexdigest()
        assert set(want) <= set(filter(None, r.spans.split(",")))
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(s.startswith(k) for s in want) for k in pii.KINDS]


def _row(n, **given):
    plain = {"kind": 0, **dict.fromkeys(pii.LABELERS, 1), **dict.fromkeys(pii.FEATURES, 0), "context": 0}
    return plain | given | {"n": n}


def test_em_tells_reliable_labelers():
    good, bad = _row(90), _row(60, pattern=-1, checksum=-1, gazetteer=0)
    real, table = pii.estimate([good, bad])
    assert real[0] > 0.95 and real[1] < 0.05
    assert table["checksum"][1][0] > 0.9 and table["boundary"][1][0] == pytest.approx(table["boundary"][1][1], abs=0.1)
    model = pii.fit([good, bad])
    at = pii.LABELERS.index("checksum")
    assert model.votes[at, 2] > model.votes[at, 0]
    assert not pii.fit([]).votes.any()


def test_classifier_learns_from_what_no_labeler_sees():
    # the same votes, once after "call" and once after "order": the words come with other candidates' votes
    call, order = pii.WORDS.index("call"), pii.WORDS.index("order")
    sure = _row(50, kind=3, word=call)
    never = _row(50, kind=3, word=order, pattern=-1, checksum=-1, gazetteer=-1, boundary=-1, shape=-1)
    model = pii.fit([sure, never, _row(2, kind=3, word=call, pattern=-1, checksum=0, gazetteer=0), _row(2, kind=3, word=order, pattern=-1, checksum=0, gazetteer=0)])
    weights = model.features["word"][3]
    assert weights[call] > 0 > weights[order]


def test_the_method_adds_spans(spark):
    added = "mail to jane.doe (at) example (dot) org or call (702) 555-0742 now"
    refused = "order 111-222-3333444, see release 702-555-07429 and serial x1234.5678.9012.3456"
    rows = [(k, "write to joe%d@example.com or call +1 (702) 555-01%02d now" % (k, k)) for k in range(40)] + [(50 + k, "order 1.2.3.4, invoice 4111 1111 1111 11%02d" % k) for k in range(20)] + [(98, refused), (99, added)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = {r.doc_id: r.s for r in docs.select("doc_id", pii.find_pii(docs, pii.fit_pii(docs)).alias("s")).collect()}
    assert [(s.kind, added[s.start : s.end], s.base) for s in found[99]] == [(0, "jane.doe (at) example (dot) org", False), (3, "(702) 555-0742", False)]
    assert found[98] == []


def test_overlaps_with_the_base_are_left_out(spark):
    def spans(*given):
        return spark.createDataFrame([([(*x, 0.9) for x in given],)], f"s array<{pii.SPAN}>")

    # kind, start, end, base; sorted, the base first where starts tie
    frame = spans((0, 0, 4, False), (0, 3, 9, True), (0, 5, 6, False), (0, 8, 12, False), (0, 9, 12, False), (1, 4, 9, False), (3, 1, 3, False), (3, 3, 5, True), (3, 3, 4, False))
    got = frame.select(pii._beside_base(pii._beside_base(F.col("s"), False), True).alias("s")).first().s
    assert [tuple(x)[:4] for x in got] == [(0, 3, 9, True), (0, 9, 12, False), (1, 4, 9, False), (3, 1, 3, False), (3, 3, 5, True)]


def test_very_long_texts_take_linear_time(spark):
    import time

    unit = "Write to joe@example.com or call +1 702 555 0742, order 12, ip 10.0.0.1; under the MIT License, see the Apache License. "
    docs = spark.createDataFrame([(1, unit)], "doc_id long, text string").select("doc_id", F.repeat("text", F.lit(4_000)).alias("text"))
    model = pii.fit([])
    began = time.perf_counter()
    row = docs.select(F.size(F.filter(pii.find_pii(docs, model), lambda s: s["base"])).alias("n")).first()
    assert row.n == 12_000
    clean = pii.redact(docs, model).select(F.length("text").alias("n"), F.substring("text", -len(unit) + 9, 7).alias("end")).first()
    assert clean.n < len(unit) * 4_000
    found = licenses.scan_licenses(docs).select(F.size("base").alias("n"), F.element_at("base", -1)["word"].alias("last"), "n_words", F.size("found").alias("m")).first()
    assert found.n == 8_000 and found.n_words == 4_000 * len(words(unit)) and found.m >= 4_000
    assert found.last == found.n_words - 2
    assert time.perf_counter() - began < 120


def test_pieces_of_blocks(spark):
    text = "é🙂xyz" * 2000
    frame = spark.createDataFrame([(a, n) for a in (0, 1, 4095, 4096, 4097, 8191, 9999, 10000) for n in (0, 1, 2, 4096, 9000)], "a int, n int").withColumn("t", F.lit(text))
    for r in frame.select("a", "n", piece(blocks(F.col("t")), F.col("a"), F.col("n")).alias("p")).collect():
        assert r.p == text[r.a : r.a + r.n]


def test_redaction_of_odd_rows(spark, odd_docs, no_docs):
    model = pii.fit([])
    more = odd_docs.where("doc_id = 9").withColumn("text", F.lit("to a@b.cd, from +1 702 555 0742 é x@y.zz")).unionByName(odd_docs)
    clean = pii.redact(more, model)
    assert clean.columns == more.columns
    texts = [r.text for r in clean.where("doc_id = 9").collect()]
    assert "to <EMAIL>, from <PHONE> é <EMAIL>" in texts and "x" in texts
    assert clean.where("text is null").count() == more.where("text is null").count()
    assert pii.redact(no_docs, model).count() == 0
    assert not pii.fit_pii(no_docs).votes.any()
