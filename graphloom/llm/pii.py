"""Personal data by weak supervision.

Candidates come from strict and loose patterns.  Six labelers (pattern,
checksum, gazetteer, context, boundary, shape) each vote for, against or
abstain on every candidate.  Expectation-maximisation over the votes of the
whole corpus estimates how reliable each labeler is and how likely each
candidate is real.  A logistic span classifier is then trained on those
likelihoods.  Besides the votes it sees what no labeler looked at: the word
before the candidate, the kinds of the characters on both its sides, its form
with runs of digits and letters collapsed, and its length.

Votes and features are few and discrete, so the corpus is reduced by one
aggregation to counts of distinct rows of them, whatever its size; both fits
work on these counts.  The classifier is applied as a column expression.
Strict matches that pass their checks are the base and are always spans; the
classifier decides on all other candidates.

Style: DataFrame functions only; two passes over the text and no shuffle but
that of the counts.
"""

from __future__ import annotations

import math
from functools import cache
from typing import NamedTuple

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import constants, let, table
from graphloom.llm.spans import blocks, find_all, piece, running

KINDS = ("email", "ip", "card", "phone")

# The base patterns, with possessive repeats where no other match is lost.
EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"(?<![0-9])[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"

#: Loose patterns: what may be personal data but isn't of the base's form.
LOOSE = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64} ?[\[({]at[\])}] ?[A-Za-z0-9-]{1,63}(?: ?(?:\.|[\[({]dot[\])}]) ?[A-Za-z0-9-]{2,63}){1,4}",
    "ip": r"(?<![0-9A-Fa-f:])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![0-9A-Fa-f:])",
    "card": r"(?<![0-9./])[0-9]{4}[./][0-9]{4}[./][0-9]{4}[./][0-9]{4}(?![0-9./])",
    "phone": r"(?<![0-9+)(.-])\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}(?![0-9])",
}

#: Cheap tests; a text that fails has no match of the kind, strict or loose.
GATES = {"email": r"@|[\[({]at[\])}]", "ip": r"[0-9]\.[0-9]++\.[0-9]|[0-9A-Fa-f]:[0-9A-Fa-f]{1,4}:[0-9A-Fa-f]", "card": r"[0-9](?:[ -]?[0-9]){12}|[0-9]{4}[./][0-9]{4}[./][0-9]{4}", "phone": r"\+[0-9]|[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}"}

#: Context words before a candidate, in lower case, for and against each kind.
CONTEXT = {
    "email": (r"e-?mail|mail|contact|write to|reach|correo|courriel|kontakt", r"example of|regex|pattern"),
    "ip": (r"\bip\b|address|server|host|login|logged in|client|adresse", r"version|release|section|chapter|\bv\.?$"),
    "card": (r"card|visa|mastercard|amex|credit|debit|payment|karte|carte|tarjeta", r"isbn|serial|tracking|order|invoice|\bid\b|sku"),
    "phone": (r"phone|\btel\b|call|mobile|fax|cell|whatsapp|telefon|tel[eé]fono|t[eé]l", r"isbn|serial|version|order|invoice|sku|\bid\b"),
}
#: Gazetteers.
TLDS = ("com", "org", "net", "edu", "gov", "io", "info", "biz", "de", "fr", "es", "uk", "eu", "us", "it", "nl", "ch", "at", "be", "se", "pl", "ru", "cn", "jp", "br", "ca", "au", "in")
CARD_PREFIX = r"^(?:4|5[1-5]|2[2-7]|3[47]|6)"
CALLING_CODES = r"^(?:1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|21[1-8]|35[0-9]|38[0-9]|42[0-3])"
RESERVED_IP = r"^(?:0|22[4-9]|2[34][0-9]|25[0-5])\."

LABELERS = ("pattern", "checksum", "gazetteer", "context", "boundary", "shape")
BEFORE = 40

#: What the classifier alone sees, and how many values each has.  Words before a candidate (0: none, 1: any other word):
WORDS = (
    "", "*", "is", "at", "to", "on", "or", "from", "by", "of", "the", "my", "me", "us", "ip", "id", "no", "nr", "tel", "call", "phone", "mobile", "fax", "cell", "number", "mail", "email", "contact", "reach", "write", "card",
    "visa", "pay", "account", "server", "host", "address", "version", "release", "order", "invoice", "serial", "isbn", "code", "section", "and", "an", "auf", "von", "bei", "de", "du", "le", "la", "el", "al",
)
#: Forms: runs of digits are 9, of letters a (0: any other).
FORMS = ("*", "a@a.a", "a.a@a.a", "a9@a.a", "a@a.a.a", "a [at] a [dot] a", "9.9.9.9", "9:9:9:9:9:9:9:9", "9", "9 9 9 9", "9-9-9-9", "9.9.9.9", "9 9 9", "9-9-9", "9.9.9", "(9) 9-9", "+9 9 9", "+9 9 9 9", "+9 (9) 9-9", "+9-9-9-9", "+9")
FEATURES = {"size": 5, "word": len(WORDS), "sides": 16, "form": len(FORMS)}

_CANDIDATES = "array<struct<kind:int,start:int,end:int,value:string,base:boolean,votes:struct<" + ",".join(f"{x}:int" for x in LABELERS) + ">," + ",".join(f"{x}:int" for x in FEATURES) + ">>"


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    weighed = F.transform(
        F.split(F.reverse(digits), ""),
        lambda c, i: let(F.ascii(c) - 48, lambda d: F.when(i % 2 == 0, d).otherwise(d * 2 - F.when(d > 4, 9).otherwise(0))),
    )
    return F.aggregate(weighed, F.lit(0), lambda a, x: a + x) % 10 == 0


def _small_parts(value: Column) -> Column:
    """Whether no dot-separated part is over 255, however many zeros lead."""
    return F.forall(F.split(value, r"\."), lambda p: let(F.regexp_replace(p, "^0+(?=[0-9])", ""), lambda x: (F.length(x) < 3) | ((F.length(x) == 3) & (x <= "255"))))


def _passes(kind: str, value: Column) -> Column:
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        return _small_parts(value)
    if kind == "card":
        return let(_digits(value), lambda d: F.length(d).between(13, 19) & _luhn(d))
    return F.length(_digits(value)).between(9, 15)


def _vote(yes: Column, no: Column) -> Column:
    return F.when(yes, 1).when(no, -1).otherwise(0)


def _votes(kind: str, m: Column, left: Column, sides: Column, strict: Column, base: Column) -> Column:
    value, digits = m["value"], _digits(m["value"])
    plain = F.lit(False)
    if kind == "email":
        checksum = (F.length(value) <= 254, F.length(value) > 254)
        gazetteer = (F.lower(F.regexp_extract(value, r"([A-Za-z]+)[^A-Za-z]*$", 1)).isin(*TLDS), plain)
        shape = (value.rlike("^[A-Za-z0-9]"), value.rlike(r"^[._%+-]+(?:@|$)"))
    elif kind == "ip":
        dotted = F.contains(value, F.lit("."))
        checksum = (~dotted | _small_parts(value), dotted & ~_small_parts(value))
        gazetteer = (~value.rlike(RESERVED_IP), value.rlike(RESERVED_IP))
        shape = (value.rlike(r"^(?:[0-9]{1,3}\.){3}[0-9]{1,3}$|:"), value.rlike(r"(?:^|\.)0[0-9]|^[0-9]\.[0-9]\.[0-9]\.[0-9]$"))
    elif kind == "card":
        checksum = (F.length(digits).between(13, 19) & _luhn(digits), F.lit(True))
        gazetteer = (digits.rlike(CARD_PREFIX), F.lit(True))
        shape = (value.rlike(r"^[0-9]{4}([^0-9]?)[0-9]{4}\1[0-9]{4}\1[0-9]{1,7}$|^[0-9]{4}[ -]?[0-9]{6}[ -]?[0-9]{5}$"), digits.rlike(r"^([0-9])\1+$") | value.rlike(r"^[0-9]{1,2}[ -][0-9]{1,2}[ -]"))
    else:
        checksum = (F.length(digits).between(9, 15), F.lit(True))
        gazetteer = (F.startswith(value, F.lit("+")) & digits.rlike(CALLING_CODES), F.startswith(value, F.lit("+")))
        shape = (value.rlike(r"[ ().-][0-9]{2,4}[ .-][0-9]{2,4}"), digits.rlike(r"^([0-9])\1+$"))
    yes, no = CONTEXT[kind]
    given = {
        "pattern": _vote(base, ~strict),
        "checksum": _vote(*checksum),
        "gazetteer": _vote(*gazetteer),
        "context": _vote(left.rlike(yes), left.rlike(no)),
        "boundary": _vote(~sides.rlike(r"[\p{L}\p{N}@_]"), F.lit(True)),
        "shape": _vote(*shape),
    }
    return F.struct(*[given[x].cast("int").alias(x) for x in LABELERS])


def _side(char: Column) -> Column:
    """0: none or white space, 1: a letter or digit, 2: an opening or closing sign, 3: any other sign."""
    return F.when(char.rlike(r"[\p{L}\p{N}]"), 1).when(char.rlike(r"[\[\](){}<>\"']"), 2).when(char.rlike(r"[^\s]"), 3).otherwise(0)


def _position(value: Column, known: tuple[str, ...], other: Column) -> Column:
    return let(F.array_position(constants(known), value).cast("int"), lambda at: F.when(at > 0, at - 1).otherwise(other))


def _candidates(kind: str, held: Column, matches: Column) -> Column:
    """Candidates from ``matches`` with their ``strict``: whether they are of the base's form."""
    number = KINDS.index(kind)

    def of(m: Column) -> Column:
        around = F.struct(
            F.lower(piece(held, F.greatest(m["start"] - BEFORE, F.lit(0)), F.least(m["start"], F.lit(BEFORE)))).alias("left"),
            piece(held, m["start"] - 1, F.when(m["start"] > 0, 1).otherwise(0)).alias("before"),
            piece(held, m["end"], F.lit(1)).alias("after"),
            (m["strict"] & _passes(kind, m["value"])).alias("base"),
        )
        return let(
            around,
            lambda x: F.struct(
                F.lit(number).alias("kind"), m["start"].alias("start"), m["end"].alias("end"), m["value"].alias("value"), x["base"].alias("base"),
                _votes(kind, m, x["left"], F.concat(x["before"], F.lit(" "), x["after"]), m["strict"], x["base"]).alias("votes"),
                F.least(F.floor(F.length(m["value"]) / 8), F.lit(4)).cast("int").alias("size"),
                _position(F.regexp_extract(x["left"], r"(\p{L}*)[^\p{L}]*$", 1), WORDS, F.lit(1)).alias("word"),
                (_side(x["before"]) * 4 + _side(x["after"])).alias("sides"),
                _position(F.regexp_replace(F.regexp_replace(m["value"], "[A-Za-z]+", "a"), "[0-9]+", "9"), FORMS, F.lit(0)).alias("form"),
            ),
        )

    return F.transform(matches, of).cast(_CANDIDATES)


def _flagged(matches: Column, strict: bool) -> Column:
    return F.transform(matches, lambda m: F.struct(m["start"].alias("start"), m["end"].alias("end"), m["value"].alias("value"), F.lit(strict).alias("strict")))


def _all_candidates(text: Column) -> Column:
    """Strict and loose candidates of every kind, by kind and start."""
    strict = {"email": EMAIL, "ip": IP, "card": CARD, "phone": PHONE}
    empty = F.array().cast(_CANDIDATES)

    def found(gates: Column, held: Column) -> Column:
        parts = []
        for kind in KINDS:
            matches = find_all(text, strict[kind])
            if kind == "card":  # a lone digit run of another length is no candidate
                matches = F.filter(matches, lambda m: F.length(_digits(m["value"])).between(13, 19))
            both = F.concat(_flagged(matches, True), _flagged(find_all(text, LOOSE[kind]), False))
            parts.append(F.when(gates[kind], _candidates(kind, held, both)).otherwise(empty))
        return F.concat(*parts)

    def gated(gates: Column) -> Column:
        return F.when(gates["email"] | gates["ip"] | gates["card"] | gates["phone"], let(blocks(text), lambda held: found(gates, held))).otherwise(empty)

    return F.when(text.rlike(r"[0-9@\[({]"), let(F.struct(*[text.rlike(GATES[k]).alias(k) for k in KINDS]), gated)).otherwise(empty)


@cache
def _candidates_in(text_col: str, context: str) -> Column:
    """All candidates of a column; building the expression takes seconds, so it is kept for as long as the Spark context lives."""
    return let(F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")), _all_candidates)


def _context(docs: DataFrame) -> str:
    return docs.sparkSession.sparkContext.applicationId


class Model(NamedTuple):
    """The span classifier: a bias for each kind, a weight for each labeler's vote, and one for each kind and value of a feature; and the labelers' vote distributions."""

    kinds: np.ndarray
    votes: np.ndarray  # labeler, vote + 1
    features: dict[str, np.ndarray]  # kind, value
    reliability: dict[str, dict[int, tuple[float, float]]]


def vote_counts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``kind, votes..., features..., n``: how often each distinct row of votes and features occurs in the corpus."""
    each = docs.select(F.explode(_candidates_in(text_col, _context(docs))).alias("c"))
    keys = [F.col("c.kind").alias("kind"), *[F.col(f"c.votes.{x}").alias(x) for x in LABELERS], *[F.col(f"c.{x}").alias(x) for x in FEATURES]]
    return each.select(*keys).groupBy("kind", *LABELERS, *FEATURES).agg(F.count("*").alias("n"))


def estimate(rows: list[dict], rounds: int = 60) -> tuple[list[float], dict]:
    """EM for two hidden classes: the probability that each vote row is real, and the labelers' vote distributions.

    A labeler's distribution given each class starts in its favour (a vote for
    is likelier for real spans) and is smoothed by the same prior, so that the
    classes can't swap and a labeler never seen stays mild.
    """
    prior = {1: (6.0, 2.0), 0: (3.0, 3.0), -1: (1.0, 5.0)}
    share = {k: 0.5 for k in range(len(KINDS))}
    table = {x: {v: (prior[v][0] / 10, prior[v][1] / 10) for v in prior} for x in LABELERS}
    real: list[float] = []
    for _ in range(rounds):
        real = []
        for r in rows:
            a, b = math.log(share[r["kind"]]), math.log(1 - share[r["kind"]])
            for x in LABELERS:
                p, q = table[x][r[x]]
                a, b = a + math.log(p), b + math.log(q)
            real.append(1 / (1 + math.exp(min(700.0, max(-700.0, b - a)))))
        for k in share:
            n = sum(r["n"] for r in rows if r["kind"] == k)
            share[k] = (1 + sum(r["n"] * p for r, p in zip(rows, real, strict=True) if r["kind"] == k)) / (2 + n)
        for x in LABELERS:
            got = {v: list(prior[v]) for v in prior}
            for r, p in zip(rows, real, strict=True):
                got[r[x]][0] += r["n"] * p
                got[r[x]][1] += r["n"] * (1 - p)
            sums = [sum(got[v][i] for v in got) for i in (0, 1)]
            table[x] = {v: (got[v][0] / sums[0], got[v][1] / sums[1]) for v in got}
    return real, table


def fit(counts: list[dict], steps: int = 300) -> Model:
    """EM on the distinct votes, then a logistic classifier of votes and features on its likelihoods; no rows give neutral weights.

    Gradient steps are scaled by how often a weight is used; weights shrink a
    little in each, those of features more than those of votes.
    """
    names = ("kind", *LABELERS)
    totals: dict[tuple, int] = {}
    for r in counts:
        key = tuple(r[x] for x in names)
        totals[key] = totals.get(key, 0) + r["n"]
    votes = [dict(zip(names, key, strict=True)) | {"n": n} for key, n in sorted(totals.items())]
    real, table = estimate(votes)
    likely = {tuple(r[x] for x in names): p for r, p in zip(votes, real, strict=True)}

    rows = sorted(counts, key=lambda r: tuple(r[x] for x in (*names, *FEATURES)))
    sizes = [len(KINDS), *[3] * len(LABELERS), *[len(KINDS) * n for n in FEATURES.values()]]
    starts = np.cumsum([0, *sizes])
    weights = np.zeros(starts[-1])
    if rows:
        at = np.array([[r["kind"], *[r[x] + 1 for x in LABELERS], *[r["kind"] * n + r[x] for x, n in FEATURES.items()]] for r in rows]) + starts[:-1]
        n = np.array([r["n"] for r in rows], float)
        n /= n.sum()
        goal = np.array([likely[tuple(r[x] for x in names)] for r in rows])
        mass = np.bincount(at.ravel(), np.repeat(n, at.shape[1]), minlength=len(weights)) * at.shape[1]
        shrink = np.where(np.arange(len(weights)) < starts[1 + len(LABELERS)], 1e-3, 5e-3)
        for _ in range(steps):
            off = n * (1 / (1 + np.exp(-np.clip(weights[at].sum(axis=1), -30, 30))) - goal)
            slope = np.bincount(at.ravel(), np.repeat(off, at.shape[1]), minlength=len(weights))
            weights -= 4 * slope / (mass + 1e-4) + shrink * weights
    parts = [weights[a:b] for a, b in zip(starts, starts[1:], strict=False)]
    return Model(parts[0], np.array(parts[1 : 1 + len(LABELERS)]), {x: w.reshape(len(KINDS), -1) for x, w in zip(FEATURES, parts[1 + len(LABELERS) :], strict=True)}, table)


def fit_pii(docs: DataFrame, text_col: str = "text") -> Model:
    """Learn from every text of ``docs``; what reaches the driver is bounded by the number of distinct vote rows."""
    return fit([r.asDict() for r in vote_counts(docs, text_col).collect()])


def _score(model: Model, c: Column) -> Column:
    def weight(place: Column, weights: np.ndarray) -> Column:
        return F.get(constants(map(float, weights.ravel())), place)

    z = weight(c["kind"], model.kinds)
    for k, x in enumerate(LABELERS):
        z = z + weight(c["votes"][x] + 1, model.votes[k])
    for x, n in FEATURES.items():
        z = z + weight(c["kind"] * n + c[x], model.features[x])
    return 1 / (1 + F.exp(-z))


SPAN = "struct<kind:int,start:int,end:int,base:boolean,score:double>"


def _beside_base(spans: Column, reverse: bool) -> Column:
    """``spans``, sorted, without those beyond the base that overlap a base span of their kind before them, or after them if ``reverse``."""

    def step(state: Column, s: Column) -> tuple[Column, Column]:
        same = state["kind"] == s["kind"]
        edge = s["start"] if reverse else s["end"]
        reach = F.least(state["edge"], edge) if reverse else F.greatest(state["edge"], edge)
        met = same & ((state["edge"] < s["end"]) if reverse else (state["edge"] > s["start"]))
        after = F.when(s["base"], F.struct(s["kind"].alias("kind"), F.when(same, reach).otherwise(edge).alias("edge"))).otherwise(state)
        return after, F.when(s["base"] | ~met, s)

    start = F.struct(F.lit(-1).alias("kind"), F.lit(0).alias("edge"))
    kept = F.filter(running(F.reverse(spans) if reverse else spans, start, SPAN, step), lambda s: s.isNotNull())
    return F.reverse(kept) if reverse else kept


def find_pii(docs: DataFrame, model: Model, text_col: str = "text", threshold: float = 0.5) -> Column:
    """The spans of ``text_col`` as an array of kind, start, end, base, score, by kind and start.

    Base spans are always there; other candidates need a score of
    ``threshold`` and no overlap with a base span of their kind.  Null, empty
    and very short texts have none.  Whole texts are read, in time that grows
    with their length.  Repeated rows have the same spans, an empty table has
    none, and no other column is read.
    """

    def chosen(all_found: Column) -> Column:
        scored = F.transform(all_found, lambda c: F.struct(c["kind"].alias("kind"), c["start"].alias("start"), c["end"].alias("end"), c["base"].alias("base"), _score(model, c).alias("score")))
        wanted = F.filter(scored, lambda s: s["base"] | (s["score"] >= threshold))
        ordered = F.array_sort(F.transform(wanted, lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), (~s["base"]).alias("more"), s["end"].alias("end"), s["score"].alias("score"))))
        spans = F.transform(ordered, lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"), (~s["more"]).alias("base"), s["score"].alias("score")))
        return let(spans, lambda x: F.when(F.exists(x, lambda s: ~s["base"]), _beside_base(_beside_base(x, False), True)).otherwise(x))

    return let(_candidates_in(text_col, _context(docs)), chosen)


def redact(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """``docs`` with every span of ``text_col`` replaced by its kind in angle brackets; all columns stay, whatever their names.

    Spans of two kinds that overlap are replaced as one, by the kind that
    starts first.  Null texts stay null, texts without spans (empty ones too)
    as they are; repeated rows stay repeated, and an empty table stays empty.
    """
    text = docs[text_col]
    by_place = F.array_sort(F.transform(find_pii(docs, model, text_col), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))
    names = F.array(*[F.lit(f"<{k.upper()}>") for k in KINDS])

    def rebuilt(spans: Column, held: Column) -> Column:
        def step(at: Column, s: Column) -> tuple[Column, Column]:
            part = F.when(s["start"] < at, "").otherwise(F.concat(piece(held, at, s["start"] - at), F.get(names, s["kind"])))
            return F.greatest(at, s["end"]), part

        last = F.array_max(F.transform(spans, lambda s: s["end"]))
        return F.concat(F.array_join(running(spans, F.lit(0), "string", step), ""), piece(held, last, F.length(text) - last))

    clean = let(by_place, lambda spans: F.when(F.size(spans) == 0, text).otherwise(let(blocks(text), lambda held: rebuilt(spans, held))))
    return docs.withColumn(text_col, F.when(text.isNotNull(), clean))


def op8_pii(spark, sf_dir: str) -> DataFrame:
    """``find_pii`` over all of ``documents``, with a model of all of them, as counts and lists of spans."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit_pii(docs)
    found = docs.select("doc_id", find_pii(docs, model).alias("s"))
    names = F.array(*[F.lit(k) for k in KINDS])

    def listed(spans: Column) -> Column:
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")

    base = F.filter("s", lambda s: s["base"])
    number = lambda k: F.size(F.filter("s", lambda s: s["base"] & (s["kind"] == k))).cast("long").alias(f"n_{KINDS[k]}")
    return found.select("doc_id", *map(number, range(len(KINDS))), F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("s")).alias("spans"))
