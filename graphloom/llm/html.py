"""Main text of web pages by the maximum-scoring subsequence.

A page is cut into tags and runs of text in one linear scan.  Words score
positive, tags negative, and one more linear scan finds the contiguous region
with the best sum.  Inside the region, what stands in menus, asides, forms,
notices, adverts or reader comments is left out.

The weights come from labelled pages, those that mark their article by
``article`` or ``main`` (a bounded sample, and the few in ``LABELLED``).  Each
is read in three disguises (the marks gone; names gone too; and no element
that says what it is), and an averaged structured perceptron moves the weights
until the best region is the labelled one.  So the weights hold for pages that
mark and name nothing.  Where a page does mark articles, words beside all marks
score nothing and aren't text of it, and tags cost next to nothing, so that the
region reaches from the first article to the last.

Style: Arrow batches; parsing is imperative work on one page.  Nothing is
shuffled.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import small_batches, table

#: Pages that the weights are learned from, and the longest among them in bytes.
SAMPLE = 400
SAMPLE_HTML = 1 << 17

_TOKEN = re.compile(
    r"<!--(?P<comment>.*?)(?:-->|$)|<[!?][^>]*(?:>|$)|<(?P<close>/?)(?P<name>[A-Za-z][^\s/>]*)(?P<attrs>(?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>|</?[A-Za-z][^>]*(?:>|$)|(?P<text>[^<]+|<)",
    re.S,
)
_ATTR = re.compile(r"([A-Za-z][\w:-]*)\s*(?:=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")

#: Elements whose content is no text of the page, and those whose content is raw.
RAW = frozenset("script style noscript template iframe textarea title xmp noembed noframes".split())
UNSEEN = frozenset("head svg math canvas object audio video select button datalist".split()) | RAW
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that are never the article, wherever they stand.
ASIDE = frozenset("nav aside footer form menu dialog fieldset".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
ARTICLE = frozenset({"article", "main"})
#: Elements that an opening block ends if they are still open.
CLOSED_BY_BLOCK = "p"
ITEMS = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table", "tbody", "thead", "tfoot"}, "td": {"tr", "table"}, "th": {"tr", "table"}, "option": {"select"}}

#: Elements whose class is read for what they are, and those whose id is, too.  Headings aren't among them.
NAMED = frozenset("div section article header ul ol li dl table tbody tr td p span center details figure ins".split())
NAMED_BY_ID = frozenset("div section header ul ol table".split())
#: Words of a name that name something else than the article.
OTHER_NAMES = frozenset(
    "nav navbar navigation menu submenu breadcrumb breadcrumbs crumbs masthead banner topbar footer bottombar colophon contentinfo sidebar aside complementary widget widgets rail "
    "ad ads adv advert adverts advertisement advertising adsense adslot sponsor sponsored sponsors promo promos promotion promoted outbrain taboola cookie cookies consent gdpr privacy notice notices notification alert alertdialog "
    "popup modal overlay dialog newsletter subscribe subscription signup login signin register search searchbox share sharing social related recommended recommendations trending teaser teasers "
    "comment comments commentlist disqus reply replies respond form toolbar pagination pager paging skip copyright legal disclaimer paywall".split()
)
#: Words that may stand beside those in a name without changing what it names; with any other word a name says something else.
NEUTRAL_NAMES = frozenset(
    "site global main page post posts article articles entry story list lists box boxes block blocks container wrapper wrap inner outer content area section panel bar item items group row col column "
    "left right top bottom primary secondary button buttons link links icon icons unit slot zone body".split()
)
HEADER_NAMES = frozenset({"header", "hdr", "siteheader"})
BESIDE_HEADER = frozenset("site global main container wrapper wrap inner outer top bar area row".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert menu menubar toolbar form".split())

#: Least weight of a plain word and largest of a tag: words score positive, tags negative.
LEAST_WORD, MOST_TAG = 0.05, -0.01
EPOCHS = 8


class Weights(NamedTuple):
    words: dict[str, float]
    tags: dict[str, float]
    unknown_tag: float


class Token(NamedTuple):
    kind: str  # plain, link, other (a run of text), tag, or break (a tag of or in another element than the article's)
    value: str  # the text, decoded, or the tag's name, with a slash if it closes
    marked: bool  # inside an element that marks the article


def _says_other(name: str, in_article: bool) -> bool:
    """Whether one name (a class or id) is whole made of words for something else than the article."""
    words = set(re.findall(r"[a-z]{2,}", re.sub(r"([a-z])([A-Z])", r"\1 \2", name).lower()))
    if words & OTHER_NAMES:
        return words <= OTHER_NAMES | NEUTRAL_NAMES | HEADER_NAMES
    return not in_article and bool(words & HEADER_NAMES) and words <= HEADER_NAMES | BESIDE_HEADER


def _is_other(name: str, attrs: str, in_article: bool, by_name: bool) -> bool:
    if name in ASIDE:
        return True
    if name == "header" and not in_article:
        return True
    if not by_name or not attrs or attrs.isspace():
        return False
    given = {k.lower(): a or b or c for k, a, b, c in _ATTR.findall(attrs)}
    if "hidden" in given or given.get("aria-hidden") == "true" or re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", given.get("style", ""), re.I):
        return True
    if name not in NAMED:
        return False
    if ROLES.intersection(given.get("role", "").lower().split()):
        return True
    names = " ".join(given.get(k, "") for k in ("class", "itemprop", "data-role", *(["id"] if name in NAMED_BY_ID else [])))
    return any(_says_other(x, in_article) for x in names.split())


def tokens(page: str, by_name: bool = True, by_tag: bool = True) -> Iterator[Token]:
    """Tags and runs of text in page order; what no reader sees is left out.

    ``by_name`` takes classes, ids and roles as signs of what an element is,
    ``by_tag`` its tag.  Inside ``main`` the names of what it stands in don't
    count, and marks inside another element than the article's are none.
    """
    stack: list[tuple[str, bool, int, bool]] = []  # name, whether it is unseen, how much it adds to ``other``, whether it marks the article
    unseen = other = marked = links = 0
    at, end = 0, len(page)

    def pop() -> None:
        nonlocal unseen, other, marked, links
        name, was_unseen, was_other, was_marked = stack.pop()
        unseen -= was_unseen
        other -= was_other
        marked -= was_marked
        links -= name == "a"

    while at < end:
        m = _TOKEN.match(page, at)
        at = m.end() if m else end
        if m is None or m.lastgroup is None or m["comment"] is not None:
            continue
        if (text := m["text"]) is not None:
            if not unseen:
                yield Token("other" if other else "link" if links else "plain", html.unescape(text) if "&" in text else text, marked > 0)
            continue
        if m["name"] is None:
            continue
        name = m["name"].lower()
        if m["close"]:
            # ends the nearest element of the name and all inside it; a stray end tag ends nothing
            depth = next((k for k in range(len(stack) - 1, -1, -1) if stack[k][0] == name), None)
            if depth is not None and not (name in INLINE and any(x[0] not in INLINE for x in stack[depth + 1 :])):
                was, ended_other = unseen, stack[depth][2] > 0
                while len(stack) > depth:
                    pop()
                if not was:
                    yield Token("break" if other or ended_other else "tag", "/" + name, marked > 0)
            continue
        if name in RAW:
            close = re.compile(rf"</{re.escape(name)}\b[^>]*>?", re.I).search(page, at)
            at = close.end() if close else end
            continue
        if name not in INLINE:
            # an opening block ends an open paragraph, an item ends the item before it
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == CLOSED_BY_BLOCK:
                    while len(stack) > k:
                        pop()
                    break
                if stack[k][0] not in INLINE:
                    break
            if bounds := ITEMS.get(name):
                for k in range(len(stack) - 1, -1, -1):
                    if stack[k][0] == name:
                        while len(stack) > k:
                            pop()
                        break
                    if stack[k][0] in bounds:
                        break
        is_unseen = name in UNSEEN
        is_other = by_tag and not is_unseen and name not in VOID and _is_other(name, m["attrs"], marked > 0, by_name)
        if not unseen:
            yield Token("break" if other or is_other else "tag", name, marked > 0)
        if name in VOID or m["attrs"].endswith("/"):
            continue
        adds = -other if name == "main" else int(is_other)
        marks = name in ARTICLE and not other + adds
        stack.append((name, is_unseen, adds, marks))
        unseen += is_unseen
        other += adds
        marked += marks
        links += name == "a"


#: Pages whose article is marked, for corpora that mark none.
LABELLED = (
    "<html><body><header><a href=/>Daily News</a></header><nav><ul><li><a href=/a>World</a></li><li><a href=/b>Sport</a></li><li><a href=/c>Culture</a></li></ul></nav>"
    "<main><h1>A bridge opens</h1><p>The new bridge over the river opened this morning after three years of work.</p><p>Hundreds of people walked across it in the <a href=/r>rain</a>.</p></main>"
    "<div><h3>More</h3><ul><li><a href=/1>Older story</a></li><li><a href=/2>Another story</a></li></ul></div><footer><p>All rights reserved</p></footer></body></html>",
    "<body><table><tr><td><a href=/>Home</a></td><td><a href=/x>Shop</a></td></tr></table><div><article><h2>How to bake bread</h2><p>Mix flour, water, salt and yeast, and let the dough rest over night.</p>"
    "<ul><li>Heat the oven well before baking.</li><li>Bake for forty minutes.</li></ul><p>Let it cool before you cut it.</p></article></div><div><p><a href=/t>Terms</a> <a href=/p>Privacy</a> <a href=/k>Contact</a></p></div></body>",
)


#: Disguises of labelled pages, as options of ``tokens``.
DISGUISES = ({}, {"by_name": False}, {"by_name": False, "by_tag": False})


def _disguised(page: str, options: dict) -> list[Token]:
    """The page's tokens as if its marks, and without ``by_tag`` all elements that say what they are, were divisions."""
    gone = ARTICLE if options.get("by_tag", True) else ARTICLE | ASIDE | {"header", "section"}
    found = []
    for t in tokens(page, **options):
        bare = t.value.lstrip("/")
        found.append(t._replace(value=t.value.replace(bare, "div")) if t.kind in ("tag", "break") and bare in gone else t)
    return found


def _features(found: list[Token]) -> list[tuple[str, int]]:
    """Per token: what it counts as, and how often (words of a run, or one tag); other elements' words and tags count as nothing."""
    return [("<" + t.value, 1) if t.kind == "tag" else (t.kind, len(t.value.split())) if t.kind in ("plain", "link") else ("", 0) for t in found]


def _best(scores: list[float]) -> tuple[int, int]:
    """Where the contiguous run with the largest positive sum starts and ends; of equal sums the first, and an empty run if none is positive."""
    best, total, start = (0.0, 0, 0), 0.0, 0
    for k, x in enumerate(scores):
        if total <= 0:
            total, start = 0.0, k
        total += x
        if total > best[0]:
            best = (total, start, k + 1)
    return best[1:]


def learn(pages: list[str], epochs: int = EPOCHS) -> Weights:
    """Weights under which the best region of each labelled page, in each disguise, is the labelled one, as far as one set of weights can.

    Only pages that mark an article count; ``LABELLED`` always do.  The start
    is the log-odds of words and tags inside against outside; the perceptron's
    steps are as large as the share of a page's words that it got wrong.
    """
    cases: list[tuple[list[tuple[str, int]], int, int]] = []
    for page in (*LABELLED, *pages):
        for options in DISGUISES:
            found = _disguised(page, options)
            at = [k for k, t in enumerate(found) if t.marked and t.kind in ("plain", "link") and t.value.strip()]
            if at:
                cases.append((_features(found), at[0], at[-1] + 1))
    inside: Counter[str] = Counter()
    outside: Counter[str] = Counter()
    for features, start, end in cases:
        for k, (name, n) in enumerate(features):
            (inside if start <= k < end else outside)[name] += n
    names = sorted(n for n in inside | outside if n)
    a, b = sum(inside[n] for n in names), sum(outside[n] for n in names)
    odds = {n: math.log((inside[n] + 1) / (a + len(names))) - math.log((outside[n] + 1) / (b + len(names))) for n in names}

    def bounded(name: str, w: float) -> float:
        return max(w, LEAST_WORD) if name == "plain" else max(w, 0.0) if name == "link" else min(w, MOST_TAG)

    now = {n: bounded(n, min(1.0, max(-1.0, w))) for n, w in odds.items()} | {"link": 0.0}
    sums, steps = dict.fromkeys(now, 0.0), 0
    for epoch in range(epochs):
        for features, start, end in cases:
            low, high = _best([now.get(name, 0.0) * n for name, n in features])
            if (low, high) != (start, end):
                wrong: Counter[str] = Counter()
                for k in range(min(low, start), max(high, end)):
                    name, n = features[k]
                    if name and (missed := (start <= k < end) - (low <= k < high)):
                        wrong[name] += missed * n
                size = sum(n for name, n in features[start:end]) or 1
                rate = 0.5 / (1 + epoch) / max(10, size) ** 0.5
                for name, n in wrong.items():
                    now[name] = bounded(name, now[name] + rate * n)
                now["link"] = min(now["link"], now["plain"])
            steps += 1
            for name, w in now.items():
                sums[name] += w
    mean = {n: w / steps for n, w in sums.items()} if steps else now
    tags = {n[1:]: w for n, w in mean.items() if n[0] == "<"}
    return Weights({"plain": mean.get("plain", 1.0), "link": mean.get("link", 0.0)}, tags, sum(tags.values()) / len(tags) if tags else -0.5)


def extract(page: str, weights: Weights) -> str:
    """The main text: blocks joined by one space, white space inside a block made one space.

    A page whose every element names itself as something else is read once
    more, by its tags alone.
    """
    return _extract(list(tokens(page)), weights) or _extract(list(tokens(page, by_name=False)), weights)


def _extract(found: list[Token], weights: Weights) -> str:
    marks = any(t.marked and t.kind in ("plain", "link") and t.value.strip() for t in found)
    scores = []
    for t, (name, n) in zip(found, _features(found), strict=True):
        if t.kind == "tag":
            scores.append(MOST_TAG if marks else weights.tags.get(t.value, weights.unknown_tag))
        elif not name or marks and not t.marked:
            scores.append(0.0)
        else:
            scores.append(n * (max(weights.words.values()) if marks else weights.words[name]))
    start, end = _best(scores)
    parts: list[str] = []
    for t in found[start:end]:
        if t.kind in ("tag", "break"):
            if t.value.lstrip("/") not in INLINE:
                parts.append(" ")
        elif t.kind != "other":
            parts.append(t.value if t.marked or not marks else " ")
    return " ".join("".join(parts).split())


def fit_html(pages: DataFrame, sample: int = SAMPLE) -> Weights:
    """Weights from a bounded sample of ``pages``: about ``sample`` by a hash of the page's id, at most twice as many, always the same."""
    total = pages.count()
    share = min(1.0, sample / max(1, total))
    drawn = pages.select(F.pmod(F.xxhash64(F.lit("sample"), F.col("page_id")), F.lit(1 << 20)).alias("draw"), "html")
    rows = drawn.where((F.octet_length("html") <= SAMPLE_HTML) & (F.col("draw") < int(share * (1 << 20)) + 1))
    return learn(sorted(r.html for r in rows.orderBy("draw", "html").limit(2 * sample).collect()))


def extract_pages(pages: DataFrame, weights: Weights) -> DataFrame:
    """``page_id, url, text, n_chars`` for every row; null and empty pages and those without a main text give ''.

    The whole html is read, however long, one page at a time.  Of regions with
    equal sums the first is taken.  Repeated rows each give their row, null ids
    and urls stay null, an empty table gives no rows, and other columns are not
    read.
    """
    small_batches(pages.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [extract(h, weights) if h else "" for h in batch.column("html").to_pylist()]
            yield pa.record_batch([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    few = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return few.mapInArrow(run, "page_id long, url string, text string, n_chars long")


def op5_html(spark, sf_dir: str) -> DataFrame:
    """``extract_pages`` over all of ``pages``, with weights from a sample of them."""
    pages = table(spark, sf_dir, "pages")
    return extract_pages(pages, fit_html(pages))
