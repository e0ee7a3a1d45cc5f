"""Main-text extraction: the maximum-scoring run of a page's words and tags.

A page is read as a sequence of words and tags.  Words score positive or nothing, tags
negative, and one linear scan finds the contiguous run with the highest sum; its
words that score are the main text.

What a word scores follows from the elements that hold it.  Each element adds
features: what kind of element it is, whether its class, id or role names a part
of the page that is no article, whether it is hidden, whether its block consists
of links.  A logistic regression on the labelled pages below
(:data:`LABELLED`) gives each feature its weight; the sum of a word's weights
is its score where it is positive.  The regression reads one row for each stretch of text.
An article or main element starts anew: what lies around it says nothing, unless that
is a list of comments or of related pages.  Tags are weighted by their log-odds
of main text in the same pages.

Text in scripts, styles, controls and other elements that are no running text
is never read.  Class and id names count by their parts, but not after words such
as `has` or `no` ("has-sidebar", "no-ads"), and not on html, body, main and
article elements, except for comments.

Defined results: a null or empty page, or one without words that score, gives the
empty text and 0 characters.  Repeated pages give repeated rows.  Ties between
runs go to the first.  Elements nested deeper than `DEEPEST` are read as parts of
the element at that depth, so that time and memory grow with the page's length.
"""

from __future__ import annotations

import functools
import html as html_lib
import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from lightshelf.llm.common import slices

# Fixed values of HTML: elements by their role.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = "script style title textarea xmp iframe noembed noframes"
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data dfn em font i ins del kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr img".split())
NEVER = frozenset("script style title head button select option textarea noscript template iframe object svg canvas menu dialog input audio video map xmp noembed noframes".split())
TEXT_BLOCKS = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre ul ol dl figure figcaption table hr br li dt dd".split())
CLOSES_P = frozenset("address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul figure".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar".split())
#: Features of elements by name.
NAMED = {"nav": "nav", "header": "header", "footer": "footer", "aside": "aside", "form": "form", "fieldset": "form", "article": "article", "main": "article", "p": "prose", "blockquote": "prose", "pre": "prose", "li": "item", "dt": "item", "dd": "item", "td": "cell", "th": "cell"} | {f"h{i}": "heading" for i in range(1, 7)}
# Words in class and id names of parts of a page that are no article, and of those with articles of their own.
MARKS = frozenset("ad ads adbox advert advertisement adverts advertising sponsor sponsored promo promotion sidebar cookie cookies consent gdpr notice notices banner popup modal newsletter subscribe subscription share sharing social breadcrumb breadcrumbs menu nav navbar navigation footer masthead pagination pager widget toolbar login signup paywall alert".split())
READERS = frozenset("comment comments disqus replies respond related recommended recommendations".split())
#: First words of class names that tell about an element without naming it.
ABOUT = frozenset("has no not with without is hide show".split())
DEEPEST = 400

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    rf"|<(?P<raw>{RAW.replace(' ', '|')})\b[^>]*>.*?(?:</(?P=raw)\s*>|\Z)"
    r"|<[!?][^>]*>"
    r"|<(?P<end>/?)(?P<name>[a-zA-Z][^\s/>]*)(?P<attrs>(?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>"
    r"|<(?P<end2>/?)(?P<name2>[a-zA-Z][^\s/>]*)(?P<attrs2>[^>]*)>",
    re.S | re.I,
)
_ATTRIBUTE = re.compile(r"([^\s\"'<>/=]+)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+))?")


@functools.lru_cache(maxsize=4096)
def element_features(name: str, attrs: str) -> frozenset[str]:
    """Features of an element by its name and its own attributes."""
    out = {NAMED[name]} if name in NAMED else set()
    if not attrs or name in ("html", "body"):
        return frozenset(out)
    for key, value in _ATTRIBUTE.findall(attrs):
        key, value = key.lower(), value.strip("\"'").lower()
        if key == "role":
            if value in ROLES:
                out.add("marked")
            elif value in ("main", "article"):
                out.add("article")
        elif key == "hidden" or key == "aria-hidden" and value == "true" or key == "style" and re.search(r"display\s*:\s*none", value):
            out.add("hidden")
        elif key in ("class", "id"):
            for word in value.split():
                parts = re.split(r"[^a-z0-9]+", word)
                if parts[0] in ABOUT:
                    continue
                if not READERS.isdisjoint(parts):
                    out.add("reader")
                elif not MARKS.isdisjoint(parts) and name not in ("main", "article"):
                    out.add("marked")
    return frozenset(out)


class Element:
    """An open or closed element: its name, the features of all that holds its text, and its words."""

    __slots__ = ("name", "features", "block", "words", "linked")

    def __init__(self, name: str, features: frozenset[str], block: Element | None) -> None:
        self.name, self.features = name, features
        self.block = block or self  # the nearest element that is no inline one
        self.words = self.linked = 0  # of a block: its words, and those in links


def _within(parent: Element, name: str, own: frozenset[str]) -> frozenset[str]:
    if "article" in own and not {"reader", "aside"} & parent.features:
        return own
    if name == "header" and "article" in parent.features:
        own = own - {"header"}
    return parent.features | own if own else parent.features


class Page:
    """The sequence of a page: words and tags, and the element that holds each."""

    def __init__(self, source: str) -> None:
        self.kinds: list[str] = []  # "text", "skip" (an element that is never read), or a tag's name
        self.texts: list[str] = []
        self.owner: list[Element] = []
        stack = [Element("#page", frozenset(), None)]
        never = 0  # depth of the stack at which an element that is never read was opened
        links = over = at = 0

        def text(part: str) -> None:
            n = len(part.split())
            block = stack[-1].block
            block.words += n
            block.linked += n if links else 0
            self._add("text", part, stack[-1])

        # behind the last > there is no tag: looking for one from each < would take time by the square
        end = source.rfind(">") + 1
        last = source.find("<!--", end)
        tail = source[end : len(source) if last < 0 else last]
        for m in _TOKEN.finditer(source, 0, end):
            if m.end() == end and (m["raw"] and not re.search(r"</[a-zA-Z]+\s*>\Z", m[0]) or m[0].startswith("<!--") and not m[0].endswith("-->")):
                tail = ""  # in an element or comment that is never closed
            if m.start() > at and not never:
                text(source[at : m.start()])
            at = m.end()
            if m["raw"]:
                if not never:
                    self._add("skip", "", stack[-1])
                continue
            name = (m["name"] or m["name2"] or "").lower()
            if not name:
                continue
            if m["end"] or m["end2"]:
                if name in VOID:
                    continue
                k = len(stack) - 1
                while k and stack[k].name != name:
                    k -= 1
                if not k:
                    continue
                links -= sum(e.name == "a" for e in stack[k:])
                del stack[k:]
                if never and len(stack) < never:
                    never = 0
                elif not never:
                    self._add(name, "", stack[-1])
                continue
            attrs = m["attrs"] or m["attrs2"] or ""
            if never:
                # an article does not lie in a control: that was never closed
                if name in ("article", "main"):
                    del stack[never - 1 :]
                    never = links = 0
                elif name not in VOID and not attrs.endswith("/") and len(stack) < DEEPEST:
                    stack.append(Element(name, stack[-1].features, None))
                    links += name == "a"
                    continue
                else:
                    continue
            if name in CLOSES_P and any(e.name == "p" for e in stack[-4:]):
                k = max(i for i, e in enumerate(stack) if e.name == "p")
                if all(e.name in INLINE for e in stack[k + 1 :]):
                    links -= sum(e.name == "a" for e in stack[k:])
                    del stack[k:]
            if name in VOID:
                self._add("skip" if name == "input" else name, "", stack[-1])
                continue
            parent = stack[-1]
            out = name in NEVER
            self._add("skip" if out else name, "", parent)
            if attrs.endswith("/") and name not in INLINE and name not in NEVER and name not in ("p", "div", "li"):
                continue
            if len(stack) >= DEEPEST:
                continue
            stack.append(Element(name, _within(parent, name, element_features(name, attrs)), parent.block if name in INLINE else None))
            links += name == "a"
            if out:
                never = len(stack)
        if not never:
            text(source[at:end] + tail)

    def _add(self, kind: str, text: str, owner: Element) -> None:
        self.kinds.append(kind)
        self.texts.append(text)
        self.owner.append(owner)

    def features(self, i: int) -> frozenset[str]:
        """Features of the words of token `i`."""
        e = self.owner[i]
        return e.features | {"links"} if 2 * e.block.linked >= max(1, e.block.words) else e.features


# Labelled pages: what stands between the marks [[ and ]] is main text, all other is not.
LABELLED = [
    "<html><head><title>t</title></head><body><nav><ul><li><a>Home page</a></li><li><a>All news</a></li></ul></nav><div class='ad'>Buy this now</div>[[<article><h1>Rain in the valley</h1><p>It rained for <b>three days</b> in a row and the river rose over its banks.</p><p>Nobody was hurt.</p><p>The bridge stays closed until the water has gone down again.</p></article>]]<footer>All rights reserved <a>Imprint</a></footer></body></html>",
    "<body><header><div><a>Logo</a></div><ul><li><a>One</a></li><li><a>Two</a></li><li><a>Three</a></li></ul></header><div><div>[[<h2>A longer walk</h2><p>We left early in the morning, before the sun was up, and walked along the <a>old road</a> to the next village.</p><p>There we ate bread and cheese.<br>Then we went on.</p><blockquote>Walking is the best of all rests.</blockquote>]]</div></div><aside><h3>More</h3><ul><li><a>Hills</a></li><li><a>Lakes</a></li></ul></aside></body>",
    "<body><table><tr><td><a>Start</a></td><td><a>Archive</a></td><td><a>Contact</a></td></tr></table><main>[[<h1>How to bake bread</h1><p>Mix flour, water, salt and yeast, and let the dough rest over night in a cool place.</p><ol><li>Fold the dough four times.</li><li>Heat the oven.</li></ol><p>Bake it for fifty minutes.</p>]]</main><form><label>Your mail</label><input><button>Send</button></form><div><p><a>Terms</a> <a>Privacy</a></p></div></body>",
    "<body><div><span><a>Sign in</a></span><span><a>Help</a></span></div>[[<p>The committee met on Monday to talk about the new school.</p><p>After two hours the members agreed on a <i>plan</i> that will be shown to the public in May.</p><p>It is the third attempt.</p>]]<div class='comments'><h4>Comments</h4><div><span>anna</span><p>Good that it is done at last.</p></div><div><span>ben</span><p>No!</p></div></div><div><a>Top</a></div></body>",
    "<body><div class='cookie-notice'><p>We use cookies to make this page better.</p><button>Fine</button></div><header><h1>The Daily Paper</h1><p>News for everyone</p></header><div id='content' class='content has-sidebar'>[[<h2>The market opens again</h2><p>After the long winter the market on the square opens on Saturday.</p>]]<div class='ad-slot'><p>Shoes for little money</p></div>[[<p>There will be music and soup.</p>]]<aside><p>The square was built long ago.</p></aside>[[<p>Come early.</p>]]<div class='share-buttons'><p>Share this with friends</p></div></div><div id='sidebar'><h3>Most read</h3><p>A house is sold</p><p>A cat is found</p></div><footer><p>The Daily Paper, since 1901</p></footer></body>",
    "<body><div class='navbar'>Start Shop Help</div><article>[[<header><h1>On bees</h1></header><p>Bees fly when it is warm.</p><ul><li>They like clover.</li><li>They do not like rain.</li></ul>]]<form><p>Write to us about bees</p><input></form>[[<table><tr><td>May</td><td>many bees</td></tr><tr><td>December</td><td>none</td></tr></table><p>So it goes.</p>]]<aside class='related'><h3>Also of interest</h3><p>On wasps and their nests</p></aside><footer><p>Written by a friend of bees</p></footer></article><section class='comments'><article><p>I love bees and keep some of them.</p></article><article><p>They sting.</p></article></section></body>",
    "<body>[[<div>The ship left the harbour at noon and was seen last near the lighthouse.</div><div>Its crew of nine is missing.</div><div>Boats look for it.</div>]]<div role='contentinfo'><p>Call us at any time</p></div><div hidden><p>This is not shown to anyone</p></div><nav><p>Older pages and newer pages</p></nav></body>",
    "<body><div class='page share'><article>[[<h1>Snow</h1><div>Snow fell on all hills.</div><div><pre>depth 40</pre></div><dl><dt>Depth</dt><dd>Forty</dd></dl><p>See <a>the map</a>.</p><ul><li><a>Map of the hills</a></li></ul>]]</article></div><div class='newsletter'><h3>Our letter</h3><p>Get all news by mail each week.</p></div></body>",
    "<body><div><div><a>Home</a></div></div><div class='body'>[[<div><h2>A night at the station</h2></div><div><p>The last train had left, and the next one would come at six.</p></div><div><div>We waited.</div></div><section><p>Nobody slept, as it was cold and the lamps were bright.</p></section><div><p>Then it came.</p></div>]]</div><div><div><a>Back</a></div><div><a>Next</a></div></div></body>",
    "<body><article>[[<h1>Salt</h1><p>Salt comes from the sea.</p>]]<aside><p>The sea is wide</p></aside>[[<p>It is dried in the sun.</p>]]<div class='ad'><p>Buy pans here</p></div>[[<ul><li>White salt</li><li>Grey salt</li></ul>]]<nav><ul><li>First part</li><li>Second part</li></ul></nav>[[<h2>Trade</h2><p>It was carried by mule.</p>]]<div hidden><p>Words for machines</p></div>[[<p>Mules are slow.</p>]]<div class='comments'><h3>Comments</h3><ul><li>Well said</li></ul><p>I like it</p></div><form><h3>Write</h3><p>Your words</p></form><footer><h3>About</h3><p>By a friend</p></footer><aside><h3>Note</h3><ul><li>See also</li></ul></aside><div class='share'><h3>Share</h3><ul><li>By mail</li></ul></div></article></body>",
    "<body><main><nav><h2>Parts</h2><p>One and two</p></nav>[[<p>The <a>bridge</a> <a>over</a> the river is long.</p>]]<form><ul><li>Name</li></ul></form>[[<ol><li><a>First picture</a></li></ol>]]<div hidden><h3>Nothing</h3><ul><li>None</li></ul></div>[[<p>It was built in stone.</p>]]<div class='related'><h3>More bridges</h3><p>The bridge of wood</p></div><footer><ul><li>By us</li></ul></footer></main></body>",
]
FEATURES = ("links", "nav", "header", "footer", "aside", "form", "article", "prose", "heading", "item", "cell", "marked", "reader", "hidden")


def tag_kind(kind: str, inside: bool) -> str:
    """Name under which a tag's weight is learned; `inside`: in an article."""
    if kind == "skip":
        return "skip"
    if kind in INLINE or kind == "br":
        return "inline"
    return "flow" if kind in TEXT_BLOCKS or inside else "frame"


def learn_weights(labelled: list[str], steps: int = 300, penalty: float = 0.02) -> dict[str, float]:
    """Weights of features of words ("word" for the rest, by logistic regression) and of kinds of tags (log-odds, at most -0.02)."""
    inside: Counter[str] = Counter()
    outside: Counter[str] = Counter()
    rows, marks = [], []
    for source in labelled:
        page, main = Page(source.replace("[[", "\x01").replace("]]", "\x02")), False
        for i, (kind, text) in enumerate(zip(page.kinds, page.texts)):
            if kind != "text":
                (inside if main else outside).update([tag_kind(kind, "article" in page.owner[i].features)])
                continue
            for part in re.split("([\x01\x02])", text):
                main = part == "\x01" or main and part != "\x02"
                if part.strip("\x01\x02 "):
                    rows.append([1.0] + [float(f in page.features(i)) for f in FEATURES])
                    marks.append(float(main))
    x, y = np.array(rows), np.array(marks)
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-x @ w))
        hessian = (x * (p * (1 - p))[:, None]).T @ x + penalty * np.eye(len(w))
        w -= np.linalg.solve(hessian, x.T @ (p - y) + penalty * w)
    n, m = sum(inside.values()) + 4, sum(outside.values()) + 4
    odds = {k: math.log((inside[k] + 1) / n) - math.log((outside[k] + 1) / m) for k in ("inline", "flow", "frame", "skip")}
    return dict(zip(("word", *FEATURES), w.tolist())) | {k: min(-0.02, v) for k, v in odds.items()}


WEIGHTS = learn_weights(LABELLED)


def best_run(scores: list[float]) -> tuple[int, int]:
    """First and last place of the contiguous run with the highest sum (the first of equal ones); (0, -1) if none is positive."""
    best, found, total, start = 0.0, (0, -1), 0.0, 0
    for i, s in enumerate(scores):
        if total <= 0:
            total, start = 0.0, i
        total += s
        if total > best:
            best, found = total, (start, i)
    return found


def token_scores(page: Page, weights: dict[str, float]) -> tuple[list[float], list[float]]:
    """The score of each token, and that of one word of it (0 for tags).

    Within elements whose words do not score, only the outermost tags count, as one that is skipped.
    """
    held: dict[frozenset[str], float] = {}

    def word(features: frozenset[str]) -> float:
        got = held.get(features)
        if got is None:
            got = held[features] = max(0.0, weights["word"] + sum(weights[f] for f in features))
        return got

    scores, each, dark = [], [], False
    for i, (kind, text) in enumerate(zip(page.kinds, page.texts)):
        e = page.owner[i]
        if kind == "text":
            x = word(page.features(i))
            scores.append(x * len(text.split()))
            each.append(x)
            continue
        was, dark = dark, word(e.features) <= 0
        scores.append(0.0 if dark and was else weights["skip" if dark else tag_kind(kind, "article" in e.features)])
        each.append(0.0)
    return scores, each


def main_text(source: str | None, weights: dict[str, float] | None = None) -> str:
    """The main text of one page, blocks joined by single spaces."""
    if not source:
        return ""
    page = Page(source)
    scores, each = token_scores(page, weights or WEIGHTS)
    a, b = best_run(scores)
    parts: list[str] = []
    for kind, text, x in zip(page.kinds[a : b + 1], page.texts[a : b + 1], each[a : b + 1]):
        if kind == "text":
            parts.append(text if x > 0 else " ")
        elif kind not in INLINE:
            parts.append(" ")
    return " ".join(html_lib.unescape("".join(parts)).split())


def extract(pages: DataFrame, html: str = "html", keys: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """`keys`, `text` and `n_chars` (code points) of each page."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "_html"):
            texts = [main_text(x) for x in batch.column("_html").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(k) for k in keys] + [pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())], [*keys, "text", "n_chars"])

    held = pages.select(*keys, pages[html].alias("_html"))
    kinds = "".join(f"`{k}` {t}, " for k, t in held.dtypes[:-1])
    return held.mapInArrow(run, f"{kinds}text string, n_chars bigint")
