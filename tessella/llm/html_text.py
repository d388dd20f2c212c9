"""Main text of HTML pages: flat text blocks, classified by a small decision tree.

One linear pass cuts a page into flat blocks of text at block-level tags. A block's features are its
word count and link density, those of the blocks before and after it, whether it is a heading or a
list item, and a hint: evidence from the names of elements and the words of class, id and role, summed
from the outermost element in, where what is nearer counts for more. No name removes anything by
itself: `LABELLED` blocks (pages of `LAYOUTS`, which a seed fills with words) show the tree how far to
go by each feature, so long prose survives a doubtful name, and links or stray lines don't survive a
good one.
"""

from __future__ import annotations

import functools
import html
import random
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tessella.llm.common import schema_with, trimmed, without

#: Elements without text of the page: what they hold is passed over up to their end tag.
_RAW = set("script style title textarea noscript template iframe object svg canvas audio video select button datalist".split())
#: Of these, those that hold no markup: without an end tag they reach to the end of the page.
_CDATA = set("script style title textarea".split())
#: Elements that end a block.
_BLOCK = set("address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul".split())
_VOID = set("area base br col embed hr img input link meta param source track wbr".split())
_HEADINGS = set("h1 h2 h3 h4 h5 h6".split())
_ITEMS = set("li dt dd".split())
#: An element that ends where the next one of its kind begins.
_SIBLINGS = {x: group for group in (("li",), ("dt", "dd"), ("td", "th"), ("tr",), ("option",)) for x in group}

# Evidence. Fixed weights: an element's own, and that of one name of a class, id or role.
_ELEMENT = {"nav": -4.0, "footer": -4.0, "aside": -4.0, "form": -4.0, "menu": -4.0, "dialog": -4.0, "fieldset": -4.0, "header": -4.0, "article": 3.0, "main": 2.0}
_HIDDEN = -6.0
_WHOLLY, _PARTLY, _DOUBTFUL, _GOOD = -2.0, -1.5, -0.5, 1.5
_FURNITURE = set(
    "ad ads adv advert adverts advertisement advertising alert banner breadcrumb breadcrumbs byline comment comments complementary consent contentinfo cookie cookies copyright dialog disclaimer "
    "discussion disqus feedback footer form gdpr header login masthead menu modal nav navbar navigation newsletter notice overlay pager pagination popup promo promotion recommended related replies "
    "reply respond search share sharing sidebar signup skip social sponsor sponsored subscribe subscription tags toolbar topbar widget widgets".split()
)
_ARTICLE = set("article content entry main maincontent post story text body".split())
#: What takes the meaning from a name: "has-sidebar", "text-ad-free".
_NEGATION = set("has with no without free".split())

_NAME = re.compile(r"[a-zA-Z][a-zA-Z0-9:-]*")
_STEP = re.compile(r"[>\"']")
_ATTRIBUTE = re.compile(r"""([^\s"'<>/=]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]*))?""")
_WORDS = re.compile(r"[a-z]+")
_RAW_END = {x: re.compile(rf"</{x}\b[^>]*>", re.IGNORECASE) for x in _RAW}


def _weight(name: str) -> float:
    """Evidence of one name, as of a class."""
    found = _WORDS.findall(name)
    bad, good, turned = (sum(w in group for w in found) for group in (_FURNITURE, _ARTICLE, _NEGATION))
    if not bad or turned:
        return _GOOD if good else 0.0
    return _DOUBTFUL if good else _WHOLLY if bad == len(found) else _PARTLY


@functools.lru_cache(4096)
def _named(attributes: str) -> tuple[float, bool]:
    """(evidence of the names in class, id and role, whether the element is hidden)."""
    total, hidden = 0.0, False
    for m in _ATTRIBUTE.finditer(attributes):
        key, value = m[1].lower(), (m[2] or "").strip("\"'").lower()
        if key in ("class", "id", "role"):
            total += sum(map(_weight, set(value.split())))
        elif key == "hidden" or key == "aria-hidden" and value == "true" or key == "style" and re.search(r"display\s*:\s*none", value):
            hidden = True
    return max(-4.0, min(total, 2.0)), hidden


def _joined(outer: float, own: float) -> float:
    """The hint of an element by what it lies in and its own evidence: an inner name can turn a good
    place into a bad one, but hardly the other way."""
    if own < 0:
        return max(-6.0, min(outer, 0.5) + own)
    return min(4.0, outer + (own if outer > -2 else own / 2))


class _Place:
    """An open block-level element: its hint, how much of it is a form's, and its inline elements."""

    __slots__ = ("tag", "hint", "form", "within", "inline", "open")

    def __init__(self, tag: str, hint: float, form: float = 0.0, within: bool = False):
        self.tag, self.hint, self.form, self.within = tag, hint, form, within
        self.inline: list[tuple[str, float]] = []
        self.open: dict[str, int] = {}


def _tag_end(page: str, at: int, last: dict[str, int]) -> int:
    """Where the ``>`` of a tag is that begins before ``at``, past quoted values; -1 if nowhere. Once
    a quote that never closes has hidden all that follows, any ``>`` ends a tag."""
    if at > last[">"]:
        return -1
    start = at
    while not last["broken"] and (m := _STEP.search(page, at)):
        if m[0] == ">":
            return m.start()
        if page[max(start, m.start() - 16) : m.start()].rstrip().endswith("="):
            at = page.find(m[0], m.end(), last[m[0]] + 1) + 1
            if not at:
                break
        else:
            at = m.end()  # a stray quote in the middle of a name or value
        if at > last[">"]:
            break
    last["broken"] = True
    return page.find(">", start)


def blocks(page: str) -> list[tuple[str, int, int, float, int]]:
    """(text, words, words in links, hint, kind) of each block with text; kind: 2 heading, 1 list
    item, 0 other. Time is linear in the page's length."""
    out, held, kind, link, at, n = [], [], 0, False, 0, len(page)
    stack, counts = [_Place("", 0.0)], {}
    last, unclosed = {q: page.rfind(q) for q in ">\"'"} | {"broken": False}, set()

    def add(raw: str) -> None:
        if raw:
            top = stack[-1]
            held.append((html.unescape(raw) if "&" in raw else raw, link, top.inline[-1][1] if top.inline else top.hint))

    def close() -> None:
        if held:
            text = " ".join("".join(x[0] for x in held).split())
            if text:
                linked = sum(len(x.split()) for x, on, _ in held if on)
                out.append((text, len(text.split()), linked, max(hint for x, _, hint in held if not x.isspace()), kind))
            held.clear()

    def pop() -> None:
        counts[stack.pop().tag] -= 1

    while at < n:
        lt = page.find("<", at)
        if lt < 0:
            break
        after = page[lt + 1 : lt + 2]
        if after in "!?" and after:
            add(page[at:lt])
            if page.startswith("<!--", lt):
                end, size = page.find("-->", lt + 4), 3
            elif page.startswith("<![CDATA[", lt):
                end, size = page.find("]]>", lt + 9), 3
                add(html.escape(page[lt + 9 : end if end >= 0 else n]))
            else:
                end, size = page.find(">", lt), 1
            at = end + size if end >= 0 else n
            continue
        m = _NAME.match(page, lt + 2 if after == "/" else lt + 1)
        if not m:
            add(page[at : lt + 1])
            at = lt + 1
            continue
        add(page[at:lt])
        end = _tag_end(page, m.end(), last)
        if end < 0:  # a tag that never ends is none, and hides what follows
            at = n
            break
        closing, tag, attributes, at = after == "/", m[0].lower(), page[m.end() : end], end + 1
        top = stack[-1]
        if tag in _RAW:
            if not closing and not attributes.endswith("/") and tag not in unclosed:
                stop = _RAW_END[tag].search(page, at)
                if stop:
                    at = stop.end()
                elif tag in _CDATA:
                    at = n
                else:
                    unclosed.add(tag)
            continue
        if tag == "a":
            link = not closing
        if tag not in _BLOCK:
            if closing:
                if top.open.get(tag):
                    while True:
                        gone = top.inline.pop()[0]
                        top.open[gone] -= 1
                        if gone == tag:
                            break
            elif tag not in _VOID and not attributes.endswith("/"):
                own, hidden = _named(attributes.strip()) if attributes.strip() else (0.0, False)
                if own or hidden or top.inline:
                    outer = top.inline[-1][1] if top.inline else top.hint
                    top.inline.append((tag, _joined(outer, _HIDDEN if hidden else own)))
                    top.open[tag] = top.open.get(tag, 0) + 1
            continue
        close()
        link, kind = False, 0
        if closing:
            if counts.get(tag):
                while stack[-1].tag != tag:
                    pop()
                pop()
            continue
        kind = 2 if tag in _HEADINGS else 1 if tag in _ITEMS else 0
        if tag in _VOID:
            continue
        if stack[-1].tag in ("p", *_HEADINGS):
            pop()
        siblings = _SIBLINGS.get(tag, ())
        if tag == "tr" and stack[-1].tag in ("td", "th") or stack[-1].tag in siblings:
            pop()
        if stack[-1].tag in siblings:
            pop()
        top = stack[-1]
        own, hidden = _named(attributes.strip().rstrip("/")) if attributes.strip() else (0.0, False)
        if tag in ("html", "body"):
            own = 0.0
        outer, form = top.hint, top.form
        if tag in ("article", "main", "h1") and form:  # a form around the whole page says nothing of it
            outer, form = min(outer - form, 4.0), 0.0
        element = 0.0 if tag == "header" and top.within else _ELEMENT.get(tag, 0.0)
        hint = _joined(outer, _HIDDEN if hidden else element + own)
        stack.append(_Place(tag, hint, form + (min(hint - outer, 0.0) if tag == "form" else 0.0), top.within or tag in ("article", "main")))
        counts[tag] = counts.get(tag, 0) + 1
    add(page[at:])
    close()
    return out


# The labelled table. A layout is markup with places to fill: M a paragraph of main text, m a short one, H a heading
# of it, T its list item, P prose that isn't main text (teasers, comments, adverts), b a short line that isn't, B a link.
LAYOUTS = """
<header><h1>b</h1> B B</header><nav><ul><li>B<li>B<li>B</ul></nav><main><article><h1>H</h1><p>M<p>m<p>M<h2>H</h2><p>M<ul><li>T<li>T</ul><p>m</article></main><aside><h3>b</h3><p>P</aside><footer>b B B</footer>
<nav><ul><li>B<li>B<li>B<li>B</ul></nav><div class="ad">P</div><article><h1>H</h1><p>m</article><footer>b</footer>
<nav><ul><li>B<li>B</ul></nav><div class="ad">b</div><article><h1>H</h1><p>m<br>m<p>m<br>m<p>m</article><footer>b P</footer>
<article><p>m<p>m<p>m<p>M</article>
<article><h1>H</h1><p>m</p><div class="ad">P</div><p>M</p><p class="advert">b</p><p>M<p class="byline">b<div class="share">B B B</div><div class="related-posts"><h3>b</h3><ul><li>B<li>B</ul></div></article>
<article><header><h1>H</h1><p>m</header><p>M<ul><li>B<li>B<li>B</ul><p>m<form><label>b</label><p>P</form><aside>P</aside></article><footer>b B</footer>
<div id="header"><h1>B</h1><p>b</div><div id="menu"><ul><li>B<li>B<li>B</ul></div><div id="content"><h2>H</h2><p>M<p>M<p>m<p>M</div><div id="sidebar"><h3>b</h3><ul><li>B<li>B</ul><p>P</div><div id="footer"><p>b</div>
<div class="page with-sidebar"><div class="breadcrumbs">B B</div><div class="entry-content"><h1>H</h1><p>M<p>m<blockquote>M</blockquote><p>M</div><div class="sidebar-left"><p>P<ul><li>B<li>B</ul></div></div><div class="site-footer">b</div>
<div class="cookie-notice">P</div><div class="post"><h1>H</h1><p>M<p>M<p>m</div><section id="comments"><h3>b</h3><div class="comment"><p>P</div><div class="comment"><p>P<p>b</div><div class="comment"><p>P</div></section>
<div class="main"><h1>H</h1><p>M<p>M</div><section class="comment-list"><article class="comment"><p>P</article><article class="comment"><p>P</article></section>
<div class="post-body reply"><p>M<p>M</div><div class="reply"><p>P</div><div class="reply"><p>b</div>
<div id="feedback-form-article"><h2>H</h2><p>M<p>M<p>M</div><div id="feedback-form"><p>b<p>P<label>b</label></div>
<div class="newsletter-box"><h3>b</h3><p>P</div><div class="content text-ad-free"><p>M<p>M<p>m</div><div class="ad-box">P</div><div class="promo">P</div>
<div class="comment-text"><p>b<p>B<p>b</div><div class="story-content"><p>m<p>M</div><div class="related-articles"><p>b<p>B</div>
<ul><li>B<li>B<li>B<li>B<li>B</ul><h1>H</h1><p>M<p>M<p>m<p>M<h2>H</h2><p>M<p>M<p>b B</p><ul><li>B<li>B<li>B</ul><p>b
<table><tr><td>B<td>B<td>B<tr><td><h2>H</h2><p>M<p>M<p>M<p>M<td>B<br>B<br>b</table><p>b
<div>b B</div><div>B</div><div>B</div><div><div>H</div><div>M</div><div>M</div><div>M</div></div><div>b</div><div>B B</div><div>b</div>
<p>B B B<h1>H</h1><p>M<p>M<p>M<p>b<p>B<p>b<p>B<p>b
<div><h3>b</h3><ul><li>B<li>B<li>B</ul></div><div><h1>H</h1><p>M<ul><li>T<li>T<li>T</ul><p>M</div><div><h3>b</h3><ul><li>B<li>B</ul></div><div>b</div>
<main><h1>H</h1><p>M<p>m<p>M<div class="advertisement">P</div><p>M</main><nav>B B B</nav><div role="contentinfo">b</div>
<div id="feedback-form-article">M</div>
<div class="post-body reply">M</div>
<div class="content text-ad-free"><p>M</div>
<div>M</div>
<div class="comment">P</div>
<form><div class="main"><article><h1>H</h1><p>M<p>M<p>m</article></div></form><form><p>P<p>b</form><div class="subscribe"><p>P</div>
"""
#: Pages of each layout, and the seed that fills them.
PAGES, SEED = 6, 20
#: Words of a place to fill, least and most.
_SIZES = {"M": (18, 90), "m": (1, 17), "H": (1, 10), "T": (2, 14), "P": (4, 40), "b": (1, 7), "B": (1, 4)}


def labelled() -> tuple[np.ndarray, np.ndarray]:
    """Features and labels of the blocks of all filled layouts: `PAGES` pages a layout, some 1,250 rows."""
    rng, rows, labels = random.Random(SEED), [], []

    def fill(m: re.Match) -> str:
        low, high = _SIZES[m[0]]
        word = "main" if m[0] in "MmHT" else "other"
        words = [word] * round(low + (high - low) * rng.random() ** 2)
        if m[0] == "B":
            return f"<a href=x>{' '.join(words)}</a>"
        if m[0] == "M" and rng.random() < 0.3 or m[0] == "T" and rng.random() < 0.5:
            k = rng.randrange(1, 2 + len(words) // 3)
            words[:k] = ["<a href=x>" + " ".join(words[:k]) + "</a>"]
        return " ".join(words)

    for _ in range(PAGES):
        for layout in LAYOUTS.strip().splitlines():
            page = re.sub(r"(?<=[> ])[MmHTPbB](?=[ <]|$)", fill, layout)
            found = blocks(page)
            rows += features(found)
            labels += [x[0].startswith("main") for x in found]
    return np.array(rows, float), np.array(labels, bool)


def features(found: list[tuple[str, int, int, float, int]]) -> list[tuple]:
    """Hint, words, link density, words and link density before and after, and kind of each block."""
    around = [(0, 0.0), *((b[1], min(b[2] / b[1], 1.0)) for b in found), (0, 0.0)]
    return [(b[3], *around[k + 1], *around[k], *around[k + 2], b[4]) for k, b in enumerate(found)]


#: Where the features stand in a row.
HINT, WORDS, DENSITY, KIND = 0, 1, 2, 7


def grow(rows: np.ndarray, labels: np.ndarray, depth: int = 8, least: int = 3):
    """A decision tree by Gini impurity: a label, or (feature, threshold, below, above)."""
    if depth == 0 or len(rows) < 2 * least or labels.min() == labels.max():
        return bool(2 * labels.sum() >= len(labels))
    best = None
    for f in range(rows.shape[1]):
        order = np.argsort(rows[:, f], kind="stable")
        x, y = rows[order, f], np.cumsum(labels[order])
        n = np.arange(1, len(x))
        ok = (x[1:] > x[:-1]) & (n >= least) & (len(x) - n >= least)
        if not ok.any():
            continue
        n, below = n[ok], y[:-1][ok]
        above = y[-1] - below
        impurity = below * (n - below) / n + above * (len(x) - n - above) / (len(x) - n)
        k = int(impurity.argmin())
        if best is None or impurity[k] < best[0] - 1e-9:
            at = np.flatnonzero(ok)[k]
            best = (impurity[k], f, float((x[at] + x[at + 1]) / 2))
    if best is None:
        return bool(2 * labels.sum() >= len(labels))
    _, f, cut = best
    low = rows[:, f] <= cut
    return f, cut, grow(rows[low], labels[low], depth - 1, least), grow(rows[~low], labels[~low], depth - 1, least)


@functools.cache
def tree():
    """The tree of the labelled table."""
    return grow(*labelled())


def decide(node, row: tuple) -> bool:
    while not isinstance(node, bool):
        f, cut, low, high = node
        node = low if row[f] <= cut else high
    return node


def main_text(page: str | None, node=None) -> str:
    """The main text: its blocks, a line each; empty for a null page or one without main text."""
    found, node = blocks(page or ""), tree() if node is None else node
    return "\n".join(b[0] for b, row in zip(found, features(found), strict=True) if decide(node, row))


def extract(pages: DataFrame) -> DataFrame:
    """``pages`` (html, further columns) with text and n_chars (its code points) in place of html.

    A null or empty page has an empty text. Malformed markup is read as browsers would: elements
    end where their parents do, and what follows a tag that never ends is not text. Rows that repeat
    give the same text; an empty table gives no rows. An extra column named text or n_chars gives way.
    """
    rest = without(pages, "html", "text", "n_chars")
    names, node = rest.columns, tree()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(x, node) for x in batch.column(len(names)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(names)], pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64())], [*names, "text", "n_chars"])

    return pages.select(*[f"`{c}`" for c in names], "html").mapInArrow(trimmed(run), schema_with(rest, "text string, n_chars bigint"))
