"""Main text of web pages by maximum-scoring subsequence.

A page becomes a sequence of words and tags. Words score above zero and tags below, by how much depends
on where they stand; the weights are fitted on labelled pages. One linear scan finds the contiguous
stretch with the highest sum. Class words, roles and element names that speak of menus, notices, adverts,
comments and the like remove nothing by themselves: they are features with fitted weights. Inside the
best stretch, an element with such a mark goes if its own sum is below zero.
"""

from __future__ import annotations

import html
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import chunks, table
from .layouts import LAYOUTS, filled

# Element names of HTML, and words that hint at an element beside the article.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style title textarea noframes xmp iframe noembed".split())
#: Elements without text for readers; nothing else is left out before the scan.
NO_TEXT = frozenset("head script style title noscript noframes template button select option textarea iframe svg canvas object audio video datalist".split())
BESIDE = frozenset("nav footer aside form dialog menu fieldset label".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd mark q s samp small span strike strong sub sup time tt u var wbr ruby rt rp".split())
PARAGRAPH = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre".split())
LISTS = frozenset("li ul ol dl dd dt".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert form menu menubar".split())
MARKS = frozenset(
    "ad ads advert adverts advertisement advertising adsense banner breadcrumb breadcrumbs comment comments commentlist consent cookie cookies disqus footer gdpr header login masthead menu "
    "modal nav navbar navigation newsletter notice notification pager pagination paywall popup promo promoted promotion recommended related replies reply respond share sharing sidebar sidenav "
    "signup skip skiplink social sponsor sponsored subscribe subscription teaser toc toolbar topbar widget".split()
)
#: Words beside a mark in one class name that leave its meaning as it is ("site-footer", "ad-slot").
NEUTRAL = frozenset("site main global page left right top bottom inner outer wrap wrapper container box block section area bar slot list links items item buttons button group panel primary secondary thread form count unit space text div col column el sticky mobile desktop".split())
CLOSED_BY = {"p": frozenset("p div ul ol table h1 h2 h3 h4 h5 h6 section article aside nav header footer main form blockquote pre hr figure address dl fieldset".split()), "li": frozenset(["li"]), "td": frozenset("td th tr".split()), "th": frozenset("td th tr".split()), "tr": frozenset(["tr"]), "dt": frozenset("dt dd".split()), "dd": frozenset("dt dd".split()), "option": frozenset("option".split()), "head": frozenset("body p div ul ol table h1 h2 h3 section article nav header main".split())}

_OPEN = re.compile(r"<(?:(!--)|([!?])|(/?)([a-zA-Z][^\s/>]*))")
#: The rest of a tag: attributes up to ">", which may stand inside a quoted value. Every character is read once.
_REST = re.compile(r"""(?:[^'">]|"[^"]*"|'[^']*')*+>""", re.S)
_ATTR = re.compile(r"""(?<![^\s"'/])(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>"']+))?(?![^\s"'/=])""", re.I)
_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")
_UNSEEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
WORD_FEATURES = ("word", "in a link", "in a list", "in a paragraph", "in the article", "beside the article", "hinted", "marked")
TAG_FEATURES = ("tag", "link", "list", "container", "inline", "paragraph", "article", "in the article", "beside the article", "hinted", "marked")
#: Bits of an item's place.
LINK, LIST, PARA, INSIDE, OUTSIDE, HINT, MARK = (1 << k for k in range(7))
KINDS = ("link", "list", "container", "inline", "paragraph", "article")


def hint(tag: str, attrs: str) -> int:
    """How clearly an element calls itself something beside the article: 0, 1 (hinted), 2 (marked), 3 (hidden)."""
    best = 2 if tag in BESIDE else 0
    for name, value in _ATTR.findall(attrs) if attrs else ():
        name, value = name.lower(), value.strip("\"'")
        if name == "hidden" or name == "style" and _UNSEEN.search(value):
            return 3
        if name == "aria-hidden" and value.lower() == "true" or name == "role" and value.lower() in ROLES:
            best = 2
        if name in ("class", "id"):
            for one in value.split():
                parts = {x.lower() for x in _PART.findall(one)}
                if parts & MARKS:
                    clear = not parts - MARKS - NEUTRAL - {p for p in parts if p.isdigit()} and tag not in PARAGRAPH and tag not in ("html", "body")
                    best = max(best, 2 if clear else 1)
    return best


class Page:
    """The words and tags of a page in order, with what is known of their place.

    text, gap: words, or the gap that a tag leaves between words. kind: -1 for words, else a number in
    KINDS. place: bits. elements: [first item, end item, tag, hint] in the order of their opening tags.
    Reading is linear in the page: every character and every open element is passed a bounded number of times.
    """

    def __init__(self, page: str):
        self.text: list[str] = []
        self.kind: list[int] = []
        self.place: list[int] = []
        self.at: list[int] = []
        self.elements: list[list] = []
        self._read(page)
        self._settle()

    def _read(self, page: str) -> None:
        stack: list[tuple[str, int, int]] = []  # tag, element number or -1 (no text), stack place of the nearest block at or below
        opened: dict[str, int] = {}
        hidden = links = lists = paras = 0
        quotes = True

        def add(kind: int, text: str, bits: int, at: int) -> None:
            self.kind.append(kind)
            self.text.append(text)
            self.place.append(bits)
            self.at.append(at)

        def count(tag: str, by: int) -> None:
            nonlocal links, lists, paras
            opened[tag] = opened.get(tag, 0) + by
            links += by * (tag == "a")
            lists += by * (tag in ("li", "dd", "dt"))
            paras += by * (tag in PARAGRAPH)

        def pop() -> None:
            nonlocal hidden
            tag, number, _ = stack.pop()
            if number < 0:
                hidden -= 1
            else:
                self.elements[number][1] = len(self.text)
            count(tag, -1)

        def words(begin: int, end: int) -> None:
            if not hidden and begin < end:
                add(-1, html.unescape(page[begin:end]), LINK * (links > 0) | LIST * (lists > 0) | PARA * (paras > 0), begin)

        at, size = 0, len(page)
        while True:
            m = _OPEN.search(page, at)
            if not m:
                words(at, size)
                break
            words(at, m.start())
            at = m.end()
            if m[1]:  # a comment; one that never ends takes the rest
                end = at if page[at : at + 1] == ">" else page.find("-->", at)
                at = size if end < 0 else end + (1 if page[end] == ">" else 3)
                continue
            rest = _REST.match(page, at) if quotes and not m[2] else None
            if rest:
                end = rest.end()
            else:  # quotes that never end: from here on tags end at the next ">"
                quotes = quotes and bool(m[2])
                end = page.find(">", at) + 1
                if not end:  # a tag that the end of the page cuts off
                    break
            attrs, at = page[m.end() : end - 1], end
            if m[2]:
                continue
            tag = m[4].lower()
            kind = 0 if tag == "a" else 1 if tag in LISTS else 3 if tag in INLINE or tag == "br" else 4 if tag in PARAGRAPH else 5 if tag in ("article", "main") else 2
            gap = "" if tag in INLINE else " " if tag in ("br", "td", "th") else "\n"
            if m[3]:
                if opened.get(tag):
                    while stack[-1][0] != tag:
                        pop()
                    if not hidden:
                        add(kind, gap, 0, m.start())
                    pop()
                elif not hidden:
                    add(kind, gap, 0, m.start())
                continue
            while stack and tag in CLOSED_BY.get(stack[-1][0], ()):
                pop()
            # an open paragraph also ends inside unclosed inline elements
            if tag in CLOSED_BY["p"] and stack and stack[-1][2] >= 0 and stack[stack[-1][2]][0] == "p":
                for _ in range(len(stack) - stack[-1][2]):
                    pop()
            level = hint(tag, attrs)
            gone = tag in NO_TEXT or level == 3
            if not hidden:
                add(2 if gone else kind, gap, 0, m.start())
            if tag in VOID or attrs.endswith("/") and tag not in RAW:
                continue
            if tag in RAW:
                close = re.compile(f"</{re.escape(tag)}(?![^\\s/>])", re.I).search(page, at)
                if not hidden and not gone:
                    add(-1, page[at : close.start() if close else size], 0, at)
                if not close:
                    break
                at = page.find(">", close.end()) + 1 or size
                continue
            if gone:
                hidden += 1
            else:
                self.elements.append([len(self.text) - 1, -1, tag, level] if not hidden else [len(self.text), -1, tag, 0])
            block = len(stack) if tag not in INLINE else stack[-1][2] if stack else -1
            stack.append((tag, -1 if gone else len(self.elements) - 1, block))
            count(tag, 1)
        while stack:
            pop()

    def _settle(self) -> None:
        """Finds the article, takes marks off what holds it, and fills in the bits that follow from both."""
        n = len(self.text)
        counts = np.array([len(t.split()) if k < 0 else 0 for k, t in zip(self.kind, self.text, strict=True)], np.int64)
        self.counts = counts
        upto = np.concatenate(([0], np.cumsum(counts)))
        held = lambda e: int(upto[e[1]] - upto[e[0]])
        heads = np.zeros(n + 1, np.int64)
        for e in self.elements:
            if e[2] == "h1":
                heads[e[0] + 1] += 1
        heads = np.cumsum(heads)
        own = [e for e in self.elements if e[2] in ("article", "main") and e[3] < 2 and e[1] > e[0]]
        # the first main element, else the article with a top heading, else the longest
        article = max(own, key=lambda e: (e[2] == "main", heads[e[1]] > heads[e[0]], held(e)), default=None)
        total = int(upto[-1])
        change = np.zeros((4, n + 1), np.int64)

        def mark(row: int, e) -> None:
            change[row, e[0]] += 1
            change[row, e[1]] -= 1

        self.marked = []
        for e in self.elements:
            if not e[3]:
                continue
            if article and e[0] <= article[0] and e[1] >= article[1]:
                continue
            if not article and e[2] not in ("nav", "footer", "aside") and 2 * held(e) >= total and (heads[e[1]] > heads[e[0]] or not heads[-1]):
                e[3] = 1
            mark(2 if e[3] == 1 else 3, e)
            self.marked.append(e)
        if article:
            mark(0, article)
        for e in self.elements:
            if e[2] == "header":  # of the page, not of the article
                if not article or e[0] < article[0] or e[1] > article[1]:
                    if not (article and e[0] <= article[0] and e[1] >= article[1]) and not (not article and 2 * held(e) >= total):
                        e[3] = 2
                        mark(3, e)
                        self.marked.append(e)
        inside, _, hinted, marked = (np.cumsum(c)[:n] > 0 for c in change)
        self.marked.sort(key=lambda e: (e[0], -e[1]))
        place = np.array(self.place, np.int64)
        place |= np.where(inside, INSIDE, OUTSIDE if article else 0) | np.where(hinted, HINT, 0) | np.where(marked, MARK, 0)
        self.place = place.tolist()


def features(kind: int, place: int) -> list[int]:
    """Numbers of the features of an item; those of tags follow those of words."""
    if kind < 0:
        return [0, *(k + 1 for k in range(7) if place >> k & 1)]
    return [len(WORD_FEATURES) + k for k in (0, 1 + kind, *(7 + k for k, bit in enumerate((INSIDE, OUTSIDE, HINT, MARK)) if place & bit))]


class Scorer:
    """Scores of items by log odds z of being main text: a word scores log(1 + e**z), always above zero, a
    tag -log(1 + e**-z), always below."""

    def __init__(self, weights: np.ndarray):
        self.weights = weights
        self.known: dict[tuple[int, int], float] = {}

    def one(self, kind: int, place: int) -> float:
        key = (kind, place)
        if key not in self.known:
            z = float(sum(self.weights[f] for f in features(kind, place)))
            self.known[key] = float(np.logaddexp(0, z) if kind < 0 else -np.logaddexp(0, -z))
        return self.known[key]

    def scores(self, page: Page) -> np.ndarray:
        one = self.one
        return np.array([one(k, p) for k, p in zip(page.kind, page.place, strict=True)], float) * np.where(np.array(page.kind) < 0, page.counts, 1)


def scan(scores: list[float]) -> tuple[int, int]:
    """[begin, end) of the contiguous stretch with the highest sum; the longest one on ties, (0, 0) if none is positive."""
    best, found, total, begin = 0.0, (0, 0), 0.0, 0
    for i, s in enumerate(scores):
        if total < 0:
            total, begin = 0.0, i
        total += s
        if total > best or (total == best and best > 0 and i + 1 - begin > found[1] - found[0]):
            best, found = total, (begin, i + 1)
    return found


def kept_items(page: Page, scores: np.ndarray) -> np.ndarray:
    """Which items are main text: those of the best stretch, less those of marked elements whose own sum is below zero."""
    begin, end = scan(scores.tolist())
    keep = np.zeros(len(scores), bool)
    keep[begin:end] = True
    upto = np.concatenate(([0.0], np.cumsum(scores)))
    done = 0
    for first, last, _, level in page.marked:
        if level < 2:  # a hint around the stretch says nothing about it
            first, last = max(first, begin), min(last, end)
        if done <= first < min(last, end) and last > begin and upto[last] - upto[first] < 0:
            keep[first:last] = False
            done = last
    return keep


def extract(page: str | None, scorer: Scorer) -> str:
    """Text of the best region: white space in a block is one blank, blocks are joined by a newline."""
    if not page:
        return ""
    read = Page(page)
    if not read.text:
        return ""
    blocks, block = [], []
    for kind, s, keep in zip(read.kind, read.text, kept_items(read, scorer.scores(read)).tolist(), strict=True):
        if kind < 0:
            if keep:
                block.append(s)
        elif s == "\n":
            blocks.append("".join(block))
            block = []
        else:
            block.append(s)
    blocks.append("".join(block))
    return "\n".join(b for b in (" ".join(x.split()) for x in blocks) if b)


def fit(pages: list[list[tuple[str, bool]]] | None = None, rounds: int = 600, rate: float = 1.0) -> np.ndarray:
    """Log-odds weights by logistic regression on the words and tags of labelled pages."""
    rows: dict[tuple, list[float]] = {}
    for page in filled(LAYOUTS, 8, 5) if pages is None else pages:
        ends = np.cumsum([len(p) for p, _ in page])
        read = Page("".join(p for p, _ in page))
        for kind, place, n, at in zip(read.kind, read.place, read.counts.tolist(), read.at, strict=True):
            if kind >= 0 or n:
                got = rows.setdefault(tuple(features(kind, place)), [0.0, 0.0])
                got[page[int(np.searchsorted(ends, at, "right"))][1]] += n if kind < 0 else 1
    x = np.zeros((len(rows), len(WORD_FEATURES) + len(TAG_FEATURES)))
    for k, fs in enumerate(rows):
        x[k, list(fs)] = 1
    seen = np.array(list(rows.values()))
    w = np.zeros(x.shape[1])
    words = x[:, 0] > 0
    for of in (words, ~words):  # two regressions: words and tags share no feature
        a, n = x[of], seen[of]
        total = n.sum()
        for _ in range(rounds):
            p = 1 / (1 + np.exp(-a @ w))
            w -= rate * (a.T @ (n.sum(1) * p - n[:, 1]) / total + 1e-4 * w * (a.any(0)))
    return w


def extract_pages(pages: DataFrame, weights: np.ndarray) -> DataFrame:
    """page_id, url, text, n_chars of every row of `pages`; other columns are ignored.

    A null or empty html, and a page with nothing but markup, has an empty text. Repeated rows are answered
    one by one.
    """

    def run(batches):
        scorer = Scorer(weights)
        for b in chunks(batches, "html"):
            text = [extract(h, scorer) for h in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(text, pa.string()), pa.array([len(t) for t in text], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return pages.select(F.col("page_id").cast("long"), "url", "html").mapInArrow(run, "page_id long, url string, text string, n_chars long")


def op2_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page; null html is empty, pages of any length are read whole, repeated rows are read one by one."""
    return extract_pages(table(spark, sf_dir, "pages"), fit())
