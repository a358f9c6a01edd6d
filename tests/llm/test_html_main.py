"""Main text of pages: reading, scan and weights."""

import time

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from fellwalk.llm import html_main, layouts

PAGE = """<html><head><title>T</title><style>p{}</style></head><body><header>Top</header><nav><ul><li><a href=/>Home</a></li></ul></nav>
<div id="cookie-notice">We use cookies to make this site better for you and for us</div>
<article><h1>A   title &amp; more</h1><p>First &#233;té paragraph with <b>bold</b> words and <a href=x>a link</a>.<div class="ad">Buy this now</div>
<p>Second one<br>goes on</p><ul><li>item one</li></ul><script>var a = "<p>no</p>";</script><aside>See also</aside></article>
<section class="comments"><p>I liked this a lot, thank you for the article</p></section><form><p>Your mail</p></form><footer>&copy; us</footer></body></html>"""
PAGE_TEXT = "A title & more\nFirst été paragraph with bold words and a link.\nSecond one goes on\nitem one"


@pytest.fixture(scope="module")
def scorer():
    return html_main.Scorer(html_main.fit())


def test_pages(scorer):
    assert html_main.extract(PAGE, scorer) == PAGE_TEXT
    plain = "<div><a href=1>a</a> <a href=2>b</a></div><div><h1>Head</h1><p>" + "long text here " * 20 + "</p><p>" + "more of it now " * 20 + "</p></div><div><a href=3>c</a></div>"
    assert html_main.extract(plain, scorer) == "Head\n" + ("long text here " * 20).strip() + "\n" + ("more of it now " * 20).strip()
    cut = "<body><article><p><b>Never closed and cut off in the middle of a ta<br><p>Second paragraph of it</p><p class='x"
    assert html_main.extract(cut, scorer) == "Never closed and cut off in the middle of a ta\nSecond paragraph of it"
    assert html_main.extract('<article><p>Alpha text one.</p><p class="teaser">Lead.</p><p>Beta.</p></article>', scorer) == "Alpha text one.\nLead.\nBeta."


@pytest.mark.parametrize("name", ["layout has-sidebar", "page no-sidebar", "content-with-sidebar", "post menu-open", "row header-visible", "widget-content", "related-work", "share"])
@pytest.mark.parametrize("inner", ["<article>{}</article>", "<div>{}</div>", "{}"])
def test_marks_around_the_article_keep_it(scorer, name, inner):
    body = "<h1>Title here</h1>" + "<p>some words of a text and more of them</p>" * 5
    page = f"<body><nav><a href=/>home</a></nav><div class='{name}'>{inner.format(body)}</div><div class=ad>Buy this now or never</div><footer>bye</footer></body>"
    assert html_main.extract(page, scorer) == "\n".join(["Title here", *["some words of a text and more of them"] * 5])


def test_signs(scorer):
    for place in range(1 << 7):
        assert scorer.one(-1, place) > 0
        assert all(scorer.one(kind, place) < 0 for kind in range(len(html_main.KINDS)))


def words_by_label(page, scorer):
    """(main and kept, kept only, main only) words of a labelled page."""
    ends = np.cumsum([len(p) for p, _ in page])
    read = html_main.Page("".join(p for p, _ in page))
    keep = html_main.kept_items(read, scorer.scores(read))
    label = np.array([page[int(np.searchsorted(ends, at, "right"))][1] for at in read.at])
    words = read.counts * (np.array(read.kind) < 0)
    return np.array([words[label & keep].sum(), words[~label & keep].sum(), words[label & ~keep].sum()])


def test_held_out_layouts(scorer):
    right, wrong, lost = sum(words_by_label(p, scorer) for p in layouts.filled(layouts.HELD_OUT, 20, 91))
    assert right / (right + wrong) > 0.98 and right / (right + lost) > 0.98


def test_the_scan_does_the_removal(scorer):
    """Words that go by the scan alone, on pages whose boilerplate has no class words or roles."""
    gone = kept = 0
    for page in layouts.filled({k: layouts.LAYOUTS[k] for k in ("plain", "tables", "divs")}, 10, 3):
        read = html_main.Page("".join(p for p, _ in page))
        begin, end = html_main.scan(scorer.scores(read).tolist())
        label = words_by_label(page, scorer)
        total = read.counts.sum()
        inside = read.counts[begin:end].sum()
        gone, kept = gone + total - inside, kept + inside
        assert label[1] == 0 and not read.marked
    assert gone > 0.05 * kept


def test_whole_result_by_brute_force(scorer):
    pages = [*layouts.filled(layouts.LAYOUTS | layouts.HELD_OUT, 2, 17), [(PAGE, True)]]
    for page in pages:
        read = html_main.Page("".join(p for p, _ in page))
        scores = scorer.scores(read)
        best = (0.0, 0, 0, 0)
        for i in range(len(scores)):
            total = 0.0
            for j in range(i, len(scores)):
                total += scores[j]
                if total > best[0] + 1e-9 or abs(total - best[0]) <= 1e-9 and total > 0 and j + 1 - i > best[1]:
                    best = (total, j + 1 - i, i, j + 1)
        keep = {k for k in range(best[2], best[3])}
        for first, last, _, level in read.marked:  # an outer element comes before those in it
            if level == 1:
                first, last = max(first, best[2]), min(last, best[3])
            if sum(scores[first:last]) < 0:
                keep -= set(range(first, last))
        text, gaps = "", {"": "", " ": " ", "\n": "\n"}
        for k, (kind, s) in enumerate(zip(read.kind, read.text, strict=True)):
            text += gaps[s] if kind >= 0 else " ".join(("x" + s + "x").split())[1:-1] if k in keep else ""
        want = [" ".join(line.split()) for line in text.split("\n")]
        assert html_main.extract("".join(p for p, _ in page), scorer) == "\n".join(x for x in want if x)


BAD = ['<a b="' * 170_000, "<div>" * 200_000, "<p><td>" + "<b>" * 100_000 + "<hr>" * 100_000, "<!--" * 250_000, "<a " * 300_000, "<script>" * 120_000, "<" * 1_000_000, "</b>" * 200_000, "<b>x</i>" * 100_000, '<a b="" ' * 120_000, '<p class="' + "menu " * 200_000 + '">x']


@pytest.mark.parametrize("page", BAD, ids=range(len(BAD)))
def test_broken_pages_take_linear_time(scorer, page):
    begin = time.process_time()
    html_main.extract(page, scorer)
    assert time.process_time() - begin < 5  # about a second on a free core; hours if quadratic


def test_edge_rows(spark, scorer):
    pages = spark.createDataFrame([(1, "u", None, 1), (2, None, "", 2), (3, "u", PAGE, 3), (3, "u", PAGE, 3), (4, "u", "<nav>menu</nav>", 4), (5, "u", "<p>" + "w " * 60_000, 5), (None, "u", "<p>no id, but a text of some length</p>", 6)], "page_id long, url string, html string, text int")
    got = html_main.extract_pages(pages, scorer.weights).collect()
    assert [(r.page_id, r.n_chars == len(r.text)) for r in got] == [(k, True) for k in (1, 2, 3, 3, 4, 5, None)]
    assert got[0].text == got[1].text == got[4].text == "" and got[5].n_chars == 2 * 60_000 - 1 and got[2].text == got[3].text == PAGE_TEXT
    assert html_main.extract_pages(pages.limit(0), scorer.weights).count() == 0


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(-5, 5), max_size=30))
def test_scan_finds_the_best_stretch(xs):
    begin, end = html_main.scan([float(x) for x in xs])
    assert sum(xs[begin:end]) == max([0, *(sum(xs[i:j]) for i in range(len(xs)) for j in range(i, len(xs) + 1))])


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["<p>", "</p>", "<b>", "</b>", "<div class=ad>", "</div>", "<script>", "</script>", "<!--", "-->", '<a x="', '">', "<", ">", "&amp;", " word ", "text", "<li>", "<h1>", "<article>", "</article>", "<table>", "<td>", "<br/>", "<form>", "\n"]), max_size=30).map("".join))
def test_any_markup_is_read(page):
    got = html_main.extract(page, html_main.Scorer(np.ones(len(html_main.WORD_FEATURES) + len(html_main.TAG_FEATURES))))
    assert got == got.strip() and "\n\n" not in got
