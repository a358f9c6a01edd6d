"""Labelled pages: layouts written for this library, filled with made-up prose of random length.

[[ and ]] enclose the main text of a layout, so every word and tag of a filled page has a label. Slots:
$s a few words, $l a sentence, $p a long paragraph, $body the paragraphs, headings and lists of an article,
$links list items with links, $flat links side by side, $said a run of reader comments.
"""

from __future__ import annotations

import random
import re

LAYOUTS = {
    "news": '<body><div id="cookie-banner" class="cookie">$l <button>$s</button></div><header class="site-header"><a href="/">$s</a></header><nav class="main-nav"><ul>$links</ul></nav><div class="ad">$l</div><main><article>[[<h1>$s</h1>$body]]<div class="ad-slot">$l</div>[[$body]]<div class="share">$flat</div></article><aside class="related"><h3>$s</h3><ul>$links</ul></aside><section id="comments">$said</section></main><footer><p>$l</p><ul>$links</ul></footer></body>',
    "blog": '<body class="home has-sidebar"><div id="page" class="site"><div id="header"><h2><a href="/">$s</a></h2><p>$l</p></div><div id="content" class="content-with-sidebar"><div class="post">[[<h1>$s</h1>$body]]<p class="tags">$flat</p></div><div class="comments-area"><h3>$s</h3>$said</div></div><div id="sidebar"><h3>$s</h3><ul>$links</ul><p>$l</p></div><div id="footer">$l $flat</div></div></body>',
    "plain": "<body><div>$flat</div>[[<h1>$s</h1>$body]]<hr><div>$flat</div></body>",
    "tables": '<body><table><tr><td colspan="2">$flat</td></tr><tr><td><ul>$links</ul></td><td>[[<h2>$s</h2>$body]]</td></tr><tr><td colspan="2">$s $flat</td></tr></table></body>',
    "docs": '<body><div class="navbar">$flat</div><div class="layout menu-open"><div class="sidebar"><ul>$links</ul><ul>$links</ul></div><div class="content">[[<h1>$s</h1>$body]]<div class="pager">$flat</div></div><div class="toc"><ul>$links</ul></div></div><div class="footer">$l</div></body>',
    "wiki": '<body><div class="mw-menu"><ul>$links</ul></div><div id="content" class="page-body" role="main">[[<h1>$s</h1><p>$p <a href="/x">$s</a> $l <a href="/y">$s</a></p>$body]]</div><div class="footer-links"><ul>$links</ul></div></body>',
    "bare article": "<body><nav>$flat</nav><div>$l</div><article>[[<h1>$s</h1>$body]]</article><footer>$l</footer></body>",
    "divs": "<body><div><div>$s</div><ul>$links</ul></div><div><div>[[<h1>$s</h1><div>$p</div><div>$p</div>$body]]</div><div><div>$s</div><ul>$links</ul></div></div><div>$s <a href='/'>$s</a></div></body>",
    "notice": '<body><div class="notice">$l $l</div><div class="popup modal"><p>$l</p><form><input name="q">$s</form></div><div class="row header-visible"><article class="post share">[[<h1>$s</h1>$body]]<div class="newsletter-signup"><p>$l</p></div>[[$body]]</article></div><div class="sponsored"><p>$l</p><p>$l</p></div><div id="disqus" class="comment-list">$said</div></body>',
    "form page": '<body><form id="page-form"><div class="topbar">$flat</div><div class="main-area widget-content">[[<h1>$s</h1>$body]]</div><div class="widget"><p>$l</p><ul>$links</ul></div></form><div class="copyright">$l</div></body>',
    "short": '<body><div class="menu"><ul>$links</ul></div><article>[[<p>$s</p>]]</article><div class="comments">$said</div><footer>$l $flat</footer></body>',
    "discussion": '<body><nav><ul>$links</ul></nav><div class="entry related-work"><h1>[[$s</h1>$body]]</div><section class="replies">$said $said $said</section><div class="promo">$p</div></body>',
}
#: Layouts that the shipped weights are not fitted on; tests score them.
HELD_OUT = {
    "magazine": '<body><div class="topbar">$flat</div><div class="navigation"><ul>$links</ul></div><div class="wrapper no-sidebar"><section class="story">[[<h1>$s</h1><p class="lead">$p</p>$body]]<div class="advert">$p</div>[[$body]]</section><div class="comment-thread">$said</div></div><div class="site-footer"><p>$l</p>$flat</div></body>',
    "shop": '<body><header><ul>$links</ul></header><div class="breadcrumbs">$flat</div><main>[[<h1>$s</h1>$body]]</main><aside><p>$p</p></aside><div class="recommended"><ul>$links</ul></div><footer>$flat</footer></body>',
    "old": "<body><center>$flat</center>[[<h2>$s</h2>$body]]<center>$flat</center></body>",
    "wide": '<body><div class="page"><div class="menu"><ul>$links</ul></div><div class="body">[[<h1>$s</h1>$body]]</div><div class="subscribe">$l<form>$s</form></div></div></body>',
}
_SLOT = re.compile(r"\[\[|\]\]|\$[a-z]+")


def _filler(r: random.Random):
    def words(a: int, b: int) -> str:
        return " ".join("".join(r.choice("aeiourstnlm") for _ in range(r.randint(1, 9))) for _ in range(r.randint(a, b)))

    def links(join: str) -> str:
        return join.join(f'<a href="/{j}">{words(1, 3)}</a>' for j in range(r.randint(3, 9)))

    def body() -> str:
        kinds = [f"<p>{words(3, 90)}</p>", f"<p>{words(15, 60)} <a href='/x'>{words(1, 3)}</a> {words(5, 30)}<br>{words(3, 9)}", f"<p>{words(20, 90)}</p>", f"<h2>{words(1, 6)}</h2><p>{words(10, 60)}</p>", f"<ul><li>{words(1, 20)}</li><li>{words(8, 20)}</li></ul>", f"<blockquote><p>{words(5, 30)}</p></blockquote>"]
        return "".join(r.choice(kinds) for _ in range(r.randint(1, 6)))

    return {
        "$s": lambda: words(1, 5),
        "$l": lambda: words(5, 22),
        "$p": lambda: words(25, 90),
        "$body": body,
        "$links": lambda: "<li>" + links("</li><li>") + "</li>",
        "$flat": lambda: links(" | "),
        "$said": lambda: "".join(f'<div class="comment"><b>{words(1, 2)}</b><p>{words(5, 60)}</p><a href="#">{words(1, 1)}</a></div>' for _ in range(r.randint(1, 6))),
    }


def filled(layouts: dict[str, str], each: int, seed: int) -> list[list[tuple[str, bool]]]:
    """`each` pages of every layout, as pieces of markup with their label."""
    r = random.Random(seed)
    fill = _filler(r)
    pages = []
    for layout in layouts.values():
        for _ in range(each):
            page, main, at = [], False, 0
            for m in _SLOT.finditer(layout):
                page.append((layout[at : m.start()], main))
                at = m.end()
                if m[0] in ("[[", "]]"):
                    main = m[0] == "[["
                else:
                    page.append((fill[m[0]](), main))
            page.append((layout[at:], main))
            pages.append([p for p in page if p[0]])
    return pages
