"""Operator 1 on small pages with known texts."""

from __future__ import annotations

import math
import random

import pytest

from weftline.llm import html_text

ARTICLE = """<!DOCTYPE html><html><head><title>T</title><style>p{margin:0}</style><script>var t="</p>";</script></head><body>
<nav><ul><li><a href="/">Home</a></li></ul></nav><div class="ad">Buy</div><div class="cookie-notice">We use cookies</div>
<article><header><h1>A  &amp;
B</h1></header><p>One <b>two</b>&nbsp;three&#33;<p>Four<br>five<ul><li>a<li>b</ul><form><input value=x><button>Go</button></form>
<aside>Side</aside><table><tr><td>c<td>d</table><div class="comments"><p>First!</p></div></article>
<section id="comments"><article class="comment">Nice</article></section><footer>&copy; x</footer></body></html>"""


def texts(spark, rows):
    pages = spark.createDataFrame([(*r, "extra") for r in rows], "page_id long, url string, html string, text string")
    return sorted((r["page_id"], r["text"], r["n_chars"]) for r in html_text.main_texts(pages).collect())


def test_article_without_frame(spark):
    got = texts(spark, [(1, "http://a.b/c", ARTICLE)])
    expected = "A & B\n\nOne two three!\n\nFour five\n\na\n\nb\n\nc\n\nd"
    assert got == [(1, expected, len(expected))]


def test_odd_rows(spark):
    rows = [(1, None, None), (2, "x", ""), (3, "http://h/", "<p>"), (4, "http://h/", "plain 1 < 2"), (4, "http://h/", "<p>caf&eacute; \U0001f600"), (None, "http://h/", "<p>z")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {(r["page_id"], r["text"], r["n_chars"]) for r in html_text.main_texts(pages).collect()}
    assert got == {(1, "", 0), (2, "", 0), (3, "", 0), (4, "plain 1 < 2", 11), (4, "café \U0001f600", 6), (None, "z", 1)}


def test_empty_table(spark):
    assert html_text.main_texts(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


@pytest.mark.parametrize("n", [1, 40])
def test_host_frame_goes_by_importance(spark, n):
    """Pages without marks: blocks that stand on every page of a host go, blocks of their own stay; a single page keeps all."""
    page = "<body><div class=top><p>Welcome to us</p></div><div class=x><p>Text of page {i} alone</p></div><div class=end><p>All rights</p></div></body>"
    got = texts(spark, [(i, "http://h.example/p", page.format(i=i)) for i in range(n)])
    if n == 1:
        assert got[0][1] == "Welcome to us\n\nText of page 0 alone\n\nAll rights"
    else:
        assert [t for _, t, _ in got] == [f"Text of page {i} alone" for i in range(n)]


def by_definition(pages):
    """{(host, node): (pages, importance, branch)} of a style tree made page by page in plain Python, each different page once."""
    hosts = {}
    for url, html in pages:
        blocks, layouts = html_text.parse(html)
        hosts.setdefault(html_text.host_of(url), {})[tuple((b.nodes, b.text) for b in blocks)] = layouts
    out = {}
    for host, found in hosts.items():
        texts, styles, on = {}, {}, {}
        for blocks, layouts in found.items():
            seen = {n[: i + 1] for n in [*(b[0] for b in blocks), *layouts] for i in range(len(n))}
            for n in seen:
                on[n] = on.get(n, 0) + 1
            for n, t in set(blocks):
                texts.setdefault(n, []).append(t)
            for n, x in layouts.items():
                styles.setdefault(n, []).append(x)
        own = {}
        for n, m in on.items():
            base, parts = math.log(max(m, 2)), []
            if n in styles:
                k = len(styles[n])
                parts.append((1 - html_text.GAMMA, -sum(styles[n].count(x) / k * math.log(styles[n].count(x) / k) for x in set(styles[n])) / base))
            if n in texts:
                parts.append((html_text.GAMMA, 1 - sum(math.log(texts[n].count(t)) for t in texts[n]) / len(texts[n]) / base))
            both = sum(w * x for w, x in parts) if len(parts) == 2 else parts[0][1] if parts else 0.0
            own[n] = 1.0 if m == 1 else both
        below = {n: [d for d in on if d[: len(n)] == n] for n in on}
        w = lambda n, d: on[d] * html_text.DECAY ** (len(d) - len(n))
        composite = {n: sum(w(n, d) * own[d] for d in ds) / sum(w(n, d) for d in ds) for n, ds in below.items()}
        for n, ds in below.items():
            out[host, n] = (on[n], own[n], max(composite[d] for d in ds))
    return out


def test_tree_against_definition(spark):
    rng = random.Random(4)

    def page(depth=0):
        parts = []
        for _ in range(rng.randint(1, 3)):
            tag = rng.choice(["div class=a", "div class=b2", "p", "section id=x7", "ul"])
            inner = page(depth + 1) if depth < 3 and not tag.startswith("p") else rng.choice(["same", "or this", f"own {rng.random()}"])
            parts.append(f"<{tag}>{inner}</{tag.split()[0]}>")
        return "".join(parts)

    made = [(f"http://h{rng.randint(0, 1)}/", page()) for _ in range(60)]
    made += made[:20]  # copies count once
    df = spark.createDataFrame([(i, u, h) for i, (u, h) in enumerate(made)], "page_id long, url string, html string")
    got = {(r["host"], tuple(r["above"])): (r["pages"], r["importance"], r["branch"]) for r in html_text.style_tree(html_text.parsed_pages(df)).collect()}
    expected = by_definition(made)
    assert got.keys() == expected.keys()
    for k, v in expected.items():
        assert got[k] == pytest.approx(v), k


def test_tree_decides_inside_marked_articles(spark):
    """A box of its own with the same texts on every page goes from articles too; with the tree switched off it stays."""
    page = "<body><article><h1>Same title</h1><p>Text {i} of a page</p><div class=x9><p>Our offers</p><ul><li>All</li></ul></div><p>Shared end</p></article></body>"
    rows = [(i, "http://h.example/p", page.format(i=i)) for i in range(40)]
    assert [t for _, t, _ in texts(spark, rows)] == [f"Same title\n\nText {i} of a page\n\nShared end" for i in sorted(range(40))]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    assert {r["text"].count("Our offers") for r in html_text.main_texts(pages, low=0.0).collect()} == {1}
    both = [sorted(map(str, html_text.main_texts(pages, most_broadcast=n).collect())) for n in (0, 1000)]
    assert both[0] == both[1]


def test_repeated_pages_are_no_frame(spark):
    """Copies, pages of few distinct texts, and one page with many equal cells lose nothing."""
    cells = "<table class=t>" + "<tr><td>0</td></tr>" * 30 + "</table>"
    rows = [(i, "http://h/", f"<body><div class=c><p>Copy</p><p>of one</p></div>{cells}</body>") for i in range(50)]
    want = "Copy\n\nof one" + "\n\n0" * 30
    assert {t for _, t, _ in texts(spark, rows)} == {want}
    near = [(i, "http://n/", f"<body><article><div class=c><p>Long text that all of them share</p></div><p>{i}</p></article></body>") for i in range(50)]
    assert texts(spark, near)[7][1] == "Long text that all of them share\n\n7"


@pytest.mark.parametrize(
    ("page", "text"),
    [
        ("<p data-x=it's>Hello world</p><p>don't</p><p>end</p>", "Hello world\n\ndon't\n\nend"),
        ('<article><p title="5" tall">Main text</p>', "Main text"),
        ("a<!-->b<!-- x --!>c</3>d</>e", "abcde"),
        ("<p a = 'x>y' b=\"c>d\" c>z<p/x=1>q", "z\n\nq"),
        ("<p class=a class=ad>first</p><p a=\"never closed>x</p><p>y</p>", "first\n\nx\n\ny"),
        ("<div class='ad' class='x'>gone</div>stays &amp; &#x41;&nbsp;&eacute;", "stays & A é"),
    ],
)
def test_tokeniser(spark, page, text):
    assert texts(spark, [(1, "http://h/", page)])[0][1] == text


def test_long_deep_and_clashing(spark):
    """Very long and very deep pages, and columns named like computed ones."""
    long = "<article>" + "<p>word word</p>" * 50_000 + "</article>"
    deep = "<div class=q>" * 3000 + "deep" + "</div>" * 3000
    rows = [(1, "http://h/", long, 5, "x"), (2, "http://h/", deep, None, None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, _row long, node string")
    got = {r["page_id"]: r["text"] for r in html_text.main_texts(pages).collect()}
    assert got == {1: "\n\n".join(["word word"] * 50_000), 2: "deep"}


def test_broken_markup_ends():
    for bad in ("<", "<div", "</", "<!--", "<a href='x", "<script>never closed", "<p><p></b></p></div>", "<" * 2000, "&#xFFFFFFFF;"):
        html_text.parse(bad)


@pytest.mark.parametrize("name", ["content-sidebar-wrap", "site-content has-sidebar", "right-sidebar-layout", "no-comments", "post tag-advertising", "sidebar", "related", "comments"])
@pytest.mark.parametrize("tag", ["article", "main"])
def test_class_of_a_wrapper_does_not_hide_the_article(spark, name, tag):
    page = f"<body><div class='{name}'><div><{tag}><h1>Title</h1><p>Body</p></{tag}></div></div><div class=sidebar><p>Links</p></div></body>"
    assert texts(spark, [(1, "http://h/", page)])[0][1] == "Title\n\nBody"


@pytest.mark.parametrize("name", ["post tag-advertising", "article-header", "content-sidebar-wrap"])
def test_parts_of_names_decide_nothing(spark, name):
    page = f"<body><div class='{name}'><h1>Title</h1><p>Body</p></div><div class='ad-slot-3'>Buy</div><div class='cookie-notice'>OK</div></body>"
    assert texts(spark, [(1, "http://h/", page)])[0][1] == "Title\n\nBody"
    page = f"<body><article><div class='{name}'><h1>Title</h1></div><div class=header>Sub</div><div class=share-buttons>Tweet</div><p>Body</p></article></body>"
    assert texts(spark, [(1, "http://h/", page)])[0][1] == "Title\n\nSub\n\nBody"


def test_other_articles_stay_out(spark):
    page = "<body><main><article><p>Body</p><div class=related><article>Teaser</article></div></article></main><div id=comments><article>Nice</article></div></body>"
    assert texts(spark, [(1, "http://h/", page)])[0][1] == "Body"
