"""Main text and wrappers of web pages."""

from __future__ import annotations

import random
import functools
import html as entities
import re

import duckdb
import numpy as np
import pytest

from trainlake.llm import html, queries

SF_DIR = "/root/testdata/sf0.01"

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var a="</p>";</script></head><body>
<header><h2>Site</h2></header><nav><ul><li><a href=x>Home</a><li>News</ul></nav>
<div class="cookie-notice">We use cookies</div><div id=sidebar><p>Side</div><div class="ad">Buy</div>
<article class="post"><header><h1>Head &amp; <b>shoul</b>ders</h1></header><p>One  <i>two</i>
three&nbsp;four<br>five<!-- <p>gone</p> --><p>six &lt;b&gt; 1 < 2<aside>note</aside><ul><li>a<li>b</ul><table><tr><td>c<td>d</table>
<form><input><button>Go</button></form><div class="comments"><p>First!</p></div><p hidden>no</p></article>
<footer>&copy; me</footer></body></html>"""


def test_article():
    assert html.main_text(PAGE, {}) == "Head & shoulders One two three four five six <b> 1 < 2 a b c d"


@pytest.mark.parametrize(
    "page, text",
    [
        ("", ""),
        ("plain &amp text", "plain & text"),
        ("<p>cut off <b>he", "cut off he"),
        ("<p>cut <a href='x", "cut"),
        ("a<script>x", "a"),
        ("<article></article><p>body</p>", "body"),
        ("<div class='Menu'>m</div><div>x</div><div CLASS=\"main-header\">h</div>", "x"),
        ("<p>a</b></i>b</p>c</p>d", "ab c d"),
        ("<" * 50 + "&#x41;&#66;&bogus;", "<" * 50 + "AB&bogus;"),
    ],
)
def test_rough_pages(page, text):
    assert html.main_text(page, {}) == text


def test_long_page():
    text = html.main_text("<article>" + "<p>word &amp; word</p>" * 50_000, {})
    assert len(text) == 50_000 * 12 - 1


def test_wrapper():
    pages = [
        "<div><h1>Site</h1><ul><li>a<li>b<li>c</ul><p>one</p><p>two</p><div class=x>Read on</div></div>",
        "<div><h1>Site</h1><ul><li>d</ul><p>three</p></div>",
        "<div><h1>Site</h1><ul><li>e<li>f</ul><h3>new</h3><p>four</p><p>five</p><p>six</p><div class=x>Read on</div></div>",
    ]
    wrapper = html.stream(pages[0])
    for page in pages[1:]:
        wrapper = html.aligned(wrapper, html.stream(page))
    assert html.expression(wrapper) == r"<div><h1>Site</h1><ul>(<li>#</li>)+</ul>(<h3>new</h3>)?(<p>#</p>)+(<div.x>Read\ on</div.x>)?</div>"
    constants = html.template_texts(wrapper)
    assert [html.main_text(p, constants) for p in pages] == ["a b c one two", "d three", "e f four five six"]


def test_alignment_accepts_both():
    """The expression of a wrapper, slots as any text, matches every stream it was made of."""

    def pattern(tokens):
        out = ""
        for t in tokens:
            out += re.escape(f"<{t[1]}>") if t[0] == "t" else ("[^<]*" if t[2] is None else re.escape(t[2])) if t[0] == "x" else f"(?:{pattern(t[1:])}){t[0]}"
        return out

    def flat(page):
        out = ""
        for kind, value, element in html.events(page):
            if kind == "text":
                out += html.mark(html.tidy(value))
            elif value not in html.INLINE and kind != "break":
                out += f"<{'/' if kind == 'close' else ''}{element.path.rpartition('/')[2]}>"
        return out

    import random

    rng = random.Random(4)
    for _ in range(60):
        pages = []
        for _ in range(4):
            parts = [rng.choice(["<p>x</p>", "<p>y</p>", "<ul>" + "<li>i</li>" * rng.randrange(1, 4) + "</ul>", "<div>d</div>", "<h2>t</h2>"]) for _ in range(rng.randrange(1, 7))]
            pages.append("<main>" + "".join(parts) + "</main>")
        wrapper = html.stream(pages[0])
        for page in pages[1:]:
            wrapper = html.aligned(wrapper, html.stream(page))
        for page in pages:
            assert re.fullmatch(pattern(wrapper), flat(page)), (pages, html.expression(wrapper))


def test_query(spark):
    pages = duckdb.sql(f"SELECT page_id, url, html FROM '{SF_DIR}/pages.parquet'").fetchall()
    got = {r.page_id: r for r in queries.QUERIES["op8_html_extraction"](spark, SF_DIR).collect()}
    assert len(got) == len(pages)
    for page_id, url, page in pages:
        body = re.search(r"(?s)<article>(.*?)(</article>|$)", page)[1]
        body = re.sub(r"</?(p|h1|br)>", "\n", re.sub(r"</?b>", "", body))
        lines = [re.sub(r"\s+", " ", entities.unescape(x)).strip() for x in body.split("\n")]
        text = re.sub(r"\s+", " ", " ".join(filter(None, lines)))
        assert (got[page_id].text, got[page_id].url, got[page_id].n_chars) == (text, url, len(text))


def test_edges(spark):
    rows = [(1, None, None, "h"), (2, "http://u@A.example:80/x", "<p>x</p>", "h"), (2, "http://a.example/y", "<p>x</p>", "h"), (None, "nonsense", "<nav>n</nav>", "h"), (3, "https://a.example?q", "<p>y</p><p>same</p>", "h")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, host string")
    got = sorted((str(r.page_id), r.text, r.n_chars) for r in html.extract_main_text(df).collect())
    assert got == [("1", "", 0), ("2", "x", 1), ("2", "x", 1), ("3", "y same", 6), ("None", "", 0)]
    assert {r.host: r.n_pages for r in html.infer_wrappers(df).collect()} == {"": 2, "a.example": 3}
    assert html.extract_main_text(df.limit(0)).count() == 0


def extracted(spark, pages, url="http://h.example/"):
    df = spark.createDataFrame([(k, f"{url}{k}", page) for k, page in enumerate(pages)], "page_id long, url string, html string")
    return [r.text for r in sorted(html.extract_main_text(df).collect(), key=lambda r: r.page_id)]


def test_wrapper_chooses_the_content(spark):
    """A teaser in an article element beside the story, and a constant text in an article."""
    stories = [f"<article><p>teaser {w}</p></article><div id=story><p>the long story of {w} and its end</p></div>" for w in ("one", "two", "three")]
    assert extracted(spark, stories) == [f"teaser {w} the long story of {w} and its end" for w in ("one", "two", "three")]
    inside = [f"<div>{w}</div><article><p>the story of {w} and its end</p><div class=more>Read on</div></article>" for w in ("one", "two", "three")]
    assert extracted(spark, inside) == [f"the story of {w} and its end" for w in ("one", "two", "three")]
    assert extracted(spark, stories[:1]) == ["teaser one"]


def test_copies_and_shared_texts_stay(spark):
    """Copies say nothing about a template, nor do pages that differ in their menus alone; equal
    headings and a shared body stay, a shared line beside differing text goes."""
    assert extracted(spark, ["<p>x</p>"] * 3) == ["x"] * 3
    assert extracted(spark, [f"<nav>{k}</nav><p>x</p><footer>{k}</footer>" for k in "abc"]) == ["x"] * 3
    assert extracted(spark, [f"<h3>{k}</h3><p>the one paragraph of all</p>" for k in "abc"]) == [f"{k} the one paragraph of all" for k in "abc"]
    assert extracted(spark, [f"<h1>Soups</h1><p>mix the {k}</p><h2>Method</h2><p>stir the {k}</p>" for k in "abc"]) == [f"Soups mix the {k} Method stir the {k}" for k in "abc"]
    assert extracted(spark, [f"<p>mix the {k}</p><div>Read on</div>" for k in "aab"]) == [f"mix the {k}" for k in "aab"]
    assert extracted(spark, ["<p>mix the a</p><div class=x>own</div>"] * 2 + ["<p>mix the b</p>"]) == ["mix the a own"] * 2 + ["mix the b"]


@pytest.mark.parametrize("around", ["<div class='has-sidebar'>", "<div class='no-sidebar'>", "<div class='with-comments'>", "<form>", "<div class='sidebar'>", "<div id='page' class='wide widget'>", "<main><form>"])
def test_article_in_a_theme(around):
    assert html.main_text(f"<p>menu</p>{around}<article><p>text</p></article></div></form>", {}) == "text"


def test_names_of_passages():
    page = "<article><h2 id='side-effects'>Side effects</h2><p id=search>a</p><h2 id='related-work'>Related work</h2><div class='share-price'>b</div><p class='ad'>x</p></article>"
    assert html.main_text(page, {}) == "Side effects a Related work b"


@pytest.mark.parametrize(
    "page, text",
    [
        ("<div class='site-header'>h</div><div class='left-sidebar x'>s</div><div id='comment-list'>c</div><div class='post-body'>t</div>", "t"),
        ("<article>a</article><div class=comments><article>c</article></div>", "a"),
        ("<aside><article>n</article></aside><p>t</p>", "t"),
        ("<nav><article>n</article></nav>", ""),
        ("<form><p>the whole page</p><button>Go</button><nav>n</nav></form>", "the whole page"),
        ("<div hidden><article>n</article></div>t", "t"),
    ],
)
def test_what_drops(page, text):
    assert html.main_text(page, {}) == text


def varied_page(seed: int, n: int) -> str:
    """A page whose blocks are drawn anew for each seed, between a menu and a footer."""
    rng = random.Random(seed)
    out = ["<html><body><div class=\"top\">Home Shop Contact</div>"]
    for _ in range(n):
        tag, name = rng.choice(["p", "h2", "ul", "div", "section"]), rng.choice("abcde")
        item = "".join(f'<li class="{rng.choice("xyz")}">item {rng.random()}</li>' for _ in range(2))
        out.append(f"<ul>{item}</ul>" if tag == "ul" else f'<{tag} class="{name}">text {rng.random()} of {seed}</{tag}>')
    return "".join([*out, "<div class=\"end\">All rights reserved by us</div></body></html>"])


@pytest.mark.parametrize("cells", [1 << 21, 25])
def test_common_subsequence(monkeypatch, cells):
    """As long as by the plain table, whether the sequences are halved or not."""
    monkeypatch.setattr(html, "CELLS", cells)
    rng = np.random.default_rng(1)
    for _ in range(150):
        x, y = rng.integers(0, 4, rng.integers(0, 25)), rng.integers(0, 4, rng.integers(0, 25))
        best = np.zeros((len(x) + 1, len(y) + 1), int)
        for i in range(len(x)):
            for j in range(len(y)):
                best[i + 1, j + 1] = best[i, j] + 1 if x[i] == y[j] else max(best[i, j + 1], best[i + 1, j])
        pairs = html.common(x, y)
        assert len(pairs) == best[-1, -1] and all(x[i] == y[j] for i, j in pairs)
        assert all(p[0] < q[0] and p[1] < q[1] for p, q in zip(pairs[:-1], pairs[1:], strict=True))


def test_two_long_varied_pages():
    """Two pages of 50,000 tokens: little memory, and the template is found."""
    import tracemalloc

    x, y = html.stream(varied_page(1, 14_000)), html.stream(varied_page(2, 14_000))
    tracemalloc.start()
    wrapper = html.aligned(x, y)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert min(len(x), len(y)) > 40_000 and most < 200 << 20
    assert set(html.removable(wrapper).values()) - {None} == {"Home Shop Contact", "All rights reserved by us"}


def test_long_wrappers_decide_alike(monkeypatch):
    """A wrapper that keeps its optional groups as a bag says what the whole one says, and stays short
    however many pages a host has."""
    streams = [html.stream(varied_page(k, 30)) for k in range(40)]

    def wrapper(longest: int) -> list:
        monkeypatch.setattr(html, "LONGEST_WRAPPER", longest)
        return functools.reduce(html.aligned, streams)

    whole, short = wrapper(1 << 30), wrapper(100)
    assert html.tokens_in(short) < 200 < html.tokens_in(whole)
    # The bag has no order, so other runs may be common; what goes is the same.
    gone = [{p: t for p, t in html.removable(w).items() if t is not None} for w in (whole, short)]
    assert gone[0] == gone[1] and html.in_articles(whole) == html.in_articles(short)
    assert set(gone[0].values()) == {"Home Shop Contact", "All rights reserved by us"}
    assert "Home Shop Contact" in html.expression(short).replace("\\", "")
