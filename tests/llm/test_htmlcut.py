import html
import itertools
import random
import re

import pytest

from pairsift.llm import htmlcut as H
from pairsift.llm.queries import op7_html_main_text

from .data import SMALL, have_tables

PAGE = """<html><head><title>No</title><style>p{}</style></head><body><header class="site"><h1>Site</h1><a href=x>x</a></header>
<div class="cookie-notice">We use cookies, please accept them all now for the good of everyone here.</div><nav><ul><li><a>Home</a></ul></nav>
<main><h1>Title &amp;  more</h1><p>First <b>pa</b>ra&nbsp;with some words
in it.<p>Second &lt;one&gt;<br>goes on.<ul><li>one</li><li>two <a href=x>link</a></li></ul><div class="ad-box">Buy now this great thing</div>
<blockquote>Quote</blockquote><table><tr><td>a<td>b</table><section id="comments"><h3>Comments</h3><p>I think this is a long reader comment with
lots of words to say nothing at all.</p></section></main><aside>Side text</aside><form>Name <input></form><footer>foot</footer>
<script>if (a<b) x("</p>")</script></body></html>"""


def test_page():
    want = ["Title & more", "First para with some words in it.", "Second <one> goes on.", "one", "two link", "Quote", "a", "b"]
    assert H.main_text(PAGE).split("\n\n") == want


def test_without_article():
    page = '<div id="content"><h2>Hi</h2><p>Some text.</p><p>ok</p></div><div class="sidebar"><p>Popular posts</p></div><ul><li><a>Home</a><li><a>About</a></ul>'
    assert H.main_text(page) == "Hi\n\nSome text.\n\nok"


@pytest.mark.parametrize("page, text", [(None, ""), ("", ""), (" \n ", ""), ("plain &copy; text", "plain © text"), ("<p>a<b", "a<b"), ("<script>x", ""), ("</p></div>a", "a"), ("<p>" * 3000 + "deep", "deep"), ("<div>" * 3000 + "deep", "deep"), ("&#x41;&bogus;", "A&bogus;")])
def test_odd_pages(page, text):
    assert H.main_text(page) == text


@pytest.mark.parametrize("page, text", [
    ("<html><head><title>No</title><meta charset=utf-8><body><p>Some text.</body></html>", "Some text."),
    ("<html><head><title>No</title><style>p{}</style><p>Some text.</p></html>", "Some text."),
    ("<head><noscript><img src=x>no</noscript><link href=y><body><p>Some text.</p>", "Some text."),
    ("<head><noscript><img src=x>no<body><p>Some text.</p>", "Some text."),
    ("<head><title>No</title>Some text.", "Some text."),
    ("<div><select><option>a<option>b<p>Some text.</p></div>", "Some text."),
    ("<div><select><option>a<hr><option>b</select><p>Some text.</p></div>", "Some text."),
    ("<div><option>a<p>Some text.</p></div>", "Some text."),
    ("<div><svg><path d=x><p>Some text.</p></div>", "Some text."),
    ("<p>So <math><mi>x</mi><mo>=</mo><mn>1</mn><annotation>x=1</annotation></math> holds.", "So x=1 holds."),
    ("<p>See <svg><title>No</title><desc>no</desc><text>axis</text><text>value</text></svg> here.", "See axis value here."),
])
def test_omitted_end_tags_and_foreign_text(page, text):
    assert H.main_text(page) == text


def test_cut_is_least():
    rng = random.Random(7)
    for _ in range(150):
        n = rng.randrange(1, 8)
        content, boiler = [rng.randrange(9) for _ in range(n)], [rng.randrange(9) for _ in range(n)]
        tied = [(i, j, rng.randrange(1, 6)) for i, j in itertools.combinations(range(n), 2) if rng.random() < 0.5]
        net = H.Network(n + 2)
        for i in range(n):
            net.tie(n, i, content[i], 0)
            net.tie(i, n + 1, boiler[i], 0)
        for i, j, room in tied:
            net.tie(i, j, room, room)

        def cost(good):
            return sum(boiler[i] if good[i] else content[i] for i in range(n)) + sum(r for i, j, r in tied if good[i] != good[j])

        assert cost(net.cut(n, n + 1)[:n]) == min(cost(g) for g in itertools.product((True, False), repeat=n))


def test_odd_rows(spark):
    rows = spark.createDataFrame([(1, "u", None, 5), (1, "u", PAGE, 6), (None, None, "", 7)], "page_id long, url string, html string, text int")
    got = H.extract(rows)
    assert got.columns == ["page_id", "url", "text", "n_chars"]
    assert sorted(r.n_chars for r in got.collect()) == [0, 0, len(H.main_text(PAGE))]
    assert H.extract(rows.limit(0)).count() == 0


@pytest.mark.skipif(not have_tables(), reason="no tables")
def test_query(spark):
    """Blocks of the pages' article elements, found by pattern."""
    pages = {r.page_id: r.html for r in spark.read.parquet(f"{SMALL}/pages.parquet").collect()}
    got = op7_html_main_text(spark, SMALL).collect()
    assert len(got) == len(pages)
    for r in got:
        inner = pages[r.page_id].split("<article>", 1)[1].split("</article>", 1)[0].replace("<br>", " ")
        blocks = [" ".join(html.unescape(re.sub("<[^>]*>", "", b)).split()) for b in re.split(r"</?(?:p|h\d)>", inner)]
        want = "\n\n".join(b for b in blocks if b)
        assert (r.text, r.n_chars) == (want, len(want))
