"""HTML extraction: exact texts of many kinds of page, hard inputs, held-out layouts, decoding against brute force."""

from __future__ import annotations

import itertools
import random
import time

import numpy as np
import pytest

from edgeframe.llm import html_extract as H
from edgeframe.llm import queries as Q

SF = "/root/testdata/sf0.001"
A = "The committee met on Tuesday, and it agreed on three points that had been open for weeks."
B = "Later the chair said that the budget, which is small, would be raised in the coming year."
HEAD = "<html><head lang=en><meta charset=utf-8><title>T</title><style>p {}</style><script>x()</script>"
ARTICLE = ["Council agrees", A, B]
PAGES = {
    "all kinds of block": (
        f"<nav><a href=/>Home</a></nav><article><h1>Council agrees</h1><p>{A}</p><ul><li>First point</li><li>Second point</li></ul><pre>x = 1\ny = 2</pre><table><tr><td>Year</td><td>2020</td></tr></table><figure><figcaption>The hall at night</figcaption></figure><blockquote>It was a long day, he said.</blockquote></article><footer>© 2024 Site</footer>",
        ["Council agrees", A, "First point", "Second point", "x = 1 y = 2", "Year", "2020", "The hall at night", "It was a long day, he said."],
    ),
    "cookie box in the article": (f"<article><div class=cookie-notice>We use cookies. <button>Accept</button></div><h1>Council agrees</h1><p>{A}</p><p>{B}</p></article>", ARTICLE),
    "header in the article": (f"<article><header><h1>Council agrees</h1></header><p>{A}</p><p>{B}</p></article>", ARTICLE),
    "bare": (f"<h1>Council agrees</h1><p>{A}</p><p>{B}</p>", ARTICLE),
    "table layout": (f"<table><tr><td><a href=/a>Home</a><br><a href=/b>News</a></td><td><h1>Council agrees</h1><p>{A}</p><p>{B}</p></td></tr></table>", ARTICLE),
    "bare with menus": (f"<div><a href=/>Home</a> | <a href=/n>News</a> | <a href=/c>Contact</a></div><h1>Council agrees</h1><p>{A}</p><h2>Background</h2><p>{B}</p><div>Copyright 2024 The Paper. All rights reserved.</div>", ["Council agrees", A, "Background", B]),
    "comments and sidebar": (
        f"<article><h1>Council agrees</h1><p>{A}</p><p>{B}</p></article><section class=comments><h3>Comments</h3><div class=comment><b>Ann</b><p>I do not think that this is right, since the budget was cut before.</p></div></section><aside class=sidebar><h3>Related</h3><ul><li><a href=/1>Old story</a></li></ul></aside>",
        ARTICLE,
    ),
    "one paragraph": (f"<p>{A}</p>", [A]),
    "form between": (f"<main><h1>Council agrees</h1><p>{A}</p><form><label>Subscribe to our newsletter</label><input><button>Send</button></form><p>{B}</p></main>", ARTICLE),
    "head not closed": (f"{HEAD}<article><h1>Council agrees</h1><p>{A}</p><p>{B}</p></article>", ARTICLE),
    "drawing and frame not closed": (f"<article><h1>Council agrees</h1><p>{A} <svg><text>x</p><p>{B}<iframe src=a></p></article>", ARTICLE),
    "unclosed paragraphs": (f"<article><h1>Council agrees</h1><p>{A}<p>{B}</article>", ARTICLE),
}


@pytest.fixture(scope="module")
def model():
    import duckdb

    return H.train([h for (h,) in duckdb.sql("SELECT html FROM '/root/testdata/sf0.01/pages.parquet' ORDER BY page_id").fetchall()])


@pytest.mark.parametrize("name", PAGES)
def test_main_text(model, name):
    page, want = PAGES[name]
    page = page if page.startswith("<html") else f"<html><body>{page}</body></html>"
    assert H.extract_pages([page], model)[0].split("\n\n") == want


def test_given_pages(model):
    """Every block of the articles of the given pages, and nothing else."""
    import duckdb

    pages = [h for (h,) in duckdb.sql("SELECT html FROM '/root/testdata/sf0.001/pages.parquet'").fetchall()]
    assert H.extract_pages(pages, model) == ["\n\n".join(H._pieces(p)[0]) for p in pages]


def test_held_out_layouts(model):
    r, right, total = random.Random(99), 0, 0
    import duckdb

    for (page,) in duckdb.sql("SELECT html FROM '/root/testdata/sf0.001/pages.parquet'").fetchall():
        good, bad = H._pieces(page)
        for _ in range(4):
            t = H.parse(H._Layout(r, good[: r.choice([2, 5, 40])], bad).page(), layout=True)
            f = H.forest([t])
            kept = H.decode(f, model.logit(H.features([t], f)))
            marks = [(x == 1, k) for tag, x, k in zip(t.tag, t.truth, kept) if tag == "#" and x >= 0]
            right, total = right + sum(a == b for a, b in marks), total + len(marks)
    assert right / total > 0.98


@pytest.mark.parametrize("seed", range(60))
def test_decoding_against_all_labelings(seed):
    """The decoded labels are the best of all in which a node is kept if and only if one of its children is."""
    r = np.random.default_rng(seed)
    t = H.Tree()
    t.add("html", -1)
    for _ in range(int(r.integers(1, 10))):
        t.add("div", int(r.choice([i for i, x in enumerate(t.tag) if x != "#"])))
        if r.random() < 0.5:
            t.tag[-1] = "#"
    kids = [[j for j, u in enumerate(t.up) if u == i] for i in range(len(t.tag))]
    leafless = [i for i in range(len(t.tag)) if not kids[i] and t.tag[i] != "#"]
    for i in leafless:
        t.tag[i] = "#"
    logit = np.round(r.normal(0, 2, len(t.tag)), 3)
    best = max(
        (sum(x if k else -x for x, k in zip(logit, keep)), keep)
        for keep in itertools.product([False, True], repeat=len(logit))
        if all(not kids[i] or keep[i] == any(keep[j] for j in kids[i]) for i in range(len(logit)))
    )
    kept = H.decode(H.forest([t]), logit)
    assert sum(x if k else -x for x, k in zip(logit, kept)) == pytest.approx(best[0]) and kept.tolist() == list(best[1])


def test_parser():
    leaves = lambda page: H.parse(page).leaves()
    assert leaves("<div><p>a<p>b<script>x</script> c<br>d</div>e") == ["a", "b c d", "e"]
    body = "<header>Top</header><p>First words.</p><p>Second words.</p>"
    want = ["Top", "First words.", "Second words."]
    for page in (f"{HEAD}</head><body>{body}</body></html>", f"{HEAD}<body>{body}</body>", f"{HEAD}{body}", f"{HEAD}</HEAD >{body}"):
        assert leaves(page) == want
    assert leaves(f"{HEAD}Bare words") == ["Bare words"]
    assert leaves("<script>a</scripts>b</script >c") == ["c"]
    assert leaves("<p>Let <math><mi>x</mi> = <mn>2</mn></math> and <object data=a.svg>a chart</object> show.</p>") == ["Let x = 2 and a chart show."]
    assert leaves("<p>a<svg><text>no</p><p>b<math>c</p><p>d<object>e</p>f") == ["a", "b c".replace(" ", ""), "de", "f"]
    assert leaves("<p>a < b and 1<2 &lt; &amp;c&#233;&nbsp;d") == ["a < b and 1<2 < &cé d"]
    assert leaves('<p title="a>b" class=x>c<!-- d <p> -->e<!-->f') == ["cef"] and leaves("<p>a<b") == ["a"] and leaves("<p>a<!-- b") == ["a"]
    assert leaves("<ul><li>a<ul><li>b</ul><li>c</ul><table><tr><td>d<td>e<tr><td>f</table>g") == list("abcdefg")
    assert leaves("<p>wo<wbr>rd<img src=x>two</i></p></div>end") == ["word two", "end"]


@pytest.mark.parametrize("bomb", ['<a "' * 250_000, '<a ="' * 200_000, "<b>" * 8000 + "</i>" * 8000 + "<p>x</p>" * 8000, "<b>" * 8000 + "<div>x" * 8000, "<iframe>" * 50_000, "<!--" * 200_000, "<" * 500_000, "<li><p>" * 20_000, "<svg>" * 20_000 + "x", "<script>" * 10_000, "<div>" * 8_000 + "a", "&" * 500_000])
def test_hard_pages_take_linear_time(model, bomb):
    start = time.process_time()
    H.extract_pages([bomb], model)
    assert time.process_time() - start < 8


def test_query(spark):
    got = Q.op2_html_extraction(spark, SF).toPandas()
    assert len(got) == 50 and (got.n_chars == got.text.str.len()).all() and (got.n_chars > 0).all()
    empty = spark.createDataFrame([], "page_id long, url string, html string, text string")
    assert H.extract(empty).count() == 0


def test_nulls_and_repeats(spark):
    big = (1 << 62) + 1
    rows = [(big, "u", f"<p>{A}</p>", 1), (None, None, f"<p>{B}</p>", 2), (None, "v", None, 3), (big, "u", f"<p>{A}</p>", 1), (2, "w", "", 4)]
    got = H.extract(spark.createDataFrame(rows, "page_id long, url string, html string, n_chars int")).collect()
    assert sorted(((r.page_id, r.url, r.text) for r in got), key=repr) == sorted([(big, "u", A), (None, None, B), (None, "v", ""), (big, "u", A), (2, "w", "")], key=repr)
    assert all(r.n_chars == len(r.text) for r in got)


def test_hostile_pages_raise_nothing():
    """Attributes that look like training marks, endless references and attributes: each page gives its text."""
    leaves = lambda page: H.parse(page).leaves()
    assert leaves(f'<div data-truth="abc"><p data-truth=9999999999>{A}</p></div>') == [A]
    assert leaves(f"<p>{A} &#{'1' * 5000};</p>") == [f"{A} \ufffd"]
    assert leaves(f"<p>{A} &#{'0' * 5000}65;&#x{'0' * 5000}42;&#1114112;&#12345678</p>") == [f"{A} AB\ufffd\ufffd"]
    assert leaves("&#65;&#0065;&amp;&lt;&nope;&#;&#x;" * 2000)[0].startswith("AA&<&nope;&#;&#x;AA")
    assert leaves("<p " + "data-truth=x class='a' " * 50_000 + f">{A}</p>") == [A]
    assert leaves("<p " + 'a="' * 50_000 + f">{A}</p>") in ([], [A])
    for junk in ("&#", "&#9" * 9999, "<" * 9999, "<a " * 999, "</" * 999, "<!--" * 999, "<p>" * 9999, "<b data-truth>" * 999, "\x00&#0;&#55296;", "<p data-truth='-'>" * 99):
        H.parse(junk)


def test_marks_of_a_page_are_no_evidence():
    """The same page with and without attributes named like the marks gives the same text."""
    pages = [f"<nav><a href=/>Home</a></nav><article><h1>Council agrees</h1><p>{A}</p><p>{B}</p></article>"]
    model = H.train(pages)
    marked = [pages[0].replace("<nav>", "<nav data-truth=1>").replace("<article>", "<article data-truth='0'>")]
    assert H.extract_pages(marked, model) == H.extract_pages(pages, model)
