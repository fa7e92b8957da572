"""Main text: marginals against all states, held-out layouts, pages of the tables, odd pages."""

import html
import itertools
import os
import random
import re

import numpy as np
import pandas as pd
import pytest

from gneiss.llm import pages
from gneiss.llm.dom import parse
from gneiss.llm.layouts import labelled_pages

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def model():
    return pages.fit(labelled_pages(pages.PAGES))


def states(dom):
    out = []
    for parent, mark in zip(dom.parent, dom.mark):
        out.append(mark if mark is not None else parent >= 0 and out[parent])
    return np.array(out)


def text_of(model, page):
    dom = parse(page)
    p, _ = model.beliefs(pages.forest([dom], model.vocabulary))
    return pages.main_text(dom, p >= pages.THRESHOLD)


@pytest.mark.parametrize("seed", range(4))
def test_messages_give_the_marginals_of_all_states(seed):
    rng = np.random.default_rng(seed)
    n, kinds = 8, 3
    parent = np.array([-1, *(rng.integers(0, i) for i in range(1, n))])
    depth = np.zeros(n, int)
    for i in range(1, n):
        depth[i] = depth[parent[i]] + 1
    f = pages.Forest(parent, [np.flatnonzero(depth == d) for d in range(depth.max() + 1)], np.arange(n), np.arange(n), rng.integers(0, kinds, n))
    model = pages.TreeModel(None, rng.normal(0, 2, n), rng.normal(0, 2, (kinds, 2, 2)), rng.normal(0, 2, (kinds, 2, 2)))
    p, joint = model.beliefs(f, pairs=True)
    total, single, both = 0.0, np.zeros(n), np.zeros((n, 2, 2))
    for y in itertools.product((0, 1), repeat=n):
        score = sum(model.own[i] * y[i] for i in range(n)) + sum(model.child[f.kind[i], y[parent[i]], y[i]] + model.above[f.kind[parent[i]], y[parent[i]], y[i]] for i in range(1, n))
        weight = np.exp(score)
        total += weight
        single += weight * np.array(y)
        for i in range(1, n):
            both[i, y[parent[i]], y[i]] += weight
    assert np.allclose(p, single / total) and np.allclose(joint[1:], both[1:] / total)


def test_held_out_layouts(model):
    nodes = wrong = exact = 0
    held_out = labelled_pages(200, seed=12345)
    for page in held_out:
        dom = parse(page)
        y = states(dom)
        p, _ = model.beliefs(pages.forest([dom], model.vocabulary))
        text = np.array([bool(t.strip()) for t in dom.text])
        nodes, wrong = nodes + text.sum(), wrong + ((p >= pages.THRESHOLD) != y)[text].sum()
        exact += pages.main_text(dom, y) == pages.main_text(dom, p >= pages.THRESHOLD)
    assert wrong / nodes < 0.01 and exact / len(held_out) > 0.9


def test_coupling_is_needed(model):
    """Without the tables of parents and children a short paragraph of an article is not told from one of a comment."""
    alone = pages.TreeModel(model.vocabulary, model.own, model.child * 0, model.above * 0)
    nodes = wrong = better = 0
    for page in labelled_pages(50, seed=777):
        dom = parse(page)
        text, y, f = np.array([bool(t.strip()) for t in dom.text]), states(dom), pages.forest([dom], model.vocabulary)
        nodes += text.sum()
        wrong += ((alone.beliefs(f)[0] >= 0.5) != y)[text].sum()
        better += ((model.beliefs(f)[0] >= 0.5) != y)[text].sum()
    assert better < wrong / 5


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="tables not present")
def test_pages_of_the_tables(spark):
    got = pages.op12_html_extraction(spark, FOLDER).toPandas().set_index("page_id")
    given = pd.read_parquet(f"{FOLDER}/pages.parquet")
    assert len(got) == len(given)
    for r in given.itertuples():
        inside = re.search("<article>(.*)</article>", r.html, re.S).group(1)
        want = " ".join(html.unescape(re.sub("<[^>]*>", " ", inside)).split())
        assert got.text[r.page_id] == want and got.n_chars[r.page_id] == len(want) and got.url[r.page_id] == r.url


LINE = "Vor mehr als hundert Jahren stand hier ein Haus, und niemand wusste, wem es gehörte. "
CASES = [
    (f"<body><div class=cookie-banner>We use cookies, you know.</div><div id=content><h1>T</h1><p>{LINE}</p><p>Ja.</p></div><div class=sidebar><p>x y z.</p></div></body>", f"T {LINE}Ja."),
    (f"<body><header><h1>Site</h1></header><main><article><h1>A &lt; B</h1><p>{LINE}<div class='ad'>Buy it.</div><p>so&nbsp;it   is</article><section class='comments'><p>{LINE}</p></section></main><footer>c</footer>", f"A < B {LINE}so it is"),
    (f"<nav><a href=/>Home</a></nav><article><p>{LINE}<b>bo</b>ld &amp;amp; &eacute; &#233;&#xe9;</p><form><p>Your name, please.</p><input></form><aside><p>{LINE}</p></aside></article>", f"{LINE}bold &amp; é éé"),
    (f"<article><p>{LINE}<script>if (a<b) x='</p>';</script><!-- <p>no</p> --><style>p{{}}</style>on</p></article>", f"{LINE}on"),
]


@pytest.mark.parametrize("page,want", CASES)
def test_kinds_of_page(model, page, want):
    assert text_of(model, page) == " ".join(want.split())


def test_odd_pages(spark, model):
    deep = "<div>" * 3000 + "<p>deep</p>"
    long = "<article>" + f"<p>{LINE}</p>" * 40_000 + "</article>"
    odd = [None, "", " ", "<", "<p", "<!--", "<!-- x", "</p></div>", "&", "&amp", "<a title=\"x", "<script>never ends", "\x00<p>\x00", "<table><tr><td>a<td>b<tr><td>c", "<li>a<li>b", deep, "<p>" * 3000, long]
    rng = random.Random(3)
    pieces = ["<p>", "</p>", "<b", ">", "<div class='", "'", '"', "=", "text", "<!--", "-->", "&lt;", "<script>", "</script>", "<td>", "</table>", "é"]
    odd += ["".join(rng.choice(pieces) for _ in range(rng.randint(1, 60))) for _ in range(100)]
    rows = [(i, f"u{i}", p, "x", 1, "y") for i, p in enumerate(odd)] + [(None, None, CASES[0][0], "x", 1, "y")] * 2
    schema = "page_id long, url string, html string, text string, n_chars int, tag string"
    got = pages.extract(spark.createDataFrame(rows, schema), model).toPandas()
    assert list(got.columns) == ["page_id", "url", "text", "n_chars"] and len(got) == len(rows)
    assert (got.text.str.len() == got.n_chars).all() and list(got.text[got.page_id.isna()]) == [" ".join(CASES[0][1].split())] * 2
    text = got.set_index("page_id").text
    assert text[0] == text[1] == text[2] == "" and text[odd.index(long)] == " ".join([LINE.strip()] * 40_000)
    assert pages.extract(spark.createDataFrame([], schema), model).count() == 0


def test_text_is_read_once_and_in_order():
    """Every character outside markup is in exactly one node, in page order."""
    for page in labelled_pages(50, seed=5):
        plain = re.sub(r"<script>.*?</script>|<style>.*?</style>|<!--.*?-->|<[^>]*>", "", page, flags=re.S)
        assert "".join(parse(page).text) == html.unescape(plain)
