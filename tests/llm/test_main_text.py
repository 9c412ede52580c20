import time

import numpy as np
import pytest

from chronolith.llm import main_text as M


@pytest.fixture(scope="module")
def model():
    return M.model()


def test_marginals_equal_enumeration():
    tree = M.parse("<div><p>a<b>b</b></p><nav><a>c</a></nav></div>")
    chance = np.random.default_rng(0)
    weights, edges = chance.normal(size=M.FEATURES), chance.normal(size=(2, 2, 2))
    forest = M.Forest([tree])
    got, joint = forest.marginals(weights, edges)
    n = len(tree.tags)
    own = np.bincount(forest.node, weights[forest.feature], n)
    total, mass, pair = 0.0, np.zeros(n), np.zeros((n, 2, 2))
    for code in range(1 << n):
        y = [code >> k & 1 for k in range(n)]
        w = np.exp(sum(own[k] for k in range(n) if y[k]) + sum(edges[int(forest.is_text[k]), y[forest.parent[k]], y[k]] for k in range(1, n)))
        total += w
        mass += w * np.array(y)
        for k in range(1, n):
            pair[k, y[forest.parent[k]], y[k]] += w
    assert np.allclose(got, mass / total) and np.allclose(joint[1:], pair[1:] / total)


def test_held_out_pages(model):
    pages = M.labelled_pages(150, seed=991)
    trees = [M.parse(h) for h, _ in pages]
    forest = M.Forest(trees)
    kept = forest.marginals(*model)[0] >= 0.5
    right = total = 0
    for k, (tree, (_, labels)) in enumerate(zip(trees, pages, strict=True)):
        at = [i for i, (tag, text) in enumerate(zip(tree.tags, tree.texts, strict=True)) if tag == M.TEXT and text.strip()]
        right += sum(kept[forest.first[k] + i] == y for i, y in zip(at, labels, strict=True))
        total += len(at)
    assert right / total > 0.98


def test_markup(model):
    page = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style></head><body><nav><ul><li><a href="/a">Menu</a></ul></nav>
    <!-- x --><div class="cookie-notice">We use cookies</div><article><h1>A &amp; B</h1><p>One <b>bo</b>ld&nbsp;word<br>next<p>Two &lt;x&gt;
    <script>var t="</p>";</script> more</article><div class="comments"><p>Nice!</p></div><footer>&copy; me</footer>"""
    assert M.main_texts([page, "", "<", "plain words only here", "<p>cut off <b"], *model)[0] == "A & B One bold word next Two <x> more"


def test_extract(spark, model):
    rows = [(1, "u", None), (2, None, ""), (3, "u", "<article><p>" + "long words here. " * 20_000 + "</p></article>"), (None, "u", "<article><p>no id</p></article>")]
    pages = spark.createDataFrame(rows + rows[3:], "page_id long, url string, html string").selectExpr("*", "'x' AS text", "1 AS n_chars")
    got = {r.page_id: r for r in M.extract(pages, *model).collect()}
    assert got[1].text == got[2].text == "" and got[2].n_chars == 0 and got[3].n_chars == len(("long words here. " * 20_000).strip())
    assert got[None].text == "no id" and M.extract(pages, *model).count() == 5 and M.extract(pages.limit(0), *model).count() == 0


def test_deep_nesting_takes_seconds(model):
    began = time.perf_counter()
    deep = "<div>" * 100_000 + "<article><p>deep text</p>"
    assert M.main_texts([deep, "<ul>" + "<li>x" * 20_000, "<p>" * 20_000 + "y", "<b>" * 50_000 + "z" + "</i>" * 50_000], *model)
    assert time.perf_counter() - began < 30


#: Pages written by hand, in layouts and with names that the writer of training pages does not use: markup and main text.
BY_HAND = [
    (
        """<html><body><div id="wrap"><div class="navigation-bar"><a href="/">Home</a> <a href="/blog">Blog</a> <a href="/about">About us</a></div>
<main><section><h1>Growing leeks</h1><p>Leeks want a deep, rich soil and a long season, so sow them early and plant them out in June.</p>
<p>Water them well in dry weather; a <em>light</em> mulch keeps the soil moist and the weeds away.</p></section></main>
<footer><p>&copy; 2020 The garden club. All rights reserved.</p></footer></div></body></html>""",
        "Growing leeks Leeks want a deep, rich soil and a long season, so sow them early and plant them out in June. Water them well in dry weather; a light mulch keeps the soil moist and the weeds away.",
    ),
    (
        """<!doctype html><title>x</title><header><h2>The Daily</h2><nav><a href=a>News</a><a href=b>Sport</a></nav></header>
<article class="story"><h1>Bridge opens</h1><p>The new bridge over the river was opened on Monday by the mayor and several hundred people.<p>It took four years to build and cost less than was feared at first.</article>
<aside class="related-links"><h3>Read on</h3><ul><li><a href=1>Old bridge closed</a><li><a href=2>Ferry to stay</a></ul></aside><div class="comments"><p>Well done all!</p></div>""",
        "Bridge opens The new bridge over the river was opened on Monday by the mayor and several hundred people. It took four years to build and cost less than was feared at first.",
    ),
    (
        """<body><div class="cookie-banner"><p>This site uses cookies. <button>Accept</button></p></div><div class="post-content"><p>Three things to know before you buy a bicycle: its size, its weight, and the shop that will mend it when it breaks.</p>
<ul><li>Size comes first of all.</li><li>Weight matters on hills.</li></ul></div><div class="sidebar"><form><input name=q><button>Search</button></form></div><script>var a = 1;</script></body>""",
        "Three things to know before you buy a bicycle: its size, its weight, and the shop that will mend it when it breaks. Size comes first of all. Weight matters on hills.",
    ),
    (
        """<table><tr><td class="menu"><a href=1>Start</a><br><a href=2>Contact</a></td><td><article><h2>Minutes of the meeting</h2><p>The members met at eight and agreed on the budget for the coming year without a vote.</p></article></td></tr></table><div class="footer">Imprint</div>""",
        "Minutes of the meeting The members met at eight and agreed on the budget for the coming year without a vote.",
    ),
]


def test_pages_written_by_hand(model):
    got = M.main_texts([html for html, _ in BY_HAND], *model)
    assert got == [text for _, text in BY_HAND]
