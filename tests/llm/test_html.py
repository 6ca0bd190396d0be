"""HTML extraction: parsing against the standard library's parser, decoding against all labellings, pages labelled by hand, deep and broken pages."""

from __future__ import annotations

import itertools
import random
import time
from html.parser import HTMLParser

import numpy as np
import pytest

from bagweave.llm import html_text
from bagweave.llm.html_text import Page

#: (page, main text): written by hand, none from the generator.
LABELLED = [
    (
        """<!DOCTYPE html><html lang="en"><head><meta charset="utf-8"><title>Tides - Coast Daily</title><style>p{margin:0}</style></head><body class="single">
<header class="site-header"><a href="/">Coast Daily</a><nav class="main-nav"><ul><li><a href="/news">News</a></li><li><a href="/sport">Sport</a></li><li><a href="/weather">Weather</a></li></ul></nav></header>
<main><article class="post"><h1>Spring tides flood the old harbour</h1><p>Water stood knee-deep in the market hall on Tuesday morning, after the highest tide in eleven years met an easterly gale.</p>
<p>Traders had moved their stock to the upper floor the evening before, and <a href="/x">the council</a> said that no one was hurt.</p><div class="advertisement"><p>Boots for every weather, now half price.</p></div>
<h2>More to come</h2><p>A second tide of the same height is expected on Thursday, but forecasters think that the wind will have turned by then.</p></article></main>
<aside class="sidebar"><h3>Most read</h3><ul><li><a href="/1">Bridge closed until May</a></li><li><a href="/2">Ferry strike ends</a></li></ul></aside>
<section id="comments"><h3>2 comments</h3><div class="comment"><p>We saw it from the hill, quite a sight.</p></div><div class="comment"><p>Same as in 2013 then.</p></div></section>
<footer class="site-footer"><p>&copy; 2024 Coast Daily. All rights reserved.</p><p><a href="/privacy">Privacy</a> <a href="/terms">Terms</a></p></footer></body></html>""",
        ["Spring tides flood the old harbour", "Water stood knee-deep in the market hall on Tuesday morning, after the highest tide in eleven years met an easterly gale.", "Traders had moved their stock to the upper floor the evening before, and the council said that no one was hurt.", "More to come", "A second tide of the same height is expected on Thursday, but forecasters think that the wind will have turned by then."],
    ),
    (
        """<body><div id="cookie-banner">We use cookies to improve your visit. <button>Accept</button></div><div id="wrapper"><div id="menu"><a href="a">Home</a> | <a href="b">About</a> | <a href="c">Contact</a></div>
<div id="content"><h2>How to prune an apple tree</h2>Prune in late winter, before the buds swell.<br>Take out dead wood first.<ul><li>Cut just above a bud that faces outward.</li><li>Leave the tree open, so that a bird could fly through it.</li></ul>
<blockquote>A bad cut is worse than no cut at all, my grandfather used to say.</blockquote><p>Burn what shows canker &amp; keep your blades clean.</p></div><div class="share-buttons"><a href="#">Tweet</a><a href="#">Pin</a></div></div><div id="footer">Made by hand. <a href="m">Mail me</a></div></body>""",
        ["How to prune an apple tree", "Prune in late winter, before the buds swell. Take out dead wood first.", "Cut just above a bud that faces outward.", "Leave the tree open, so that a bird could fly through it.", "A bad cut is worse than no cut at all, my grandfather used to say.", "Burn what shows canker & keep your blades clean."],
    ),
    (
        """<html><body><form action="/search"><label>Search the archive</label><input name=q><button>Go</button></form><nav><ol class="breadcrumbs"><li><a href="/">Start</a></li><li><a href="/maths">Mathematics</a></li></ol></nav>
<section class="article-body"><p>The sum of the first <math><mi>n</mi></math> odd numbers is a square, which a child can see by laying pebbles.</p><p>Each new odd number is an angle around the square laid before, and so it makes a larger one.</p>
<table><tr><td>1</td><td>one pebble</td></tr><tr><td>1 + 3</td><td>four pebbles</td></tr></table><p>Nothing in this needs algebra, though algebra says it faster.</p></section>
<div class="related-posts"><h4>You may like</h4><a href="/t">Triangular numbers</a></div><div class="newsletter"><p>Get one puzzle a week by mail.</p><form><input type=email></form></div><script>var a = "<p>not text</p>";</script></body></html>""",
        ["The sum of the first n odd numbers is a square, which a child can see by laying pebbles.", "Each new odd number is an angle around the square laid before, and so it makes a larger one.", "1", "one pebble", "1 + 3", "four pebbles", "Nothing in this needs algebra, though algebra says it faster."],
    ),
    (
        """<div class="page"><div class="top-banner"><p>Sale ends Sunday</p></div><article><p>She closed the shop at six and walked home along the canal, as she had done every day for thirty years.</p><p>That evening the water was still.</p><p>A heron stood where the lock gates met, and did not move when she passed within an arm's length of it.</p></article><ol class="comment-list"><li>Lovely ending.</li><li>I don't get the heron.</li></ol></div>""",
        ["She closed the shop at six and walked home along the canal, as she had done every day for thirty years.", "That evening the water was still.", "A heron stood where the lock gates met, and did not move when she passed within an arm's length of it."],
    ),
]


def test_labelled_pages():
    """Of all blocks of pages labelled by hand at least nine in ten are judged right, kept or not."""
    right = wrong = 0
    for page, want in LABELLED:
        got = html_text.main_texts([page], html_text.fitted())[0].split("\n\n")
        every = [t for _, t in Page(page).runs]
        assert all(w in every for w in want), set(want) - set(every)
        for t in every:
            right += (t in got) == (t in want)
            wrong += (t in got) != (t in want)
    assert right >= 9 * wrong and right > 40, (right, wrong)


class Plain(HTMLParser):
    """Runs of text between block tags."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.out, self.run, self.skip = [], "", 0

    def cut(self):
        if t := " ".join(self.run.split()):
            self.out.append(t)
        self.run = ""

    def handle_starttag(self, tag, attrs):
        if tag in html_text.BLOCKS:
            self.cut()
        elif tag in ("br", "img"):
            self.run += " "
        self.skip += tag in ("script", "style")

    def handle_endtag(self, tag):
        if tag in html_text.BLOCKS:
            self.cut()
        self.skip -= tag in ("script", "style")

    def handle_data(self, data):
        if not self.skip:
            self.run += data


def test_runs_against_the_standard_parser():
    r = random.Random(9)
    leaf = lambda: r.choice(["word", "a &amp; b", "x<br>y", "<b>bold</b>", "<a href='x>y'>link</a>", "é&nbsp;ü", "<!-- <p> -->", "<script>if (a<b) '</p>'</script>", "1 < 2", "&#65;&#x42;"])

    def tree(depth):
        if depth == 0 or r.random() < 0.3:
            return leaf()
        tag = r.choice(["div", "p", "section", "ul", "h2", "blockquote"])
        inner = "".join(leaf() if tag in ("p", "h2") else f"<li>{tree(depth - 1)}</li>" if tag == "ul" else tree(depth - 1) for _ in range(r.randint(1, 4)))
        return f"<{tag} class=\"a > b\" data-x='1'>{inner}</{tag}>"

    for _ in range(300):
        source = f"<html><body>{''.join(tree(5) for _ in range(3))}</body></html>"
        plain = Plain()
        plain.feed(source)
        plain.close()
        plain.cut()
        assert [t for _, t in Page(source).runs] == plain.out, source


def test_decoding_is_the_best_labelling():
    r = random.Random(10)
    for _ in range(60):
        page = Page("<body>" + "".join(r.choice(["<div>", "</div>", "<div>x</div>"]) for _ in range(10)))
        n = len(page.tag)
        odds = np.array([1e9, *(r.uniform(-3, 3) for _ in range(n - 1))])
        legal = (k for k in itertools.product([False, True], repeat=n) if k[0] and all(k[page.parent[v]] or not k[v] for v in range(1, n)))
        best = max(sum(odds[v] for v in range(1, n) if k[v]) for k in legal)
        kept = page.decode(odds.copy())
        assert all(kept[page.parent[v]] or not kept[v] for v in range(1, n))
        assert sum(odds[v] for v in range(1, n) if kept[v]) == pytest.approx(best)


def test_trees_score_rows_one_by_one():
    model = html_text.fitted()
    x = np.concatenate([Page(s).features() for s in html_text.training_pages(5, seed=8)])

    def one(row):
        total = model.start
        for tree in model.trees:
            k = 0
            while isinstance(tree[k], tuple):
                k = 2 * k + 1 + (row[tree[k][0]] > tree[k][1])
            total += tree[k] or 0
        return total

    assert model(x) == pytest.approx([one(row) for row in x])


@pytest.mark.parametrize("source", [
    "<div>" * 30_000 + "x", '<a "x" ' * 20_000, '<a "x>" ' * 20_000, "<script>" + "</script " * 20_000, "<!" * 50_000, "<div " + "a" * 300_000 + ">x</div>", "<td><table>" + "<div>" * 10_000 + "<td></td>" * 10_000,
    "<div>" * 10_000 + "<li></li>" * 10_000, "<p>" * 30_000 + "x", "<a href='" + "<p>x</p>" * 30_000, "&" * 300_000, "<" * 300_000, "<!--" * 50_000,
], ids=range(13))
def test_broken_pages_take_linear_time(source):
    start = time.process_time()
    page = Page(source)
    page.decode(np.concatenate([[1e9], np.ones(len(page.tag) - 1)]))
    page.numbers(), page.marks()
    assert time.process_time() - start < 5


def test_references_are_decoded_between_tags_only():
    assert Page("<p>&l<b>t;</b> AT&amp;T &lt;b&gt; &amp;lt;</p>").runs == [(1, "&lt; AT&T <b> &lt;")]


def test_repeated_and_large_pages(spark, monkeypatch):
    monkeypatch.setattr(html_text, "NODES_AT_ONCE", 50)
    page, want = LABELLED[0]
    rows = [(1, None, page), (1, None, page), (2, "u", None), (3, "u", "<article>" + "<p>Some words of a long page, one after the other.</p>" * 5000 + "</article>")]
    got = sorted((tuple(x) for x in html_text.extracted(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()), key=str)
    assert got[0] == got[1] and got[0][3] == len(got[0][2]) and got[0][2] == html_text.main_texts([page], html_text.fitted())[0]
    assert got[2] == (2, "u", "", 0) and got[3][2].count("\n\n") == 4999
