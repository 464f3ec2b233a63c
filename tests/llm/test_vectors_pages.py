"""Embeddings and pages, and the pipeline."""

import math
import random
from collections import Counter
from fractions import Fraction

import numpy as np
import pytest

from corpuskit.llm import embdup, html, topk
from corpuskit.llm.common import components


def vectors(seed=3, n=300, dim=16):
    rng = np.random.default_rng(seed)
    base = rng.standard_normal((n, dim))
    rows = []
    for i in range(n):
        v = base[i] if i % 3 else base[i - i % 9] + 0.13 * rng.standard_normal(dim)
        rows.append((i, [float(x) for x in v]))
    rows += [(1000, None), (1001, []), (1002, [0.0] * dim), (1003, [None] * dim), (1004, [float("nan")] * dim), (1005, [float("inf")] + [1.0] * (dim - 1)), (1006, [1.0, 2.0])]
    rows += [(1010 + i, rows[1][1]) for i in range(5)] + [(1020, [2 * x for x in rows[1][1]]), (-3, [1e300] * dim), (-4, [1e-300] * dim)]
    return rows


def usable(v, zero=False):
    return bool(v) and all(x is not None and math.isfinite(x) for x in v) and (zero or any(v))


def test_components(spark):
    rng = random.Random(2)
    edges = [(i, i + 1) for i in range(40)] + [(rng.randrange(100, 160), rng.randrange(100, 160)) for _ in range(50)] + [(7, 7), (500, 501)] * 2 + [(900, x) for x in range(901, 990)]
    rng.shuffle(edges)
    label = {}
    for a, b in edges:
        if a != b:
            label.setdefault(a, a), label.setdefault(b, b)
    for _ in range(200):
        for a, b in edges:
            if a != b:
                label[a] = label[b] = min(label[a], label[b])
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == label
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.mark.parametrize("chunk", [1024, 6])
def test_embedding_duplicates(spark, monkeypatch, chunk):
    monkeypatch.setattr(embdup, "CHUNK", chunk)
    data = vectors()
    good = [(i, np.array(v) / np.abs(v).max()) for i, v in data if usable(v)]
    links, label = {i: 0 for i, _ in data}, {i: i for i, _ in data}

    def top(x):
        while label[x] != x:
            x = label[x]
        return x

    for k, (i, v) in enumerate(good):
        for j, w in good[k + 1 :]:
            if len(v) == len(w) and v @ w / np.sqrt((v @ v) * (w @ w)) >= 0.9:
                links[i], links[j] = links[i] + 1, links[j] + 1
                a, b = top(i), top(j)
                label[max(a, b)] = min(a, b)
    table = spark.createDataFrame(data, "vec_id long, embedding array<double>").selectExpr("*", "'x' AS node", "1 AS h1", "2 AS m").repartition(3)
    got = {r.vec_id: r for r in embdup.near_duplicates(table).collect()}
    assert len(got) == len(data)
    assert {i: r.n_links for i, r in got.items()} == links and sum(links.values()) > 100
    assert {i: r.component_id for i, r in got.items()} == {i: top(i) for i in links}
    assert all(r.kept == (r.component_id == i) for i, r in got.items())
    assert embdup.near_duplicates(table.limit(0)).count() == 0


def test_embedding_duplicates_without_ids(spark):
    """Rows without an id link, and name no component."""
    near = lambda x: [1.0, 0.1 * x, 0.0]
    data = [(None, near(0)), (4, near(1)), (None, near(2)), (2, near(3)), (None, [0.0, 0.0, 1.0]), (None, [0.0, 0.1, 1.0]), (None, [0.0, 1.0, 0.0]), (9, [-1.0, 0.0, 0.0]), (None, None), (9, [-1.0, 0.0, 0.0])]
    got = embdup.near_duplicates(spark.createDataFrame(data, "vec_id long, embedding array<double>"))
    want = [(None, 3, 2, False)] * 2 + [(4, 3, 2, False), (2, 3, 2, True)] + [(None, 1, None, True)] * 2 + [(None, 0, None, True)] * 2 + [(9, 1, 9, True)] * 2
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, want))


def test_embedding_recall(spark):
    """At 12,000 vectors with planted pairs just above the threshold, links against all pairs."""
    rng, dim = np.random.default_rng(8), 64
    base = rng.standard_normal((9000, dim))
    unit = lambda x: x / np.linalg.norm(x, axis=1, keepdims=True)
    base, side = unit(base), rng.standard_normal((3000, dim))
    side = unit(side - (side * base[:3000]).sum(axis=1, keepdims=True) * base[:3000])
    cos = rng.uniform(0.9, 0.92, (3000, 1))
    every = np.concatenate((base, cos * base[:3000] + np.sqrt(1 - cos * cos) * side))
    bits, tables = embdup.tables_for(len(every))
    assert tables > 20 and embdup.most_differing(bits * tables) < 0.35 * bits * tables
    want = np.array([(unit(every[i : i + 1000]) @ unit(every).T >= 0.9).sum(axis=1) - 1 for i in range(0, len(every), 1000)]).ravel()
    table = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(every)], "vec_id long, embedding array<double>").repartition(4)
    got = {r.vec_id: r.n_links for r in embdup.near_duplicates(table).collect()}
    found = np.array([got[i] for i in range(len(every))])
    assert (found <= want).all() and want.sum() >= 6000 and found.sum() / want.sum() >= 0.995


def test_tables_follow_recall():
    for n in (2, 1000, 10**6, 10**9):
        bits, tables = embdup.tables_for(n)
        assert 1 - (1 - (1 - math.acos(0.9) / math.pi) ** bits) ** tables >= 0.999


@pytest.mark.parametrize(("block", "k"), [(4096, 5), (4, 3), (4096, 400)])
def test_exact_topk(spark, monkeypatch, block, k):
    monkeypatch.setattr(topk, "BLOCK", block)
    data = [(i, v) for i, v in vectors() if v is None or not any(x and math.isfinite(x) and abs(x) > 1e6 for x in v)] + [(7, vectors()[8][1]), (None, [1.0] * 16)]
    whole = [(i, [math.floor(256 * x) for x in v]) for i, v in data if i is not None and usable(v, True)]
    want = []
    for q, v in whole:
        if q % 50 == 0:
            scored = sorted((-sum(a * b for a, b in zip(v, w)), i) for i, w in whole if i != q and len(w) == len(v))
            want += [(q, r + 1, i, -s) for r, (s, i) in enumerate(scored[:k])]
    table = spark.createDataFrame(data, "vec_id long, embedding array<double>").selectExpr("*", "'x' AS score", "1 AS q", "2 AS rank").repartition(3)
    found = topk.search(table, table["vec_id"] % 50 == 0, k=k)
    assert sorted(map(tuple, found.collect())) == sorted(want)
    assert topk.search(table.limit(0), table["vec_id"] % 50 == 0).count() == 0
    assert topk.search(table.where("vec_id % 50 <> 0"), table["vec_id"] % 50 == 0).count() == 0


def test_topk_beyond_doubles(spark):
    table = spark.createDataFrame([(0, [3e9, 1.0]), (1, [2.0, 5.0]), (2, [3e3, 1.0])], "vec_id long, embedding array<double>")
    got = [tuple(r) for r in topk.search(table, table["vec_id"] % 50 == 0).orderBy("rank").collect()]
    exact = lambda w: sum(math.floor(256 * a) * math.floor(256 * b) for a, b in zip([3e9, 1.0], w))
    assert got == [(0, 1, 2, exact([3e3, 1.0])), (0, 2, 1, exact([2.0, 5.0]))]


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body><nav><ul><li><a href="/a">Home</a></li><li><a href="/b">News</a></li></ul></nav>
<!-- ad --><div class="ad">Buy this now.</div><article><h1>A title &amp; more</h1><p><b>First  paragraph
of text with some words.<br><p>Second &eacute;t&eacute; paragraph, 1 < 2, with more words in it.</p>
<div class="advert">Special offer for you.</div><p>Third paragraph ends the article here.</article>
<section id="comments"><h3>2 comments</h3><div class="comment"><p>I liked this very much, thanks for it.</p></div></section>
<aside class="sidebar"><h3>Related articles</h3><ul><li><a href="/c">Other one</a></li></ul></aside><footer>&copy; example &middot; Some words.</footer></body></html>"""


def plain_top(rows, k=5):
    """The best rows by Python's integers, scores held within a long."""
    whole = [(i, [math.floor(Fraction(x) * 256) for x in v]) for i, v in rows]
    out = []
    for q, v in whole:
        if q % 50 == 0:
            scored = sorted((-max(-(2**63), min(2**63 - 1, sum(a * b for a, b in zip(v, w)))), i) for i, w in whole if i != q)
            out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(scored[:k])]
    return sorted(out)


@pytest.mark.parametrize(
    "rows",
    [
        [(0, [1e12, 1.0]), (1, [-1e12, 1.0]), (2, [1e12, 0.0]), (3, [2e12, 0.0]), (4, [1.0, 0.0]), (5, [-2e12, 0.0])],
        [(0, [4e6, 0.0]), (1, [1e7, 0.0]), (2, [9e6, 0.5]), (3, [-1e7, 0.0]), (4, [9e6, -0.5])],  # scores between 2**61 and 2**63 keep their order
        [(0, [1e306, -1e306]), (1, [1.0, 1.0]), (2, [1e306, 1e306]), (3, [1e-300, 0.0]), (50, [0.0, 0.0]), (100, [1.7e308, 1.7e308]), (4, [-1.7e308, 1.0])],
        [(0, [2.0**27 + 0.25, 1.0]), (1, [2.0**27 - 0.125, 3.0]), (2, [2.0**27, 2.0]), (3, [-(2.0**27), 0.1])],
    ],
)
def test_topk_of_components_of_any_size(spark, rows):
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(2)
    found = topk.search(table, table["vec_id"] % 50 == 0)
    assert sorted(map(tuple, found.collect())) == plain_top(rows)


def test_blocks_of_a_page():
    got = html.blocks(PAGE)
    texts = [t for _, t, _ in got]
    assert texts[:4] == ["Home", "News", "Buy this now.", "A title & more"]
    assert "First paragraph of text with some words." in texts and "Second été paragraph, 1 < 2, with more words in it." in texts
    assert not any("var t" in t or "p{}" in t or t == "T" for t in texts)
    assert html.blocks("") == [] and html.blocks("<div>") == [] and html.blocks("a < b") == [((), "a < b", 0.0)]
    assert html.blocks("<p>x<!-- never ends") == [((("p", ()),), "x", 0.0)]


@pytest.mark.parametrize(("page", "texts"), [
    ("<p title='5\" disk'>text one</p><p>he said \"hi\" to me</p><p>last</p>", ["text one", 'he said "hi" to me', "last"]),
    ("<p title='a > b'>text", ["text"]), ('<p title = "a > b" x=\'c>d\'>text', ["text"]), ("<p a=b'c>text</p>it's", ["text", "it's"]),
    ("<p>a <!--> b</p><p>c</p>", ["a b", "c"]), ("<p>a <!---> b", ["a b"]), ("<p>a <!-- x --!> b", ["a b"]), ("<p>a<!-- -- > -->b", ["ab"]),
    ("a <b c", ["a <b c"]), ("<p a=\"x>y</p>z", ["y", "z"]), ("<svg><p>x", ["x"]), ("<svg><p>y</svg>x", ["x"]), ("x<style>y", ["x"]), ("\u0130<script>a</SCRIPT>b", ["\u0130b"]),
    ("<?php x ?>y<!DOCTYPE z></>w", ["yw"]), ("&lt;p&gt; &amp;amp; &#x41;&copy", ["<p> &amp; A\u00a9"]),
])
def test_tags_quotes_and_comments(page, texts):
    assert [t for _, t, _ in html.blocks(page)] == texts


def test_deep_pages_have_right_paths():
    """Elements below any depth open and close; long paths are told by their ends."""
    page = "<main>" + "<div class='a'>" * 500 + "<p>in</p>" + "</div>" * 500 + "<p>out</p></main><footer>last</footer>"
    paths = {t: [n for n, _ in path] for path, t, _ in html.blocks(page)}
    assert paths["out"] == ["main", "p"] and paths["last"] == ["footer"]
    assert paths["in"] == ["main"] + ["div"] * 118 + ["p"]
    for lot in ("<div>x", "</div>", "<svg>", "<p x=\"", "<!--", "<td>", "<"):
        html.blocks(lot * 20_000)


def test_html_text(spark):
    pages = [(1, "u", PAGE), (2, None, None), (3, "v", ""), (4, "w", "<html><body></body></html>"), (5, "x", "<p>" * 5000), (1, "u", PAGE)]
    big = "<article><h1>Head of it</h1>" + "".join(f"<p>Paragraph number {i} has a few words.</p>" for i in range(5000)) + "</article>"
    table = spark.createDataFrame([*pages, (6, "y", big)], "page_id long, url string, html string").selectExpr("*", "'z' AS text", "1 AS n_chars")
    got = sorted(html.extract(table).collect(), key=lambda r: r.page_id)
    want = "A title & more\nFirst paragraph of text with some words.\nSecond été paragraph, 1 < 2, with more words in it.\nThird paragraph ends the article here."
    assert [r.text for r in got[:2]] == [want, want] and [r.text for r in got[2:6]] == ["", "", "", ""]
    assert got[6].text.count("\n") == 5000
    assert all(r.n_chars == len(r.text) for r in got)
    assert html.extract(table.limit(0)).count() == 0


P1 = "Rain fell on the hills for three days, and the river rose until it reached the old stone bridge."
P2 = "The mayor asked people to stay at home. Schools were closed, and two roads to the north could not be used."
P3 = "By Friday the water had gone down again. Shops opened, and children walked to school along the muddy street."
NAV = "".join(f'<li><a href="/{x}">{x}</a></li>' for x in ("Home", "News", "Sport", "Contact"))
HAND = [
    ("bare paragraphs", f"<p>{P1}</p><p>{P2}</p>", f"{P1}\n{P2}"),
    ("one line", "<p>Hello world</p>", "Hello world"),
    ("meaningless class and a cookie line", f'<div class="x"><h1>River in flood</h1><p>{P1}</p><p>{P2}</p></div><div class="y">We use cookies to improve your experience.</div>', f"River in flood\n{P1}\n{P2}"),
    ("layout table", f'<table><tr><td><a href="/">Home</a><br><a href="/n">News</a><br><a href="/c">Contact</a></td><td><h1>River in flood</h1><p>{P1}</p><p>{P3}</p></td></tr></table>', f"River in flood\n{P1}\n{P3}"),
    ("semantic elements", f"<!doctype html><html><body><header><p>The Valley Post</p></header><nav><ul>{NAV}</ul></nav><main><article><h1>River in flood</h1><p>{P1}</p><p>{P2}</p></article></main><footer><p>Copyright 2021. All rights reserved.</p></footer></body></html>", f"River in flood\n{P1}\n{P2}"),
    ("blog with side column and comments", f'<div id="wrapper"><div id="header"><div class="logo">My blog</div></div><div class="post-content"><h2>After the flood</h2><p>{P3}</p><p>{P1}</p></div><div class="sidebar"><h3>Recent posts</h3><ul>{NAV}</ul></div><div id="comments"><div class="comment"><p>I saw this from my window, it was terrible.</p></div></div></div>', f"After the flood\n{P3}\n{P1}"),
    ("generated classes", f'<div class="css-1x2y3z"><ul>{NAV}</ul></div><div class="sc-abcde"><h1>River in flood</h1><p>{P1}</p><p>{P2}</p><p>{P3}</p></div><div class="css-9a8b7c"><p>Privacy policy Terms of use</p></div>', f"River in flood\n{P1}\n{P2}\n{P3}"),
    ("advert inside the article", f"<article><h1>River in flood</h1><p>{P1}</p><div class='ad banner-ad'>Buy rubber boots now and save.</div><p>{P2}</p><aside class='related'><a href='/x'>More on floods</a></aside><p>{P3}</p></article>", f"River in flood\n{P1}\n{P2}\n{P3}"),
    ("lists and headings", f'<div class="content"><h1>What to pack</h1><p>{P2}</p><h2>Before you go</h2><ul><li>Warm clothes and dry shoes.</li><li>A torch with new batteries.</li></ul><p>{P3}</p></div><div class="footer">&copy; 2020 The Valley Post</div>', f"What to pack\n{P2}\nBefore you go\nWarm clothes and dry shoes.\nA torch with new batteries.\n{P3}"),
    ("newsletter form and consent dialog", f'<div class="cookie-banner"><p>This site uses cookies.</p><button>Accept all</button></div><section class="article-body"><h1>River in flood</h1><p>{P1}</p><p>{P3}</p></section><form class="newsletter"><label>E-mail</label><input name="e"><button>Subscribe</button></form>', f"River in flood\n{P1}\n{P3}"),
    ("upper-case tags without end tags", f"<HTML><BODY><H1>River in flood</H1><P>{P1}<P>{P2}<P>{P3}</BODY></HTML>", f"River in flood\n{P1}\n{P2}\n{P3}"),
    ("quotes and scripts", f"""<article><h1 title='5" of rain'>River in flood</h1><p data-x='a > b'>{P1}</p><!--><p>{P2}</p><script>if (a < b) document.write("<p>no</p>");</script></article>""", f"River in flood\n{P1}\n{P2}"),
    ("deep wrappers", "<div>" * 300 + f"<h1>River in flood</h1><p>{P1}</p><p>{P2}</p>" + "</div>" * 300 + f"<footer><p>All rights reserved.</p></footer>", f"River in flood\n{P1}\n{P2}"),
]


def test_html_text_of_pages_of_other_shapes():
    """Pages that the generator of training pages does not make: words found of those wanted, and wanted of those found."""
    found = html.main_text(html.trained(), [page for _, page, _ in HAND])
    got, want = [Counter(t.split()) for t in found], [Counter(t.split()) for *_, t in HAND]
    hits = sum(sum((a & b).values()) for a, b in zip(got, want))
    assert hits >= 0.95 * sum(map(Counter.total, want)) and hits >= 0.95 * sum(map(Counter.total, got))


def test_html_labels_on_held_out_pages():
    model, right, total = html.trained(), 0, 0
    for page, labels in html.training_pages(150, seed=77):
        cut = html.blocks(page)
        assert len(cut) == len(labels)
        found = html.label(model, [html._vectors(cut)])[0] >= 0.5
        right, total = right + int((found == np.array(labels)).sum()), total + len(labels)
    assert right / total > 0.98


def test_lstm_gradient():
    """Backpropagation agrees with finite differences."""
    rng = np.random.default_rng(1)
    model = html.Lstm()
    model.w = {k: v.astype(np.float64) for k, v in model.w.items()}
    pages = [rng.standard_normal((n, html.DIM)).astype(np.float32) for n in (3, 5)]
    x, mask = html._padded(pages)
    x, target = x.astype(np.float64), (rng.random(mask.shape) > 0.5) * mask

    def loss():
        p, _, _ = model.forward(x, mask)
        return -(mask * (target * np.log(p) + (1 - target) * np.log(1 - p))).sum() / mask.sum()

    seen = {}
    copy = {k: v.copy() for k, v in model.w.items()}
    adam = {"n": 0}
    model.step(x, mask, target, adam, 0.0)
    for k in ("xf", "hb", "bf", "o"):
        at = tuple(rng.integers(0, s) for s in copy[k].shape)
        model.w = {n: v.copy() for n, v in copy.items()}
        model.w[k][at] += 1e-3
        up = loss()
        model.w[k][at] -= 2e-3
        seen[k] = ((up - loss()) / 2e-3, adam[k][0][at] / 0.1)
    for numeric, analytic in seen.values():
        assert analytic == pytest.approx(numeric, rel=0.05, abs=1e-4)


def test_skipped_elements_end_where_they_end():
    texts = lambda page: [b[1] for b in html.blocks(page)]
    assert texts("<svg><svg></svg><text>leak</text></svg><p>a</p>") == ["a"]
    assert texts("<title>x</titlex></title><p>b</p>") == ["b"]
    assert texts("<template><template/>x</template><p>c</p><object><p>inner") == ["c", "inner"]
    assert texts("<p>d</p><NOSCRIPT>Enable</noscript ><p>e</p><script>if (a<b) '</scripty>'</script><p>f") == ["d", "e", "f"]


MANUALS = {
    '<div class="wrapper"><div class="toc"><ul><li><a href="#a">Intro</a></li><li><a href="#b">Usage</a></li></ul></div><div class="doc"><h2>Intro</h2><p>This tool reads files.</p>'
    "<pre>run tool x</pre><h2>Usage</h2><dl><dt>-v</dt><dd>prints more</dd></dl></div></div>": "Intro\nThis tool reads files.\nrun tool x\nUsage\n-v\nprints more",
    '<body><div class="container"><nav class="docs-nav"><a href="/a">Install</a> <a href="/b">API</a></nav><div class="markdown-body"><h1>Install</h1><p>Get it.</p>'
    "<ul><li>Linux</li><li>Mac</li></ul><p>Done.</p></div></div></body>": "Install\nGet it.\nLinux\nMac\nDone.",
    "<p>a <!--> b</p><p>c</p>": "a b\nc",
    "<article><h1>Title here</h1><p>Some text of the article that goes on.</p><noscript>Enable JavaScript to view.</noscript><p>More of it.</p></article>": "Title here\nSome text of the article that goes on.\nMore of it.",
}


@pytest.mark.parametrize("page", MANUALS)
def test_documentation_pages(page):
    assert html.main_text(html.trained(), [page]) == [MANUALS[page]]
