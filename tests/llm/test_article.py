"""Main texts of pages: the tables' pages against their articles, other layouts, odd HTML, decoding against all choices."""

import html
import itertools
import re

import numpy as np
import pytest

from pathloom.llm import article, dom


def plain(page):
    """The blocks of the only article of one of the tables' pages."""
    inside = re.search(r"<article>(.*?)</article>", page, re.S)[1]
    blocks = [" ".join(html.unescape(re.sub(r"<[^>]+>", " " if x else "", b)).split()) for b in re.split(r"</?(?:p|h1)>", inside) for x in ["<br" in b]]
    return "\n\n".join(b for b in blocks if b)


@pytest.fixture(scope="module")
def pages(spark, tables):
    return spark.read.parquet(f"{tables}/pages.parquet")


@pytest.fixture(scope="module")
def trees(pages):
    return article.learn(pages)


def test_the_tables_pages_give_their_articles(spark, tables, pages):
    want = {r.page_id: (r.url, plain(r.html)) for r in pages.collect()}
    got = article.op13(spark, tables).collect()
    assert {r.page_id: (r.url, r.text) for r in got} == want
    assert all(r.n_chars == len(r.text) for r in got)


def test_layouts_that_were_not_learned(trees, pages):
    words = [w for r in pages.collect() for t in dom.read(r.html).text if t for w in t.split(" ")]
    maker = article._Maker([w.replace("&", "&amp;").replace("<", "&lt;") for w in words], seed=77)
    made = [maker.page() for _ in range(300)]
    want = ["\n\n".join(t.replace(article.MARK, "") for t in dom.read(p).text if t and article.MARK in t) for p in made]
    got = article.extract([p.replace(article.MARK, "") for p in made], trees)
    assert sum(a == b for a, b in zip(got, want)) / len(made) > 0.88


def test_a_page_with_everything_around(trees):
    page = """<html><body class="home"><header><h1>Site</h1><p>All the news.</p></header><nav><a href=/a>A</a> <a href=/b>B</a></nav>
    <div class="cookie-notice">We use cookies. <button>Fine</button></div><div id="content"><h1>Tea &amp; cake</h1><p>First&nbsp;paragraph
    with <b>bold</b> words, about tea.<p>Second one; 3 &lt; 4.</p><div class="ad">Buy more tea.</div><p>Last.</p></div>
    <aside><h3>More</h3><ul><li><a href=/1>One</a><li><a href=/2>Two</a></ul></aside><form><label>Mail</label><input><button>Send</button></form>
    <section id="comments"><h2>Comments</h2><p>I like this text very much, it is good.</p><p>So do I.</p></section>
    <footer>&copy; Site</footer><script>var x = "<p>no</p>";</script></body></html>"""
    assert article.extract([page], trees) == ["Tea & cake\n\nFirst paragraph with bold words, about tea.\n\nSecond one; 3 < 4.\n\nLast."]


def test_null_empty_and_broken_pages(trees):
    odd = [None, "", "   ", "<", "<!-- open", "<p", "</p></div>", "<script>never closed", "<ul><li><li>", "&#0;&bogus;&#x110000;", "<a href='x", "<div " * 500, "<b>" * 3000 + "x", "<!doctype html>"]
    for page, text in zip(odd, article.extract(odd, trees)):
        assert isinstance(text, str), page
    assert article.extract([None, "", "<p>", "<script>x</script>"], trees) == ["", "", "", ""]
    long = "<article>" + "<p>some words of a long page.</p>" * 30_000 + "</article>"
    assert article.extract([long], trees)[0].count("\n\n") == 29_999


def test_blocks_of_html():
    texts = lambda page: [t for t in dom.read(page).text if t]
    assert texts("a<p>b<p>c<div>d</p>e</div>f") == ["a", "b", "c", "d", "e", "f"]
    assert texts("<b>x</b>y <i>z</i><br>w") == ["xy z w"]
    assert texts("<ul><li>1<li>2<ul><li>3</ul><li>4</ul>") == ["1", "2", "3", "4"]
    assert texts("<table><tr><td>1<td>2<tr><td>3</table>4") == ["1", "2", "3", "4"]
    assert texts("<p title='a>b' x=\"<p>\">t</p>&amp;lt;<style>p{}</style><SCRIPT>1</SCRIPT >u") == ["t", "&lt;u"]
    assert texts("<h1>a<h2>b</h2>c<hr>d<select><option>no</select>e") == ["a", "b", "c", "de"]
    assert texts("1 < 2 & 3 > 2 <x-y>z</x-y>") == ["1 < 2 & 3 > 2 z"]


def test_decoding_is_the_best_choice_without_contradictions():
    rng = np.random.default_rng(3)
    for _ in range(60):
        page = dom.Page()
        for _ in range(7):
            parent = int(rng.choice([k for k, t in enumerate(page.tag) if t != dom.RUN]))
            page.text[page.add(dom.RUN if rng.random() < 0.6 else "div", parent)] = None
        page.text = [f"t{k}" if t == dom.RUN else None for k, t in enumerate(page.tag)]
        odds = rng.normal(size=8) * 2
        filled = [any(page.tag[j] == dom.RUN and i in chain(page, j) for j in range(8)) for i in range(8)]
        best = max(
            (sum((odds[i] if k else -odds[i]) for i, k in enumerate(keep) if i and filled[i]), keep)
            for keep in itertools.product([False, True], repeat=8) if keep[0] and all(keep[page.parent[i]] or not keep[i] for i in range(1, 8))
        )
        runs = {f"t{i}" for i in range(8) if page.tag[i] == dom.RUN and best[1][i]}
        assert set(filter(None, article.decoded(page, odds).split("\n\n"))) == runs


def chain(page, i):
    out = []
    while i >= 0:
        out.append(i)
        i = page.parent[i]
    return out


def test_boosted_trees_learn_and_constant_labels_do_no_harm():
    rng = np.random.default_rng(2)
    x = rng.integers(0, 9, (2000, 6)).astype(np.int16)
    y = ((x[:, 0] > 4) ^ (x[:, 3] > 2)).astype(float)
    assert (((article.fit(x, y)(x) > 0) == y).mean()) > 0.97
    assert np.isfinite(article.fit(x, np.zeros(2000))(x)).all()


def test_columns_repeats_and_empty_tables(spark, pages):
    some = pages.limit(5).selectExpr("page_id", "url", "html", "'a' as text", "1 as row", "'b' as n_chars")
    doubled = some.unionByName(some).unionByName(spark.createDataFrame([(None, None, None, "t", 1, "n")], some.schema))
    out = article.extracted(doubled)
    assert out.count() == 11 and out.select("row.*").columns == some.columns
    assert article.articles(pages.limit(0), pages_row(pages)).count() == 0
    assert [r.text for r in article.articles(spark.createDataFrame([(1, None)], "page_id long, html string"), pages_row(None)).collect()] == [""]


def pages_row(_):
    from pyspark.sql import functions as F

    return F.struct("page_id")
