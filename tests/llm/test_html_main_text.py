"""Main texts: exact on the given pages, held-out accuracy on pages in other
dresses, the reader's rules, and the network's gradient against differences."""

import html
import re

import numpy as np
import pytest

from ratecraft.llm import html_main_text as mt
from ratecraft.llm.html_leaves import Paths, leaves

from ..conftest import SF_SMALL


def texts(page):
    return [t for t, _, _ in leaves(page, Paths())]


@pytest.mark.parametrize(("page", "want"), [
    ("", []),
    ("plain  text\n here", ["plain text here"]),
    ("<p>a<p>b<br>c</p>d", ["a", "b c", "d"]),
    ("<p>one <b>two</b><i>three</i></p>", ["one twothree"]),
    ("<script>var t='</p>';</script><style>p{}</style><title>x</title><p>y", ["y"]),
    ("<p>a<!-- <p>b</p> -->c<!-->d<!--->e<!-- open", ["acde"]),
    ("<!DOCTYPE html><?x y?></ z><p>&lt;p&gt; &amp;amp; &eacute;&#233;&#xe9;&nbsp;z &copy", ["<p> &amp; ééé z ©"]),
    ("<p title='a>b' data=x\"y>in</p><p unclosed='", ["in"]),
    ("1 < 2 <3 <p>x</p", ["1 < 2 <3", "x"]),
    ("<ul><li>a<li>b<ul><li>c</ul><li>d</ul>e", ["a", "b", "c", "d", "e"]),
    ("<table><tr><td>a<td>b<tr><th>c</table>d", ["a", "b", "c", "d"]),
    ("<dl><dt>a<dd>b<dt>c</dl><h1>t</h1>u", ["a", "b", "c", "t", "u"]),
    ("<select><option>a</select><textarea>b</textarea><button>c</button><p>d<button>e", ["de"]),
    ("<SCRIPT>x</SCRIPT ><DIV>up</DIV></nothing><svg><text>s</text></svg>", ["up"]),
    ("<p>left<hr>right<script>rest", ["left", "right"]),
])
def test_leaves(page, want):
    assert texts(page) == want


def test_paths_links_and_depth():
    paths = Paths()
    (a, nav, linked), (b, body, plain) = leaves('<nav class="Top-Menu"><a href=x>go</a></nav><main><p>text', paths)
    assert (a, linked, b, plain) == ("go", 2, "text", 0)
    assert mt._by_rule(nav, paths) == 0 and mt._by_rule(body, paths) == 1
    deep = "<div>" * 30_000 + "x" + "</div>" * 30_000 + "<a b='>" * 3000 + "<p" * 30_000
    assert texts(deep) == ["x"]
    assert len(texts("<li>y" * 20_000)) == 20_000


def test_gradient_matches_differences():
    rng = np.random.default_rng(0)
    model, size = mt._fresh(rng), np.array([5, 3])
    x = mt._padded(rng.normal(size=(8, mt.WIDTH)), size)
    label = np.full((5, 2), -1)
    label[:5, 0], label[:3, 1] = [1, 0, -1, 1, 0], [0, 1, 1]
    _, grad, dx = mt.gradient(model, x, size, label)
    for held, found in [(model[k], grad[k]) for k in ("xf", "hf", "cf", "xb", "hb", "cb", "out", "bias")] + [(x, dx)]:
        at = tuple(rng.integers(n) for n in held.shape)
        at = (1, 1, 4) if held is x else at
        held[at] += 1e-6
        up = mt.gradient(model, x, size, label)[0]
        held[at] -= 2e-6
        down = mt.gradient(model, x, size, label)[0]
        held[at] += 1e-6
        assert abs((up - down) / 2e-6 - found[at]) < 1e-6


def test_judging_in_batches_is_judging_alone():
    model = mt._fresh(np.random.default_rng(1))
    pages = ["<p>a</p>" * 3, "", "<nav><li>b<li>c</nav><p>long text here", "<h1>t</h1>" + "<p>word " * 40]
    paths = Paths()
    found = [leaves(p, paths) for p in pages]
    size = np.array([len(f) for f in found])
    whole = mt.judge(model, mt.Blocks(sum(found, []), paths), size)
    alone = [mt.judge(model, mt.Blocks(f, paths), np.array([len(f)])) for f in found if f]
    assert whole.tolist() == np.concatenate(alone).tolist()


def article(page):
    """The given pages' article: their heading and paragraphs."""
    inner = page[page.index("<article>") + 9:page.index("</article>")]
    parts = [" ".join(html.unescape(re.sub("</?b>", "", p).replace("<br>", " ")).split())
             for p in re.split("</?(?:h1|p)>", inner)]
    return "\n".join(p for p in parts if p)


@pytest.fixture(scope="module")
def model(spark):
    return mt.train(spark.read.parquet(f"{SF_SMALL}/pages.parquet"))


def test_given_pages(spark, model):
    pages = spark.read.parquet(f"{SF_SMALL}/pages.parquet")
    got = {r.page_id: r for r in mt.main_texts(pages, model).collect()}
    rows = pages.collect()
    assert len(got) == len(rows)
    for p in rows:
        assert (got[p.page_id].url, got[p.page_id].text) == (p.url, article(p.html))
        assert got[p.page_id].n_chars == len(article(p.html))


def test_held_out_dresses(spark, model):
    rng, right, n = np.random.default_rng(8), 0, 0
    for p in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").where("page_id >= 150").collect():
        made, label = mt._made_page(rng, article(p.html).split("\n"))
        paths = Paths()
        blocks = leaves(made, paths)
        assert len(blocks) == len(label)
        right += int((mt.judge(model, mt.Blocks(blocks, paths), np.array([len(blocks)])) == np.array(label)).sum())
        n += len(label)
    assert n > 1000 and right >= 0.97 * n


def test_odd_rows(spark, model):
    rows = [(1, "u", None, 5), (1, "u", "", 5), (None, None, "<article><h1>A title</h1><p>Some words here.</p></article>", 5),
            (None, None, "<article><h1>A title</h1><p>Some words here.</p></article>", 5), (3, "v", "<nav><li>x</nav>", 5),
            (4, "w", "<article><p>" + "many words, " * 100_000 + "</article>", 5)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text int")
    got = mt.main_texts(pages, model).collect()
    assert [(r.page_id, r.n_chars) for r in got if r.page_id == 1] == [(1, 0)] * 2
    assert [r.text for r in got if r.page_id is None] == ["A title\nSome words here."] * 2
    assert [r.text for r in got if r.page_id == 3] == [""]
    assert [r.n_chars for r in got if r.page_id == 4] == [len("many words, " * 100_000) - 1]


def test_without_labelled_blocks(spark):
    pages = spark.createDataFrame([(1, "u", "<p>a</p><p>b"), (2, "u", None)], "page_id long, url string, html string")
    assert {(r.page_id, r.text) for r in mt.main_texts(pages).collect()} == {(1, "a\nb"), (2, "")}
    assert mt.main_texts(pages.where("page_id = 9")).collect() == []
