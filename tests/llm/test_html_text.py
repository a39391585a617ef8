import html
import itertools
import re
import time

import numpy as np

from maintspark.llm import html_text as H
from maintspark.llm.common import read


def article_of(page):
    """The text between the article tags of the test tables' pages."""
    inner = re.search(r"<article>(.*)</article>", page, re.DOTALL)[1]
    parts = [" ".join(html.unescape(re.sub(r"</?b>", "", s).replace("<br>", " ")).split()) for s in re.split(r"</?(?:p|h1)>", inner)]
    return "\n\n".join(s for s in parts if s)


def test_pages_equal_their_articles(spark):
    pages = read(spark, "/root/testdata/sf0.01", "pages")
    texts = {r.page_id: r.html for r in pages.collect()}
    rows = H.op3_html_text(pages).collect()
    assert len(rows) == len(texts)
    right = 0
    for r in rows:
        assert r.n_chars == len(r.text)
        right += r.text == article_of(texts[r.page_id])
    assert right >= 0.99 * len(rows)


def test_other_layouts():
    model = H.default_model()
    page = """<html><body><header><h1>Site name</h1><nav><ul><li><a href=/>Home</a></li></ul></nav></header>
      <div class="cookie-banner"><p>We use cookies. Accept?</p></div><main><article><h1>The &lt;title&gt;</h1><p>First   para&shy;graph,
      with a <a href="x">link</a> in it. And more.<p>Second &amp; last one of these.<div class="ad">Buy now, it is cheap.</div></article></main>
      <aside><h3>Related</h3><ul><li><a href=/b>Another story</a></li></ul></aside><form><label>Mail</label><button>Send</button></form>
      <section class="comments"><div class="comment"><p>I don't agree at all.</p></div></section><footer><p>&copy; 2020 Site</p></footer></body></html>"""
    assert H.main_text(page, model) == "The <title>\n\nFirst para\xadgraph, with a link in it. And more.\n\nSecond & last one of these."


def test_held_out_accuracy():
    model = H.default_model()
    got = [(a, b) for rows, labels in H._examples(H.labelled_pages(120, seed=77)) for a, b in zip(model.decode(rows), labels)]
    assert np.mean([a == b for a, b in got]) > 0.98


def test_viterbi_equals_enumeration():
    rng = np.random.default_rng(8)
    model = H.ChainModel()
    model.emit, model.move, model.first = rng.normal(size=(H.WIDTH, 2)), rng.normal(size=(2, 2)), rng.normal(size=2)
    for n in range(1, 8):
        rows = [rng.integers(0, H.WIDTH, 3).tolist() for _ in range(n)]
        emit = [model.emit[r].sum(0) for r in rows]
        score = lambda ys: model.first[ys[0]] + sum(e[y] for e, y in zip(emit, ys)) + sum(model.move[a, b] for a, b in zip(ys, ys[1:]))
        assert tuple(model.decode(rows)) == max(itertools.product((0, 1), repeat=n), key=score)


def test_blocks_of_broken_markup():
    texts = lambda page: [b.text for b in H.blocks(page)]
    assert texts(None) == texts("") == texts("<p></p><!-- never closed <p>x</p>") == []
    assert texts("plain text only") == ["plain text only"]
    assert texts("<p>a<b>b</p>c</b>d<p>e<br>f&nbsp;g") == ["ab", "cd", "e f g"]
    assert texts("<script>var a='</p><p>x';</script><p>y</p><style>z") == ["y"]
    assert texts("<ul><li>a<li>b<ul><li>c</ul><li>d</ul>") == ["a", "b", "c", "d"]
    assert texts('<p title="a>b">5 < 6 &amp; 7 > 3</p></div></p>') == ["5 < 6 & 7 > 3"]
    assert len(texts("<div>" * 3000 + "x")) == 1


def test_hostile_markup_takes_time_with_its_length():
    for part in ("<a ", '<p x="', "<head>", "<div>x", "<p '\">x", "<!", "<![CDATA[", "<script>", "<b><i>", "<b><div>x</b>", "<li>x", "</div>", "<a<", "&lt", "<head >x<"):
        page = part * (1_000_000 // len(part))
        began = time.time()
        H.blocks(page)
        assert time.time() - began < 4, part
    assert sum(len(b.text) for b in H.blocks("<div>x" * 100_000)) == 100_000
    assert [b.text for b in H.blocks("a <b c <p x='> d <!-- e > f --> g <h ")] == ["a d g <h"]


def test_hard_rows(spark):
    rows = [(1, None, None), (2, "u", ""), (3, "u", "x"), (3, "u", "x"), (4, "u", "<article><p>" + "word " * 100_000 + "</article>")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "'t' text", "1 n_chars")
    got = sorted(((r.page_id, r.n_chars) for r in H.op3_html_text(pages).collect()))
    assert [g[0] for g in got] == [1, 2, 3, 3, 4] and got[0][1] == got[1][1] == 0 and got[4][1] == 499_999
    assert H.op3_html_text(pages.where("false")).collect() == []
