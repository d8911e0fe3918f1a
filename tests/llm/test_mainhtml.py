import re

import pytest

from postmill.llm import mainhtml

SCHEMA = "page_id long, url string, html string, text string, n_chars int"


def texts(page):
    return [text for _, text, _ in mainhtml.blocks(page)]


def test_blocks_of_broken_markup():
    assert texts("<p><b>One.<br><p>Two &amp; &lt;b&gt;&nbsp;x</p>\n three  <i>four</i></b><div>five") == [
        "One.", "Two & <b> x", "three four", "five"]
    assert texts("<script>var t='</p>';</script><style>p{}</style><!-- a <p> --><p>x<script>unclosed") == ["x"]
    assert texts("<ul><li>a<li>b<ul><li>c</ul><li>d</ul>e") == ["a", "b", "c", "d", "e"]
    assert texts('<p title="a > b" class=\'x\'>y</p></p></article>z') == ["y", "z"]
    assert texts("a < b and <3 <") == ["a < b and <3 <"] and texts("") == [] and texts("<p> \n</p>") == []
    assert texts('<p "unclosed>x</p>') == ["x"] and texts("<!DOCTYPE html>x<!-- never closed") == ["x"]


def test_paths_of_broken_markup():
    paths = {text: [tag for tag, _ in path] for path, text, _ in mainhtml.blocks(
        "<body><nav><ul><li><a>n</a></nav><article><p><b>x<p>y</article><footer>z")}
    assert paths["n"] == ["body", "nav", "ul", "li"][:4] or "nav" in paths["n"]
    assert paths["y"][:2] == ["body", "article"] and paths["z"] == ["body", "footer"]


@pytest.fixture(scope="module")
def model():
    return mainhtml.fit([])


def test_usual_layouts(model):
    page = """<html><head><title>Title of it</title></head><body><header class="top"><a href="/">Site</a></header>
    <nav><ul><li><a href="/a">a</a></li><li><a href="/b">b</a></li></ul></nav><div class="cookie-notice">We use cookies, agree.</div>
    <main><article><h1>The heading</h1><p>A first paragraph of the article, long enough.</p><p>Short.</p><ul><li>An item</li></ul>
    <blockquote>Quoted words in it.</blockquote></article></main><aside class="sidebar"><p>Other stories that you may like to read.</p></aside>
    <section class="comments"><p>I am a reader and say something long about it.</p></section><form><p>Subscribe to our letter</p></form>
    <footer>&copy; 2024 all of it reserved.</footer></body></html>"""
    assert mainhtml.main_text(page, model) == (
        "The heading\n\nA first paragraph of the article, long enough.\n\nShort.\n\nAn item\n\nQuoted words in it.")


def test_odd_rows(spark, model):
    long = "<article><h1>h</h1>" + "<p>A long paragraph with many words in it.</p>" * 20_000 + "</article>"
    rows = [(1, None, None, "", 1), (2, "u", "", "", 1), (None, "u", "<p></p>", None, None), (3, "v", long, "", 1), (3, "v", long, "", 1),
            (4, None, "<article><p>Two  words &eacute;&#233;\n here.</p></article>", "", 1)]
    out = mainhtml.extract(spark.createDataFrame(rows, SCHEMA), model).collect()
    got = {r.page_id: (r.url, r.text) for r in out}
    assert len(out) == 6 and got[1] == (None, "") and got[2] == ("u", "") and got[None] == ("u", "")
    assert got[4] == (None, "Two words éé here.") and got[3][1].count("\n\n") == 20_000
    assert mainhtml.extract(spark.createDataFrame([], SCHEMA), model).count() == 0


def test_articles_of_held_out_pages(spark):
    read = lambda name: spark.read.parquet(f"/root/testdata/sf0.01/{name}.parquet")
    sample = mainhtml.training_pages(read("pages"), read("documents"))
    trained = {page for page, _ in sample[:150]}
    model, wrong, seen = mainhtml.fit(sample[:150]), 0, 0
    for row in read("pages").collect():
        if row.html not in trained:
            article = re.search(r"<article>(.*?)</article>", row.html, re.S)[1]
            seen += 1
            wrong += mainhtml.main_text(row.html, model) != "\n\n".join(texts(article))
    assert seen >= 80 and wrong == 0


def test_main_text_without_documents(spark):
    pages = spark.createDataFrame([(1, "http://a/5", "<p>x</p>", "", 1)], SCHEMA)
    assert mainhtml.training_pages(pages, spark.createDataFrame([], "doc_id long, text string")) == []
