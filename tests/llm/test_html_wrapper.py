from __future__ import annotations

import time

import pytest

from lectern.llm import html as H


@pytest.mark.parametrize(
    ("page", "text"),
    [
        ("<article><div class='article-header'><h1>The title</h1></div><p>x</p></article>", "The title x"),
        ("<div class='entry-header'><h1>Title</h1></div><p class='notice-of-award'>won</p><div class='cookie-notice'>no</div>", "Title won"),
        ("<div class='site-header'>no</div><div id='comments-area'>no</div><div class='adBox2'>no</div><p class='advisory'>yes</p>", "yes"),
    ],
)
def test_names_of_classes(page, text):
    assert H.main_text(page, set()) == text


def test_deep_and_wide_pages(spark):
    deep = "<div>" * 1200 + "<p>text {}</p>" + "</div>" * 1200
    wide = "".join(f"<h2>{{0}} {i}</h2><p>{{0}} para {i}</p>" for i in range(20_000))
    started = time.time()
    for body in (deep, wide):
        expression, _ = H.infer([body.format(k) for k in range(3)])
        assert "#TEXT" in expression
    assert "(<h2>#TEXT</h2><p>#TEXT</p>)+" in expression
    assert time.time() - started < 60
    rows = [(k, f"http://{name}.example/{k}", body.format(k)) for name, body in (("deep", deep), ("wide", wide)) for k in range(3)]
    found = {(r.url, r.page_id): r.text for r in H.extracted(spark.createDataFrame(rows, "page_id int, url string, html string")).collect()}
    assert found["http://deep.example/1", 1] == "text 1"
    assert found["http://wide.example/2", 2].startswith("2 0 2 para 0 2 1") and found["http://wide.example/2", 2].endswith("2 para 19999")


def test_the_wrapper_finds_menus_and_template_without_any_names(spark):
    page = "<div><a href='/{0}'>menu {0}</a> <a href='/x'>other {0}</a></div><section><h1>Title {0}</h1><p>body {0} <a href='/y'>y</a></p></section><p>All rights</p>"
    rows = [(i, "http://h.example/a", page.format(i)) for i in range(4)]
    found = {r.page_id: r.text for r in H.extracted(spark.createDataFrame(rows, "page_id int, url string, html string")).collect()}
    assert found == {i: f"Title {i} body {i} y" for i in range(4)}
    # Without the wrapper menus and template stay.
    assert H.main_text(rows[1][2], set()) == "menu 1 other 1 Title 1 body 1 y All rights"


def test_expressions_of_hosts(spark):
    page = "<body><div>Ours</div>{}<ul>{}</ul></body>"
    rows = [(i, f"http://h{i % 2}.example/{i}", page.format(f"<h1>t {i}</h1>" if i % 3 else "", "".join(f"<li>{i} {k}</li>" for k in range(1 + i % 4)))) for i in range(40)]
    rows += [(99, None, "<p>x</p>"), (98, "http://one.example/", "<p>x</p>"), (97, "http://none.example/", None)]
    found = {r.host: r.expression for r in H.expressions(spark.createDataFrame(rows, "page_id int, url string, html string"), few=3).collect()}
    body = "<body><div>Ours</div>(<h1>#TEXT</h1>)?(<ul>)?"
    assert set(found) == {"h0.example", "h1.example", "one.example"}
    assert found["one.example"] == "<p>#TEXT</p>"
    for k in (0, 1):
        assert found[f"h{k}.example"].startswith("<body><div>Ours</div>(<h1>#TEXT</h1>)?") and "(<li>#TEXT</li>)+" in found[f"h{k}.example"], (found, body)


def test_edges_of_tables(spark):
    from pyspark.sql import functions as F

    rows = [(1, "http://h.example/", "<p>a</p>")] * 4 + [(2, "http://h.example/", None), (None, None, "<p>b</p>"), (3, "", ""), (4, "http://h.example/", "<p>" + "w " * 300_000 + "</p>")]
    df = spark.createDataFrame(rows, "page_id int, url string, html string").select("*", *(F.lit("x").alias(c) for c in ("text", "host", "literals", "block", "page", "linked", "n", "wrapper")))
    found = H.extracted(df)
    assert sorted(found.columns) == sorted(df.columns)
    assert sorted((str(r.page_id), len(r.text)) for r in found.collect()) == [("1", 1)] * 4 + [("2", 0), ("3", 0), ("4", 599_999), ("None", 1)]
    assert H.extracted(df.limit(0)).count() == 0 and H.expressions(df.limit(0)).count() == 0


def test_pages_of_the_tables_by_brute_force(spark, sf_dir):
    """Every page of the tables has one article: its paragraphs and headings, by plain cutting of the markup."""
    import html
    import re

    from lectern.llm.registry import QUERIES

    pages = {r.page_id: r.html for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()}
    for r in QUERIES["op9_main_text"](spark, sf_dir).collect():
        inner = re.search(r"<article>(.*?)(</article>|$)", pages[r.page_id] or "", re.S)
        blocks = re.split(r"</?(?:p|h1|br|li|ul)[^>]*>", inner[1]) if inner else []
        expected = " ".join(x for b in blocks if (x := " ".join(html.unescape(re.sub(r"<[^>]*>", "", b)).split())))
        assert r.text == expected and r.n_chars == len(expected)
