from __future__ import annotations

from lectern.llm import html as H


def texts(spark, rows):
    pages = spark.createDataFrame([(i, u, h) for i, (u, h) in enumerate(rows)], "page_id int, url string, html string")
    return {r.page_id: r.text for r in H.extracted(pages).collect()}


def test_every_distinct_page_of_a_host_decides(spark):
    body = "<div><p>text {}</p></div><div>Same everywhere</div>"
    # For any text there are more copies of it than of all others: its hash is the smallest in one of these hosts.
    hosts = [[f"page {k}" for k in range(9)] + [f"page {many}"] * 9 for many in range(9)]
    rows = [(f"http://h{n}.example/a", body.format(t)) for n, own in enumerate(hosts) for t in own]
    assert texts(spark, rows) == {i: h[len("<div><p>") : h.index("</p>")] for i, (_, h) in enumerate(rows)}


def test_what_a_few_pages_share_is_no_template(spark):
    rows = [("http://h.example/a", f"<p>common</p><div>only {i}</div>") for i in range(6)]
    rows += [("http://h.example/b", f"<div>other {i}</div>") for i in range(40)]
    found = texts(spark, rows)
    assert all(found[i] == f"common only {i}" for i in range(6))


def test_pages_without_a_host_have_no_template(spark):
    found = texts(spark, [(None, f"<p>same</p><div>{i}</div>") for i in range(5)])
    assert found == {i: f"same {i}" for i in range(5)}


def test_template_inside_the_article_goes(spark):
    rows = [("http://h.example/a", f"<article><p>text {i}</p><div class='x1'>Buy now</div></article><div>tail {i}</div>") for i in range(5)]
    assert texts(spark, rows) == {i: f"text {i}" for i in range(5)}
    assert H.main_text("<main><p>a</p><p>b</p></main><p>c</p>", {("main/p", "a"), ("main/p", "b")}) == ""


def test_constant_siblings_are_literals(spark):
    pages = [f"<body><p>Accept cookies</p><p>article {i}</p>{'<p>more</p>' * (i % 2)}<p>Copyright</p></body>" for i in range(4)]
    expression, literals = H.infer(pages)
    assert expression == "<body><p>Accept cookies</p>(<p>#TEXT</p>)+<p>Copyright</p></body>"
    assert literals == [["body/p", "Accept cookies"], ["body/p", "Copyright"]]
    assert texts(spark, [("http://h.example/a", p) for p in pages]) == {i: f"article {i}" + " more" * (i % 2) for i in range(4)}
