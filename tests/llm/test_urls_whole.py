from __future__ import annotations

from pyspark.sql import functions as F

from lectern.llm import urls as U


def test_branches_below_the_fifth_segment_differ(spark):
    rows = [(i, f"http://d.example/a/b/c/d/e/f/{'spam' if i % 2 else 'news'}/{i}") for i in range(200)]
    pages = spark.createDataFrame(rows, "page_id bigint, url string")
    labels = pages.select(F.col("page_id").alias("id"), F.expr("NOT contains(url, 'spam')").alias("good"))
    found = U.judged(pages, labels, []).collect()
    assert all((r.verdict == "block") == ("spam" in r.url) for r in found)
    assert {r.template for r in found} == {"/a/b/c/d/e/f/spam/#", "/a/b/c/d/e/f/news/#"}


def test_digit_segments_with_opposite_labels_stay_apart(spark):
    rows = [(i, f"http://f.example/forum{12 + i % 2}/{i}") for i in range(120)]
    pages = spark.createDataFrame(rows, "page_id bigint, url string")
    labels = pages.select(F.col("page_id").alias("id"), F.expr("NOT contains(url, 'forum12')").alias("good"))
    found = U.judged(pages, labels, []).collect()
    assert all((r.verdict == "block") == ("forum12" in r.url) for r in found)
    assert {r.template for r in found} == {"/forum12/#", "/forum13/#"}


def test_edges_of_tables(spark):
    long = "http://l.example/" + "x" * 200_000 + "/" + "/".join(map(str, range(12)))
    rows = [(1, "http://h.example/a"), (1, "http://h.example/a"), (1, "http://h.example/b"), (None, None), (2, ""), (3, long), (4, "http://h.example"), (None, "http://h.example/#/#")]
    names = ["host", "path", "template", "purity", "rule", "verdict", "shape", "n", "k", "child", "prefix", "id", "good", "rows"]
    pages = spark.createDataFrame(rows, "page_id bigint, url string").select("*", *(F.lit("y").alias(c) for c in names))
    labels = spark.createDataFrame([(1, True), (1, False), (None, True), (2, None)], "id bigint, good boolean")
    found = U.judged(pages, labels, [("block", "l.example/x")])
    assert sorted(found.columns) == sorted(pages.columns)
    got = found.collect()
    assert len(got) == len(rows) and [r.rule for r in got if r.page_id == 3] == ["l.example/x"]
    assert {(r.host, r.path, r.template) for r in got if r.url in (None, "")} == {("", "", "/")}
    assert all(r.purity is not None and r.verdict in ("allow", "block") for r in got)
