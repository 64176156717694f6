from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from lectern.llm import html as H
from lectern.llm import urls as U
from lectern.llm.registry import URL_RULES


@pytest.mark.parametrize(
    ("page", "text"),
    [
        ("<body><header>Hi</header><div class='post'><p>a&amp;b <b>c</b>d<br>e</p><p>f&nbsp; g</p></div><div id='comments'>x</div><aside>q</aside></body>", "a&b cd e f g"),
        ("<nav>m</nav><article><header><h1>T</h1></header><p>x</p><section class='comments'><article><p>bad</p></article></section><form>f</form><p>y<script>1<2</script>z</p></article> tail<footer>f</footer>", "T x yz"),
        ("<article><p><b>unclosed bold<br><p>next <i>it</i>.</article><footer>no</footer>", "unclosed bold next it."),
        ("<main><ul><li>a<li>b</ul><!-- <p>c</p> --><div class='ad'>d</div></main><div>e</div>", "a b"),
        ("plain &lt;text&gt; only", "plain <text> only"),
        ("<style>p{}</style><title>t</title>", ""),
        ("<p>broken <a href='x>y", "broken y"),
        ("", ""),
    ],
)
def test_main_text(page, text):
    assert H.main_text(page, set()) == text


def test_wrapper_has_slots_options_and_groups():
    pages = [f"<div><h1>Title {i}</h1>" + "".join(f"<p>{i} {k}</p>" for k in range(i + 1)) + ("<table><tr><td>x</td></tr></table>" if i == 1 else "") + "</div><div>Powered by Us</div>" for i in range(3)]
    expression, literals = H.infer(pages)
    assert "(<p>#TEXT</p>)+" in expression and "(<table>" in expression and "<h1>#TEXT</h1>" in expression
    assert ["div", "Powered by Us"] in literals
    assert H.main_text(pages[2], {tuple(x) for x in literals}) == "Title 2 2 0 2 1 2 2"


def test_extraction_of_a_table(spark):
    rows = [(i, "http://h.example/a", f"<div><p>text {i}</p></div><div>Same everywhere</div>", "x", "y") for i in range(5)]
    rows += [(9, None, None, "x", "y"), (10, "no host", "<p>only</p>", "x", "y")]
    pages = spark.createDataFrame(rows, "page_id int, url string, html string, text string, literals string")
    found = {r.page_id: r.text for r in H.extracted(pages.drop("literals")).collect()}
    assert found == {i: f"text {i}" for i in range(5)} | {9: "", 10: "only"}
    assert H.extracted(pages.limit(0).drop("literals")).count() == 0


def rule_of(host, path):
    best = None
    for what, text in URL_RULES:
        own, _, rest = text.partition("/")
        if (host == own or host.endswith("." + own)) and path.startswith("/" + rest) and (best is None or len(text) > len(best[1])):
            best = what, text
    return best


def test_parts_and_rules(spark):
    urls = ["HTTP://A.Example.COM/en/7x?q#f", "http://b.example.com/en/8", "https://example.com/en/71", "x://net/de/", "x://example.net/de/8", "x://org/es/", "x://borg/es/", "no scheme", None, "http://h", "http://h?x/y", "a://b://c/d", ""]
    df = spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "page_id bigint, url string")
    labels = spark.createDataFrame([], "id bigint, good boolean")
    for r in U.judged(df, labels, URL_RULES).collect():
        after = (r.url or "").split("://", 1)[1] if "://" in (r.url or "") else ""
        cut = min([after.index(c) for c in "/?#" if c in after] or [len(after)])
        path = after[cut:] if after[cut : cut + 1] == "/" else ""
        host, path = after[:cut].lower(), path.split("?")[0].split("#")[0]
        best = rule_of(host, path)
        assert (r.host, r.path, r.rule) == (host, path, best and best[1]), r.url
        assert r.verdict == (best[0] if best else "allow")


def test_impure_templates_are_blocked(spark):
    rows = [(i, f"http://s.example/{'spam' if i % 2 else 'news'}/{i}-title/{i}") for i in range(400)] + [(1000 + i, f"http://other.example/{chr(97 + i % 26)}{i}/x") for i in range(60)]
    pages = spark.createDataFrame(rows, "page_id bigint, url string")
    labels = pages.where("page_id % 3 = 0").select(F.col("page_id").alias("id"), F.expr("NOT contains(url, 'spam')").alias("good"))
    found = U.judged(pages, labels, []).collect()
    assert len(found) == 460
    assert all((r.verdict == "block") == ("spam" in r.url) for r in found)
    assert {r.template for r in found if "s.example" in r.host and "spam" in r.url} == {"/spam/#-title/#"}
    assert {r.template for r in found if r.host == "other.example"} == {"/*/x"}
    assert U.judged(pages.limit(0), labels, []).count() == 0
