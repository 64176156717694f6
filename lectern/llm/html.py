"""Main text of HTML pages, with wrappers inferred from pages of the same host.

A host's wrapper is a union-free regular expression over tags. A block (path and text) that nearly all distinct pages of the
host have is literal in it, its template; every other is a slot. Counts over all pages decide that, and also which
slots hold links only, menus. Pages are then aligned one after another: runs of like siblings, or of like
groups of them, become repeated groups; what has no partner becomes optional. ``expressions`` writes the wrapper of every host.
From each page come the texts in slots, of its main part if an element marks one, else of all but menus, without parts whose
element, class or role says that they are none of the article.
"""

from __future__ import annotations

import bisect
import hashlib
import html
import json
import re
from collections import Counter
from collections.abc import Callable, Iterator
from typing import Any, NamedTuple

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import settle, small_batches
from lectern.llm.urls import parts

#: Distinct pages that a host needs for a wrapper and a literal is on, at least, and the share of the host's distinct pages that a literal is on.
LEAST, HELD = 3, 0.8
#: Share of a slot's characters in links from which it is a menu. Siblings of a repeated group, at most.
LINKED, GROUP = 0.9, 4
#: Bytes of wrappers' texts up to which they are broadcast.
BROADCAST_BYTES = 16 << 20

_token = re.compile(
    r"<!--.*?(?:-->|\Z)|<(script|style|textarea|title|noscript|template|svg|iframe|select)\b[^>]*>.*?(?:</\1\s*>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*)([^>\"']*+(?:(?:\"[^\"]*\"|'[^']*')[^>\"']*+)*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>|<[!?/][^>]*>|([^<]+|<)",
    re.S | re.I,
)
_attribute = re.compile(r"""([^\s=/>"']+)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""")
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_BLOCK = frozenset(
    "address article aside blockquote body br center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html li main menu nav ol option p pre section summary table tbody td tfoot th thead title tr ul".split()
)
#: Elements that belong to no article.
_OTHER = frozenset("head nav footer aside form button dialog menu object audio video canvas label input fieldset".split())
_ROLES = frozenset("navigation banner contentinfo complementary search alert alertdialog dialog form menu menubar toolbar".split())
#: What a class or id names, by the last of its words that isn't one of _PLACES.
_NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense sponsor sponsored promo promotion banner sidebar sidebars menu menus nav navbar navigation breadcrumb breadcrumbs footer masthead topbar header cookie cookies consent gdpr notice notices notification alert newsletter subscribe subscription signup login comment comments disqus discussion reply replies respond related recommended recommendations share sharing social widget widgets popup modal overlay pagination pager toolbar skip".split()
)
_PLACES = frozenset("area bar block body bottom box button buttons col column container content fixed form group holder icon icons inner item items left link links list main message outer panel right row section side slot text thread title top unit wrap wrapper zone".split())
#: With one of these before it, or inside the main part, a header is the article's own.
_OWN = frozenset("article blog content entry news post recipe story title".split())
_MAIN = frozenset(("article", "main"))
_HEADINGS = frozenset(("h1", "h2", "h3", "h4", "h5", "h6"))


def _named(attributes: str) -> dict[str, str]:
    return {a.lower(): html.unescape(x or y or z) for a, x, y, z in _attribute.findall(attributes)}


def _other(name: str, given: dict[str, str], inside_main: bool) -> bool:
    """Whether an element is none of the article."""
    if name in _OTHER or (name == "header" and not inside_main):
        return True
    if given.get("role", "").lower() in _ROLES or "hidden" in given or given.get("aria-hidden") == "true":
        return True
    if name in ("html", "body") or name in _HEADINGS:
        return False
    for name in f"{given.get('class', '')} {given.get('id', '')}".split():
        words = [w.lower() for w in re.split(r"[_\-]+|(?<=[a-z])(?=[A-Z])|\d+", name) if w]
        while len(words) > 1 and words[-1] in _PLACES:
            words.pop()
        if words and words[-1] in _NAMES and not (words[-1] == "header" and (inside_main or not _OWN.isdisjoint(words))):
            return True
    return False


class Leaf(NamedTuple):
    """A block of a page: the names of its open block elements, its text, whether it is none of the article, whether it
    is of the main part, the elements' serial numbers, and the share of its characters that are in links."""

    path: str
    text: str
    other: bool
    main: bool
    serials: tuple[int, ...]
    linked: float


def leaves(page: str) -> Iterator[Leaf]:
    """The page's blocks, in order."""
    stack: list[tuple[str, bool, bool]] = []
    serials: list[int] = []  # of the block elements on the stack
    held: list[str] = []
    state: tuple[str, bool, bool, tuple[int, ...]] = ("", False, False, ())
    links = serial = linked = 0

    def flush() -> Iterator[Leaf]:
        nonlocal linked
        size = sum(map(len, held))
        text = " ".join(html.unescape("".join(held)).split())
        held.clear()
        if text:
            yield Leaf(state[0], text, state[1], state[2], state[3], linked / size)
        linked = 0

    def shrink(at: int) -> None:
        nonlocal links
        gone = stack[at:]
        del stack[at:]
        links -= sum(x[0] == "a" for x in gone)
        del serials[len(serials) - sum(x[0] in _BLOCK for x in gone) :]

    for m in _token.finditer(page):
        text = m[8]
        if text is not None:
            if not held:
                # Inline elements aren't part of a block's path.
                path = "/".join(x[0] for x in stack if x[0] in _BLOCK)
                state = path, bool(stack) and stack[-1][1], bool(stack) and stack[-1][2], tuple(serials)
            held.append(text)
            linked += len(text) if links else 0
            continue
        name = (m[3] or m[6] or "").lower()
        if not name:
            continue
        closing, attributes = (m[2], m[4]) if m[3] else (m[5], m[7])
        given = _named(attributes) if "=" in attributes else {}
        before = (stack[-1][1], stack[-1][2]) if stack else (False, False)
        if closing:
            if name in _BLOCK:
                yield from flush()
            at = next((i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == name), None)
            if at is not None:
                if name not in _BLOCK and any(x[0] in _BLOCK for x in stack[at:]):
                    continue  # a stray end of an inline element closes no block
                shrink(at)
        else:
            if name in _BLOCK:
                yield from flush()
                while stack and (stack[-1][0] not in _BLOCK or stack[-1][0] == "p"):
                    shrink(len(stack) - 1)
                before = (stack[-1][1], stack[-1][2]) if stack else (False, False)
            if name in _VOID or attributes.endswith("/"):
                continue
            other = before[0] or _other(name, given, before[1])
            stack.append((name, other, before[1] or (name in _MAIN and not other)))
            links += name == "a"
            if name in _BLOCK:
                serial += 1
                serials.append(serial)
        after = (stack[-1][1], stack[-1][2]) if stack else (False, False)
        if after[0] != (before[0]) and held:
            yield from flush()
    yield from flush()


Node = dict[str, Any]
Block = tuple[str, str]


def constants(pages: list[str]) -> set[Block]:
    """The blocks that are literal in a wrapper of these distinct pages."""
    on = Counter(block for page in pages for block in {(x.path, x.text) for x in leaves(page)})
    return {block for block, n in on.items() if n >= max(LEAST, HELD * len(pages))}


def _node(name: str, text: str | None = None) -> Node:
    return {"name": name, "children": [], "text": text, "optional": False, "repeated": False}


def _key(node: Node) -> tuple[Any, ...]:
    """What partners in an alignment have in common: the name, and the text of a literal; of a group, its members' keys."""
    if node["name"] == "#":
        return "#", node["text"]
    own = node["children"]
    if not node["name"]:
        return "", *map(_key, own)
    return node["name"], own[0]["text"] if len(own) == 1 and own[0]["name"] == "#" else None


def _pairs(x: list[Any], y: list[Any]) -> list[tuple[int, int]]:
    """An alignment in order of equal keys: of those that stand once on both sides as many as can be, then, between these,
    each with the next equal one. Takes n log n time and linear memory."""
    ones = lambda z: {k: i for i, k in enumerate(z) if (c := counts[k]) == (1, 1)}
    counts: dict[Any, tuple[int, int]] = {}
    for k in x:
        a, b = counts.get(k, (0, 0))
        counts[k] = a + 1, b
    for k in y:
        a, b = counts.get(k, (0, 0))
        counts[k] = a, b + 1
    of_y = ones(y)
    # The longest rising run of places in y, for unique keys in the order of x.
    ends: list[int] = []
    runs: list[tuple[int, int, int]] = []  # (i, j, run before)
    last: list[int] = []
    for k, i in ones(x).items():
        j = of_y[k]
        at = bisect.bisect_left(ends, j)
        runs.append((i, j, last[at - 1] if at else -1))
        if at == len(ends):
            ends.append(j)
            last.append(len(runs) - 1)
        else:
            ends[at], last[at] = j, len(runs) - 1
    anchors = []
    r = last[-1] if last else -1
    while r >= 0:
        anchors.append(runs[r][:2])
        r = runs[r][2]
    places: dict[Any, list[int]] = {}
    for j, k in enumerate(y):
        places.setdefault(k, []).append(j)
    out, i0, j0 = [], 0, 0
    for i1, j1 in [*anchors[::-1], (len(x), len(y))]:
        for i in range(i0, i1):
            at = places.get(x[i], [])
            n = bisect.bisect_left(at, j0)
            if n < len(at) and at[n] < j1:
                out.append((i, at[n]))
                j0 = at[n] + 1
        if i1 < len(x):
            out.append((i1, j1))
        i0, j0 = i1 + 1, j1 + 1
    return out


def aligned(wrapper: Node, sample: Node) -> Node:
    """The wrapper, changed in place so that it takes the sample too.

    Children are aligned in order by name and literal text. One without a partner becomes optional.
    """
    work = [(wrapper, sample)]
    while work:
        to, of = work.pop()
        to["optional"] |= of["optional"]
        to["repeated"] |= of["repeated"]
        a, b = to["children"], of["children"]
        children, i, j = [], 0, 0
        for m, n in [*_pairs([_key(c) for c in a], [_key(c) for c in b]), (len(a), len(b))]:
            for alone in (*a[i:m], *b[j:n]):
                alone["optional"] = True
                children.append(alone)
            if m < len(a):
                children.append(a[m])
                work.append((a[m], b[n]))
            i, j = m + 1, n + 1
        to["children"] = children
    return wrapper


def _folded(children: list[Node]) -> list[Node]:
    """Runs of like siblings, and of like groups of up to GROUP siblings, as one repeated node each."""
    for size in range(1, GROUP + 1):
        out: list[Node] = []
        keys: list[Any] = []
        i = 0
        while i < len(children):
            unit = [_key(c) for c in children[i : i + size]]
            n = 1
            while len(unit) == size and [_key(c) for c in children[i + n * size : i + (n + 1) * size]] == unit:
                n += 1
            # A literal isn't repeated with itself, and what is repeated already isn't a group's only member.
            if n == 1 or all(k[0] == "#" and k[1] is not None for k in unit):
                out.append(children[i])
                i += 1
                continue
            one = children[i] if size == 1 else _node("") | {"children": children[i : i + size]}
            for m in range(1, n):
                other = children[i + m * size : i + (m + 1) * size]
                aligned(one, other[0] if size == 1 else _node("") | {"children": other})
            one["repeated"] = True
            out.append(one)
            i += n * size
        children = out
    return children


def tree(page: str, is_literal: Callable[[str, str], bool]) -> Node:
    """The page's blocks as a tree of its block elements, repeats folded."""
    root = _node("")
    made = [root]
    by_serial: dict[int, Node] = {}
    for x in leaves(page):
        node = root
        for name, serial in zip(x.path.split("/") if x.path else [], x.serials, strict=True):
            if serial not in by_serial:
                by_serial[serial] = _node(name)
                node["children"].append(by_serial[serial])
                made.append(by_serial[serial])
            node = by_serial[serial]
        node["children"].append(_node("#", x.text if is_literal(x.path, x.text) else None))
    for node in reversed(made):  # children before parents
        node["children"] = _folded(node["children"])
    return root


def expression(root: Node) -> str:
    """The wrapper as a union-free regular expression over tags."""
    out: list[str] = []
    work: list[Node | str] = [root]
    while work:
        node = work.pop()
        if isinstance(node, str):
            out.append(node)
            continue
        sign = "*" if node["optional"] and node["repeated"] else "+" if node["repeated"] else "?" if node["optional"] else ""
        if sign:
            out.append("(")
            work.append(f"){sign}")
        if node["name"] == "#":
            out.append(node["text"] if node["text"] is not None else "#TEXT")
            continue
        if node["name"]:
            out.append(f"<{node['name']}>")
            work.append(f"</{node['name']}>")
        work.extend(reversed(node["children"]))
    return "".join(out)


def packed(root: Node) -> str:
    """A wrapper as flat JSON: for each node its parent's number, name, text, whether optional, repeated."""
    rows: list[list[Any]] = []
    work = [(-1, root)]
    while work:
        parent, node = work.pop()
        rows.append([parent, node["name"], node["text"], int(node["optional"]), int(node["repeated"])])
        work.extend((len(rows) - 1, c) for c in reversed(node["children"]))
    return json.dumps(rows, ensure_ascii=False)


def unpacked(text: str) -> Node:
    nodes: list[Node] = []
    for parent, name, own, optional, repeated in json.loads(text):
        nodes.append({"name": name, "children": [], "text": own, "optional": bool(optional), "repeated": bool(repeated)})
        if parent >= 0:
            nodes[parent]["children"].append(nodes[-1])
    return nodes[0]


def infer(pages: list[str]) -> tuple[str, list[list[str]]]:
    """A wrapper for all distinct pages, aligned one after another: (expression, [path, text] of its literals)."""
    own = list(dict.fromkeys(pages))
    literals = constants(own)
    trees = [tree(page, lambda path, text: (path, text) in literals) for page in own]
    for sample in trees[1:]:
        aligned(trees[0], sample)
    return expression(trees[0]), [list(block) for block in sorted(literals)]


def _chosen(page: str, is_literal: Callable[[str, str], bool], is_menu: Callable[[str], bool] = lambda path: False) -> str:
    """The texts in the wrapper's slots: those of the main part if an element marks one, else of the whole page without menus."""
    own = [x for x in leaves(page) if not x.other]
    marked = any(x.main for x in own)
    return " ".join(x.text for x in own if (x.main if marked else not is_menu(x.path)) and not is_literal(x.path, x.text))


def main_text(page: str, template: set[Block]) -> str:
    return _chosen(page, lambda path, text: (path, text) in template)


def mark(path: str, text: str | None = None) -> int:
    """A 64-bit hash of a block, or of a slot, which has no text of its own."""
    if text is None:
        return int.from_bytes(hashlib.blake2b(path.encode(), digest_size=8, person=b"slot").digest(), "big", signed=True)
    return int.from_bytes(hashlib.blake2b(f"{path}\0{text}".encode(), digest_size=8).digest(), "big", signed=True)


def _near(of: DataFrame, size: Column) -> DataFrame:
    """``of`` to be broadcast if it is small; else adaptive execution splits what very large hosts join."""
    total = of.agg(F.coalesce(F.sum(size), F.lit(0))).first()[0]
    return F.broadcast(of) if total <= BROADCAST_BYTES else of


def wrappers(pages: DataFrame) -> DataFrame:
    """(host, literals) for every host with any: the marks of literal blocks and of menus, joined by commas, decided from all its distinct pages.

    A menu is a slot (path) outside the main part that a host's pages fill with links: with LINKED of its characters or more in links, on
    LEAST distinct pages. Copies of a page count once. Pages without a host have no wrapper. What is counted are marks,
    so no texts are dealt out.
    """
    small_batches(pages.sparkSession)

    @F.arrow_udf("array<struct<block:bigint,linked:double>>")
    def marks_of(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        kind = pa.list_(pa.struct([("block", pa.int64()), ("linked", pa.float64())]))
        for htmls in batches:
            out = []
            for page in htmls:
                blocks: set[int] = set()
                slots: dict[str, tuple[float, int]] = {}
                for x in leaves(page.as_py()):
                    if not x.other:
                        blocks.add(mark(x.path, x.text))
                        if not x.main:
                            a, b = slots.get(x.path, (0.0, 0))
                            slots[x.path] = a + x.linked * len(x.text), b + len(x.text)
                out.append([{"block": b, "linked": None} for b in blocks] + [{"block": mark(path), "linked": a / b} for path, (a, b) in slots.items()])
            yield pa.array(out, kind)

    host, _ = parts(F.col("url"))
    own = pages.where("html IS NOT NULL").select(host.alias("host"), F.xxhash64("html").alias("page"), "html").where("host <> ''")
    sizes = settle(own.groupBy("host").agg(F.count_distinct("page").alias("pages")).where(F.col("pages") >= LEAST), "hosts")
    blocks = own.select("host", "page", F.inline(marks_of("html")))
    counts = blocks.groupBy("host", "block").agg(F.count_distinct("page").alias("n"), F.avg("linked").alias("linked")).where(F.col("n") >= LEAST)
    held = counts.join(_near(sizes, F.octet_length("host") + 32), "host").where(F.when(F.col("linked").isNull(), F.col("n") >= HELD * F.col("pages")).otherwise(F.col("linked") >= LINKED))
    return held.groupBy("host").agg(F.array_join(F.sort_array(F.collect_list(F.col("block"))).cast("array<string>"), ",").alias("literals"))


def _marks(key: str | None, known: dict[str, frozenset[int]]) -> frozenset[int]:
    key = key or ""
    if key not in known:
        if len(known) > 1000:
            known.clear()
        known[key] = frozenset(map(int, key.split(","))) if key else frozenset()
    return known[key]


def expressions(pages: DataFrame, few: int = 32) -> DataFrame:
    """(host, expression) for every host: its wrapper, from all its pages.

    Pages become folded trees, of which equal ones of a host are one. They are aligned ``few`` at a time, on average, then the
    results again, until there is one for each host; so no task has all trees of a large host.
    """
    small_batches(pages.sparkSession)

    @F.arrow_udf("string")
    def tree_of(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        known: dict[str, frozenset[int]] = {}
        for htmls, literals in batches:
            out = []
            for page, own in zip(htmls, literals, strict=True):
                template = _marks(own.as_py(), known)
                out.append(packed(tree(page.as_py(), lambda path, text: mark(path, text) in template)))  # noqa: B023
            yield pa.array(out, pa.string())

    def merged(group: pd.DataFrame) -> pd.DataFrame:
        first, *others = map(unpacked, sorted(group["wrapper"]))
        for other in others:
            aligned(first, other)
        return pd.DataFrame([(group["host"].iloc[0], packed(first))], columns=["host", "wrapper"])

    @F.arrow_udf("string")
    def written(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for wrappers_ in batches:
            yield pa.array([expression(unpacked(w.as_py())) for w in wrappers_], pa.string())

    host, _ = parts(F.col("url"))
    of = settle(wrappers(pages), "wrappers")
    own = pages.where("html IS NOT NULL").select(host.alias("host"), "html").where("host <> ''")
    trees = settle(own.join(_near(of, F.octet_length("literals") + F.octet_length("host") + 32), "host", "left").select("host", tree_of("html", "literals").alias("wrapper")).distinct(), "trees")
    while True:
        sizes = trees.groupBy("host").agg(F.count("*").alias("n"))
        if (sizes.agg(F.max("n")).first()[0] or 0) <= 1:
            return trees.select("host", written("wrapper").alias("expression"))
        dealt = trees.join(_near(sizes, F.octet_length("host") + 32), "host").withColumn("part", F.pmod(F.xxhash64("wrapper"), F.ceil(F.col("n") / few)))
        trees = settle(dealt.groupBy("host", "part").applyInPandas(merged, "host string, wrapper string"), "trees")


def extracted(pages: DataFrame) -> DataFrame:
    """``pages`` with text: the main text, empty if there is none (also for null html); other columns stay.

    An existing column ``text`` is replaced. Rows that repeat, in whole or in page_id, are extracted each; ties have no part
    in it, as all pages of a host decide. Very deep, wide or long pages are taken whole, in time and memory linear in their size
    but for the names of open elements, which every block of a page has.
    """

    small_batches(pages.sparkSession)

    @F.arrow_udf("string")
    def text_of(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        known: dict[str, frozenset[int]] = {}
        for htmls, literals in batches:
            out = []
            for page, own in zip(htmls, literals, strict=True):
                template = _marks(own.as_py(), known)
                if template:
                    out.append(_chosen(page.as_py() or "", lambda path, text: mark(path, text) in template, lambda path: mark(path) in template))  # noqa: B023
                else:
                    out.append(_chosen(page.as_py() or "", lambda path, text: False))
            yield pa.array(out, pa.string())

    names = pages.drop("text").columns
    host, _ = parts(F.col("url"))
    of = settle(wrappers(pages), "wrappers").select(F.col("host").alias("__host"), F.col("literals").alias("__literals"))
    of = _near(of, F.octet_length("__literals") + F.octet_length("__host") + 32)
    return pages.withColumn("__host", host).join(of, "__host", "left").select(*names, text_of("html", "__literals").alias("text"))
