from __future__ import annotations

import random
import re

import numpy as np
import pytest

from lectern.llm import decontamination as D

TO_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(TO_LOWER))


def brute(text, items):
    own, hit, found = words(text), set(), set()
    for item, item_text in items:
        w = words(item_text)
        k = min(10, len(w))
        for j in range(len(w) - k + 1) if w else ():
            for i in range(len(own) - k + 1):
                if own[i : i + k] == w[j : j + k]:
                    hit.update(range(i, i + k))
                    found.add(str(item))
    return len(own), sorted(hit), sorted(found)


def test_equal_to_brute_force(spark):
    rng = random.Random(6)
    word = lambda: rng.choice("abcde")
    items = [(i, " ".join(word() for _ in range(rng.choice([1, 3, 9, 10, 11, 40])))) for i in range(12)] + [(50, None), (51, "?!"), (52, "É é 5 A")]
    texts = [" ".join(word() for _ in range(rng.randrange(60))) for _ in range(40)]
    for _ in range(60):
        own = rng.choice(items[:12])[1].split()
        start = rng.randrange(len(own))
        texts.append(" ".join([word() for _ in range(rng.randrange(9))] + own[start : start + rng.randrange(1, 30)] + [word() for _ in range(5)]))
    texts += [None, "", "x É é 5 a", "a " * 300]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    benchmark = spark.createDataFrame(items, "item_id bigint, text string")
    for block in (D.BLOCK_BYTES, 0):
        for r in D.scanned(docs, benchmark, block).collect():
            hit = [w for s in r.spans for w in range(s.start, s.end)]
            assert (r.n_words, hit, r.items) == brute(r.text, items), (block, r.doc_id)


def test_winnowing_guarantee():
    rng = np.random.default_rng(1)
    for _ in range(200):
        shared = rng.integers(0, 50, 10).astype(np.uint64)
        a, b = (np.concatenate([rng.integers(0, 50, n).astype(np.uint64), shared, rng.integers(0, 50, m).astype(np.uint64)]) for n, m in rng.integers(0, 20, (2, 2)))
        x, y = D.grams(a, D.GRAM), D.grams(b, D.GRAM)
        assert set(x[D.winnowed(x)].tolist()) & set(y[D.winnowed(y)].tolist()) & set(D.grams(shared, D.GRAM).tolist())


@pytest.mark.parametrize("block", [D.BLOCK_BYTES, 0])
def test_edges(spark, clashing, empty, block, monkeypatch):
    monkeypatch.setattr(D.scanned, "__defaults__", (block,))
    none = spark.createDataFrame([], "item_id bigint, text string")
    assert D.scanned(clashing, none).where("size(spans) > 0").count() == 0
    assert D.scanned(empty, none).count() == 0
    item = spark.createDataFrame([(None, "hello WÖRLD it s 2024 licensed under the apache license version"), (9, "no id here but")], "item_id bigint, text string")
    found = {r.doc_id: r.items for r in D.scanned(clashing, item).collect()}
    assert found[None] == ["9"] and found[1] == []
    item = spark.createDataFrame([(None, "hello Wörld it s 2024 licensed under the apache license version")], "item_id bigint, text string")
    assert {r.doc_id: r.items for r in D.scanned(clashing, item).collect()}[1] == ["null"]


def test_a_large_benchmark_with_a_frequent_passage(spark):
    """Many items and documents that share one passage, against the indexed scan."""
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(3))
    common = " ".join(word() for _ in range(14))
    items = [(i, " ".join(word() for _ in range(30)) + (" " + common if i % 3 == 0 else "")) for i in range(300)] + [(1000, "just four short words")]
    texts = [" ".join(word() for _ in range(20)) + f" {common} " + word() for _ in range(60)] * 2
    texts += [" ".join(items[i][1].split()[3:20]) + " just four short words" for i in range(0, 300, 7)] + [" ".join(word() for _ in range(400)) for _ in range(20)] + [None, ""]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    benchmark = spark.createDataFrame(items, "item_id bigint, text string")
    found = [sorted((r.doc_id, r.n_words, str(r.spans), r.items) for r in D.scanned(docs, benchmark, block).collect()) for block in (0, D.BLOCK_BYTES)]
    assert found[0] == found[1] and sum(bool(x[3]) for x in found[0]) == 163
