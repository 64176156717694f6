from __future__ import annotations

import random
from collections import Counter

import numpy as np
import pytest

from lectern.llm import neardup as N


def links_of(texts):
    """Classes by comparing all pairs."""
    keys = sorted(set(texts))
    root = {k: k for k in keys}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(keys):
        for b in keys[:i]:
            if N.overlap(a, b) >= N.SIMILARITY:
                root[find(a)] = find(b)
    return {k: find(k) for k in keys}


def corpus(rng):
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(4))
    rows = []
    for g in range(12):
        base = [word() for _ in range(rng.choice([6, 30, 120, 400]))]
        for _ in range(rng.choice([1, 2, 9])):
            own = list(base)
            for _ in range(rng.randrange(1 + len(base) // 40)):
                own[rng.randrange(len(own))] = word()
            rows.append(" ".join(own))
        rows.append(" ".join(base[: len(base) // 2] + [word() for _ in range(len(base) // 2)]))
    # A large group of near copies around the threshold.
    base = [word() for _ in range(150)]
    for _ in range(60):
        own = list(base)
        for _ in range(rng.randrange(5)):
            own[rng.randrange(len(own))] = word()
        rows.append(" ".join(own))
    return rows + rows[:5] + ["a b a b a b a b", "a b a b a b a b a b", "one two", "one two", "One  TWO!"]


def test_classes_equal_brute_force(spark):
    texts = corpus(random.Random(4))
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id bigint, text string").repartition(5)
    found = {r.doc_id: r.class_id for r in N.grouped(docs).collect()}
    expected = links_of(texts)
    first: dict[str, int] = {}
    for i, t in enumerate(texts):
        first.setdefault(expected[t], i)
    assert found == {i: first[expected[t]] for i, t in enumerate(texts)}
    kept = N.unique(docs).collect()
    assert sorted(r.doc_id for r in kept) == sorted(set(found.values()))


def test_blocks_of_a_band_are_compared_whole(spark, monkeypatch):
    monkeypatch.setattr(N, "BLOCK", 4)
    monkeypatch.setattr(N, "FEW_LINKS", 0)
    texts = corpus(random.Random(9))
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id bigint, text string")
    classes = {}
    for r in N.grouped(docs).collect():
        classes.setdefault(r.class_id, set()).add(texts[r.doc_id])
    expected = links_of(texts)
    assert sorted(map(sorted, classes.values())) == sorted(sorted(k for k in expected if expected[k] == v) for v in set(expected.values()))


def test_signatures_estimate_weighted_jaccard():
    rng = np.random.default_rng(0)
    for weights in ((1, 1), (3, 5), (40, 7)):
        shared, own_a, own_b = (rng.integers(0, 2**63, n).astype(np.uint64) for n in (200, 60, 90))
        a = np.concatenate([np.repeat(shared, weights[0]), own_a])
        b = np.concatenate([np.repeat(shared, weights[1]), own_b])
        x, y = Counter(a.tolist()), Counter(b.tolist())
        true = (x & y).total() / (x | y).total()
        s = N.signatures([a, b, np.zeros(0, np.uint64)], 2048)
        assert abs((s[0] == s[1]).mean() - true) < 4 * (true * (1 - true) / 2048) ** 0.5 + 1e-9
        assert np.isinf(s[2]).all() and np.isfinite(s[:2]).all()


def test_edges(clashing, empty):
    rows = N.grouped(clashing.drop("class_id")).collect()
    by_id = {}
    for r in rows:
        by_id.setdefault(r.doc_id, []).append(r.class_id)
    assert by_id == {1: [1, 1], 2: [2], 3: [3], None: [None], 4: [4], 8: [4], 5: [5], 6: [6], 7: [7]}
    assert N.grouped(empty).count() == 0
    kept = N.unique(clashing)
    assert kept.columns == clashing.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(map(str, [1, 2, 3, None, 4, 5, 6, 7]))


@pytest.mark.parametrize("few", [0, N.FEW_LINKS])
def test_long_chains_are_one_component(spark, monkeypatch, few):
    monkeypatch.setattr(N, "FEW_LINKS", few)
    n = 300
    order = [(k * 7919) % n for k in range(n)]
    links = spark.createDataFrame([(order[k], order[k + 1]) for k in range(n - 1)] + [(1000, 1001), (1002, 1002)], "a bigint, b bigint")
    found = {r.id: r.root for r in N.components(links).collect()}
    assert {found[k] for k in range(n)} == {0} and found[1001] == 1000 and 1002 not in found
