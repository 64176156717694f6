from __future__ import annotations

import random
import re
from collections import defaultdict

from lectern.llm import licenses, quality

WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
TO_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def base_scan(text):
    words = WORDS.findall((text or "").translate(TO_LOWER))
    places, labels = [], set()
    for phrase, label in licenses.PHRASES.items():
        own = phrase.split()
        found = [i for i in range(len(words)) if words[i : i + len(own)] == own]
        places += found
        labels |= {label} if found else set()
    return len(words), len(places), min(places, default=None), max(places, default=None), sorted(labels)


def test_licences(clashing):
    for r in licenses.scanned(clashing).collect():
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == base_scan(r.text)
        assert set(r.base_labels) <= set(r.labels) and 0 <= r.score <= 1 and r.rule == "x"
        if r.doc_id == 1:
            assert r.labels == ["apache", "apache-2.0"] and r.spans[0].first == 5 and r.score == 1.0


def test_key_phrase_is_mandatory(spark):
    text = "it under the terms of the gnu lesser general public licence as published by the free software foundation"
    good = text.replace("licence", "license")
    rows = licenses.scanned(spark.createDataFrame([(1, text), (2, f"x {good} y {good}")], "doc_id int, text string")).orderBy("doc_id").collect()
    assert rows[0].labels == [] and rows[0].score == 0
    assert rows[1].labels == ["lgpl"] and [s.first for s in rows[1].spans] == [1, 20]


def test_licences_empty(empty):
    assert licenses.scanned(empty).count() == 0


def statistics(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    at = defaultdict(list)
    for i in range(len(words) - 4):
        at[tuple(words[i : i + 5])].append(i)
    repeated = {i + k for places in at.values() if len(places) > 1 for i in places for k in range(5)}
    lines, seen, again = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)], set(), 0
    for line in lines:
        again += line in seen
        seen.add(line)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), again, len(repeated)


def test_statistics(spark, clashing):
    random.seed(5)
    texts = [" ".join(random.choice("ab") for _ in range(n)) for n in (3, 4, 5, 6, 9, 30, 200)] + ["x\nx\n\n \nx y\nx", "# a * b"]
    extra = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    for df in (clashing.select("doc_id", "text"), extra):
        for r in quality.with_statistics(df).collect():
            assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == statistics(r.text), r.text[:80] if r.text else r.text


def test_learning_recovers_a_rule():
    random.seed(1)
    rows = []
    for _ in range(900):
        row = {f: random.random() for f in quality.FEATURES}
        rows.append((row, row["symbol_share"] > 0.8 or (row["upper_share"] > 0.7 and row["digit_share"] <= 0.3)))
    rules = quality.learn(rows)
    wrong = sum(any(quality.covers(r, row) for r in rules) != bad for row, bad in rows)
    assert rules and wrong < 30
    assert quality.learn([]) == [] and quality.learn([(rows[0][0], True)]) == []


def test_verdicts_and_filters(spark, clashing, empty):
    rule = (quality.Condition("symbol_share", True, 0.05),)
    found = {r.doc_id: r for r in quality.judged(clashing, [rule]).collect()}
    assert found[7].rule.startswith("symbol_share > 0.05") and not found[7].kept
    assert found[2].base_failed and found[3].base_failed and found[4].base_failed
    kept = quality.judged(clashing, [rule]).where("kept").select("doc_id")
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(str(k) for k, r in found.items() if r.kept for _ in range(2 if k == 1 else 1))
    assert quality.judged(empty, []).count() == 0
    labels = spark.createDataFrame([(1, None, None), (None, 1, 0)], "doc_id bigint, quality int, toxic int")
    assert quality.fit(clashing, labels) == []
