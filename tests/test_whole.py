"""Queries that cover whole texts and all rows, held against plain Python."""

from __future__ import annotations

import json

from lectern.plans.registry import QUERIES


def rows(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet").collect()


def test_chapters_to_json_has_whole_texts(spark, sf_dir):
    documents = sorted(rows(spark, sf_dir, "documents"), key=lambda r: r.doc_id)
    for r in QUERIES["chapters_to_json"](spark, sf_dir).collect():
        assert json.loads(r.json) == {"title": f"T{r.doc_id}", "content": {d.doc_id: d.text for d in documents}[r.doc_id]}


def test_every_chapter_has_neighbours_and_a_label(spark, sf_dir):
    books = {}
    for d in sorted(rows(spark, sf_dir, "documents"), key=lambda r: r.doc_id):
        books.setdefault(f"{d.source}-{d.doc_id // 100}", []).append(d.doc_id)
    expected = [(b, i, i + 1 if i + 1 < len(ids) else None, i - 1 if i else None) for b, ids in books.items() for i in range(len(ids))]
    found = [tuple(r) for r in QUERIES["next_chapter"](spark, sf_dir).select("book_id", "chapter_idx", "next_idx", "prev_idx").collect()]
    assert sorted(found, key=str) == sorted(expected, key=str)
    for r in QUERIES["chapter_labels"](spark, sf_dir).collect():
        ids, index = books[r.book_id], r["index"]
        doc = ids[index - 1] if 0 < index <= len(ids) else 0
        assert r.label == ("Wprowadzenie" if index == 0 else f"Część {doc}" if doc % 3 else f"Rozdział {index}")



def test_text_functions_take_the_whole_column(spark, sf_dir):
    texts = {r.doc_id: r.text.rstrip() for r in rows(spark, sf_dir, "documents")}
    for r in QUERIES["ensure_terminal_punct"](spark, sf_dir).collect():
        text = texts[r.doc_id]
        assert r.value == (text if text == "" or text[-1] in ".!?…" else text + ".")
    assert all(r.value.endswith("KoniecTom21") for r in QUERIES["camel_ascii"](spark, sf_dir).collect())


def test_prompt_carries_the_whole_turn_before(spark, sf_dir):
    turns = sorted(rows(spark, sf_dir, "conversations"), key=lambda r: (r.conv_id, r.turn))
    prompts = {(r.conv_id, r.turn): r.prompt for r in QUERIES["prompt_assembly"](spark, sf_dir).collect()}
    pairs = [(a, b) for a, b in zip(turns, turns[1:]) if a.conv_id == b.conv_id and a.text and a.turn < b.turn]
    assert pairs and all(prompts[b.conv_id, b.turn].endswith("Streszczenie:\n" + a.text) for a, b in pairs)
