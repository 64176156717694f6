"""The one pass from a text to its chunks against the column functions of the same names, and its time."""

from __future__ import annotations

import random
import sys
import time

import pytest
from pyspark.sql import functions as F

from lectern.functions import text as T
from lectern.functions.patterns import HEADING_PAUSE, QUOTE_PAUSE, SPACES
from lectern.operators import chunking as K

EVERY = [chr(c) for c in (*range(1, 0xD800), *range(0xE000, 0x20000), *range(0xE0000, 0xE0200), sys.maxunicode)]


def texts():
    rng = random.Random(11)
    some = ["Ala ma kota", "prof.", "Nieprof.", "12.", "5.", "A.", "ß.", "_.", "im.", "(...)", "( … )", "...", "…", "Tak!", "x?", '"', "„", "“", "”", "–", "[7]", "\x00", "\x01", "\x02", "\x1c", "\x85", "ł" * 60, "słowo " * 9, "a" * 400]
    some += [f"{HEADING_PAUSE} Ala", QUOTE_PAUSE, "Koniec cytatu.", "„" + "Długi cytat " * 5 + "”.", "“" + "b " * 40 + '",', "1 " * 200, "Żółw. Łoś? (A", "bardzodługiesłowo."]
    made = ["".join(rng.choice(some) + rng.choice(["", " ", " ", "  ", "\n", "　", ". ", "! "]) for _ in range(rng.randrange(90))) for _ in range(1500)]
    # Single letters of every kind as the word before a full stop, and between and after words.
    made += [f"A{c}b {c}. Ala{c}. {c}Ala ma kota.{c}Żaba {c}." for c in EVERY[::7]]
    return [*made, *(x * 40 for x in SPACES), "", " . ", None]


def test_the_same_chunks_as_step_by_step(spark):
    given = spark.createDataFrame(list(enumerate(texts())), "i int, t string").repartition(4)
    steps = lambda t: K.pack_chunks(K.merge_abbrev(K.sentences(t)))
    cleaned = T.annotate_quotes(T.clean_text(F.col("t")))
    rows = given.select("t", steps(cleaned).alias("raw"), steps(F.col("t")).alias("clean"), K.text_chunks(F.col("t"), raw=True).alias("raw_"), K.text_chunks(F.col("t")).alias("clean_")).collect()
    for r in rows:
        assert (r.raw_, r.clean_) == (r.raw, r.clean), r.t
    assert sum(len(r.raw or []) > 3 for r in rows) > 500


def test_rows_keep_their_chunks_when_handed_over_in_parts(spark, monkeypatch):
    monkeypatch.setattr(K, "HANDED", 50)
    given = spark.range(500, numPartitions=2).select("id", F.when(F.col("id") % 7 > 0, F.repeat(F.concat(F.lit("Ala ma kota "), F.col("id"), F.lit(". ")), (F.col("id") % 5).cast("int"))).alias("content"))
    found = {r.id: r.chunk for r in K.chunks(given, raw=True).collect()}
    assert found == {i: " ".join([f"Ala ma kota {i}."] * (i % 5)) for i in range(500) if i % 7 and i % 5}


@pytest.mark.parametrize("made", [K.chunks, K.pauses])
def test_sixteen_million_characters(spark, made):
    """Before, folds of higher-order functions took two microseconds for each character (33 and 40 s in all)."""
    given = spark.range(16, numPartitions=1).select("id", F.repeat(F.lit("Ala ma kota, a kot ma Alę. Prof. Nowak „mówi”, że nie. Zobacz nr 5. "), 15000).alias("content"))
    start = time.time()
    assert made(given).agg(F.sum(F.length("chunk"))).first()[0] > 15_000_000
    assert time.time() - start < 20


@pytest.mark.parametrize("name", ["pack_chunks", "chunk_pauses", "synthesize", "synth_params", "resume_filter", "segment_batches", "segment_plan"])
def test_texts_are_cut_once(spark, sf_dir, name):
    from lectern.plans.registry import QUERIES

    assert QUERIES[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython") == 1


def test_only_chapters_that_are_left_are_cut(spark, sf_dir):
    from lectern.plans.registry import QUERIES

    plan = QUERIES["resume_filter"](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("ArrowEvalPython") < plan.index("Join Inner")
