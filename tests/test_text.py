"""Quirks that the derived tables don't bring about."""

from __future__ import annotations

import random
import re

import pytest
from pyspark.sql import functions as F

from lectern.functions import names as N
from lectern.functions import text as T
from lectern.functions.ordinals import ordinal_word
from lectern.functions.patterns import ABBREVIATIONS
from lectern.operators import chapters as C
from lectern.operators import chunking as K


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


@pytest.mark.parametrize(
    ("n", "gender", "word"),
    [(1, "m", "pierwszy"), (2, "f", "druga"), (3, "f", "trzecia"), (3, "n", "trzecie"), (21, "m", "dwudziesty pierwszy"), (100, "m", "setny"), (102, "f", "sto druga"), (999, "n", "dziewięćset dziewięćdziesiąte dziewiąte"), (0, "m", None), (1000, "m", None), (5, "x", "piąty")],
)
def test_ordinals(n, gender, word):
    assert ordinal_word(n, gender) == word


def test_clean_text(spark):
    assert value(spark, T.clean_text(F.lit("  a \n b\x07 (...) c... “q” ( … )"))) == "a b  pominięto fragment  c… “q”  pominięto fragment"


def test_numbers_after_keywords(spark):
    assert value(spark, T.numbers_to_ordinals(F.lit("ROZDZIAŁ 5, pieśń 2, strona 1001, część  12; stom 4"))) == "ROZDZIAŁ piąty, pieśń drugi, strona 1001, część dwunasta; stom 4"


def test_quotes(spark):
    long = "x" * 50
    assert value(spark, T.annotate_quotes(F.lit(f"„{long}”. A „{'y' * 49}” B"))) == f" [PAUZA_CYTAT] Cytat: {long} [PAUZA_CYTAT] Koniec cytatu. [PAUZA_CYTAT] A „{'y' * 49}” B"


def test_substring_keywords_are_reproduced(spark):
    long = F.lit("a" * 500)
    assert value(spark, C.should_skip(F.lit("Discovery"), long, F.lit("x"))) is True
    assert value(spark, C.should_skip(F.lit("Preface"), long, F.lit("x"))) is False
    assert value(spark, C.likely_chapter(F.lit("Introduction"), F.lit("short"))) is True


def test_heading(spark):
    got = value(spark, C.separate_heading(F.lit("Rozdział 6 TYTUŁ WIELKI W isława szła.")))
    assert (got.heading, got.body) == ("Rozdział szósty TYTUŁ WIELKI", "W isława szła.")
    only = value(spark, C.separate_heading(F.lit("Rozdział 6 TYTUŁ")))
    assert (only.heading, only.body) == (None, "Rozdział 6 TYTUŁ")


def test_sentences_and_abbreviations(spark):
    text = 'Był prof. Nowak. W roku 5. Maj „A. B" i C. D. End'
    assert value(spark, K.merge_abbrev(K.sentences(F.lit(text)))) == ["Był prof. Nowak.", 'W roku 5. Maj „A. B" i C. D. End']
    assert value(spark, K.merge_abbrev(K.sentences(F.lit("")))) == []


def test_chunks_keep_all_sentences_in_order(spark):
    parts = [f"Sentence number {i} of them." for i in range(60)] + ["[PAUZA] mark alone here", "w " * 200 + "long."]
    got = value(spark, K.pack_chunks(F.array(*map(F.lit, parts))))
    assert " ".join(got).replace("  ", " ") == " ".join(parts).replace("  ", " ")
    assert all(len(c) <= 300 or c in parts for c in got) and "[PAUZA] mark alone here" in got


def test_names(spark):
    assert value(spark, N.camel_ascii(F.lit("Noc nad Wisłą, łódź ß"))) == "NocNadWislaLodzSs"
    assert value(spark, N.sanitize_filename(F.lit('a/b: "c"  d?' + "x" * 60))) == ("ab_c_d" + "x" * 60)[:50]


def test_synthesis_splits_and_isolates_failures(spark):
    from lectern.operators.synthesis import TooLong, halves, synthesize

    assert halves("aa bb cc dd", lambda x: len(x) <= 8) == ["aa", "bb cc dd"]
    assert halves("abcdef", lambda x: len(x) <= 3) == ["abcdef"]

    class Picky:
        def load(self):
            pass

        def speak(self, text):
            if text == "bad!":
                raise ValueError("no")
            if len(text) > 24:
                raise TooLong("400 tokens")
            return text.upper(), len(text)

    texts = ["ok", "bad!", "", "twelve words and more are too long for it", "oneverylongwordwithoutanyspace"]
    df = synthesize(spark.createDataFrame([(t,) for t in texts], "chunk string"), Picky())
    found = {r.chunk: (r.audio_key, r.duration_ms, r.error) for r in df.collect()}
    assert found == {
        "ok": ("OK.", 3, None),
        "bad!": (None, 0, "no"),
        "": ("", 0, None),
        "twelve words and more are too long for it": ("TWELVE WORDS AND+MORE ARE+TOO LONG FOR IT.", 40, None),
        "oneverylongwordwithoutanyspace": (None, 0, "400 tokens"),
    }


def test_exact_removal_of_nested_elements(spark):
    from lectern.operators.chapters import html_strip_exact

    pages = ["a<div class='photo-credit'>x<b>y</b><div>z</div></div>b", "<figure><p>x</p><figure>y</figure>z</figure>&amp;c<br/>d", "<p id='podpis1'>no<p>end", None, ""]
    df = spark.createDataFrame([(i, p) for i, p in enumerate(pages)], "i int, html string")
    assert [r.v for r in df.select("i", html_strip_exact(df.html).alias("v")).orderBy("i").collect()] == ["a b", "&c d", "", None, ""]


def test_folds_over_many_runs_are_those_of_a_loop(spark):
    """Sentences of more than one run of the folds, runs of numbers, abbreviations at the ends of runs, none at all, null."""
    rng = random.Random(7)
    some = ["12.", "345.", "5.", "Zob. prof.", "im.", "A.", "Ala ma kota.", "Słowo " * 70 + "koniec.", "Koniec [PAUZA]", "[PAUZA_CYTAT] x", "w " * 160, "Tak.", "."]
    given = [[rng.choice(some) for _ in range(n)] for n in (0, 1, 2, K.BLOCK - 1, K.BLOCK, K.BLOCK + 1, 3 * K.BLOCK + 5)] + [None, ["12."] * 5, ["im."] * (2 * K.BLOCK)]

    def ends(s):
        word = re.search(r"(\w+)\.$", s)
        return bool(re.search(r"^[0-9]+\.$", s)) or word is not None and (word[1].lower() in ABBREVIATIONS or len(word[1]) == 1 and word[1].upper() == word[1])

    def merged(parts):
        out = []
        for s in parts:
            if out and ends(out[-1].rstrip()):
                out[-1] += " " + s
            else:
                out.append(s)
        return out

    def packed(parts):
        out, cur = [], []
        for s in parts:
            mark, text = "[PAUZA]" in s or "[PAUZA_CYTAT]" in s, " ".join(cur)
            if cur and (mark or len(text) + len(s) + 1 > 300 or len(text.split()) + len(s.split()) > 150):
                out.append(text)
                cur = []
            if mark:
                out.append(s)
            else:
                cur.append(s)
        return [c for c in [*out, " ".join(cur)] if len(c) >= 10]

    rows = spark.createDataFrame([(i, x) for i, x in enumerate(given)], "i int, parts array<string>")
    for row in rows.select("i", K.merge_abbrev(F.col("parts")).alias("merged"), K.pack_chunks(F.col("parts")).alias("packed")).collect():
        parts = given[row["i"]]
        assert row["merged"] == (None if parts is None else merged(parts)), row["i"]
        assert row["packed"] == (None if parts is None else packed(parts)), row["i"]
