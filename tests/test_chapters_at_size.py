"""Steps of the chapter queries that look at a text once, held against slow forms of the same rules."""

from __future__ import annotations

import random
import re
import time

from pyspark.sql import functions as F

from lectern.functions.ordinals import ordinal_word
from lectern.operators import chapters as C


def heading(text):
    """The rule of ``separate_heading``, word by word."""
    found = re.match(r"(?i)((?:rozdział|rozdzial|chapter|część|czesc|part)\s*[0-9]+)\s*", text)
    if not found:
        return None, text
    words = text[found.end() :].split()
    n = 0
    while n < len(words):
        clean, after = re.sub(r'[,."()\-]', "", words[n]), re.sub(r'[,."]', "", "".join(words[n + 1 : n + 2]))
        capitals = clean[:1].isupper() and not any(c.islower() for c in clean)
        if clean and (len(clean) == 1 and capitals and after[:1].islower() or not capitals):
            break
        n += 1
    if n == len(words):
        return None, text
    name, number = re.fullmatch(r"(.*?)(\d+)", found[1], re.S).groups()
    spoken = name.strip() + " " + ordinal_word(int(number)) if name[-1:].isspace() else found[1]
    return " ".join([spoken, *words[:n]]), " ".join(words[n:])


def test_headings_by_the_rule(spark):
    rng = random.Random(3)
    some = ["TYTUŁ", "W", "isława", ",", "(A)", "A.B", "\"Ż\"", "-", "„X", "1A", "ŁÓDŹ,", "Ala", ".b", "(c", "A-", "...", "ÄÖ"]
    starts = ["Rozdział 6 ", "ROZDZIAŁ  12", "chapter 999\n", "część3 ", "Tom 5 ", "", "Rozdział"]
    texts = [rng.choice(starts) + "".join(rng.choice(some) + rng.choice([" ", " ", "  ", "\n", " "]) for _ in range(rng.randrange(7))) for _ in range(3000)]
    texts = [t.strip() for t in texts]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", F.inline(F.array(C.separate_heading(F.col("t"))))).collect()
    for r in rows:
        assert (r.heading, r.body) == heading(texts[r.i]), texts[r.i]
    assert sum(r.heading is not None for r in rows) > 500


def test_heading_of_a_long_text_looks_at_its_title(spark):
    texts = spark.range(8, numPartitions=1).select(F.concat(F.lit("Rozdział 6 TYTUŁ "), F.repeat(F.lit("ala ma kota, "), 80000)).alias("t"))
    start = time.time()
    assert texts.select(F.inline(F.array(C.separate_heading(F.col("t"))))).agg(F.sum(F.length("body"))).first()[0] == 8 * (80000 * 13 - 1)
    assert time.time() - start < 6


def test_skipped_documents_are_not_dealt_out(spark, sf_dir):
    """The filter stands below the exchange, and the chapters are those that ``routed`` keeps."""
    from lectern.plans.inputs import docs

    plan = C.chapters(docs(spark, sf_dir))._jdf.queryExecution().executedPlan().toString()
    assert plan.index("Exchange") < plan.index("Filter", plan.index("Exchange")) and "okładka" in plan[plan.index("Exchange") :]
    kept = {(r.book_id, r.content) for r in C.routed(docs(spark, sf_dir)).where("reason IS NULL").collect()}
    assert kept == {(r.book_id, r.content) for r in C.chapters(docs(spark, sf_dir)).collect()}


def test_sentences_and_endings_by_the_rule(spark):
    from lectern.functions import text as T
    from lectern.functions.patterns import ABBREVIATIONS
    from lectern.operators import chunking as K

    rng = random.Random(5)
    some = ["Ala.", "ma…", "kota!", "prof.", "nieprof.", "12.", "5.", "A.", "„Tak.", 'Nie."', '"No.', "(Ba)", "–", "x?", "sierż.", "bardzodługiesłowo.", "_.", "1a.", "12. ", " "]
    texts = ["".join(rng.choice(some) + rng.choice([" ", "  ", "\n", " "]) for _ in range(rng.randrange(9))) for _ in range(2000)]
    found = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", K.sentences(F.col("t")).alias("s"), K.abbrev_ending(F.col("t")).alias("e"), T.word_count(F.col("t")).alias("n"))
    for r in found.collect():
        parts = re.split("\x02", re.sub('([„"][^"]*")', "\x02\\1\x02", texts[r.i]))
        cut = "".join(p if k % 2 else re.sub(rf"(?<=[.!?…])\s+(?=[{K.OPENS}])", "\x01", p) for k, p in enumerate(parts))
        assert r.s == [s for s in map(str.strip, cut.split("\x01")) if s], texts[r.i]
        word = re.search(r"(\w+)\.$", texts[r.i].rstrip())
        ends = bool(re.fullmatch(r"[0-9]+\.\s*", texts[r.i])) or word is not None and (word[1].lower() in ABBREVIATIONS or len(word[1]) == 1 and word[1].upper() == word[1])
        assert (r.e, r.n) == (ends, len(texts[r.i].split())), texts[r.i]


def test_endings_of_long_words_look_at_the_end(spark):
    from lectern.operators import chunking as K

    texts = spark.range(4, numPartitions=1).select(F.concat(F.repeat(F.lit("a"), 100000), F.lit("!")).alias("t"))
    start = time.time()
    assert texts.select(K.abbrev_ending(F.col("t")).alias("e")).where("e").count() == 0
    assert time.time() - start < 6
