"""Functions that take every character of every text: no pattern may try long lists for each of them, and none may change a result."""

from __future__ import annotations

import re
import sys
import time
import unicodedata

import pytest
from pyspark.sql import functions as F

from lectern.functions import names as N
from lectern.functions import text as T
from lectern.functions.patterns import CONTROL, CONTROLS, SPACE, SPACES, UNEVEN, WS, among

#: All but the planes that are private, unassigned or of ideographs.
EVERY = [chr(c) for c in (*range(1, 0xD800), *range(0xE000, 0x20000), *range(0x2F800, 0x2FA20), *range(0xE0000, 0xE0200), sys.maxunicode)]


@pytest.fixture(scope="module")
def characters(spark):
    return spark.createDataFrame([(c,) for c in EVERY], "c string").cache()


def odd(frame, condition):
    return [r.c for r in frame.where(condition).limit(5).collect()]


def test_classes_of_java_are_those_of_the_sql(characters):
    c = F.col("c")
    assert odd(characters, c.rlike(SPACE) != c.rlike(WS)) == []
    assert odd(characters, c.rlike(CONTROLS) != c.rlike(CONTROL)) == []
    assert odd(characters, F.regexp_replace(c, UNEVEN, " ") != F.regexp_replace(c, f"{WS}+", " ")) == []
    assert odd(characters, c.rlike(WS) != F.lit(SPACES).contains(c)) == []
    some = EVERY[::997] + list("²⑦٣")
    assert {r.c for r in characters.where(c.rlike(among(some))).collect()} == set(some)


def test_white_space_of_every_kind_becomes_one_blank(spark):
    text = "".join(f"a{x}b{x}{y} c " for x in SPACES for y in " \n　") + "  "
    row = spark.range(1).select(F.regexp_replace(F.lit(text), UNEVEN, " ").alias("one"), T.strip(F.lit(f"{SPACES}{text}")).alias("bare")).first()
    assert row.one == re.sub(f"[{SPACES}]+", " ", text) and row.bare == text.strip(SPACES)


def test_camel_and_digits_of_every_character(characters):
    def camel(c):
        parts = N.SPECIAL.get(c) or unicodedata.normalize("NFKD", c)
        words = "".join(x for x in parts if x.isspace() or (x.isascii() and x.isalnum())).split()
        return "X" + words[0].lower() + "y" if len(words) == 1 and parts.strip() == parts else None

    frame = characters.select("c", N.camel_ascii(F.concat(F.lit("x"), F.col("c"), F.lit("Y"))).alias("v"), T.digit_ratio(F.concat(F.col("c"), F.lit("a"))).alias("d"))
    for r in frame.collect():
        expected = camel(r.c)
        assert expected is None or r.v == expected, r.c
        # Java's list of decimal digits is older than Python's.
        assert r.d == (0.5 if r.c.isdigit() else 0.0) or unicodedata.category(r.c) == "Nd", r.c


@pytest.mark.parametrize("of", [lambda t: F.length(N.camel_ascii(F.concat(F.lit("straße "), t))), lambda t: T.digit_ratio(F.concat(t, F.lit("٣²⑦")))])
def test_long_texts_with_a_rare_character_take_no_longer(spark, of):
    """Eight million characters; before, a text with one such character took a microsecond and more for each of the others."""
    texts = spark.range(8, numPartitions=1).select(F.repeat(F.lit("Zażółć gęślą jaźń, ale nie teraz. "), 30000).alias("t"))
    start = time.time()
    texts.select(of(F.col("t")).alias("v")).agg(F.sum("v")).collect()
    assert time.time() - start < 12
