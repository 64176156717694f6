from __future__ import annotations

import pytest

LONG = "The quick brown fox jumps over the lazy dog. " * 3000
ROWS = [
    (1, "Hello  wörld, it's 2024!\n\nLicensed under the Apache License, Version 2.0.", "en", "a", 1),
    (1, "Hello  wörld, it's 2024!\n\nLicensed under the Apache License, Version 2.0.", "en", "a", 1),
    (2, None, None, None, None),
    (3, "", "en", "a", 0),
    (None, "no id here but words", "en", "a", 1),
    (4, LONG, "en", "b", 1),
    (5, " \t\n\x0b \x1c", "en", "b", 1),
    (6, "CC BY cc-by İ KKelvin MIT license GNU General Public License", "en", "b", 1),
    (7, "<|endoftext|> <|endoftext|>x ###$$$ | | |", "en", "b", 1),
    (8, LONG, "de", "c", 1),
]
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"
CLASHING = "n_words score labels spans key id text_hash shard slot toxicity class_id band host path _words rule kept items".split()


@pytest.fixture(scope="session")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA).cache()


@pytest.fixture(scope="session")
def clashing(docs):
    """The same documents with columns named like those that operators make or use."""
    from pyspark.sql import functions as F

    return docs.select("*", *(F.lit("x").alias(c) for c in CLASHING)).cache()


@pytest.fixture(scope="session")
def empty(docs):
    return docs.limit(0)
