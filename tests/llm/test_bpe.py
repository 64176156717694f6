from __future__ import annotations

import random

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from lectern.llm import bpe, tokencount

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def encoder():
    return bpe.Encoder(bpe.read_vocabulary(PATH))


@pytest.fixture(scope="module")
def library():
    t = Tokenizer.from_file(PATH)
    t.no_truncation()
    t.no_padding()
    return t


def ids(encoder, text):
    return np.frombuffer(encoder.encode([text])[0], "<i4").tolist()


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=80) | st.text(alphabet="ab'sz 1_\xa0é—×\n<|endoftext|>", max_size=120))
def test_same_ids_as_the_library(text):
    own, lib = _cached()
    assert ids(own, text) == lib.encode(text, add_special_tokens=False).ids


_pair = []


def _cached():
    if not _pair:
        t = Tokenizer.from_file(PATH)
        t.no_truncation()
        t.no_padding()
        _pair.append((bpe.Encoder(bpe.read_vocabulary(PATH)), t))
    return _pair[0]


def test_long_words_and_long_texts(encoder, library, monkeypatch):
    random.seed(3)
    text = "".join(random.choice("abcdefg") for _ in range(20_000)) + " word" * 5000
    assert ids(encoder, text) == library.encode(text, add_special_tokens=False).ids
    monkeypatch.setattr(bpe, "LONG_TEXT", 1000)
    monkeypatch.setattr(bpe, "RUN", 100)
    monkeypatch.setattr(bpe, "REMEMBERED", 50)
    assert ids(encoder, text) == library.encode(text, add_special_tokens=False).ids


def test_columns(spark, clashing, library):
    encode, decode = bpe.codec(spark, PATH)
    rows = clashing.select("text", encode("text").alias("ids")).select("text", "ids", decode("ids").alias("back")).collect()
    for row in rows:
        assert row.ids == library.encode(row.text or "", add_special_tokens=False).ids
        assert row.back == (row.text or "")


def test_decoding_odd_ids(spark, library):
    _, decode = bpe.codec(spark, PATH)
    rows = spark.createDataFrame([([198, 50256, 188],), ([99_999, 15496],), (None,), ([],)], "ids array<int>").select(decode("ids").alias("t")).collect()
    assert [r.t for r in rows] == [library.decode([198, 50256, 188], skip_special_tokens=False), "Hello", "", ""]


def test_empty(spark, empty):
    encode, _ = bpe.codec(spark, PATH)
    assert empty.select(encode("text")).count() == 0


def test_token_counts(spark, clashing, empty):
    import tiktoken

    length = tokencount.length_of(spark, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    sums = tokencount.suffix_sums(tokencount.histogram(clashing, length("text"))).cache()
    own = bpe.Encoder(bpe.read_vocabulary(PATH))
    del tiktoken
    lengths = []
    for row in clashing.select("text").collect():
        # The rank file has no special tokens, so their strings are ordinary text.
        t = Tokenizer.from_file(PATH)
        t.encode_special_tokens = True
        lengths.append(len(t.encode(row.text or "", add_special_tokens=False).ids))
    assert own is not None
    for r in sums.collect():
        least = [x for x in lengths if x >= r.length]
        assert (r.n_docs, r.docs_at_least, r.tokens_at_least, r.docs_shorter) == (lengths.count(r.length), len(least), sum(least), len(lengths) - len(least))
        assert r.truncated_total == sum(min(x, r.length) for x in lengths) and r.total_tokens == sum(lengths)
    limits = [0, 1, 5, 20, 29_999, 10**6]
    assert {r.context: r.total for r in tokencount.truncated_total(sums, limits).collect()} == {k: sum(min(x, k) for x in lengths) for k in limits}
    middle = {r.probability: r.length for r in tokencount.quantiles(sums, [0.5, 1.0]).collect()}
    assert middle == {0.5: sorted(lengths)[len(lengths) // 2 - 1], 1.0: max(lengths)}
    assert tokencount.suffix_sums(tokencount.histogram(empty, length("text"))).count() == 0
