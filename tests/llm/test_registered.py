"""The registered queries without SQL against brute force, on the smallest tables."""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from lectern.llm import quality, sharding, toxicity
from lectern.llm.registry import LIMITS, PROBABILITIES, QUERIES

MASK = (1 << 64) - 1


@pytest.fixture(scope="module")
def texts(spark, sf_dir):
    return [(r.doc_id, r.text or "") for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def test_op1_is_the_library(spark, sf_dir, texts):
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    expected = set()
    for i, t in texts:
        ids = library.encode(t, add_special_tokens=False).ids
        expected.add((i, len(ids), sha(",".join(map(str, ids))), sha(library.decode(ids, skip_special_tokens=False))))
    assert {(r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in QUERIES["op1_bpe"](spark, sf_dir).collect()} == expected


def test_op6_counts_what_op1_encodes(spark, sf_dir):
    lengths = [r.n_tokens for r in QUERIES["op1_bpe"](spark, sf_dir).collect()]
    rows = QUERIES["op6_token_counts"](spark, sf_dir).collect()
    assert {r.length: r.n_docs for r in rows if r.kind == "length"} == Counter(lengths)
    for r in rows:
        if r.kind == "length":
            longer = [x for x in lengths if x >= r.length]
            assert (r.docs_at_least, r.tokens_at_least, r.docs_shorter, r.total_tokens) == (len(longer), sum(longer), len(lengths) - len(longer), sum(lengths))
        if r.kind != "quantile":
            assert r.truncated_total == sum(min(x, r.length) for x in lengths)
        else:
            assert r.length == sorted(lengths)[math.ceil(r.share_at_most * len(lengths)) - 1]
    assert {r.length for r in rows if r.kind == "limit"} == set(LIMITS) and {r.share_at_most for r in rows if r.kind == "quantile"} == set(PROBABILITIES)


def test_special_strings_count_as_in_op1(spark):
    from lectern.llm import bpe, tokencount

    path = public_tokenizers.path("byte_bpe_50k.json")
    texts = ["<|endoftext|> x", "<|endoftext|>", "a<|endoftext|><|endoftext|>b <|endoftext|", "<|im_start|> y", None, ""]
    length = tokencount.length_of(spark, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, bpe.read_vocabulary(path)["added"])
    encode, _ = bpe.codec(spark, path)
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(t,) for t in texts], "text string")
    assert all(a == b for a, b in df.select(length("text"), F.size(encode("text"))).collect())


def score(text, model):
    """The noisy-or over all sentences, word by word."""
    low = toxicity.lowered(text)
    clean = 1 - model.leak
    for sentence in re.findall(r"[^.!?\n]*[.!?\n]+|[^.!?\n]+", low):
        cues = {c for w in re.findall(r"\w+", sentence) for c in [w, *(w[:n] + "*" for n in range(4, 9) if n <= len(w))] if c in model.weights}
        if cues:
            clean *= 1 - 1 / (1 + math.exp(-max(-30.0, min(30.0, model.bias + sum(model.weights[c] for c in cues)))))
    return 1 - clean


def test_op3_scores_and_held_out_accuracy(spark, sf_dir, texts):
    docs, labels = (spark.read.parquet(f"{sf_dir}/{n}.parquet") for n in ("documents", "labels"))
    model = toxicity.fit(docs.select("doc_id", "text"), labels)
    rows = {r.doc_id: r for r in QUERIES["op3_toxicity"](spark, sf_dir).collect()}
    for i, t in texts:
        r = rows[i]
        assert r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0)
        assert abs(r.score - score(t, model)) < 1e-9 and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5)
    known = [(rows[r.doc_id].predicted, r.toxic) for r in labels.collect() if r.toxic is not None and r.doc_id in rows and rows[r.doc_id].held_out]
    assert known and sum(a == b for a, b in known) / len(known) > 0.8


def mix(x, key):
    x = (x + key) & MASK
    x = ((x ^ (x >> 30)) * 0xBF58476D1CE4E5B9) & MASK
    x = ((x ^ (x >> 27)) * 0x94D049BB133111EB) & MASK
    return x ^ (x >> 31)


def place(row, n):
    """Four Feistel rounds over the smallest power of four, walked until inside 0..n-1."""
    half = 1
    while 4**half < n:
        half += 1
    keys = [(0x9E3779B97F4A7C15 * (k + 1)) & MASK for k in range(4)]
    x = row
    while True:
        left, right = x >> half, x & ((1 << half) - 1)
        for key in keys:
            left, right = right, left ^ (mix(right, key) & ((1 << half) - 1))
        x = (left << half) | right
        if x < n:
            return x


def test_op4_is_the_permutation_of_the_ordered_rows(spark, sf_dir, texts):
    keys = sharding.document_keys(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    ordered = sorted((tuple(r) for r in keys.select("doc_id", "size", "text_crc32", "text_hash").collect()), key=lambda r: tuple((x is not None, x) for x in r))
    by_id = dict(texts)
    expected = Counter()
    for row, (i, size, crc, _) in enumerate(ordered):
        data = by_id[i].encode()
        assert (size, crc) == (len(data) + 16, zlib.crc32(data))
        at = place(row, len(ordered))
        expected[i, size, crc, "rows", at % 40, at // 40, None] += 1
    found = QUERIES["op4_shards"](spark, sf_dir).select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard").collect()
    assert Counter(map(tuple, found)) == expected


def test_op4_clashing_columns(clashing, empty):
    from pyspark.sql import functions as F

    df = clashing.select("*", *(F.lit("x").alias(c) for c in ("slot", "row_number", "size")))
    found = sharding.sharded(df, 3, ["doc_id", "text"])
    assert sorted(found.columns) == sorted({*df.columns, "slot", "row_number", "shard"})
    assert sorted(r.row_number for r in found.collect()) == list(range(df.count()))
    assert sharding.sharded(empty, 3, ["doc_id"]).count() == 0


def test_op5_base_rules_and_verdict(spark, sf_dir, texts):
    docs, labels = (spark.read.parquet(f"{sf_dir}/{n}.parquet") for n in ("documents", "labels"))
    rules = quality.fit(docs.select("doc_id", "text"), labels)
    rows = {r.doc_id: r for r in QUERIES["op5_quality"](spark, sf_dir).collect()}
    judged = {r.doc_id: r.kept for r in quality.judged(docs.select("doc_id", "text"), rules).collect()}
    for i, t in texts:
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        windows = Counter(tuple(words[k : k + 5]) for k in range(len(words) - 4))
        repeated = {k + m for k in range(len(words) - 4) if windows[tuple(words[k : k + 5])] > 1 for m in range(5)}
        lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        expected = (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(repeated))
        r = rows[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == expected
        assert r.base_failed == (len(words) < 10 or 100 * len(repeated) > 20 * len(words))
        assert r.kept == judged[i] and not (r.base_failed and r.kept)
    good = [(rows[r.doc_id].kept, r.quality) for r in labels.collect() if r.quality is not None and r.doc_id in rows]
    assert sum(a == (b == 1) for a, b in good) / len(good) > 0.7
