"""The queries of this package, by name, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.llm import bpe, decontamination, html, licenses, neardup, oracles, quality, sharding, tokencount, toxicity, urls
from lectern.llm.common import settle, table

Query = Callable[[SparkSession, str], DataFrame]


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document encoded and decoded again; digests of the ids and of the decoded text."""
    both = bpe.round_trip(spark, public_tokenizers.path("byte_bpe_50k.json"))
    decoded = table(spark, sf_dir, "documents").select("doc_id", both("text").alias("x")).select("doc_id", "x.ids", "x.decoded")
    return decoded.select(
        "doc_id",
        F.size("ids").cast("bigint").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ",").cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


def op2_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence phrases and templates in every document."""
    found = licenses.scanned(table(spark, sf_dir, "documents").select("doc_id", "text"))
    named = lambda x: F.array_join(x, ",").alias(x)
    return found.select("doc_id", "n_words", "n_base", "first_word", "last_word", named("base_labels"), named("labels"), "score")


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's toxicity, learned from labels of documents that aren't held out."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    found = toxicity.scored(docs, model)
    return found.select(
        "doc_id",
        toxicity.held_out(F.col("doc_id")).alias("held_out"),
        F.col("toxicity").alias("score"),
        (F.col("toxicity") >= 0.5).cast("int").alias("predicted"),
        F.size("offending").cast("bigint").alias("n_offending"),
    )


def op4_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's shard among 40 and slot, under the law of equal row counts."""
    rows = sharding.document_keys(table(spark, sf_dir, "documents"))
    placed = sharding.sharded(rows, 40, ["doc_id", "size", "text_crc32", "text_hash"])
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statistics of every document and the verdict of the base rules and the learned list."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    rules = quality.fit(docs, table(spark, sf_dir, "labels"))
    return quality.judged(docs, rules).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "rule")


#: Context limits and probabilities that op6 answers besides every length that occurs.
LIMITS = [2**k for k in range(7, 18)]
PROBABILITIES = [0.5, 0.9, 0.95, 0.99, 0.999, 1.0]


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suffix sums over the histogram of all documents' encoded lengths, counted as op1 encodes them.

    kind "length": one row for each length that occurs, with all sums; "limit": tokens left at each of LIMITS, in
    truncated_total; "quantile": the length at each of PROBABILITIES, which stands in share_at_most.
    """
    special = bpe.read_vocabulary(public_tokenizers.path("byte_bpe_50k.json"))["added"]
    length = tokencount.length_of(spark, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, special)
    hist = settle(tokencount.histogram(table(spark, sf_dir, "documents"), length("text")), "lengths")
    sums = settle(tokencount.suffix_sums(hist), "sums")
    limits = tokencount.truncated_total(sums, LIMITS).select(F.lit("limit").alias("kind"), F.col("context").alias("length"), F.col("total").alias("truncated_total"))
    quantiles = tokencount.quantiles(sums, PROBABILITIES).select(F.lit("quantile").alias("kind"), "length", F.col("probability").alias("share_at_most"))
    out = sums.select(F.lit("length").alias("kind"), "*")
    return out.unionByName(limits, allowMissingColumns=True).unionByName(quantiles, allowMissingColumns=True)


def op7_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's class of near-duplicates."""
    return neardup.grouped(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "class_id")


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every document in benchmark windows of ten words."""
    found = decontamination.scanned(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    lengths = F.transform("spans", lambda x: (x["end"] - x["start"]).cast("bigint"))
    n_hit = F.aggregate(lengths, F.lit(0).cast("bigint"), lambda a, x: a + x)
    return found.select(
        "doc_id",
        "n_words",
        n_hit.alias("n_hit"),
        F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        (F.size("spans") > 0).alias("contaminated"),
    )


def op9_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's main text."""
    found = html.extracted(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return found.select("page_id", "url", "text", F.length("text").cast("bigint").alias("n_chars"))


#: Verdict and host/path of the rules of op10.
URL_RULES = [("block", "com/en/"), ("allow", "example.com/en/7"), ("allow", "net/de/"), ("block", "example.net/de/8"), ("block", "org/es/")]


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's verdict: by rule, else by its path template's purity."""
    good = (F.col("quality") == 1) & (F.col("toxic") == 0)
    labels = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("id"), good.alias("good"))
    found = urls.judged(table(spark, sf_dir, "pages").select("page_id", "url"), labels, URL_RULES)
    return found.select("page_id", "host", "path", "rule", "verdict", "template", "purity")


QUERIES: dict[str, Query] = {
    "op1_bpe": op1_bpe,
    "op2_licenses": op2_licenses,
    "op3_toxicity": op3_toxicity,
    "op4_shards": op4_shards,
    "op5_quality": op5_quality,
    "op6_token_counts": op6_token_counts,
    "op7_near_duplicates": op7_near_duplicates,
    "op8_decontamination": op8_decontamination,
    "op9_main_text": op9_main_text,
    "op10_url_filter": op10_url_filter,
}
#: The others encode, learn, extract or hash as SQL can't; tests hold them against brute force.
ORACLES: dict[str, str] = {
    "op2_licenses": oracles.LICENSES,
    "op7_near_duplicates": oracles.NEAR_DUPLICATES,
    "op8_decontamination": oracles.DECONTAMINATION,
    "op10_url_filter": oracles.urls(URL_RULES),
}
