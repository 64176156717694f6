"""Exact token counts for every context limit from one histogram of encoded lengths.

Documents are encoded whole; their lengths are aggregated to a histogram, whose size is the number of
different lengths, however many documents there are. Suffix sums over it answer totals, quantiles and
truncated totals for every limit without another look at the documents.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lectern.llm.common import small_batches

#: The vocabulary is broadcast; a file of more bytes is refused.
VOCABULARY_BYTES = 64 << 20
#: Lengths in one block of the suffix sums.
BLOCK = 1024

_encodings: dict[str, Any] = {}


def _encoding(ranks: Any, pattern: str, special: dict[str, int], digest: str) -> Any:
    import tiktoken

    key = repr((digest, pattern, sorted(special.items())))
    if key not in _encodings:
        _encodings.clear()
        _encodings[key] = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks.value, special_tokens=special)
    return _encodings[key]


def length_of(spark: SparkSession, path: str, pattern: str, special: dict[str, int] | None = None) -> Any:
    """A column function: how many tokens a text has under the rank file at ``path``; null or empty: 0.

    special: strings that are one token wherever they stand, as in the encoder that is counted for; other
    special-looking strings are ordinary text.
    """
    special = special or {}
    with open(path, "rb") as file:
        lines = file.read(VOCABULARY_BYTES + 1)
    if len(lines) > VOCABULARY_BYTES:
        raise ValueError(f"{path}: vocabulary files of more than {VOCABULARY_BYTES} bytes aren't broadcast")
    ranks = spark.sparkContext.broadcast({base64.b64decode(a): int(b) for a, b in map(bytes.split, lines.splitlines())})

    small_batches(spark)
    digest = hashlib.sha256(lines).hexdigest()

    @F.arrow_udf("bigint")
    def lengths(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        encoding = _encoding(ranks, pattern, special, digest)
        for texts in batches:
            out = []
            for text in texts.to_pylist():
                text = text or ""
                if any(x in text for x in special):
                    out.append(len(encoding.encode(text, allowed_special="all", disallowed_special=())))
                else:
                    out.append(len(encoding.encode_ordinary(text)))
            yield pa.array(out, pa.int64())

    return lengths


def histogram(docs: DataFrame, length: Column) -> DataFrame:
    """(length, n_docs) with one row for each encoded length that occurs; summed in part before the shuffle."""
    return docs.select(length.alias("length")).groupBy("length").agg(F.count("*").alias("n_docs"))


def suffix_sums(hist: DataFrame) -> DataFrame:
    """For each length L that occurs, as the context limit:

    n_docs, docs_at_least and tokens_at_least (documents of L tokens or more, and their tokens),
    docs_shorter, truncated_total (tokens left when every document is cut to L), total_tokens and
    share_at_most (share of documents with L tokens or fewer: the length is the quantile of every
    probability above the share before it and up to this one).

    Lengths are summed in blocks of 1,024, blocks in groups of 1,024, and the groups, of which there are 2,048 at most as no text
    has more than 2**31 bytes, on the driver: no task sees all lengths. Empty in, empty out.
    """
    block, group = F.floor(F.col("length") / BLOCK), F.floor(F.col("block") / BLOCK)
    rows = hist.select("length", "n_docs", block.alias("block"))
    after = lambda part, by: Window.partitionBy(part).orderBy(F.desc(by)).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    tokens = F.col("n_docs") * F.col("length")
    inside = rows.withColumn("d", F.sum("n_docs").over(after("block", "length"))).withColumn("t", F.sum(tokens).over(after("block", "length")))
    blocks = rows.groupBy("block").agg(F.sum("n_docs").alias("bd"), F.sum(tokens).alias("bt")).withColumn("group", group)
    groups = sorted(blocks.groupBy("group").agg(F.sum("bd").alias("d"), F.sum("bt").alias("t")).collect(), reverse=True)
    docs, all_tokens = sum(r["d"] for r in groups), sum(r["t"] for r in groups)
    before, beyond = (0, 0), []
    for r in groups:
        beyond.append((r["group"], *before))
        before = before[0] + r["d"], before[1] + r["t"]
    far = hist.sparkSession.createDataFrame(beyond, "group bigint, gd bigint, gt bigint")
    totals = (
        blocks.withColumn("cd", F.sum("bd").over(after("group", "block")) - F.col("bd"))
        .withColumn("ct", F.sum("bt").over(after("group", "block")) - F.col("bt"))
        .join(F.broadcast(far), "group")
        .select("block", (F.col("cd") + F.col("gd")).alias("cd"), (F.col("ct") + F.col("gt")).alias("ct"), F.lit(docs).cast("bigint").alias("docs"), F.lit(all_tokens).cast("bigint").alias("tokens"))
    )
    at = inside.join(totals, "block")
    longer, longer_tokens = F.col("d") + F.col("cd"), F.col("t") + F.col("ct")
    shorter = F.col("docs") - longer
    return at.select(
        "length",
        "n_docs",
        longer.alias("docs_at_least"),
        longer_tokens.alias("tokens_at_least"),
        shorter.alias("docs_shorter"),
        (F.col("tokens") - longer_tokens + longer * F.col("length")).alias("truncated_total"),
        F.col("tokens").alias("total_tokens"),
        ((shorter + F.col("n_docs")) / F.col("docs")).alias("share_at_most"),
    )


def truncated_total(sums: DataFrame, limits: list[int]) -> DataFrame:
    """(context, total): tokens left when every document is cut to ``context``, for any limits.

    The least length that occurs and isn't below the limit has the same documents beyond the limit.
    """
    asked = sums.sparkSession.createDataFrame([(x,) for x in limits], "context bigint")
    pairs = sums.select("length", "docs_at_least", "tokens_at_least", "total_tokens").join(F.broadcast(asked), F.col("length") >= F.col("context"))
    top = pairs.groupBy("context").agg(F.min_by(F.struct("docs_at_least", "tokens_at_least", "total_tokens"), "length").alias("x"))
    found = top.select("context", (F.col("x.total_tokens") - F.col("x.tokens_at_least") + F.col("x.docs_at_least") * F.col("context")).alias("total"))
    every = sums.agg(F.coalesce(F.max("total_tokens"), F.lit(0)).alias("every"))
    return asked.join(F.broadcast(found), "context", "left").crossJoin(F.broadcast(every)).select("context", F.coalesce("total", "every").alias("total"))


def quantiles(sums: DataFrame, probabilities: list[float]) -> DataFrame:
    """(probability, length): the least length that has at least that share of documents at or below it."""
    asked = sums.sparkSession.createDataFrame([(x,) for x in probabilities], "probability double")
    return sums.join(F.broadcast(asked), F.col("share_at_most") >= F.col("probability")).groupBy("probability").agg(F.min("length").alias("length"))
