"""Sharding by a Feistel permutation, with cycle walking, of global row numbers.

Rows are numbered 0..N-1 in a total order of their values, so the numbering does not depend on files or
partitions. A keyed four-round Feistel network permutes the smallest power of four that is no less than
N; places outside 0..N-1 are permuted again until they fall inside. Place p lies in shard ``p mod S`` at
slot ``p div S``: shard sizes differ by one row at most, slots have no gaps, and shard and slot of any row
number can be computed without looking at the data.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import settle

_U = np.uint64


def _mix(x: np.ndarray, key: int) -> np.ndarray:
    """A 64-bit finaliser with full avalanche."""
    x = x + _U(key)
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def permuted(rows: np.ndarray, n: int, seed: int = 0, rounds: int = 4) -> np.ndarray:
    """The places of row numbers 0..n-1 under the permutation of 0..n-1 that ``seed`` selects."""
    half = max(1, ((max(n - 1, 1)).bit_length() + 1) // 2)
    low = _U((1 << half) - 1)
    keys = [(0x9E3779B97F4A7C15 * (seed * 8 + k + 1)) & ((1 << 64) - 1) for k in range(rounds)]
    out = rows.astype(_U)
    walking = np.arange(len(out))
    with np.errstate(over="ignore"):
        while len(walking):
            x = out[walking]
            left, right = x >> _U(half), x & low
            for key in keys:
                left, right = right, left ^ (_mix(right, key) & low)
            out[walking] = x = (left << _U(half)) | right
            walking = walking[x >= _U(n)]
    return out.astype(np.int64)


def place(number: Column, n: int, seed: int = 0) -> Column:
    """``permuted`` for a column of row numbers; null stays null."""

    @F.arrow_udf("bigint")
    def walk(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for rows in batches:
            yield pa.array(permuted(rows.fill_null(0).to_numpy(zero_copy_only=False), n, seed), pa.int64(), mask=rows.is_null().to_numpy(zero_copy_only=False))

    return walk(number)


def numbered(df: DataFrame, keys: list[str], number: str) -> tuple[DataFrame, int]:
    """``df`` with a column of global row numbers in the order of ``keys``, and the number of rows.

    A range exchange sorts; equal rows, of which there may be very many, are spread by a salt. They are
    interchangeable, so the salt changes nothing in the result. Each partition is counted, and the counts,
    one for each partition, give the offsets; no row passes through a single task.
    """
    salt, part, local = "__salt", "__part", "__local"
    spread = df.withColumn(salt, F.xxhash64(F.monotonically_increasing_id()))
    n_parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = [*keys, salt]
    sorted_ = spread.repartitionByRange(n_parts, *order).sortWithinPartitions(*order).drop(salt)
    fixed = settle(sorted_.withColumn(local, F.monotonically_increasing_id()), "numbered").withColumn(part, F.shiftright(local, 33))
    counts = sorted(fixed.groupBy(part).count().collect())
    offsets, total = {}, 0
    for p, c in counts:
        offsets[p] = total - (p << 33)
        total += c
    if not offsets:
        return fixed.withColumn(number, F.lit(None).cast("bigint")).drop(part, local), 0
    base = df.sparkSession.createDataFrame(sorted(offsets.items()), f"{part} bigint, __base bigint")
    # One row for each partition: the bound of what is broadcast.
    return fixed.join(F.broadcast(base), part).withColumn(number, F.col(local) + F.col("__base")).drop(part, local, "__base"), total


def sharded(df: DataFrame, shards: int, keys: list[str], seed: int = 0) -> DataFrame:
    """``df`` with ``row_number``, ``shard`` (int) and ``slot`` (long), under the law of equal row counts.

    keys: columns that order the rows; rows that agree in all of them are interchangeable. Null keys come
    first. An empty table gives an empty table. Existing columns of the three names are replaced.
    """
    if shards < 1:
        raise ValueError("shards must be positive")
    rows, n = numbered(df.drop("row_number", "shard", "slot"), keys, "row_number")
    at = rows.withColumn("__place", place(F.col("row_number"), n, seed))
    return at.withColumn("shard", F.pmod("__place", F.lit(shards)).cast("int")).withColumn("slot", F.floor(F.col("__place") / shards).cast("bigint")).drop("__place")


def document_keys(docs: DataFrame) -> DataFrame:
    """doc_id, size (bytes of the text plus 16; null: none), text_crc32 and a hash that tells texts apart."""
    text = F.coalesce("text", F.lit(""))
    return docs.select("doc_id", (F.octet_length(text) + F.lit(16)).cast("bigint").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.xxhash64("text").alias("text_hash"))
