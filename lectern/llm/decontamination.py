"""Benchmark decontamination by winnowing.

Of a text's hashed k-grams of words, winnowing keeps the smallest of every w consecutive ones. Two texts
that share w + k - 1 words in a row keep a k-gram in common inside that run, whatever stands around it.
With k = 5 and w = 6 every shared run of ten words has a common fingerprint. The fingerprints of the
documents are joined to those of the benchmark; each hit is extended to both sides, word by word, and
counts if the run is at least ten words long. Items of fewer words are looked up whole.

A benchmark of up to BLOCK_BYTES is indexed in one broadcast, and documents are scanned where they are. A larger one is
joined: a bitmap of its fingerprints, of fixed size, tells which fingerprints of a document can be in it; around these the
document's windows are joined with the benchmark's by two independent 64-bit hashes, and neighbouring hits extend each other.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import Any

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import WORD, joined, plain_lower, settle, slices, small_batches

#: Words of an item's window: shared runs that count.
WINDOW = 10
#: Words of a fingerprint, and fingerprints of which one is kept.
GRAM = 5
KEPT = WINDOW - GRAM + 1
#: Bytes of benchmark text that are broadcast at most.
BLOCK_BYTES = 16 << 20
#: Bits of the bitmap of a larger benchmark's fingerprints: 16 MB.
BITS = 27
#: Words whose hash a worker remembers. Bears on speed only.
REMEMBERED = 100_000

_U = np.uint64
_words = re.compile(WORD)


def words_of(text: str | None) -> list[str]:
    return _words.findall(plain_lower(text or ""))


class _Hashes(dict[str, int]):
    """64-bit hashes of words, remembered."""

    def __missing__(self, word: str) -> int:
        self[word] = found = xxhash.xxh3_64_intdigest(word)
        return found


_known = _Hashes()


def word_hashes(words: list[str]) -> np.ndarray:
    """64-bit hashes of words."""
    if len(_known) > REMEMBERED:
        _known.clear()
    return np.fromiter(map(_known.__getitem__, words), np.uint64, len(words))


def grams(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all runs of k words."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        out = np.zeros(n, np.uint64)
        for i in range(k):
            out = out * _U(0x9E3779B97F4A7C15) + hashes[i : i + n]
        out ^= out >> _U(29)
        out *= _U(0xBF58476D1CE4E5B9)
        return out ^ (out >> _U(32))


def winnowed(hashes: np.ndarray, w: int = KEPT) -> np.ndarray:
    """Places of the kept fingerprints: the rightmost smallest of every w in a row; of fewer, of all."""
    n = len(hashes)
    if n == 0:
        return np.zeros(0, np.int64)
    w = min(w, n)
    least = hashes[w - 1 :].copy()
    at = np.arange(w - 1, n)
    for back in range(1, w):
        other = hashes[w - 1 - back : n - back]
        smaller = other < least
        least = np.where(smaller, other, least)
        at = np.where(smaller, np.arange(w - 1 - back, n - back), at)
    return np.unique(at)


class Index:
    """Fingerprints of benchmark items, and the items' words."""

    def __init__(self, items: list[tuple[Any, str]]):
        self.items = [(item, words_of(text)) for item, text in items]
        self.at: dict[int, list[tuple[int, int]]] = {}
        self.short: dict[int, dict[int, list[int]]] = {}
        for i, (_, words) in enumerate(self.items):
            hashes = word_hashes(words)
            if len(words) >= WINDOW:
                found = grams(hashes, GRAM)
                for place in winnowed(found).tolist():
                    self.at.setdefault(int(found[place]), []).append((i, place))
            elif words:
                self.short.setdefault(len(words), {}).setdefault(int(grams(hashes, len(words))[0]), []).append(i)
        self.keys = np.array(sorted(self.at), np.uint64)
        self.short_keys = {k: np.array(sorted(v), np.uint64) for k, v in self.short.items()}

    @staticmethod
    def among(values: np.ndarray, keys: np.ndarray) -> np.ndarray:
        if not len(keys) or not len(values):
            return np.zeros(len(values), bool)
        return keys[np.minimum(np.searchsorted(keys, values), len(keys) - 1)] == values

    def search(self, words: list[str], hashes: np.ndarray, found: np.ndarray, kept: np.ndarray) -> tuple[list[tuple[int, int]], set[int]]:
        """Runs [start, end) of hit words, and the places of items hit, in a text's words.

        found, kept: the text's k-grams and the places of its fingerprints.
        """
        runs: list[tuple[int, int]] = []
        items: set[int] = set()
        past: dict[tuple[int, int], int] = {}  # how far an item has been followed at an offset
        for place in kept[self.among(found[kept], self.keys)].tolist() if len(kept) else []:
            for i, at in self.at[int(found[place])]:
                own = self.items[i][1]
                if past.get((i, place - at), 0) >= place + GRAM or words[place : place + GRAM] != own[at : at + GRAM]:
                    continue
                left, right = 0, GRAM
                while left < min(place, at) and words[place - left - 1] == own[at - left - 1]:
                    left += 1
                while place + right < len(words) and at + right < len(own) and words[place + right] == own[at + right]:
                    right += 1
                past[i, place - at] = place + right
                if left + right >= WINDOW:
                    runs.append((place - left, place + right))
                    items.add(i)
        for k, keys in self.short_keys.items():
            all_k = grams(hashes, k)
            for place in np.flatnonzero(self.among(all_k, keys)).tolist():
                for i in self.short[k][int(all_k[place])]:
                    if words[place : place + k] == self.items[i][1]:
                        runs.append((place, place + k))
                        items.add(i)
        return runs, items


def merged(runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The union of runs as sorted runs with gaps between."""
    out: list[tuple[int, int]] = []
    for start, end in sorted(runs):
        if out and start <= out[-1][1]:
            out[-1] = out[-1][0], max(out[-1][1], end)
        else:
            out.append((start, end))
    return out


_indexes: dict[str, Index] = {}


def _index(value: tuple[str, list[tuple[Any, str]]]) -> Index:
    if value[0] not in _indexes:
        _indexes.clear()
        _indexes[value[0]] = Index(value[1])
    return _indexes[value[0]]


KIND = "struct<n_words:bigint,spans:array<struct<start:int,end:int>>,items:array<string>>"


def _scan(block: Any, text: Column) -> Column:
    """One block's hits, as KIND."""

    @F.arrow_udf(KIND)
    def scan(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        index = _index(block.value)
        for texts in batches:
            out = []
            texts = texts.to_pylist()
            for start, end in slices(texts):
                split = [words_of(x) for x in texts[start:end]]
                hashes = word_hashes([w for words in split for w in words])
                found = grams(hashes, GRAM)
                at = 0
                for words in split:
                    n = len(words)
                    own = found[at : at + max(n - GRAM + 1, 0)] if n >= GRAM else found[:0]
                    runs, items = index.search(words, hashes[at : at + n], own, winnowed(own))
                    spans = [{"start": a, "end": b} for a, b in merged(runs)]
                    out.append({"n_words": n, "spans": spans, "items": sorted({str(index.items[i][0]) for i in items})})
                    at += n
            yield pa.array(out, KIND_ARROW)

    return scan(text)


KIND_ARROW = pa.struct([("n_words", pa.int64()), ("spans", pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))), ("items", pa.list_(pa.string()))])


def _second(hashes: np.ndarray) -> np.ndarray:
    """Other hashes of words, from their first."""
    with np.errstate(over="ignore"):
        x = (hashes ^ _U(0xA0761D6478BD642F)) * _U(0xE7037ED1A0B428DB)
        return x ^ (x >> _U(32))


def _windows(words: list[str], k: int) -> tuple[np.ndarray, np.ndarray]:
    """Two hashes of all runs of k words. Runs of different lengths have different hashes."""
    hashes = word_hashes(words)
    with np.errstate(over="ignore"):
        return grams(hashes, k) + _U(k), grams(_second(hashes), k)


_MARKS = "array<struct<kind:int,mark:bigint>>"
_WINDOWS = "array<struct<a:bigint,b:bigint,start:int,size:int>>"
_WINDOWS_ARROW = pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64()), ("start", pa.int32()), ("size", pa.int32())]))


def _item_marks(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """Of an item of a window or more its fingerprints, kind 0; of a shorter one its only window, kind its words."""
    kind = pa.list_(pa.struct([("kind", pa.int32()), ("mark", pa.int64())]))
    for texts in batches:
        out = []
        for text in texts.to_pylist():
            words = words_of(text)
            found = grams(word_hashes(words), GRAM if len(words) >= WINDOW else max(len(words), 1))
            if len(words) >= WINDOW:
                found = np.unique(found[winnowed(found)])
            out.append([{"kind": 0 if len(words) >= WINDOW else len(words), "mark": m} for m in found.view(np.int64).tolist()])
        yield pa.array(out, kind)


def _item_windows(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for texts in batches:
        out = []
        for text in texts.to_pylist():
            words = words_of(text)
            k = min(WINDOW, len(words))
            a, b = _windows(words, k) if words else (np.zeros(0, np.uint64),) * 2
            out.append([{"a": x, "b": y, "start": n, "size": k} for n, (x, y) in enumerate(zip(a.view(np.int64).tolist(), b.view(np.int64).tolist(), strict=True))])
        yield pa.array(out, _WINDOWS_ARROW)


def _bitmap(marks: DataFrame) -> tuple[dict[int, np.ndarray], int]:
    """Of each kind the bits of its marks' upper halves. 64 at a time are put together before they come to the driver: 16 MB for a kind at most."""
    bit = F.shiftrightunsigned("mark", 64 - BITS)
    cells = marks.select("kind", F.shiftright(bit, 6).alias("cell"), bit.bitwiseAND(F.lit(63)).cast("int").alias("bit"))
    cells = cells.groupBy("kind", "cell").agg(F.bit_or(F.expr("shiftleft(1L, bit)")).alias("bits"))
    out: dict[int, np.ndarray] = {}
    for kind, cell, bits in cells.toLocalIterator():
        out.setdefault(kind, np.zeros(1 << (BITS - 6), np.int64))[cell] = bits
    return out, sum(x.nbytes for x in out.values())


def _possible(found: np.ndarray, bits: np.ndarray) -> np.ndarray:
    """Whether the marks can be in the benchmark."""
    at = (found >> _U(64 - BITS)).astype(np.int64)
    return (bits[at >> 6].view(np.uint64) >> (at & 63).astype(_U)) & _U(1) > 0


def _windows_of(bitmaps: Any, text: Column) -> Column:
    """(n_words, windows): the windows of a text that can be in the benchmark."""

    @F.arrow_udf(f"struct<n_words:bigint,windows:{_WINDOWS}>")
    def scan(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        bits = bitmaps.value
        for texts in batches:
            out = []
            for text in texts.to_pylist():
                words = words_of(text)
                hashes = word_hashes(words)
                own = []
                for kind, map_ in bits.items():
                    k = kind or WINDOW
                    if len(words) < k:
                        continue
                    found = grams(hashes, kind or GRAM)
                    if kind:
                        starts = np.flatnonzero(_possible(found, map_))
                    else:
                        kept = winnowed(found)
                        kept = kept[_possible(found[kept], map_)]
                        # All windows that hold the fingerprint.
                        starts = np.unique((kept[:, None] - np.arange(WINDOW - GRAM + 1)).reshape(-1))
                        starts = starts[(starts >= 0) & (starts <= len(words) - WINDOW)]
                    if len(starts):
                        a, b = _windows(words, k)
                        own += [{"a": x, "b": y, "start": n, "size": k} for n, x, y in zip(starts.tolist(), a[starts].view(np.int64).tolist(), b[starts].view(np.int64).tolist(), strict=True)]
                out.append({"n_words": len(words), "windows": own})
            yield pa.array(out, pa.struct([("n_words", pa.int64()), ("windows", _WINDOWS_ARROW)]))

    return scan(text)


def _joined_hits(docs: DataFrame, items: DataFrame) -> DataFrame:
    """(__key, spans, items) by text key, of texts with hits, for a benchmark of any size."""
    spark = docs.sparkSession
    bitmaps, _ = _bitmap(items.select(F.inline(F.arrow_udf(_MARKS)(_item_marks)("text"))))
    bits = spark.sparkContext.broadcast(bitmaps)
    texts = docs.where("text is not null").select(F.md5(F.col("text").cast("binary")).alias("__key"), _windows_of(bits, F.col("text"))["windows"].alias("windows"))  # no filter here, which would scan every text twice
    own = settle(texts.groupBy("__key").agg(F.first("windows").alias("windows")).select("__key", F.inline("windows")), "windows")
    theirs = settle(items.select("item", F.inline(F.arrow_udf(_WINDOWS)(_item_windows)("text"))).select("item", "a", "b").distinct(), "items")
    counts = own.groupBy("a", "b").agg(F.count("*").alias("n"))
    window = F.struct("a", "b").alias("window")
    known = settle(theirs.groupBy("a", "b").agg(F.count("*").alias("n_items")).join(counts, ["a", "b"]).select(window, "n", "n_items"), "known")
    hits = settle(joined(own.select("__key", window, "start", "size"), known, "window"), "hits")
    run = lambda a, x: F.when(
        (F.size(a) > 0) & (x["start"] <= F.try_element_at(a, F.lit(-1))["end"]),
        F.concat(F.slice(a, 1, F.size(a) - 1), F.array(F.struct(F.element_at(a, -1)["start"].alias("start"), F.greatest(F.element_at(a, -1)["end"], x["end"]).alias("end")))),
    ).otherwise(F.array_append(a, x))
    places = F.sort_array(F.collect_list(F.struct("start", (F.col("start") + F.col("size")).alias("end"))))
    spans = hits.groupBy("__key").agg(places.alias("p")).select("__key", F.aggregate("p", F.array().cast("array<struct<start:int,end:int>>"), run).alias("spans"))
    # What is joined here is the result, a row for each window and item; adaptive execution splits frequent windows.
    of_items = hits.select("__key", "window").distinct().join(theirs.select(window, "item"), "window").select("__key", "item").distinct()
    named = of_items.groupBy("__key").agg(F.sort_array(F.collect_list("item")).alias("items"))
    return settle(spans.join(named, "__key"), "found")


def scanned(docs: DataFrame, benchmark: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``docs`` with n_words, spans (array of [start, end) in words, merged and sorted) and items (sorted
    ids, as strings, of benchmark items with an occurring window).

    A null text has no words; items without words are never hit; a null item_id counts as the id "null".
    Existing columns of these names are replaced. An empty benchmark hits nothing.
    """
    spark = docs.sparkSession
    small_batches(spark)
    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("null")).alias("item"), "text").where(F.col("text").isNotNull())
    size = items.agg(F.coalesce(F.sum(F.octet_length("text") + F.octet_length("item")), F.lit(0))).first()[0]
    df = docs.drop("n_words", "spans", "items")
    if size <= block_bytes:
        rows = sorted(tuple(r) for r in items.distinct().collect())
        digest = xxhash.xxh3_128_hexdigest(repr(rows))
        return df.withColumn("__hits", _scan(spark.sparkContext.broadcast((digest, rows)), F.col("text"))).select(*df.columns, "__hits.*")
    found = _joined_hits(df, items)
    empty = F.array().cast("array<struct<start:int,end:int>>"), F.array().cast("array<string>")
    hit = df.withColumn("__key", F.md5(F.col("text").cast("binary"))).join(found, "__key", "left")
    return hit.select(*df.columns, F.arrow_udf("bigint")(_n_words)("text").alias("n_words"), F.coalesce("spans", empty[0]).alias("spans"), F.coalesce("items", empty[1]).alias("items"))


def _n_words(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """How many words a text has."""
    for texts in batches:
        yield pa.array([len(words_of(x)) for x in texts.to_pylist()], pa.int64())
