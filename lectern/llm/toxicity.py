"""Toxicity by multiple-instance learning: documents are labelled, sentences are scored.

A document is a bag of sentences, and toxic if one of them is. A sentence's score is the logistic function
of the weights of its cues, words and beginnings of words; the document's is the leaky noisy-or of its
sentences' scores, ``1 - (1 - leak) * product(1 - score)``. Weights, bias and leak are fitted to document labels
through the noisy-or, so that sentences get scores that nobody labelled; the sentences with high scores
are the offending ones.
"""

from __future__ import annotations

import bisect
import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import plain_lower, small_batches

#: Labelled documents of each class that the model is fitted to, at most: those with the smallest hash.
SAMPLE = 2500
#: Bytes of their texts, of each class, at most: the bound of what comes to the driver. A text that would exceed it isn't learned from.
SAMPLE_BYTES = 24 << 20
#: Characters of word beginnings that may be cues, and cues, at most.
PREFIXES, CUES = range(4, 9), 400
#: A cue stands in this many toxic documents at least, and is so many times likelier in them.
LEAST_DOCS, LEAST_LIFT = 6, 4.0

_word = re.compile(r"\w+")
_sentence = re.compile(r"[^.!?\n]*[.!?\n]+|[^.!?\n]+")


@dataclass
class Model:
    """Weights of cues (a word, or a beginning of words with "*" at its end), bias and leak."""

    weights: dict[str, float]
    bias: float
    leak: float


def lowered(text: str) -> str:
    """Lower case of the same length."""
    low = text.lower()
    return low if len(low) == len(text) else plain_lower(text)


def candidates(word: str) -> list[str]:
    return [word, *(word[:n] + "*" for n in PREFIXES if n <= len(word))]


def bag(text: str) -> list[set[str]]:
    """The words of each sentence."""
    return [set(_word.findall(s)) for s in _sentence.findall(lowered(text))]


def chosen_cues(texts: list[str], toxic: list[bool]) -> list[str]:
    """The cues that tell the classes apart best, by the log-likelihood ratio of document frequencies."""
    counts = {True: Counter(), False: Counter()}
    for text, y in zip(texts, toxic, strict=True):
        counts[y].update({c for w in set(_word.findall(lowered(text))) for c in candidates(w)})
    p, n = max(sum(toxic), 1), max(len(toxic) - sum(toxic), 1)

    def gain(a: int, b: int) -> float:
        total, out = a + b, 0.0
        for seen, expected in ((a, total * p / (p + n)), (b, total * n / (p + n))):
            out += seen * math.log(seen / expected) if seen else 0.0
        return out

    good = [(gain(a, counts[False][c]), c) for c, a in counts[True].items() if a >= LEAST_DOCS and (a + 0.5) / (p + 1) >= LEAST_LIFT * (counts[False][c] + 0.5) / (n + 1)]
    return [c for _, c in sorted(good, key=lambda x: (-x[0], x[1]))[:CUES]]


def train(texts: list[str], toxic: list[bool], class_weights: tuple[float, float] = (1.0, 1.0), steps: int = 400) -> Model:
    """Fit to (text, is toxic); class_weights: of clean and of toxic documents. One class only: no cues, and its share as leak."""
    if not any(toxic) or all(toxic):
        return Model({}, -6.0, 0.99 if texts and all(toxic) else 0.0)
    cues = chosen_cues(texts, toxic)
    number = {c: i for i, c in enumerate(cues)}
    known: dict[str, list[int]] = {}
    sentence_of, cue_of, doc_of = [], [], []
    for d, text in enumerate(texts):  # bags of all texts at once would take much memory
        for words in bag(text):
            found = set()
            for w in words:
                if w not in known:
                    known[w] = [number[c] for c in candidates(w) if c in number]
                found.update(known[w])
            if found:
                sentence_of += [len(doc_of)] * len(found)
                cue_of += sorted(found)
                doc_of.append(d)
    s, c, d = (np.array(x, np.int64) for x in (sentence_of, cue_of, doc_of))
    y = np.array(toxic, float)
    weight = np.where(y > 0, class_weights[1], class_weights[0])
    weight = weight / weight.sum()
    theta = np.concatenate([np.full(len(cues), 1.0), [-3.0, -4.0]])  # weights, bias, logit of the leak
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    sigmoid = lambda z: 1 / (1 + np.exp(-np.clip(z, -30, 30)))
    for step in range(1, steps + 1):
        z = np.bincount(s, theta[c], len(d)) + theta[-2]
        q = sigmoid(z)
        leak = sigmoid(theta[-1])
        log_clean = np.bincount(d, np.log1p(-np.minimum(q, 1 - 1e-9)), len(y)) + math.log1p(-leak)
        clean = np.exp(log_clean)
        # d loss / d log_clean: 1 for a clean document's -log_clean, -clean / (1 - clean) for a toxic one's.
        slope = weight * np.where(y > 0, clean / np.maximum(1 - clean, 1e-9), -1.0)
        dz = slope[d] * -q
        grad = np.concatenate([np.bincount(c, dz[s], len(cues)), [dz.sum(), (slope * -leak).sum()]])
        grad[:-2] += 1e-5 * theta[:-2]
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        theta -= 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return Model({x: round(float(w), 6) for x, w in zip(cues, theta[:-2], strict=True)}, round(float(theta[-2]), 6), round(float(sigmoid(theta[-1])), 9))


def held_out(doc_id: Column) -> Column:
    """Whether crc32 of the id as text leaves no remainder by 5; a null id: false."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(5)) == 0, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """A model of the labelled documents that aren't held out, ``sample`` and SAMPLE_BYTES of each class at most.

    Labels without doc_id or toxic are left out; of several for one doc_id the largest counts, and of
    several texts the smallest.
    """
    known = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    sizes = {r["toxic"]: r["count"] for r in known.groupBy((F.col("toxic") == 1).alias("toxic")).count().collect()}
    parts = [known.where((F.col("toxic") == 1) == F.lit(y)).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample) for y in (True, False)]
    chosen = parts[0].unionByName(parts[1])
    named = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    # Ids and lengths first: they tell which texts the bound has room for.
    lengths = named.groupBy("doc_id", "toxic").agg(F.max(F.octet_length("text")).alias("size"), F.first(F.xxhash64("doc_id")).alias("order")).collect()
    room, kept = {True: SAMPLE_BYTES, False: SAMPLE_BYTES}, []
    for r in sorted(lengths, key=lambda r: (r["order"], r["doc_id"])):
        size = r["size"] or 0
        if size <= room[r["toxic"] == 1]:
            room[r["toxic"] == 1] -= size
            kept.append((r["doc_id"],))
    known_ids = docs.sparkSession.createDataFrame(kept, docs.select("doc_id").schema)
    rows = named.join(F.broadcast(known_ids), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.max("toxic").alias("toxic")).collect()
    rows.sort(key=lambda r: r["doc_id"])
    toxic = [r["toxic"] == 1 for r in rows]
    share = lambda y: sizes.get(y, 0) / max(toxic.count(y), 1)
    return train([r["text"] or "" for r in rows], toxic, (share(False), share(True)))


class Scorer:
    """Finds cues in one pass over a text with an Aho-Corasick automaton."""

    def __init__(self, model: Model):
        import ahocorasick

        self.model = model
        self.automaton = ahocorasick.Automaton()
        for cue, weight in model.weights.items():
            plain = cue.rstrip("*")
            old = self.automaton.get(plain, (len(plain), None, None))
            self.automaton.add_word(plain, (len(plain), old[1], weight) if cue.endswith("*") else (len(plain), weight, old[2]))
        self.automaton.make_automaton()

    def score(self, text: str) -> tuple[float, list[tuple[int, int, float]]]:
        """The text's score, and (start, end, score) of sentences that have cues."""
        low, model = lowered(text), self.model
        found: dict[tuple[int, str], float] = {}
        if model.weights:
            for end, (size, whole, begun) in self.automaton.iter(low):
                start = end + 1 - size
                if start and (low[start - 1].isalnum() or low[start - 1] == "_"):
                    continue
                if begun is not None:
                    found[start, low[start : end + 1] + "*"] = begun
                if whole is not None and not (end + 1 < len(low) and (low[end + 1].isalnum() or low[end + 1] == "_")):
                    found[start, low[start : end + 1]] = whole
        clean = 1 - model.leak
        spans = []
        if found:
            bounds = [m.start() for m in _sentence.finditer(low)] + [len(low)]
            cues: dict[int, dict[str, float]] = {}
            for (start, cue), weight in found.items():
                cues.setdefault(bisect.bisect_right(bounds, start) - 1, {})[cue] = weight
            for k, own in sorted(cues.items()):
                z = model.bias + sum(own.values())
                q = 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))
                clean *= 1 - q
                spans.append((bounds[k], bounds[k + 1], q))
        return 1 - clean, spans


_scorers: dict[str, Scorer] = {}


def _scorer(model: Model) -> Scorer:
    key = hashlib.sha256(repr(model).encode()).hexdigest()
    if key not in _scorers:
        _scorers.clear()
        _scorers[key] = Scorer(model)
    return _scorers[key]


KIND = "struct<score:double,sentences:array<struct<start:int,end:int,score:double>>>"
_KIND = pa.struct([("score", pa.float64()), ("sentences", pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())])))])


def scored(docs: DataFrame, model: Model, least: float = 0.5) -> DataFrame:
    """``docs`` with toxicity (0 to 1) and offending: (start, end, score) of sentences from ``least`` on, in characters.

    A null or empty text has no sentences and scores the leak alone. Other columns stay.
    """

    small_batches(docs.sparkSession)

    @F.arrow_udf(KIND)
    def score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        own = _scorer(model)
        for texts in batches:
            out: list[Any] = []
            for text in texts:
                value, spans = own.score(text.as_py() or "")
                out.append({"score": value, "sentences": [{"start": a, "end": b, "score": q} for a, b, q in spans if q >= least]})
            yield pa.array(out, _KIND)

    names = docs.drop("toxicity", "offending").columns
    return docs.select(*names, score("text").alias("__toxic")).select(*names, F.col("__toxic.score").alias("toxicity"), F.col("__toxic.sentences").alias("offending"))
