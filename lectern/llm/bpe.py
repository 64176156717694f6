"""Byte-pair encoding and decoding by prefix-sharing trie traversal.

A byte-pair encoding has a prefix property: the encoding of a word's first ``d`` bytes is the encoding
of its first ``d - len(t)`` bytes followed by one token ``t``, and exactly one token ``t`` fits, the one
whose pair with the token before it survives the merges. The last token of every prefix thus tells the
whole encoding. The distinct words of a slice of texts form a trie; a depth-first walk computes each
node's last token from those of its ancestors, once for all words that share the prefix.

There is no shuffle: words are looked up where their texts are, with a bounded memory of recent words.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Callable, Iterator
from itertools import chain, islice
from typing import Any

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from lectern.llm.common import slices, small_batches

#: How the byte-level splitter cuts a text before the merges.
SPLIT = r" ?\p{L}+| ?\p{N}+|'s|'t|'re|'ve|'m|'ll|'d| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Characters of which plain classes are known; texts without others are split by ``re``, twice as fast.
PLAIN_LETTER, PLAIN_SPACE = r"A-Za-z\xc0-\xd6\xd8-\xf6\xf8-\u024f", r"\t-\r \xa0"
NOT_PLAIN = rf"[^{PLAIN_LETTER}{PLAIN_SPACE}\x21-\x40\x5b-\x60\x7b-\x7e\xa1\xab\xbb\xbf\u2010-\u2027]"
PLAIN_SPLIT = rf" ?[{PLAIN_LETTER}]+| ?[0-9]+|'s|'t|'re|'ve|'m|'ll|'d| ?[^{PLAIN_LETTER}{PLAIN_SPACE}0-9]+|[{PLAIN_SPACE}]+(?![^{PLAIN_SPACE}])|[{PLAIN_SPACE}]+"
#: The vocabulary is broadcast; a file of more bytes is refused.
VOCABULARY_BYTES = 64 << 20
#: Words remembered by a worker, which forgets all of them when there are more. Bears on speed only.
REMEMBERED = 120_000
#: A text of more characters is cut into words lazily, a run of words at a time.
LONG_TEXT, RUN = 2_000_000, 200_000


def byte_letters() -> dict[str, int]:
    """The letters that byte-level vocabularies write for the 256 bytes."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


def read_vocabulary(path: str) -> dict[str, Any]:
    """Token bytes, merges and added tokens of a byte-level BPE file of the tokenizers library."""
    with open(path, encoding="utf-8") as file:
        text = file.read(VOCABULARY_BYTES + 1)
    if len(text) > VOCABULARY_BYTES:
        raise ValueError(f"{path}: vocabulary files of more than {VOCABULARY_BYTES} bytes aren't broadcast")
    data = json.loads(text)
    model, letters = data["model"], byte_letters()
    if model["type"] != "BPE" or data["normalizer"] or (data["pre_tokenizer"] or {}).get("type") != "ByteLevel":
        raise ValueError(f"{path}: not a byte-level BPE without normalizer")
    if data["pre_tokenizer"].get("add_prefix_space") or not data["pre_tokenizer"].get("use_regex", True) or model.get("ignore_merges") or model.get("dropout"):
        raise ValueError(f"{path}: unknown options")
    spelled = lambda token: bytes(letters[x] for x in token)
    pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
    return {
        "ids": {spelled(token): i for token, i in model["vocab"].items()},
        "merges": [(spelled(a), spelled(b)) for a, b in pairs],
        "added": {x["content"]: x["id"] for x in data["added_tokens"]},
        "digest": hashlib.sha256(text.encode()).hexdigest(),
    }


class Encoder:
    """Encodes words by the trie walk, texts by their words."""

    def __init__(self, vocabulary: dict[str, Any]):
        self.ids: dict[bytes, int] = vocabulary["ids"]
        self.added: dict[str, int] = vocabulary["added"]
        self.rank: dict[bytes, int] = {bytes([b]): b for b in range(256)}
        self.token: list[bytes] = [bytes([b]) for b in range(256)]
        self.halves: list[tuple[int, int]] = [(b, b) for b in range(256)]
        self.pairs: dict[tuple[int, int], int] = {}
        for a, b in vocabulary["merges"]:
            if a + b in self.rank:
                raise ValueError(f"{a + b!r} is the result of two merges")
            pair = self.rank[a], self.rank[b]
            self.pairs[pair] = self.rank[a + b] = len(self.token)
            self.token.append(a + b)
            self.halves.append(pair)
        self.longest = max(map(len, self.token))
        self.fits: dict[tuple[int, int], bool] = {}
        self.whole: dict[int, bool] = {}
        #: Words' ids as little-endian int32 bytes, ready to be joined.
        self.known: dict[str, bytes] = {}
        self.split, self.plain_split, self.odd = regex.compile(SPLIT), re.compile(PLAIN_SPLIT), re.compile(NOT_PLAIN)
        self.special = re.compile("(" + "|".join(re.escape(x) for x in sorted(self.added, key=len, reverse=True)) + ")") if self.added else None

    def merged(self, word: bytes) -> list[int]:
        """The ranks that the merges give, carried out one after another."""
        parts = list(word)
        while len(parts) > 1:
            best = min(((self.pairs[p], i) for i, p in enumerate(zip(parts, parts[1:], strict=False)) if p in self.pairs), default=None)
            if best is None:
                break
            pair, i, out = self.halves[best[0]], 0, []
            while i < len(parts):
                if i + 1 < len(parts) and (parts[i], parts[i + 1]) == pair:
                    out.append(best[0])
                    i += 2
                else:
                    out.append(parts[i])
                    i += 1
            parts = out
        return parts

    def is_whole(self, t: int) -> bool:
        """Whether the merges turn the token's own bytes into the token."""
        known = self.whole.get(t)
        if known is None:
            known = self.whole[t] = self.merged(self.token[t]) == [t]
        return known

    def is_pair(self, a: int, b: int) -> bool:
        """Whether tokens a and b, side by side, survive the merges.

        Undo the merges of the two that face each other, latest first: no pair that then touches may
        have a merge that comes before the merge just undone.
        """
        left, right, limit, good = a, b, 1 << 60, True
        while True:
            rank = self.pairs.get((left, right))
            if rank is not None and rank < limit:
                good = False
                break
            if left > right or right < 256:
                if left < 256:
                    break
                limit, left = left, self.halves[left][1]
            else:
                limit, right = right + 1, self.halves[right][0]
        if len(self.fits) > REMEMBERED:
            self.fits.clear()
        self.fits[a, b] = good
        return good

    def walk(self, words: list[bytes]) -> Iterator[tuple[bytes, bytes]]:
        """(word, its ids as bytes) of distinct words, by one depth-first walk over their trie.

        In sorted order the words spell out their trie depth first: a word's branch leaves the one before
        at the length of their common prefix, and only the nodes below that are new. The states of the
        nodes on the current path, the last token's start and rank, stand in two lists.
        """
        deepest = max(map(len, words), default=0)
        last, begin = [0] * (deepest + 1), [0] * (deepest + 1)
        rank, fits, whole, longest = self.rank.get, self.fits.get, self.whole.get, self.longest
        own = [self.ids[x].to_bytes(4, "little") for x in self.token]
        before = b""
        for word in sorted(words):
            size, shared = len(word), 0
            for a, b in zip(before, word, strict=False):
                if a != b:
                    break
                shared += 1
            before = word
            for depth in range(shared + 1, size + 1):
                # Exactly one token fits, so the order of trying is free: the parent's token, grown, comes first.
                near = begin[depth - 1]
                for start in chain((near,), range(depth - 1, near, -1), range(near - 1, max(depth - longest, 0) - 1, -1)):
                    t = rank(word[start:depth])
                    if t is None:
                        continue
                    if start:
                        fit = fits((last[start], t))
                        if fit is None:
                            fit = self.is_pair(last[start], t)
                        if not fit:
                            continue
                    if whole(t) or self.is_whole(t):
                        last[depth], begin[depth] = t, start
                        break
            found, end = [], size
            while end:
                found.append(own[last[end]])
                end = begin[end]
            found.reverse()
            yield word, b"".join(found)

    def words(self, text: str) -> Iterator[list[str]]:
        """The text's words and added tokens, in runs of a bounded number."""
        if self.special is not None and any(x in text for x in self.added):
            parts = self.special.split(text)
        else:
            parts = [text]
        for part in parts:
            split = self.split if self.odd.search(part) else self.plain_split
            if part in self.added:
                yield [part]
            elif len(part) <= LONG_TEXT:
                yield split.findall(part)
            else:
                found = (m.group() for m in split.finditer(part))
                while run := list(islice(found, RUN)):
                    yield run

    def learn(self, runs: list[list[str]]) -> None:
        """Have the encodings of these words at hand."""
        known = self.known
        new = list({w for words in runs for w in words if w not in known})
        if len(known) + len(new) > REMEMBERED:
            known.clear()
            new = list(set(chain.from_iterable(runs)))
        for word, i in self.added.items():
            known[word] = i.to_bytes(4, "little")
        for word, found in self.walk([w.encode() for w in new if w not in self.added]):
            known[word.decode()] = found

    def encode(self, texts: list[str]) -> list[bytes]:
        """Token ids of each text, as little-endian int32 bytes."""
        out: list[bytes] = []
        for start, end in slices(texts):
            if end - start == 1:
                runs = []
                for words in self.words(texts[start]):
                    self.learn([words])
                    runs.append(b"".join(map(self.known.__getitem__, words)))
                out.append(b"".join(runs))
                continue
            split = [list(chain.from_iterable(self.words(x))) for x in texts[start:end]]
            self.learn(split)
            out += [b"".join(map(self.known.__getitem__, words)) for words in split]
        return out


_encoders: dict[str, Encoder] = {}


def _encoder(vocabulary: dict[str, Any]) -> Encoder:
    """The worker's encoder for a vocabulary; workers serve many tasks, each of which may load it anew."""
    key = vocabulary["digest"]
    if key not in _encoders:
        _encoders.clear()
        _encoders[key] = Encoder(vocabulary)
    return _encoders[key]


def _id_arrays(found: list[bytes]) -> pa.Array:
    ends = np.cumsum([0, *(len(x) // 4 for x in found)])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.frombuffer(b"".join(found), "<i4"), pa.int32()))


class Decoder:
    """Texts of ids."""

    def __init__(self, vocabulary: dict[str, Any]):
        token = {i: t for t, i in vocabulary["ids"].items()} | {i: t.encode() for t, i in vocabulary["added"].items()}
        self.pieces = [token.get(i, b"") for i in range(max(token) + 1)]

    def text(self, ids: list[int]) -> str:
        try:
            return b"".join(map(self.pieces.__getitem__, ids)).decode("utf-8", "replace")
        except IndexError:
            return b"".join(self.pieces[i] for i in ids if i < len(self.pieces)).decode("utf-8", "replace")


def codec(spark: SparkSession, path: str) -> tuple[Callable[[Column], Column], Callable[[Column], Column]]:
    """``(encode, decode)`` column functions for the byte-level BPE file at ``path`` (read on the driver).

    ``encode(text)``: array of token ids, as the tokenizers library gives without special tokens added;
    the strings of added tokens in a text become those tokens. A null or empty text has no ids.
    ``decode(ids)``: the text of the ids, special tokens included; bytes that are no UTF-8 become
    U+FFFD; null: empty; an id that the vocabulary lacks: nothing.
    """
    small_batches(spark)
    vocabulary = spark.sparkContext.broadcast(read_vocabulary(path))

    @F.arrow_udf("array<int>")
    def encode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        own = _encoder(vocabulary.value)
        for texts in batches:
            yield _id_arrays(own.encode([x or "" for x in texts.to_pylist()]))

    @F.arrow_udf("string")
    def decode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        own = Decoder(vocabulary.value)
        for ids in batches:
            yield pa.array([own.text(x.values.to_numpy(zero_copy_only=False).tolist() if x.is_valid else []) for x in ids], pa.string())

    return encode, decode


def round_trip(spark: SparkSession, path: str) -> Callable[[Column], Column]:
    """A column function: struct(ids, decoded), what ``encode`` gives for a text and ``decode`` for these ids, in one worker."""
    small_batches(spark)
    vocabulary = spark.sparkContext.broadcast(read_vocabulary(path))

    @F.arrow_udf("struct<ids:array<int>,decoded:string>")
    def both(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        encoder, decoder = _encoder(vocabulary.value), Decoder(vocabulary.value)
        for texts in batches:
            found = encoder.encode([x or "" for x in texts.to_pylist()])
            decoded = pa.array([decoder.text(np.frombuffer(x, "<i4").tolist()) for x in found], pa.string())
            yield pa.StructArray.from_arrays([_id_arrays(found), decoded], ["ids", "decoded"])

    return both
