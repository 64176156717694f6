"""Near-duplicates by BagMinHash signatures of word-shingle multisets.

A text is the multiset of its five-word shingles; similarity is the weighted Jaccard index, shared count over
joint count. Every shingle runs Poisson processes of points (time, place on its weight axis, register): one
for each dyadic block (0,1], (1,2], (2,4], ... of the axis below its weight, the last thinned to places below the
weight. A register keeps its earliest point; two texts agree in a register with the probability of their
similarity. Points are drawn, in growing portions, only while they come before a text's latest register.

Registers are banded. Texts that share a band are candidates; candidates are verified on their whole
bags of shingles. First each text is verified with one text, the smallest of the band that it shares with most.
Then every band whose texts are not all in one class by then is dealt out in blocks of bounded size, and pairs of
blocks are compared on signatures; what has a likely partner in another class gets its bag and is
verified in the same pair of blocks, which keeps classes of its own and hands on the links that join two of them.
So what leaves a pair of blocks is never more than its texts. Classes are the connected components of all links.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, DoubleType, LongType, StructField, StructType

from lectern.llm.common import WORD, ascii_lower, forget, joined, settle, slices, small_batches
from lectern.llm.decontamination import grams, word_hashes, words_of

SHINGLE, SIMILARITY = 5, 0.8
#: 32 bands of 5 registers: a pair at similarity 0.8 shares none with probability 3e-6.
BANDS, ROWS = 32, 5
REGISTERS = BANDS * ROWS
#: Signatures that agree in less than this share (over four standard errors below 0.8) aren't verified.
LIKELY = 0.66
#: Texts, and bytes of their bags, of a band in one block of the pairwise comparison.
BLOCK, BLOCK_BYTES = 1024, 32 << 20
#: Links of 16 bytes that are united in one task.
FEW_LINKS = 200_000

_U = np.uint64
_GOLDEN, _SILVER = 0x9E3779B97F4A7C15, 0xD1B54A32D192ED03


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def shingles(words: list[str]) -> np.ndarray:
    """Hashes of the text's five-word shingles, repeats included; of fewer words: of all of them at once."""
    hashes = word_hashes(words)
    return grams(hashes, min(SHINGLE, len(words))) if words else np.zeros(0, np.uint64)


def tagged(hashes: np.ndarray) -> np.ndarray:
    """A multiset of hashes as a sorted set: the n-th of equal ones is hashed with n."""
    own = np.sort(hashes)
    if len(own) < 2:
        return own
    first = np.r_[True, own[1:] != own[:-1]]
    at = np.arange(len(own))
    nth = at - np.maximum.accumulate(np.where(first, at, 0))
    if not nth.any():
        return own
    with np.errstate(over="ignore"):
        return np.sort(np.where(nth > 0, _mix(own + nth.astype(_U) * _U(_GOLDEN)), own))


def shared(one: np.ndarray, others: list[np.ndarray]) -> np.ndarray:
    """Weighted Jaccard index of a tagged bag and each of the others; of two empty ones: 0."""
    sizes = np.array([len(x) for x in others], np.int64)
    both = np.zeros(len(others), np.int64)
    if len(one) and sizes.any():
        every = np.concatenate(others)
        found = one[np.minimum(np.searchsorted(one, every), len(one) - 1)] == every
        both = np.diff(np.r_[0, np.cumsum(found)][np.r_[0, np.cumsum(sizes)]])
    joint = len(one) + sizes - both
    return np.where(joint > 0, both / np.maximum(joint, 1), 0.0)


def overlap(a: str | None, b: str | None) -> float:
    """Weighted Jaccard index of two texts' shingle multisets; of texts without words: 0."""
    return float(shared(tagged(shingles(words_of(a))), [tagged(shingles(words_of(b)))])[0])


def signatures(bags: list[np.ndarray], m: int = REGISTERS) -> np.ndarray:
    """BagMinHash registers, one row of m times for each multiset of hashes; infinite for an empty one."""
    registers = np.full(len(bags) * m, np.inf)
    doc = np.repeat(np.arange(len(bags)), [len(b) for b in bags])
    if not len(doc):
        return registers.reshape(len(bags), m)
    with np.errstate(over="ignore"):
        seed = np.concatenate(bags)
        order = np.lexsort((seed, doc))
        doc, seed = doc[order], seed[order]
        first = np.flatnonzero(np.r_[True, (doc[1:] != doc[:-1]) | (seed[1:] != seed[:-1])])
        weight = np.diff(np.r_[first, len(doc)])
        doc, seed = doc[first], seed[first]
        parts = []
        low, high, level = 0, 1, 0
        while len(doc):
            parts.append((doc, _mix(seed + _U(((level + 1) * _GOLDEN) & (1 << 64) - 1)), np.full(len(doc), high - low), np.minimum(weight, high) - low))
            low, high, level = high, high * 2, level + 1
            more = weight > low
            doc, seed, weight = doc[more], seed[more], weight[more]
        doc, seed, length, below = map(np.concatenate, zip(*parts, strict=True))
        time, drawn, portion = np.zeros(len(doc)), 0, 1
        while len(doc):
            count = (np.arange(drawn + 1, drawn + 1 + portion).astype(_U))[None, :]
            u = _mix(seed[:, None] + count * _U(_GOLDEN))
            v = _mix((seed[:, None] ^ _U(_SILVER)) + count * _U(_SILVER))
            step = -np.log(((u >> _U(11)).astype(float) + 0.5) * 2.0**-53) / (m * length[:, None])
            times = time[:, None] + np.cumsum(step, axis=1)
            register = (v >> _U(32)) % _U(m)
            place = ((v & _U(0xFFFFFFFF)) * length[:, None].astype(_U)) >> _U(32)
            latest = registers.reshape(-1, m).max(axis=1)
            use = (place < below[:, None].astype(_U)) & (times < latest[doc][:, None])
            at = (doc[:, None] * m + register.astype(np.int64))[use]
            np.minimum.at(registers, at, times[use])
            time = times[:, -1]
            on = time < registers.reshape(-1, m).max(axis=1)[doc]
            doc, seed, length, below, time = doc[on], seed[on], length[on], below[on], time[on]
            drawn += portion
            portion = min(64, portion * 2) if drawn > 2 else 1
    return registers.reshape(len(bags), m)


_SIGNED = pa.struct([("signature", pa.binary()), ("size", pa.int64())])


@F.arrow_udf(StructType([StructField("signature", BinaryType()), StructField("size", LongType())]))
def signed(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """16 bits of each register, and the bytes of the bag; null for a text without words."""
    for texts in batches:
        out: list[Any] = []
        texts = texts.to_pylist()
        for start, end in slices(texts):
            bags = [shingles(words_of(x)) for x in texts[start:end]]
            with np.errstate(over="ignore"):
                short = (_mix(signatures(bags).view(np.uint64)) >> _U(48)).astype(np.uint16)
            out += [{"signature": s.tobytes(), "size": 8 * len(bag)} if len(bag) else None for bag, s in zip(bags, short, strict=True)]
        yield pa.array(out, _SIGNED)


def banded(nodes: DataFrame, *columns: str) -> DataFrame:
    """The columns, one row for each band of the signature, with ``band``: a hash of its number and registers."""
    own = F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda k: F.xxhash64(k, F.substring(F.col("signature"), k * (2 * ROWS) + 1, F.lit(2 * ROWS))))
    return nodes.select(*columns, F.posexplode(own).alias("number", "band"))


@F.arrow_udf(BinaryType())
def bagged(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """Tagged bags of shingles, eight bytes for each shingle."""
    for texts in batches:
        yield pa.array([tagged(shingles(words_of(x.as_py()))).tobytes() for x in texts], pa.binary())


@F.arrow_udf(DoubleType())
def similarity(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
    """Weighted Jaccard index of two columns of bags."""
    bag = lambda x: np.frombuffer(x.as_buffer(), np.uint64)
    for a, b in batches:
        yield pa.array([float(shared(bag(x), [bag(y)])[0]) for x, y in zip(a, b, strict=True)], pa.float64())


def _united(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, root) for all links (a, b) of one task: the smallest id of each component."""
    links = [np.stack([b["a"].to_numpy(), b["b"].to_numpy()]) for b in batches]
    ids, of = np.unique(np.concatenate(links, axis=1) if links else np.zeros((2, 0), np.int64), return_inverse=True)
    up = list(range(len(ids)))

    def found(k: int) -> int:
        while up[k] != k:
            up[k] = k = up[up[k]]
        return k

    for a, b in of.reshape(2, -1).T.tolist():
        a, b = found(a), found(b)
        up[max(a, b)] = min(a, b)  # ids are in order, so the smallest is the root
    roots = ids[[found(k) for k in range(len(ids))]] if len(ids) else ids
    yield pa.record_batch({"id": pa.array(ids, pa.int64()), "root": pa.array(roots, pa.int64())})


def components(links: DataFrame) -> DataFrame:
    """(id, root) of every id in ``links`` (a, b): the smallest id that it is connected with.

    Up to FEW_LINKS links are united in one task, which holds no more than these. Of more, each component hooks on to
    its smallest neighbour, paths are halved until they reach a root, and links inside components go; at least half of
    the linked components go in each turn.
    """
    links = links.select("a", "b").where("a <> b")
    if links.count() <= FEW_LINKS:
        return settle(links.repartition(1).mapInArrow(_united, "id bigint, root bigint"), "roots")
    edges = settle(links.select("a", "b").union(links.select("b", "a")).where("a <> b").distinct(), "edges")
    roots = settle(edges.select(F.col("a").alias("id"), F.col("a").alias("root")).distinct(), "roots")
    while not edges.isEmpty():
        parents = settle(edges.groupBy("a").agg(F.least("a", F.min("b")).alias("p")), "parents")
        while True:
            up = parents.select(F.col("a").alias("p"), F.col("p").alias("q"))
            jumped = settle(parents.join(up, "p").select("a", F.col("q").alias("p"), (F.col("q") != F.col("p")).alias("moved")), "parents")
            forget(parents)
            parents = jumped
            if jumped.where("moved").isEmpty():
                break
        of = parents.select(F.col("a").alias("root"), F.col("p").alias("new"))
        last, roots = roots, settle(roots.join(of, "root", "left").select("id", F.coalesce("new", "root").alias("root")), "roots")
        a, b = parents.select("a", F.col("p").alias("x")), parents.select(F.col("a").alias("b"), F.col("p").alias("y"))
        before, edges = edges, settle(edges.join(a, "a").join(b, "b").where("x <> y").select(F.col("x").alias("a"), F.col("y").alias("b")).distinct(), "edges")
        forget(last, before, parents)
    forget(edges)
    return roots


def _cells(nodes: DataFrame, roots: DataFrame) -> DataFrame:
    """(band, number, x, y, id, root, signature, block): the texts of every pair of blocks with pairs across classes.

    Texts of a band's largest class meet those of the others only, never each other, so that one large class costs
    a row for each of its texts and block of others.
    """
    named = nodes.select("id", "signature", "size").join(roots, "id", "left").withColumn("root", F.coalesce("root", "id"))
    named = banded(named, "id", "root", "size")
    sizes = named.groupBy("band", "root").agg(F.count("*").alias("n"), F.sum("size").alias("bytes"))
    by_band = sizes.groupBy("band").agg(
        F.sum("n").alias("n"), F.sum("bytes").alias("bytes"), F.max("n").alias("most"), F.max_by(F.struct("root", "bytes"), F.struct("n", "root")).alias("major")
    )
    in_blocks = lambda n, size: F.greatest(F.ceil(n / BLOCK), F.ceil(size / BLOCK_BYTES), F.lit(1)).cast("int")
    mixed = by_band.where("n > most").select(
        "band",
        "n",
        F.col("major.root").alias("major"),
        in_blocks(F.col("most"), F.col("major.bytes")).alias("most"),
        in_blocks(F.col("n") - F.col("most"), F.col("bytes") - F.col("major.bytes")).alias("rest"),
    )
    open_ = joined(named.drop("size"), settle(mixed, "mixed"), "band").drop("n").join(nodes.select("id", "signature"), "id")
    major, dealt_to = F.col("root") == F.col("major"), lambda n: F.pmod(F.xxhash64("id"), n).cast("int")
    block = F.when(major, F.col("rest") + dealt_to(F.col("most"))).otherwise(dealt_to(F.col("rest")))
    others = F.sequence(F.lit(0), F.when(major, F.col("rest")).otherwise(F.col("rest") + F.col("most")) - 1)
    pairs = F.transform(others, lambda k: F.struct(F.least(k, F.col("block")).alias("x"), F.greatest(k, F.col("block")).alias("y")))
    return open_.withColumn("block", block).select("band", "number", "id", "root", "signature", "block", F.inline(pairs))


def _whole_cells(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Runs of whole cells of a partition sorted by cell, with the number of each row's cell within the run.

    Held at a time: the rows of one batch and of one cell.
    """
    held: list[pa.RecordBatch] = []

    def numbers(rows: pa.Table) -> np.ndarray:
        at = np.stack([rows[c].to_numpy() for c in ("band", "x", "y")])
        return np.cumsum(np.r_[False, (at[:, 1:] != at[:, :-1]).any(axis=0)])

    for batch in batches:
        if batch.num_rows:
            held.append(batch)
            rows = pa.Table.from_batches(held)
            cell = numbers(rows)
            end = int(np.searchsorted(cell, cell[-1]))
            if end:
                yield rows.slice(0, end), cell[:end]
                held = rows.slice(end).to_batches()
    if held:
        rows = pa.Table.from_batches(held)
        yield rows, numbers(rows)


def _likely(rows: pa.Table, cell: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(i, j, agreement): rows of one cell, but of two classes, that likely resemble each other, i < j.

    Only pairs whose first shared band this is: every pair is met in one cell. Every row is compared with the next
    one of its cell, then with the one after that, and so on, all rows at once.
    """
    s = np.frombuffer(b"".join(rows["signature"].to_pylist()), np.uint16).reshape(len(cell), REGISTERS)
    own, part, number = (rows[c].to_numpy() for c in ("root", "block", "number"))
    crossing = rows["x"].to_numpy() != rows["y"].to_numpy()
    found = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
    i = np.arange(len(cell))
    for step in range(1, len(cell)):
        i = i[: np.searchsorted(i, len(cell) - step)]
        i = i[cell[i] == cell[i + step]]  # a row that has no such follower has none further on
        if not len(i):
            break
        a = i[(own[i] != own[i + step]) & ~(crossing[i] & (part[i] == part[i + step]))]
        b = a + step
        agree = (s[a] == s[b]).mean(axis=1)
        likely = agree >= LIKELY
        a, b, agree = a[likely], b[likely], agree[likely]
        if len(a):
            same = (s[a].reshape(-1, BANDS, ROWS) == s[b].reshape(-1, BANDS, ROWS)).all(axis=2)
            first = same.argmax(axis=1) == number[a]
            found.append((a[first], b[first], agree[first]))
    a, b, agree = map(np.concatenate, zip(*found, strict=True))
    return a, b, agree


_PLACE = pa.schema([("band", pa.int64()), ("x", pa.int32()), ("y", pa.int32()), ("id", pa.int64())])


def _with_partner(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The places (band, x, y, id) of texts that have a likely partner of another class in their cell."""
    for rows, cell in _whole_cells(batches):
        a, b, _ = _likely(rows, cell)
        yield from rows.select(_PLACE.names).take(pa.array(np.union1d(a, b))).cast(_PLACE).to_batches()


def _linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links (a, b) of similar texts that join two classes of a cell: fewer than the cell has classes."""
    for rows, cell in _whole_cells(batches):
        a, b, agree = _likely(rows, cell)
        bags = [np.frombuffer(x.as_buffer(), np.uint64) for x in rows["bag"]]  # where they lie in the batches
        ids = rows["id"].to_numpy()
        of = np.unique(np.stack([cell, rows["root"].to_numpy()]), axis=1, return_inverse=True)[1].reshape(-1)
        up = list(range(len(cell)))

        def found(k: int, up: list[int] = up) -> int:
            while up[k] != k:
                up[k] = k = up[up[k]]
            return k

        links = []
        for k in np.argsort(-agree, kind="stable").tolist():
            i, j = int(a[k]), int(b[k])
            x, y = found(int(of[i])), found(int(of[j]))
            small, large = sorted((bags[i], bags[j]), key=len)
            # Of sizes whose ratio is below the threshold the index is, too.
            if x != y and len(small) >= SIMILARITY * len(large) and shared(large, [small])[0] >= SIMILARITY:
                up[x] = y
                links.append((ids[i], ids[j]))
        if links:
            one, other = zip(*links, strict=True)
            yield pa.record_batch({"a": pa.array(one, pa.int64()), "b": pa.array(other, pa.int64())})


def classes(docs: DataFrame, text: str = "text") -> DataFrame:
    """(key, root_key): for the md5 of every text with words, the md5 that stands for its class.

    Equal texts have equal keys, so copies cost nothing here. Texts without words have no row.
    """
    small_batches(docs.sparkSession)
    keyed = docs.where(F.col(text).isNotNull()).select(F.md5(F.col(text).cast("binary")).alias("key"), F.col(text).alias("text"))
    # Nulls go after the aggregate: a filter before it would be moved below, where it signs every text a second time.
    signs = keyed.select("key", signed("text").alias("s")).groupBy("key").agg(F.first("s").alias("s")).where("s is not null")
    nodes = settle(signs.select("key", F.monotonically_increasing_id().alias("id"), "s.signature", "s.size"), "nodes")
    centres = settle(banded(nodes, "id").groupBy("band").agg(F.min("id").alias("b"), F.count("*").alias("n")).where("n > 1"), "centres")
    met = joined(banded(nodes, "id"), centres, "band").groupBy("id", "b").agg(F.count("*").alias("bands"), F.max("n").alias("n"))
    best = met.groupBy(F.col("id").alias("a")).agg(F.max_by(F.struct("b", "n"), F.struct("bands", -F.col("b"))).alias("x")).select("a", "x.b", "x.n")
    best = settle(best, "best")  # of every text that shares a band, centres too
    # Copies are reduced to one before the exchange, which serves the join too.
    wanted = nodes.join(best.select(F.col("a").alias("id")), "id").select("key", "id")
    bags = settle(keyed.groupBy("key").agg(F.first("text").alias("text")).join(wanted, "key").select("id", bagged("text").alias("bag")), "bags")

    # A centre's bag is met by the texts in as many parts as they fill blocks.
    parts = F.ceil(F.col("n") / BLOCK).cast("int")
    pairs = best.where("a <> b").withColumn("part", F.pmod(F.xxhash64("a"), parts).cast("int"))
    spread = pairs.groupBy("b").agg(F.max(parts).alias("parts")).join(bags.withColumnRenamed("id", "b"), "b").select("b", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.col("bag").alias("bag_b"))
    tried = pairs.join(bags.withColumnRenamed("id", "a"), "a").join(spread, ["b", "part"]).select("a", "b", similarity("bag", "bag_b").alias("similarity"))
    links = settle(tried.where(F.col("similarity") >= SIMILARITY).select("a", "b"), "links")
    roots = components(links)

    cells = settle(_cells(nodes, roots), "cells")
    at = ["band", "x", "y"]
    together = lambda df: df.repartition(*at).sortWithinPartitions(*at, "id")
    partners = settle(together(cells).mapInArrow(_with_partner, "band bigint, x int, y int, id bigint"), "partners")
    likely = cells.join(partners, [*at, "id"]).join(bags, "id")
    late = together(likely).mapInArrow(_linked, "a bigint, b bigint")
    every = settle(links.unionByName(late), "links")
    forget(centres, best, bags, links, roots, cells, partners)
    roots = components(every)
    names = nodes.select("id", "key")
    of = names.join(roots, "id", "left").select("key", F.coalesce("root", "id").alias("root"))
    out = settle(of.join(names.select(F.col("id").alias("root"), F.col("key").alias("root_key")), "root").select("key", "root_key"), "classes")
    forget(nodes, every, roots)
    return out


def grouped(docs: DataFrame) -> DataFrame:
    """``docs`` with class_id (the smallest doc_id of the class) and class_key, the class's own name.

    Classes are connected components of pairs with similarity 0.8 or more. A text without words (null,
    empty) is in no class: class_key is null and class_id its own doc_id. A class without any doc_id has a null class_id.
    """
    found = classes(docs)
    names = docs.drop("class_id", "class_key").columns
    keyed = docs.select(*names, F.md5(F.col("text").cast("binary")).alias("__key"))
    own = keyed.where("__key is not null").groupBy("__key").agg(F.min("doc_id").alias("least"), F.count("*").alias("rows"))
    own = settle(own.join(found.withColumnRenamed("key", "__key"), "__key", "left"), "least")
    named = settle(own.where("root_key is not null").groupBy("root_key").agg(F.min("least").alias("class_id"), F.count("*").alias("n")), "named")
    in_class = joined(own.where("root_key is not null"), named, "root_key").select("__key", "rows", "class_id", F.col("root_key").alias("class_key"))
    alone = F.lit(None).cast("bigint").alias("class_id"), F.lit(None).cast("string").alias("class_key")
    of = settle(in_class.unionByName(own.where("root_key is null").select("__key", "rows", *alone)).withColumnRenamed("rows", "n"), "of")
    out = joined(keyed.where("__key is not null"), of, "__key").select(*names, "class_id", "class_key")
    out = out.unionByName(keyed.where("__key is null").select(*names, *alone))
    return out.withColumn("class_id", F.when(F.col("class_key").isNull(), F.col("doc_id")).otherwise(F.col("class_id")))


def unique(docs: DataFrame) -> DataFrame:
    """One row of each class: the one with the smallest doc_id (null first), of equal ones any; columns stay.

    Texts without words are in no class and all stay. Full rows go through one exchange, on text key and doc_id.
    """
    found = classes(docs)
    has_words = F.coalesce(ascii_lower(F.col("text")).rlike(WORD), F.lit(False))
    keyed = docs.withColumn("__key", F.md5(F.col("text").cast("binary")))
    least = keyed.groupBy("__key").agg(F.min(F.struct("doc_id")).alias("x"))
    winners = least.join(found, F.col("__key") == F.col("key")).groupBy("root_key").agg(F.min(F.struct("x.doc_id", "key")).alias("w"))
    chosen = settle(winners.select(F.col("w.key").alias("__k"), F.col("w.doc_id").alias("__d")), "chosen")
    kept = keyed.where(has_words).join(chosen, (F.col("__key") == F.col("__k")) & F.col("doc_id").eqNullSafe(F.col("__d")), "left_semi")
    return kept.dropDuplicates(["__key", "doc_id"]).drop("__key").unionByName(docs.where(~has_words))
