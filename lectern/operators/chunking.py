"""Sentences, chunks for speech synthesis, and what goes with each chunk."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.functions import plain as P
from lectern.functions import text as T
from lectern.functions.patterns import ABBREVIATIONS, HEADING_PAUSE, OPENS, QUOTE_PAUSE, SPACE, SPACES
from lectern.functions.text import replace, strip
from lectern.operators.chapters import separate_heading

SIZE, WORDS, LEAST = 300, 150, 10
#: Sentences that a fold appends to one array before it begins the next; bears on speed only.
BLOCK = 256
#: Characters of texts after which a worker hands over their chunks; bears on memory only.
HANDED = 1 << 20
TITLE_MS, HEADING_MS, QUOTE_MS, QUOTE_END_MS = 2500, 2000, 1000, 1500


def sentences(text: Column) -> Column:
    """Cut after ``.!?…`` before a capital, a dash or an opening mark; not inside nor beside quotes."""
    cut = lambda x: replace(x, rf"([.!?…]){SPACE}++(?=[{OPENS}])", "$1\x01")
    marked = replace(text, '([„"][^"]*+")', "\x02$1\x02")
    joined = F.array_join(F.transform(F.split(marked, "\x02"), lambda x, i: F.when(i % 2 == 0, cut(x)).otherwise(x)), "")
    # Without this mark there is no quote.
    whole = F.when(F.contains(text, F.lit('"')), joined).otherwise(cut(text))
    return F.filter(F.transform(F.split(whole, "\x01"), strip), lambda x: x != "")


def _numbered(text: Column) -> Column:
    """Whether the text is a number with a full stop."""
    return F.substring(text, 1, 1).between("0", "9") & text.rlike(rf"^[0-9]++\.{SPACE}*+\z")


def _shortened(text: Column) -> Column:
    """Whether the text ends with an abbreviation or an initial (also a digit) and a full stop."""

    def told(word: Column) -> Column:
        return F.array_contains(F.array(*map(F.lit, ABBREVIATIONS)), F.lower(word)) | ((F.length(word) == 1) & (F.upper(word) == word))

    # Of a longer word the end will do.
    tail = F.right(F.rtrim(text, F.lit(SPACES)), F.lit(max(map(len, ABBREVIATIONS)) + 2))
    return F.exists(F.array(F.regexp_extract(tail, r"([\p{L}\p{N}_]+)\.\z", 1)), told)


def abbrev_ending(text: Column) -> Column:
    """Whether the text ends with an abbreviation, an initial (also a digit), or is a number with a full stop."""
    return _numbered(text) | _shortened(text)


def _folded(items: Column, start: Column, step: Callable[[Column, Column], Column]) -> Column:
    """struct(out, state): ``step`` over all items, as ``aggregate`` does, with what each run of BLOCK items has put in ``out``.

    ``start`` and what ``step`` returns are structs with a field ``out``, an array of strings, and others. As an append copies its array,
    ``out`` begins anew with each run; else a text's cost would grow with the square of its length.
    """

    def over(all_: Column) -> Column:
        runs = F.sequence(F.lit(0), F.greatest(F.ceil(F.size(all_) / BLOCK).cast("int") - 1, F.lit(0)))
        nothing = F.array().cast("array<string>")
        begin = F.struct(F.array().cast("array<array<string>>").alias("done"), start.withField("out", nothing).alias("state"))

        def run(a: Column, k: Column) -> Column:
            state = F.aggregate(F.slice(all_, k * BLOCK + 1, F.lit(BLOCK)), a["state"].withField("out", nothing), step)
            return F.struct(F.array_append(a["done"], a["state"]["out"]).alias("done"), state.alias("state"))

        end = lambda a: F.struct(F.concat(F.flatten(a["done"]), a["state"]["out"]).alias("out"), a["state"].alias("state"))
        return F.aggregate(runs, begin, run, end)

    return F.transform(F.array(items), over)[0]


def merge_abbrev(parts: Column) -> Column:
    """Sentences that end in an abbreviation take the next one in.

    What stands before a sentence's last word doesn't bear on that word, so each sentence is looked at once; only whether it is a
    number and nothing else depends on what it has been joined to.
    """
    told = F.transform(parts, lambda s: F.struct(s.alias("s"), _shortened(s).alias("open"), _numbered(s).alias("number")))
    state = F.struct(F.array().cast("array<string>").alias("out"), F.lit(None).cast("string").alias("cur"), F.lit(False).alias("open"))

    def step(a: Column, x: Column) -> Column:
        first = a["cur"].isNull()
        out = F.when(first | a["open"], a["out"]).otherwise(F.array_append(a["out"], a["cur"]))
        cur = F.when(~first & a["open"], F.concat(a["cur"], F.lit(" "), x["s"])).otherwise(x["s"])
        return F.struct(out.alias("out"), cur.alias("cur"), (x["open"] | (x["number"] & (first | ~a["open"]))).alias("open"))

    last = lambda r: F.when(r["state"]["cur"].isNull(), r["out"]).otherwise(F.array_append(r["out"], r["state"]["cur"]))
    return F.transform(F.array(_folded(told, state, step)), last)[0]


def has_pause(text: Column) -> Column:
    return F.contains(text, F.lit(HEADING_PAUSE)) | F.contains(text, F.lit(QUOTE_PAUSE))


def pack_chunks(parts: Column, size: int = SIZE, most_words: int = WORDS) -> Column:
    """Sentences packed in order while they fit; one with a pause mark stands alone; chunks under 10 characters go."""
    told = F.transform(parts, lambda s: F.struct(s.alias("s"), F.length(s).alias("size"), T.word_count(s).alias("n"), has_pause(s).alias("mark")))
    state = F.struct(F.array().cast("array<string>").alias("out"), F.lit("").alias("cur"), F.lit(0).alias("n"))

    def step(a: Column, x: Column) -> Column:
        empty = a["cur"] == ""
        full = (F.length(a["cur"]) + x["size"] + 1 > size) | (a["n"] + x["n"] > most_words)
        flushed = F.when(empty, a["out"]).otherwise(F.array_append(a["out"], a["cur"]))
        out = F.when(x["mark"], F.array_append(flushed, x["s"])).when(~empty & full, flushed).otherwise(a["out"])
        cur = F.when(x["mark"], F.lit("")).when(empty | full, x["s"]).otherwise(F.concat(a["cur"], F.lit(" "), x["s"]))
        return F.struct(out.alias("out"), cur.alias("cur"), F.when(x["mark"], F.lit(0)).when(empty | full, x["n"]).otherwise(a["n"] + x["n"]).alias("n"))

    last = lambda r: F.filter(F.concat(r["out"], F.array(r["state"]["cur"])), lambda c: F.length(c) >= LEAST)
    return F.transform(F.array(_folded(told, state, step)), last)[0]


def text_chunks(text: Column, size: int = SIZE, raw: bool = False) -> Column:
    """array of the text's chunks: ``pack_chunks`` of ``merge_abbrev`` of ``sentences``, in one pass. raw: of a text that isn't cleaned and whose quotes aren't annotated yet."""

    def cut(t: str) -> list[str]:
        t = P.annotate_quotes(P.clean_text(t)) if raw else t
        return P.pack_chunks(P.merge_abbrev(P.sentences(t)), size, WORDS, LEAST)

    @F.arrow_udf("array<string>")
    def chunked(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            out, held = [], 0
            for value in texts:
                t = value.as_py()
                out.append(None if t is None else cut(t))
                held += len(t or "")
                if held > HANDED:
                    yield pa.array(out, pa.list_(pa.string()))
                    out, held = [], 0
            if out:
                yield pa.array(out, pa.list_(pa.string()))

    # As Spark sees it not deterministic: else the filter that it derives from an explode cuts every text once more.
    return chunked.asNondeterministic()(text)


def _packed(chapters: DataFrame, size: int, content: str, raw: bool = False) -> DataFrame:
    """``chapters`` without the content, with ``packed``: the array of its chunks, made once for each row."""
    kept = [c for c in chapters.columns if c != content]
    return chapters.select(*kept, text_chunks(F.col(content), size, raw).alias("packed"))


def chunks(chapters: DataFrame, size: int = SIZE, content: str = "content", raw: bool = False) -> DataFrame:
    """One row for each chunk: ``chapters`` without the content, with chunk_idx and chunk. raw: as in ``text_chunks``."""
    df = _packed(chapters, size, content, raw)
    return df.select(*df.drop("packed").columns, F.posexplode("packed").alias("chunk_idx", "chunk"))


def _paused(chunk: Column, following: Column) -> Column:
    """struct(pause_ms, spoken) of a chunk, by its own marks and the chunk after it.

    A heading mark gives the longer pause, else a quote mark the shorter; before a chunk that ends a quote there
    are 1,500 ms at least.
    """
    own = F.when(F.contains(chunk, F.lit(HEADING_PAUSE)), HEADING_MS).when(F.contains(chunk, F.lit(QUOTE_PAUSE)), QUOTE_MS).otherwise(0)
    before_end = F.coalesce(F.contains(following, F.lit("Koniec cytatu")), F.lit(False))
    bare = strip(F.replace(F.replace(chunk, F.lit(HEADING_PAUSE), F.lit("")), F.lit(QUOTE_PAUSE), F.lit("")))
    return F.struct(F.when(before_end, F.greatest(own, F.lit(QUOTE_END_MS))).otherwise(own).alias("pause_ms"), bare.alias("spoken"))


def _spoken(packed: Column) -> Column:
    """array of struct(chunk_idx, chunk, pause_ms, spoken); chunks that are too short without their marks go."""

    def one(chunk: Column, i: Column) -> Column:
        own = _paused(chunk, F.get(packed, i + 1))
        return F.struct(i.alias("chunk_idx"), chunk.alias("chunk"), own["pause_ms"].alias("pause_ms"), own["spoken"].alias("spoken"))

    return F.filter(F.transform(packed, one), lambda x: F.length(x["spoken"]) >= LEAST)


def pauses(chapters: DataFrame, size: int = SIZE, content: str = "content", raw: bool = False) -> DataFrame:
    """One row for each chunk as in ``chunks``, with its spoken text and pause_ms after it.

    The chunk after it stands in the same array, so nothing is dealt out or sorted.
    """
    df = _packed(chapters, size, content, raw)
    return df.select(*df.drop("packed").columns, F.inline(_spoken(F.col("packed"))))


def synth_params(text: Column, speed: Column) -> Column:
    """struct(temperature, top_p, repetition_penalty, speed): dialogue, then questions, then lists."""
    count = lambda c: F.length(text) - F.length(F.replace(text, F.lit(c), F.lit("")))
    dialogue, listing = text.rlike('["„“]'), (count("\n") > 2) | (count(",") > 5)
    return F.struct(
        F.when(dialogue | listing, 0.60).otherwise(0.55).alias("temperature"),
        F.when(dialogue, 0.90).otherwise(0.85).alias("top_p"),
        F.lit(1.5).alias("repetition_penalty"),
        F.when(listing, speed * 0.90).when(F.contains(text, F.lit("?")), speed * 0.95).otherwise(speed).alias("speed"),
    )


def segment_plan(chapters: DataFrame, size: int = SIZE) -> DataFrame:
    """What is synthesised for each chapter (book_id, chapter_idx, content): its heading as seq -1, then its chunks.

    seq, spoken, pause_before_ms, pause_after_ms and the synthesis parameters.
    """
    parted = chapters.select("book_id", "chapter_idx", F.inline(F.array(separate_heading(F.col("content")))))
    row = lambda seq, text, before, after: F.struct(seq.cast("int").alias("seq"), text.alias("spoken"), before.alias("pause_before_ms"), after.alias("pause_after_ms"))
    head = F.when(F.col("heading").isNotNull(), F.array(row(F.lit(-1), F.col("heading"), F.lit(TITLE_MS), F.lit(TITLE_MS)))).otherwise(F.array())
    body = F.transform(_spoken(F.col("packed")), lambda x: row(x["chunk_idx"], x["spoken"], F.lit(0), x["pause_ms"]))
    rows = _packed(parted, size, "body").select("book_id", "chapter_idx", F.inline(F.concat(head, body)))
    return rows.withColumn("spoken", T.ensure_terminal_punct(F.col("spoken"))).select("*", synth_params(F.col("spoken"), F.lit(1.0)).alias("p")).select("*", "p.*").drop("p")
