"""From documents in reading order to chapters: titles, filters, headings."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.functions import text as T
from lectern.functions.names import sanitize_filename, truthy
from lectern.functions.patterns import CHAPTER_WORDS, FRONT_MATTER, SPACE, SPACES, UNEVEN
from lectern.functions.text import replace, strip

SHORT, LONG, DIGITS, LEAST = 400, 1000, 0.3, 10
SKIPPED, BEFORE = "Skipped (cover, intro, metadata, or too short)", "Before first chapter"


def html_title(html: Column, filename: Column) -> Column:
    """Text of the first of h1, h2, h3, title that is there; if that is empty, the file name without extension."""
    pieces = [F.regexp_extract(html, rf"(?is)<{tag}\b[^>]*>(.*?)</{tag}>", 1) for tag in ("h1", "h2", "h3", "title")]
    found = F.lit("")
    for tag, piece in reversed(list(zip(("h1", "h2", "h3", "title"), pieces, strict=True))):
        found = F.when(html.rlike(rf"(?i)<{tag}\b"), strip(replace(piece, "<[^>]*>", ""))).otherwise(found)
    return F.coalesce(truthy(found), F.replace(F.replace(filename, F.lit(".xhtml"), F.lit("")), F.lit(".html"), F.lit("")))


def html_strip(html: Column) -> Column:
    """Without scripts, styles, menus, notes, pictures and captions, as far as patterns can tell, then without tags."""
    for tag in ("script", "style", "nav", "sup", "figure", "figcaption", "svg", "picture"):
        html = replace(html, rf"(?is)<{tag}\b[^>]*>.*?</{tag}>", "")
    html = replace(html, r"(?is)<img\b[^>]*>", "")
    html = replace(html, r"(?is)<(?:p|div|span)\b[^>]*(?:class|id)=\"[^\"]*(?:caption|image[-_]?desc|photo[-_]?credit|ilustracja|opis[-_]?zdj|podpis)[^\"]*\"[^>]*>[^<]*</(?:p|div|span)>", "")
    return replace(replace(html, r"(?s)<!--.*?-->", ""), "<[^>]*>", " ")


class _Kept(HTMLParser):
    """Texts outside removed elements; an end tag closes the last open element of its name, if there is one."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.open: list[tuple[str, bool]] = []
        self.texts: list[str] = []

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        named = any(k in ("class", "id") and v and _caption.search(v) for k, v in attrs)
        if tag not in VOID:
            self.open.append((tag, tag in REMOVED or named or bool(self.open and self.open[-1][1])))

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        return

    def handle_endtag(self, tag: str) -> None:
        at = next((i for i in range(len(self.open) - 1, -1, -1) if self.open[i][0] == tag), None)
        if at is not None:
            del self.open[at:]

    def handle_data(self, data: str) -> None:
        if not (self.open and self.open[-1][1]):
            self.texts.append(data)


REMOVED = ("script", "style", "nav", "sup", "figure", "figcaption", "img", "svg", "picture")
VOID = ("area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr")
_caption = re.compile(r"caption|image[-_]?desc|photo[-_]?credit|ilustracja|opis[-_]?zdj|podpis", re.I)


def html_strip_exact(html: Column) -> Column:
    """``html_strip`` by a parser: elements go with all that is nested in them, references are decoded, texts are joined by spaces. Null stays null."""

    @F.arrow_udf("string")
    def strip_(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for pages in batches:
            out = []
            for page in pages.to_pylist():
                kept = _Kept()
                if page is not None:
                    kept.feed(page)
                    kept.close()
                out.append(None if page is None else " ".join(kept.texts))
            yield pa.array(out, pa.string())

    return strip_(html)


def extract_document(html: Column) -> Column:
    """The chain from a document's markup to its text, in the order in which the steps depend on each other."""
    text = T.clean_text(html_strip(T.heading_markers(T.drop_cap(html))))
    text = T.clean_text(T.strip_page_numbers(text))
    text = T.clean_text(T.orphan_punct(T.strip_footnotes(T.numbers_to_ordinals(text))))
    return T.chapter_markers(T.annotate_quotes(text))


def is_front_matter(title: Column, filename: Column) -> Column:
    """A keyword, as a mere substring, in title or file name."""
    words = F.array(*map(F.lit, FRONT_MATTER))
    return F.exists(words, lambda k: F.contains(F.lower(title), k) | F.contains(F.lower(filename), k))


def should_skip(title: Column, content: Column, filename: Column) -> Column:
    return is_front_matter(title, filename) | (F.length(content) < SHORT) | (T.digit_ratio(content) > DIGITS)


def likely_chapter(title: Column, content: Column) -> Column:
    """A chapter word in the title, a title that begins like a number (i, v and x count), or a long text."""
    low = F.lower(title)
    named = F.exists(F.array(*map(F.lit, CHAPTER_WORDS)), lambda k: F.contains(low, k))
    return named | low.rlike(rf"^(?:rozdział|chapter|część|czesc|part)?{SPACE}*[0-9ivx]+") | (F.length(content) > LONG)


def routed(docs: DataFrame) -> DataFrame:
    """``docs`` (book_id, pos, title, content, filename) with ``reason``: why a document is left out, else null.

    Whether a book's first chapter has come is a running maximum over its documents that aren't skipped.
    """
    df = docs.withColumn("_skip", should_skip(F.col("title"), F.col("content"), F.col("filename")))
    df = df.withColumn("_likely", ~F.col("_skip") & likely_chapter(F.col("title"), F.col("content")))
    so_far = Window.partitionBy("book_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    df = df.withColumn("_begun", F.max("_likely").over(so_far))
    reason = F.when(F.col("_skip"), F.lit(SKIPPED)).when(~F.col("_begun"), F.lit(BEFORE))
    return df.withColumn("reason", reason).drop("_skip", "_likely", "_begun")


def chapters(docs: DataFrame) -> DataFrame:
    """Kept documents as chapters, numbered from 0 in each book.

    A skipped document doesn't begin a book, so it goes before the texts are dealt out.
    """
    df = docs.where((F.length("content") > LEAST) & ~F.coalesce(should_skip(F.col("title"), F.col("content"), F.col("filename")), F.lit(False)))
    so_far = Window.partitionBy("book_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    begun = F.max(likely_chapter(F.col("title"), F.col("content"))).over(so_far)
    kept = df.withColumn("_begun", begun).where(F.coalesce("_begun", F.lit(True)))
    order = Window.partitionBy("book_id").orderBy("pos")
    return kept.select("book_id", (F.row_number().over(order) - 1).alias("chapter_idx"), sanitize_filename(F.col("title")).alias("title"), "content")


def reading_order(spine: DataFrame, items: DataFrame) -> DataFrame:
    """Items (book_id, item_id, pos) in the spine's order (book_id, item_id, spine_pos), then those that it lacks."""
    listed = spine.join(items.select("book_id", "item_id"), ["book_id", "item_id"]).select("book_id", "item_id", F.lit(0).alias("part"), F.col("spine_pos").alias("at"))
    missing = items.join(spine, ["book_id", "item_id"], "left_anti").select("book_id", "item_id", F.lit(1).alias("part"), F.col("pos").alias("at"))
    order = Window.partitionBy("book_id").orderBy("part", "at")
    return listed.unionByName(missing).select("book_id", "item_id", (F.row_number().over(order) - 1).alias("reading_pos"))


def separate_heading(text: Column) -> Column:
    """struct(heading, body): "chapter N" with the capitalised words after it; heading null if there is none or no body.

    The words that belong to the title are those before the first that doesn't: not in capitals, or a
    lone capital before a small letter.
    """
    # A word, and all title words: what stands before them is passed once, the body is never cut into words.
    mark, end = r'[,."()\-]', rf"(?:{SPACE}++|\z)"
    lone = rf'{mark}*\p{{Lu}}{mark}*{SPACE}+[,."]*\p{{Ll}}'
    titles = rf"^((?:(?!{lone})(?:{mark}++|{mark}*+\p{{Lu}}[^\p{{Ll}}{SPACE[1:-1]}]*+){end})*+)"

    def once(value: Column, f: Callable[[Column], Column]) -> Column:
        return F.transform(F.array(value), f)[0]

    def split(a: Column) -> Column:
        even = lambda x: replace(strip(x), UNEVEN, " ")
        title, body = even(a["titled"]), even(F.substr(a["rest"], F.length(a["titled"]) + 1))
        heading = strip(T.numbers_to_ordinals(F.when(title != "", F.concat(a["prefix"], F.lit(" "), title)).otherwise(a["prefix"])))
        return once(body, lambda b: F.struct(F.when(b != "", heading).alias("heading"), F.when(b != "", b).otherwise(a["text"]).alias("body")))

    def parted(t: Column) -> Column:
        prefix = F.regexp_extract(t, rf"(?iu)^((?:rozdział|rozdzial|chapter|część|czesc|part){SPACE}*[0-9]+)", 1)
        rest = lambda p: F.ltrim(F.substr(t, F.length(p) + 1), F.lit(SPACES))
        titled = lambda p: once(rest(p), lambda r: F.struct(t.alias("text"), p.alias("prefix"), r.alias("rest"), F.regexp_extract(r, titles, 1).alias("titled")))
        return once(prefix, lambda p: F.when(p != "", once(titled(p), split)).otherwise(F.struct(F.lit(None).cast("string").alias("heading"), t.alias("body"))))

    return once(strip(text), parted)
