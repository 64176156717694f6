"""Text clean-up as column expressions, in the order in which a book's documents go through them."""

from __future__ import annotations

import sys

from pyspark.sql import Column
from pyspark.sql import functions as F

from lectern.functions.ordinals import ordinal
from lectern.functions.patterns import CONTROLS, END, FEMININE, HEADING_PAUSE, MASCULINE, QUOTE_PAUSE, SPACE, SPACES, START, UNEVEN, among

replace = F.regexp_replace

#: Digits that are no decimal digits of a script.
OTHER_DIGITS = "".join(c for c in map(chr, range(sys.maxunicode + 1)) if c.isdigit() and not c.isdecimal())


def strip(text: Column) -> Column:
    """Without white space at both ends."""
    return F.btrim(text, F.lit(SPACES))


def clean_text(text: Column) -> Column:
    """One space for any white space, no control characters, omissions spoken out, an ellipsis for three dots."""
    text = replace(replace(text, UNEVEN, " "), CONTROLS, "")
    text = replace(text, rf"\({SPACE}*(?:\.\.\.|…){SPACE}*\)", " pominięto fragment ")
    return strip(F.replace(text, F.lit("..."), F.lit("…")))


def md_clean_text(text: Column) -> Column:
    """Markdown bodies: line ends, runs of blanks and of empty lines, ``&nbsp;``, tags; spaces that the last two free stay."""
    text = F.replace(text, F.lit("\r\n"), F.lit("\n"))
    text = replace(replace(text, "[ \t]+", " "), "\n{3,}", "\n\n")
    return strip(replace(F.replace(text, F.lit("&nbsp;"), F.lit(" ")), "<[^>]+>", ""))


def drop_cap(html: Column) -> Column:
    """An initial in a span of its own joins its word."""
    return replace(html, r"(?iu)<span[^>]*(?:inicjal|dropcap|drop.cap|lettrine)[^>]*>([\p{L}\p{N}_])</span>", "$1")


def strip_page_numbers(text: Column) -> Column:
    return replace(text, rf"(?iu){START}(strona|page){SPACE}+[0-9]+{END}", "")


def strip_footnotes(text: Column) -> Column:
    return replace(text, rf"{SPACE}*\[[0-9]+\]{SPACE}*", " ")


def orphan_punct(text: Column) -> Column:
    """Full stops that footnotes have left alone."""
    return replace(replace(text, rf'(["”“]){SPACE}+\.', "$1."), rf"\.{SPACE}+\.", ".")


def _ordinals_after(text: Column, words: str, gender: str) -> Column:
    marked = replace(text, rf"(?iu){START}({words})({SPACE}+[0-9]+){END}", "$1\x01$2\x01")
    spoken = lambda x: F.coalesce(F.concat(F.lit(" "), ordinal(F.try_to_number(strip(x), F.lit("999999999")).cast("int"), gender)), x)
    return F.array_join(F.transform(F.split(marked, "\x01"), lambda x, i: F.when(i % 2 == 1, spoken(x)).otherwise(x)), "")


def numbers_to_ordinals(text: Column) -> Column:
    """Numbers 1 to 999 after a keyword as ordinals, masculine keywords first; other numbers stay."""
    return _ordinals_after(_ordinals_after(text, MASCULINE, "m"), FEMININE, "f")


def annotate_quotes(text: Column) -> Column:
    """Quotes of 50 characters and more get spoken marks; a full stop after one is not repeated."""
    quote = rf'[„“]([^„“”"]{{50,}})[”"]'
    framed = f" {QUOTE_PAUSE} Cytat: $1 {QUOTE_PAUSE} Koniec cytatu."
    text = replace(text, rf"{quote}\.{SPACE}*", f"{framed} {QUOTE_PAUSE} ")
    text = replace(text, rf"{quote}([,:;!?…]){SPACE}*", f"{framed} $2 {QUOTE_PAUSE} ")
    return replace(text, rf"{quote}{SPACE}*", f"{framed} {QUOTE_PAUSE} ")


def heading_markers(html: Column) -> Column:
    """A pause after each heading element."""
    return replace(html, "(?i)(</h[1-6]>)", f"$1 {HEADING_PAUSE} ")


def chapter_markers(text: Column, strict: bool = True) -> Column:
    """A pause after "chapter N". strict: wherever the letters occur, also inside words."""
    word = r"(?:rozdział|rozdzial|chapter|część|czesc|part)"
    if strict:
        return replace(text, rf"(?iu)({word}{SPACE}+[\dIVXLCivxlc]+[ \t]*)", f"$1 {HEADING_PAUSE}")
    return replace(text, rf"(?iu)({START}{word}{SPACE}+[\dIVXLCivxlc]+{END})", f"$1 {HEADING_PAUSE}")


def ensure_terminal_punct(text: Column) -> Column:
    """A full stop where the text ends without one of ``.!?…``; empty stays empty."""
    text = F.rtrim(text, F.lit(SPACES))
    return F.when((text == "") | text.rlike(r"[.!?…]$"), text).otherwise(F.concat(text, F.lit(".")))


def words(text: Column) -> Column:
    return F.filter(F.split(text, rf"{SPACE}+"), lambda x: x != "")


def word_count(text: Column) -> Column:
    even = strip(replace(text, UNEVEN, " "))
    return F.when(even == "", 0).otherwise(F.length(even) - F.length(F.replace(even, F.lit(" "), F.lit(""))) + 1)


def digit_ratio(text: Column) -> Column:
    """Share of digits, of any script and also raised, lowered or circled; of an empty text 0."""
    # A run of other characters is one match, and below U+00B2 a character is told by two comparisons.
    kept = replace(text, rf"[^0-9[\x{{b2}}-\x{{10ffff}}&&[\p{{Nd}}{among(OTHER_DIGITS)}]]]+", "")
    digits = F.length(kept)
    return F.when(F.length(text) > 0, digits / F.length(text)).otherwise(F.lit(0.0))
