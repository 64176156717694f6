"""Titles, labels and file names."""

from __future__ import annotations

import sys
import unicodedata
from functools import cache
from string import punctuation

from pyspark.sql import Column
from pyspark.sql import functions as F

from lectern.functions.patterns import SPACE, SPACES, among
from lectern.functions.text import replace, strip

ROMAN = ["I", "II", "III", "IV", "V", "VI", "VII", "VIII", "IX", "X"]
#: Letters without a decomposition and what they become: fixed values of the behaviour to be matched.
SPECIAL = {"ł": "l", "Ł": "L", "đ": "d", "Đ": "D", "ø": "o", "Ø": "O", "ß": "ss"}
#: Lists in which characters that become more than one are looked up.
BINS = 64


@cache
def plain_letters() -> tuple[dict[str, str], dict[str, str]]:
    """Characters whose compatibility decomposition has other characters in ASCII or white space than they have: those that become one, and those that become more."""
    one, more = {}, {}
    for c in map(chr, range(128, sys.maxunicode + 1)):
        parts = SPECIAL.get(c) or unicodedata.normalize("NFKD", c)
        if parts != c:
            kept = "".join(x for x in parts if x.isspace() or (x.isascii() and x.isalnum()))
            if len(kept) == 1:
                one[c] = kept
            elif kept:
                more[c] = kept
    return one, more


def truthy(text: Column) -> Column:
    """Null for an empty text."""
    return F.nullif(text, F.lit(""))


def sanitize_filename(name: Column) -> Column:
    return F.substring(replace(replace(name, r'[<>:"/\\|?*]', ""), rf"{SPACE}+", "_"), 1, 50)


def camel_ascii(name: Column) -> Column:
    """Pascal case in ASCII letters and digits; marks fall away, ligatures and the like are taken apart."""
    one, more = plain_letters()
    name = F.replace(name, F.lit("ß"), F.lit("ss"))
    # Other characters that become more than one are cut out and looked up, each among those of the same remainder.
    listed = [[c for c in more if ord(c) % BINS == k] for k in range(BINS)]
    keys, values = (F.array(*(F.array(*(F.lit(of(c)) for c in row)).cast("array<string>") for row in listed)) for of in (str, more.get))
    found = lambda c: F.get(F.get(values, F.ascii(c) % BINS), F.array_position(F.get(keys, F.ascii(c) % BINS), c).cast("int") - 1)
    spelt = lambda x: F.coalesce(F.concat(found(F.substring(x, 1, 1)), F.substring(x, 2, 2**31 - 2)), x)
    whole = F.when(name.rlike(among(more)), F.array_join(F.transform(F.split(name, f"(?={among(more)})"), spelt), "")).otherwise(name)
    # White space of any kind becomes blanks, which end a word each and go at last.
    to = dict.fromkeys(SPACES, " ") | {c: " " if x.isspace() else x for c, x in one.items()}
    plain = replace(F.translate(whole, "".join(to) + punctuation, "".join(to.values())), "[^ -~]+", "")
    return F.replace(F.initcap(plain), F.lit(" "), F.lit(""))


def mp3_filename(tom: Column, number: Column, series: Column, title: Column, author: Column, fmt: Column) -> Column:
    """``T{tom}_R{n}_{Series}_{Title}_{Author}.{fmt}``; tom unless null, series unless null or empty."""
    name = F.concat_ws("_", F.concat(F.lit("T"), tom.cast("string")), F.concat(F.lit("R"), number.cast("string")), truthy_camel(series), camel_ascii(title), camel_ascii(author))
    return F.concat(name, F.lit("."), fmt)


def truthy_camel(series: Column) -> Column:
    return F.when(F.coalesce(series, F.lit("")) != "", camel_ascii(series))


def fallback_filename(number: Column, title: Column, fmt: Column) -> Column:
    return F.format_string("%02d_%s.%s", number, title, fmt)


def title_from_filename(filename: Column) -> Column:
    """Without extension, leading number, underscores and hyphens; the file name if nothing is left."""
    stem = replace(filename, r"\.[^.]*$", "")
    kept = strip(F.translate(replace(stem, r"^[0-9]+[_\-\s]*", ""), "_-", "  "))
    return F.coalesce(truthy(kept), filename)


def md_title(text: Column, filename: Column) -> Column:
    """The heading that the text begins with, else the file name's title."""
    return F.when(text.rlike(r"^# [^\n]+"), strip(F.regexp_extract(text, r"^# ([^\n]+)", 1))).otherwise(title_from_filename(filename))


def book_label(series: Column, tom: Column, title: Column) -> Column:
    return F.when(series.isNotNull() & tom.isNotNull(), F.concat(series, F.lit(" T"), tom.cast("string"))).otherwise(title)


def album_label(series: Column, tom: Column, title: Column) -> Column:
    return F.when(F.coalesce(series, F.lit("")) != "", F.concat(series, F.lit(" — Tom "), F.coalesce(tom.cast("string"), F.lit("")))).otherwise(title)


def output_dir(path: Column) -> Column:
    """``{stem}_audio`` of a path."""
    base = F.regexp_extract(path, r"([^/]*)$", 1)
    return F.concat(replace(base, r"(.)\.[^.]*$", "$1"), F.lit("_audio"))


def roman_to_int(text: Column) -> Column:
    """I to X as digits, other texts as they are."""
    out = text
    for n, roman in enumerate(ROMAN, 1):
        out = F.when(text == roman, F.lit(str(n))).otherwise(out)
    return out


def concat_list_escape(path: Column) -> Column:
    return F.replace(path, F.lit("'"), F.lit("'\\''"))
