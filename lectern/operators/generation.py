"""Around generated books: outlines, prompts, checks, titles, settings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.functions.names import roman_to_int, truthy
from lectern.functions.text import strip, word_count


def chapter_count(outline: Column, book: Column) -> Column:
    """Level-two headings of the outline; without an outline what the book says, else 5."""
    stated = truthy(F.regexp_extract(book, r"Liczba rozdziałów:\s*([0-9]+)", 1)).cast("int")
    return F.coalesce(F.regexp_count(outline, F.lit(r"(?m)^## ")), stated, F.lit(5))


def outline_section(outline: Column, number: Column) -> Column:
    """Lines after the heading that has the number, up to the next heading; empty if there is none."""
    pattern = F.concat(F.lit(r"(?sm)^## [^\n]*?(?<![0-9])"), number.cast("string"), F.lit(r"[^0-9\n][^\n]*\n(.*?)(?=^## |\z)"))
    return F.call_function("regexp_extract", outline, pattern, F.lit(1))


def prompt(rules: Column, book: Column, style: Column, number: Column, count: Column, outline: Column, summary: Column) -> Column:
    """Sections joined by rules; style, outline and the summary of the chapter before only where there are some."""
    task = F.concat(F.lit("Napisz rozdział "), number.cast("string"), F.lit(" z "), count.cast("string"), F.lit("."))
    hints = F.when(F.coalesce(outline, F.lit("")) != "", F.concat(F.lit("\n\nWskazówki:\n"), outline)).otherwise(F.lit(""))
    before = F.when(F.coalesce(summary, F.lit("")) != "", F.concat(F.lit("Streszczenie:\n"), summary))
    return F.concat_ws("\n\n---\n\n", rules, book, truthy(style), F.concat(task, hints), before)


def quality_checks(text: Column) -> Column:
    """struct(is_empty, no_heading, too_short, placeholder)."""
    return F.struct(
        (F.length(text) == 0).alias("is_empty"),
        (~text.rlike(r"(?m)^# ")).alias("no_heading"),
        (word_count(text) < 500).alias("too_short"),
        text.rlike(r"(?iu)(TODO|insert here|\[\.\.\.\]|\[wstaw\])").alias("placeholder"),
    )


def failed_review(text: Column) -> Column:
    return F.contains(F.upper(text), F.lit("FAIL"))


def title_parts(title: Column) -> Column:
    """struct(tom, series, subtitle) of "Series — Tom V: Subtitle"; the title itself where there is no subtitle."""
    number = roman_to_int(F.regexp_extract(title, r".*[Tt]om\s*([IVXLC]*[0-9]*)", 1))
    return F.struct(
        F.when(number.rlike("^[0-9]+$"), number.cast("int")).alias("tom"),
        truthy(strip(F.regexp_extract(title, r"^(.*)\s*[—–-]\s*[Tt]om", 1))).alias("series"),
        F.coalesce(truthy(F.regexp_extract(title, r".*[Tt]om\s*[IVXLC0-9]*:\s*(.*)", 1)), title).alias("subtitle"),
    )


def filter_chain(denoise: Column, declick: Column, normalize: Column) -> Column:
    """The audio filters that the flags ask for, in their order."""
    clicks = F.lit("adeclick=threshold=0.05:window=55:overlap=75,acompressor=threshold=-20dB:ratio=4:attack=5:release=50")
    return F.concat_ws(",", F.when(denoise, F.lit("afftdn=nf=-25:tn=1")), F.lit("highpass=f=40,lowpass=f=15000"), F.when(declick, clicks), F.when(normalize, F.lit("loudnorm=I=-16:TP=-1.5:LRA=11")))


def profile(asked: Column, gpu: Column, gpu_gb: Column, cores: Column, ram_gb: Column) -> Column:
    """off, speed, balanced or quality, from what is asked for and what the machine has."""
    auto = F.when(gpu, F.when(gpu_gb >= 8, F.lit("speed")).otherwise(F.lit("balanced"))).when((cores >= 8) & (ram_gb >= 16), F.lit("balanced")).otherwise(F.lit("quality"))
    named = F.when(asked.isNull() | (asked == "off"), F.lit("off")).when(asked == "auto", auto).otherwise(asked)
    return F.when((named == "speed") & ~gpu, F.lit("balanced")).otherwise(named)


def chunk_size(profile: Column, asked: Column) -> Column:
    """The profile's size, unless another than the default was asked for."""
    own = F.when(profile == "speed", 400).when(profile == "quality", 200).otherwise(300)
    return F.when(asked == 300, own).otherwise(asked)


def valid_arguments(n_inputs: Column, speed: Column, slug: Column, tom: Column) -> Column:
    """Exactly one input, speed in 0.5 to 2, a plain slug, a volume of digits if any."""
    return (n_inputs == 1) & speed.between(0.5, 2.0) & slug.rlike("^[a-z0-9_-]+$") & F.coalesce(tom.rlike("^[0-9]+$"), F.lit(True))


def last_lines(lines: DataFrame, n: int) -> DataFrame:
    """The n lines with the largest line_no; a top-k, no sort of the whole log."""
    return lines.orderBy(F.desc("line_no")).limit(n)


def command(fixed: list[str], options: dict[str, Column], flags: dict[str, Column]) -> Column:
    """array of a command's words: the fixed ones, each option with its value unless that is null or empty, each flag that is true."""
    parts = [F.array(*map(F.lit, fixed))]
    parts += [F.when(F.coalesce(value, F.lit("")) != "", F.array(F.lit(name), value)).otherwise(F.array()) for name, value in options.items()]
    parts += [F.when(value, F.array(F.lit(name))).otherwise(F.array()) for name, value in flags.items()]
    return F.concat(*parts)


def dated(name: Column, day: Column | None = None) -> Column:
    """``{name}_{year-month-day}``; of today, in the session's time zone, if no day is given."""
    return F.concat(name, F.lit("_"), F.date_format(F.current_date() if day is None else day, "yyyy-MM-dd"))
