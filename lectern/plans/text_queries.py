"""Scalar functions over injected texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.functions import names as N
from lectern.functions import numbers as M
from lectern.functions import text as T
from lectern.functions.ordinals import ordinal
from lectern.functions.patterns import FEMININE, HEADING_PAUSE, MASCULINE, QUOTE_PAUSE, WS
from lectern.operators import chapters as C
from lectern.plans.inputs import DOCS, MARKUP, docs, sql_clean, sql_replace, sql_strip, sql_words
from lectern.plans.ordinal_sql import sql_ordinal
from lectern.plans.registry import query
from lectern.session import table


def sql_docs(value: str, name: str = "value") -> str:
    return f"WITH {DOCS} SELECT doc_id, {value} AS {name} FROM docs"


def _scalar(name: str, value: object, sql: str) -> None:
    """Registers ``value`` (made from nothing, when a session is there) over the injected documents."""

    @query(sql_docs(sql), name)
    def _run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return docs(spark, sf_dir).select("doc_id", value().alias("value"))


def sql_ordinals(x: str, words: str, gender: str) -> str:
    marked = sql_replace(x, rf"(?i)\b({words})({WS}+[0-9]+)\b", "\\1\x01\\2\x01")
    number = f"try_cast({sql_strip('p')} AS INTEGER)"
    return f"array_to_string(list_transform(string_split({marked}, chr(1)), lambda p, i: CASE WHEN i % 2 = 0 THEN coalesce(' ' || {sql_ordinal(number, gender)}, p) ELSE p END), '')"


def sql_quotes(x: str) -> str:
    quote = '[„“]([^„“”"]{50,})[”"]'
    framed = f" {QUOTE_PAUSE} Cytat: \\1 {QUOTE_PAUSE} Koniec cytatu."
    x = sql_replace(x, rf"{quote}\.{WS}*", f"{framed} {QUOTE_PAUSE} ")
    x = sql_replace(x, rf"{quote}([,:;!?…]){WS}*", f"{framed} \\2 {QUOTE_PAUSE} ")
    return sql_replace(x, rf"{quote}{WS}*", f"{framed} {QUOTE_PAUSE} ")


def sql_digits(x: str) -> str:
    return f"CASE WHEN length({x}) > 0 THEN length(regexp_replace({x}, '[^\\p{{Nd}}²⑦]', '', 'g')) / length({x}) ELSE 0.0 END"


def sql_camel(x: str) -> str:
    plain = f"regexp_replace(strip_accents(translate(replace({x}, 'ß', 'ss'), 'łŁđĐøØ', 'lLdDoO')), '[^a-zA-Z0-9\\s]', '', 'g')"
    return f"array_to_string(list_transform(list_filter(string_split_regex({plain}, '\\s+'), lambda w: w <> ''), lambda w: upper(w[1]) || lower(w[2:])), '')"


def sql_file_title(x: str) -> str:
    stem = f"regexp_replace({x}, '\\.[^.]*$', '')"
    number = f"regexp_replace({stem}, '^[0-9]+[_\\-\\s]*', '')"
    return f"coalesce(nullif({sql_strip(f'''translate({number}, '_-', '  ')''')}, ''), {x})"


_scalar("clean_text", lambda: T.clean_text(F.col("content")), sql_clean("content"))
_scalar(
    "md_clean_text",
    lambda: T.md_clean_text(F.concat(F.lit("a\r\nb \t c\n\n\n\n&nbsp;<b>"), F.col("content"), F.lit("</b> &nbsp; "))),
    sql_strip(sql_replace("replace(" + sql_replace(sql_replace("replace(concat('a' || chr(13) || chr(10) || 'b ' || chr(9) || ' c' || repeat(chr(10), 4) || '&nbsp;<b>', content, '</b> &nbsp; '), chr(13) || chr(10), chr(10))", "[ \t]+", " "), "\n{3,}", "\n\n") + ", '&nbsp;', ' ')", "<[^>]+>", "")),
)
_scalar("strip_page_numbers", lambda: T.strip_page_numbers(F.col("content")), sql_replace("content", rf"(?i)\b(strona|page){WS}+[0-9]+\b", ""))
_scalar("strip_footnotes", lambda: T.strip_footnotes(F.col("content")), sql_replace("content", rf"{WS}*\[[0-9]+\]{WS}*", " "))
_scalar(
    "orphan_punct",
    lambda: T.orphan_punct(F.concat(F.col("content"), F.lit(' "x" . Y. . Z'))),
    sql_replace(sql_replace("concat(content, ' \"x\" . Y. . Z')", rf'(["”“]){WS}+\.', "\\1."), rf"\.{WS}+\.", "."),
)
_scalar("numbers_to_ordinals", lambda: T.numbers_to_ordinals(F.col("content")), sql_ordinals(sql_ordinals("content", MASCULINE, "m"), FEMININE, "f"))
_scalar("annotate_quotes", lambda: T.annotate_quotes(F.col("content")), sql_quotes("content"))
_scalar(
    "chapter_markers",
    lambda: T.chapter_markers(F.col("content")),
    sql_replace("content", rf"(?i)((?:rozdział|rozdzial|chapter|część|czesc|part){WS}+[\dIVXLCivxlc]+[ \t]*)", f"\\1 {HEADING_PAUSE}"),
)
_scalar(
    "ensure_terminal_punct",
    lambda: T.ensure_terminal_punct(F.col("text")),
    "CASE WHEN v = '' OR regexp_matches(v, '[.!?…]$') THEN v ELSE v || '.' END".replace("v", f"({sql_replace('text', f'{WS}+$', '')})"),
)
_scalar("word_count", lambda: T.word_count(F.col("content")).cast("bigint"), sql_words("content") + "::BIGINT")
_scalar("digit_ratio", lambda: F.round(T.digit_ratio(F.concat(F.col("content"), F.lit("٣²⑦"), F.repeat(F.lit("7"), F.col("doc_id").cast("int") % 50))), 9), f"round({sql_digits('''concat(content, '٣²⑦', repeat('7', (doc_id % 50)::INT))''')}, 9)")
_scalar("sanitize_filename", lambda: N.sanitize_filename(F.concat(F.col("title"), F.lit(' a/b\\c:"d" '), F.col("content"))), "substr(" + sql_replace(sql_replace("concat(title, ' a/b\\c:\"d\" ', content)", '[<>:"/\\\\|?*]', ""), f"{WS}+", "_") + ", 1, 50)")
_scalar("title_from_filename", lambda: N.title_from_filename(F.col("filename")), sql_file_title("filename"))
_scalar(
    "md_title",
    lambda: N.md_title(F.concat(F.when(F.col("doc_id") % 2 == 0, F.lit("# ")).otherwise(F.lit("")), F.col("title"), F.lit("\n"), F.col("content")), F.col("filename")),
    f"CASE WHEN doc_id % 2 = 0 THEN {sql_strip('title')} ELSE {sql_file_title('filename')} END",
)
_scalar("camel_ascii", lambda: N.camel_ascii(F.concat(F.col("title"), F.lit(" łódź straße Antonín Dvořák Škoda Čapek đuro Ångström "), F.col("content"))), sql_camel("concat(title, ' łódź straße Antonín Dvořák Škoda Čapek đuro Ångström ', content)"))
_scalar(
    "mp3_filename",
    lambda: N.mp3_filename(F.when(F.col("doc_id") % 3 > 0, F.col("doc_id") % 12), F.col("pos"), F.when(F.col("doc_id") % 4 == 0, F.lit("")).otherwise(F.lit("Noc nad Wisłą")), F.col("title"), F.lit("Stanisław Žák Dvořáček"), F.lit("mp3")),
    f"concat_ws('_', CASE WHEN doc_id % 3 > 0 THEN 'T' || (doc_id % 12) END, 'R' || pos, CASE WHEN doc_id % 4 <> 0 THEN 'NocNadWisla' END, {sql_camel('title')}, 'StanislawZakDvoracek') || '.mp3'",
)
_scalar("fallback_filename", lambda: N.fallback_filename(F.col("pos") % 150, F.col("title"), F.lit("wav")), "CASE WHEN pos % 150 < 10 THEN '0' ELSE '' END || (pos % 150) || '_' || title || '.wav'")
_scalar("output_dir", lambda: N.output_dir(F.concat(F.lit("/books/x.y/"), F.col("filename"))), "regexp_replace(filename, '\\.[^.]*$', '') || '_audio'")
_scalar("concat_list_escape", lambda: N.concat_list_escape(F.concat(F.lit("d'"), F.col("filename"), F.lit("'"))), "replace(concat('d''', filename, ''''), '''', '''\\''''')")
_scalar(
    "roman_to_int",
    lambda: N.roman_to_int(F.element_at(F.array(*map(F.lit, [*N.ROMAN, "XI", "7"])), (F.col("doc_id") % 12 + 1).cast("int"))),
    "CASE WHEN doc_id % 12 < 10 THEN (doc_id % 12 + 1)::VARCHAR WHEN doc_id % 12 = 10 THEN 'XI' ELSE '7' END",
)

@query("SELECT n, g AS gender, CASE g WHEN 'm' THEN " + sql_ordinal("n", "m") + " WHEN 'f' THEN " + sql_ordinal("n", "f") + " ELSE " + sql_ordinal("n", "n") + " END AS word FROM (SELECT o_orderkey % 1100 AS n, ['m','f','n'][1 + (o_orderkey % 3)::INT] AS g, row_number() OVER () AS r FROM orders)")
def ordinal_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ordinals of 0 to 1,099 in three genders."""
    n = F.col("o_orderkey") % 1100
    g = F.element_at(F.array(F.lit("m"), F.lit("f"), F.lit("n")), (F.col("o_orderkey") % 3 + 1).cast("int"))
    word = F.when(g == "m", ordinal(n, "m")).when(g == "f", ordinal(n, "f")).otherwise(ordinal(n, "n"))
    return table(spark, sf_dir, "orders").select(n.alias("n"), g.alias("gender"), word.alias("word"))


@query("SELECT event_id, CASE WHEN h > 0 THEN h || ':' || lpad(m::VARCHAR, 2, '0') ELSE m::VARCHAR END || ':' || lpad(s::VARCHAR, 2, '0') AS value FROM (SELECT event_id, t // 3600 AS h, t % 3600 // 60 AS m, t % 60 AS s FROM (SELECT event_id, floor(value * 97)::BIGINT AS t FROM events))")
def format_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", M.format_time(F.col("value") * 97).alias("value"))


@query("SELECT event_id, greatest(0.0, least(value - 30.0, 60.0)) AS back, greatest(0.0, least(value + 30.0, 60.0)) AS forward FROM events")
def clamp_seek(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seeking by 30 s to both sides inside 60 s."""
    at = lambda d: M.clamp(F.col("value") + d, F.lit(0.0), F.lit(60.0))
    return table(spark, sf_dir, "events").select("event_id", at(-30.0).alias("back"), at(30.0).alias("forward"))


@query("SELECT event_id, CASE WHEN user_id % 5 > 0 THEN value / (user_id % 5) ELSE 0.0 END AS fraction FROM events")
def progress_fraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", M.progress_fraction(F.col("value"), F.col("user_id") % 5).alias("fraction"))


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").selectExpr("page_id", f"{MARKUP} AS html")


PAGES = f"pg AS (SELECT page_id, {MARKUP} AS html FROM pages)"


@query(f"WITH {PAGES} SELECT page_id, " + sql_replace("html", r"(?i)<span[^>]*(?:inicjal|dropcap|drop.cap|lettrine)[^>]*>([\p{L}\p{N}_])</span>", "\\1") + " AS value FROM pg")
def drop_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages(spark, sf_dir).select("page_id", T.drop_cap(F.col("html")).alias("value"))


@query(f"WITH {PAGES} SELECT page_id, " + sql_replace("html", "(?i)(</h[1-6]>)", f"\\1 {HEADING_PAUSE} ") + " AS value FROM pg")
def heading_markers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages(spark, sf_dir).select("page_id", T.heading_markers(F.col("html")).alias("value"))


def sql_html_title(html: str) -> str:
    found = "''"
    for tag in ("title", "h3", "h2", "h1"):
        piece = sql_strip(f"regexp_replace(regexp_extract({html}, '(?is)<{tag}\\b[^>]*>(.*?)</{tag}>', 1), '<[^>]*>', '', 'g')")
        found = f"CASE WHEN regexp_matches({html}, '(?i)<{tag}\\b') THEN {piece} ELSE {found} END"
    return f"coalesce(nullif({found}, ''), 'part')"


@query("SELECT page_id, " + sql_html_title("CASE WHEN page_id % 3 = 0 THEN replace(html, 'h1>', 'h6>') WHEN page_id % 3 = 1 THEN '<p>x</p>' ELSE html END") + " AS title FROM pages")
def html_title(spark: SparkSession, sf_dir: str) -> DataFrame:
    markup = F.expr("CASE WHEN page_id % 3 = 0 THEN replace(html, 'h1>', 'h6>') WHEN page_id % 3 = 1 THEN '<p>x</p>' ELSE html END")
    return table(spark, sf_dir, "pages").select("page_id", C.html_title(markup, F.lit("part.xhtml")).alias("title"))


def sql_html_strip(x: str) -> str:
    for tag in ("script", "style", "nav", "sup", "figure", "figcaption", "svg", "picture"):
        x = sql_replace(x, rf"(?is)<{tag}\b[^>]*>.*?</{tag}>", "")
    x = sql_replace(x, r"(?is)<img\b[^>]*>", "")
    x = sql_replace(x, r"(?is)<(?:p|div|span)\b[^>]*(?:class|id)=\"[^\"]*(?:caption|image[-_]?desc|photo[-_]?credit|ilustracja|opis[-_]?zdj|podpis)[^\"]*\"[^>]*>[^<]*</(?:p|div|span)>", "")
    return sql_replace(sql_replace(x, r"(?s)<!--.*?-->", ""), "<[^>]*>", " ")


@query(f"WITH {PAGES} SELECT page_id, {sql_html_strip('html')} AS value FROM pg")
def html_strip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages(spark, sf_dir).select("page_id", C.html_strip(F.col("html")).alias("value"))


@query()
def html_strip_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages stripped by a parser."""
    return pages(spark, sf_dir).select("page_id", C.html_strip_exact(F.col("html")).alias("value"))


def sql_extract(x: str) -> list[str]:
    """The chain as steps over a column v, to keep the SQL from growing with every nesting."""
    return [
        sql_replace(sql_replace(x, r"(?i)<span[^>]*(?:inicjal|dropcap|drop.cap|lettrine)[^>]*>([\p{L}\p{N}_])</span>", "\\1"), "(?i)(</h[1-6]>)", f"\\1 {HEADING_PAUSE} "),
        sql_clean(sql_html_strip("v")),
        sql_clean(sql_replace("v", rf"(?i)\b(strona|page){WS}+[0-9]+\b", "")),
        sql_ordinals("v", MASCULINE, "m"),
        sql_ordinals("v", FEMININE, "f"),
        sql_replace("v", rf"{WS}*\[[0-9]+\]{WS}*", " "),
        sql_clean(sql_replace(sql_replace("v", rf'(["”“]){WS}+\.', "\\1."), rf"\.{WS}+\.", ".")),
        sql_quotes("v"),
        sql_replace("v", rf"(?i)((?:rozdział|rozdzial|chapter|część|czesc|part){WS}+[\dIVXLCivxlc]+[ \t]*)", f"\\1 {HEADING_PAUSE}"),
    ]


def chained(key: str, source: str, steps: list[str], first: str) -> str:
    """CTEs e0, e1, ... that apply the steps to column v one after another."""
    parts, of = [first], source
    for k, step in enumerate(steps):
        parts.append(f"e{k} AS (SELECT {key}, {step} AS v FROM {of})")
        of = f"e{k}"
    return "WITH " + ", ".join(parts) + f" SELECT {key}, v AS value FROM {of}"


@query(chained("page_id", "pg", sql_extract("html"), PAGES))
def extract_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A document's markup to its text, all steps in a row."""
    return pages(spark, sf_dir).select("page_id", C.extract_document(F.col("html")).alias("value"))
