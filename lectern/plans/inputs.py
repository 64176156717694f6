"""Logical inputs derived from the tables by expressions that Spark and DuckDB read alike.

The tables have none of the phrases that the operators react to, so these put them in, by the key.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lectern.functions.patterns import CONTROL, WS
from lectern.session import table

TITLE = (
    "CASE doc_id % 9 WHEN 0 THEN concat('Rozdział ', doc_id % 1200) WHEN 1 THEN 'Okładka książki' WHEN 2 THEN concat('Discovery ', doc_id) "
    "WHEN 3 THEN concat('Introduction ', doc_id) WHEN 4 THEN concat('  Noc: nad <Wisłą> ', doc_id % 13) WHEN 5 THEN 'Stock/TOC?' ELSE concat('Tekst ', doc_id % 400) END"
)
FILENAME = "concat(lpad(cast(doc_id % 100 AS string), 2, '0'), CASE doc_id % 5 WHEN 0 THEN '-cover_page' WHEN 1 THEN '-my-great-chapter' ELSE concat('_part_', doc_id) END, CASE WHEN doc_id % 2 = 0 THEN '.xhtml' ELSE '.md' END)"
CONTENT = (
    "concat(CASE WHEN doc_id % 3 = 0 THEN concat('Rozdział ', doc_id % 1200, ' TYTUŁ KSIĄŻKI ') ELSE '' END, '„', substr(text, 1, 40 + cast(doc_id % 40 AS int)), '”', "
    "CASE doc_id % 4 WHEN 0 THEN '. ' WHEN 1 THEN ', ' ELSE ' ' END, text, ' [', doc_id % 90, '] . Zob. prof. A. Nowak, nr 5. Strona ', doc_id % 70, ' (...) część 12 koniec... tom 21')"
)
#: A book: a hundred consecutive ids of one source, so that there are more books, not longer ones, at a larger scale.
BOOK = "concat(source, '-', cast(floor(doc_id / 100) AS bigint))"
DOCS = f"docs AS (SELECT doc_id, {BOOK} AS book_id, doc_id AS pos, {TITLE} AS title, {FILENAME} AS filename, {CONTENT} AS content, text FROM documents)"
MARKUP = (
    "concat('<h2>Rozdział ', page_id % 300, '</h2><p><span class=\"litera_inicjal\">W</span>isława<sup>[', page_id % 9, ']</sup></p>', "
    "CASE WHEN page_id % 3 = 0 THEN '<figure><img src=\"a.png\"><figcaption>Podpis</figcaption></figure><p class=\"photo-credit\">Foto</p>' ELSE '' END, html)"
)


def docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, book_id, pos, title, filename, content, text) from ``documents``."""
    return table(spark, sf_dir, "documents").selectExpr(
        "doc_id", f"{BOOK} AS book_id", "doc_id AS pos", f"{TITLE} AS title", f"{FILENAME} AS filename", f"{CONTENT} AS content", "text"
    )


def sql_replace(x: str, pattern: str, to: str) -> str:
    quoted = lambda s: s.replace("'", "''")
    return f"regexp_replace({x}, '{quoted(pattern)}', '{quoted(to)}', 'g')"


def sql_strip(x: str) -> str:
    return sql_replace(x, rf"^{WS}+|{WS}+$", "")


def sql_clean(x: str) -> str:
    x = sql_replace(sql_replace(x, f"{WS}+", " "), CONTROL, "")
    x = sql_replace(x, rf"\({WS}*(?:\.\.\.|…){WS}*\)", " pominięto fragment ")
    return sql_strip(f"replace({x}, '...', '…')")


def sql_words(x: str) -> str:
    """The number of words."""
    return f"len(list_filter(string_split_regex({x}, '{WS}+'), lambda w: w <> ''))"
