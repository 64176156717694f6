"""Files, labels, books and manifests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lectern.functions import names as N
from lectern.operators import catalogue as G
from lectern.plans.inputs import BOOK, DOCS, docs, sql_replace, sql_strip
from lectern.plans.registry import query
from lectern.plans.text_queries import sql_camel  # noqa: F401
from lectern.session import table
from lectern.sources.markdown import split_chapters

FILE = "concat(CASE doc_id % 6 WHEN 0 THEN 'T2_' WHEN 1 THEN 'x' ELSE '' END, 'R', doc_id % 31, '_', 'Book_', doc_id, CASE WHEN doc_id % 7 = 0 THEN '.wav' ELSE '.mp3' END)"
FILES = f"files AS (SELECT {BOOK} AS book_id, {FILE} AS filename FROM documents)"
LISTED = "listed AS (SELECT book_id, filename, regexp_extract(filename, '^R([0-9]+)_', 1)::INT AS index FROM files WHERE regexp_matches(filename, '^R[0-9]+_') AND filename LIKE '%.mp3')"
TITLES = f"titles AS (SELECT {BOOK} AS book_id, row_number() OVER (PARTITION BY {BOOK} ORDER BY doc_id) - 1 AS chapter_idx, CASE WHEN doc_id % 3 > 0 THEN concat('Część ', doc_id) END AS title FROM documents)"
LABELLED = "labelled AS (SELECT l.book_id, l.index, filename, CASE WHEN l.index = 0 THEN 'Wprowadzenie' ELSE coalesce(t.title, 'Rozdział ' || l.index) END AS label FROM listed l LEFT JOIN titles t ON t.book_id = l.book_id AND t.chapter_idx + 1 = l.index)"
META = (
    "SELECT source AS book_id, concat(source, '-slug') AS slug, concat('Księga ', source) AS title, 'Autor' AS author, CASE WHEN min(doc_id) % 2 = 0 THEN '' ELSE 'Saga' END AS series, "
    "CASE WHEN min(doc_id) % 3 > 0 THEN CAST(min(doc_id) % 12 AS int) END AS tom, concat('2024-01-', lpad(cast(min(doc_id) % 28 + 1 AS string), 2, '0'), 'T00:00:00Z') AS generated_at FROM documents GROUP BY source"
)
BOOKS = f"meta AS ({META.replace('FROM documents', f'FROM (SELECT doc_id, {BOOK} AS source FROM documents)')}), books AS (SELECT m.book_id, slug, title, author, nullif(series, '') AS series, tom, generated_at, chapters FROM meta m JOIN (SELECT book_id, list({{'index': index, 'filename': filename, 'label': label}} ORDER BY index, filename) AS chapters FROM labelled GROUP BY book_id) c USING (book_id))"
BASE = f"WITH {FILES}, {LISTED}, {TITLES}, {LABELLED}, {BOOKS}"


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").selectExpr(f"{BOOK} AS book_id", f"{FILE} AS filename")


def titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every chapter; every third one has no title."""
    order = Window.partitionBy("book_id").orderBy("doc_id")
    title = F.when(F.col("doc_id") % 3 > 0, F.concat(F.lit("Część "), F.col("doc_id").cast("string")))
    return table(spark, sf_dir, "documents").select(F.expr(BOOK).alias("book_id"), "doc_id").select("book_id", (F.row_number().over(order) - 1).alias("chapter_idx"), title.alias("title"))


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.labelled(G.listed(files(spark, sf_dir)), titles(spark, sf_dir))


def books(spark: SparkSession, sf_dir: str) -> DataFrame:
    meta = table(spark, sf_dir, "documents").groupBy(F.expr(BOOK).alias("source")).agg(F.min("doc_id").alias("m")).selectExpr(*_meta_exprs())
    return G.books(labels(spark, sf_dir), meta)


def _meta_exprs() -> list[str]:
    body = META[len("SELECT ") : META.index(" FROM documents")].replace("min(doc_id)", "m")
    out, depth, start = [], 0, 0
    for i, c in enumerate(body):
        depth += (c == "(") - (c == ")")
        if c == "," and not depth:
            out.append(body[start:i])
            start = i + 1
    return [*out, body[start:]]


@query(f"WITH {FILES}, {LISTED} SELECT book_id, index, filename FROM listed")
def list_mp3_rindex(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.listed(files(spark, sf_dir)).select("book_id", "index", "filename")


@query(f"WITH {FILES}, {LISTED}, {TITLES}, {LABELLED} SELECT book_id, index, filename, label FROM labelled")
def chapter_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return labels(spark, sf_dir).select("book_id", "index", "filename", "label")



@query(
    f"{BASE} SELECT book_id, '{{\"slug\":\"' || slug || '\",\"title\":\"' || title || '\",\"author\":\"' || author || '\"' || coalesce(',\"series\":\"' || series || '\"', '') || coalesce(',\"tom\":' || tom, '') || ',\"generated_at\":\"' || generated_at || '\",\"chapters\":' || to_json(chapters)::VARCHAR || '}}' AS json FROM books"
)
def book_meta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A book's JSON; series and volume only where there are some."""
    row = F.struct("slug", "title", "author", "series", "tom", "generated_at", "chapters")
    return books(spark, sf_dir).select("book_id", F.to_json(row).alias("json"))


@query(f"{BASE} SELECT '{{\"books\":[' || string_agg('{{\"slug\":\"' || slug || '\",\"n\":' || len(chapters) || '}}', ',' ORDER BY generated_at, slug) || ']}}' AS json FROM books")
def manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All books, sorted by the text of generated_at, in one JSON object."""
    row = F.struct(F.coalesce("generated_at", F.lit("")).alias("at"), "slug", F.size("chapters").alias("n"))
    all_ = books(spark, sf_dir).agg(F.sort_array(F.collect_list(row)).alias("b"))
    return all_.select(F.to_json(F.struct(F.transform("b", lambda x: F.struct(x["slug"].alias("slug"), x["n"].alias("n"))).alias("books"))).alias("json"))


@query(f"{BASE} SELECT slug, c.index, c.filename, c.label FROM (SELECT slug, unnest(chapters) AS c FROM books)")
def manifest_explode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A manifest's JSON back to rows."""
    row = F.struct("slug", "title", "author", "series", "tom", "generated_at", "chapters")
    json = books(spark, sf_dir).groupBy("book_id").agg(F.to_json(F.struct(F.collect_list(row).alias("books"))).alias("json"))
    return G.exploded(json)


@query(f"SELECT {BOOK} AS book_id, string_agg(text, chr(10) ORDER BY concat('chapter_', doc_id, '.md')) AS text FROM documents GROUP BY ALL")
def concat_book(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chapter files in the order of their names: 1, 10, 11, 2."""
    named = table(spark, sf_dir, "documents").select(F.expr(BOOK).alias("book_id"), F.concat(F.lit("chapter_"), F.col("doc_id").cast("string"), F.lit(".md")).alias("name"), "text")
    return G.ordered_concat(named, ["book_id"], "name", "text", "\n")


@query("SELECT doc_id, '{\"title\":' || to_json(concat('T', doc_id))::VARCHAR || ',\"content\":' || to_json(text)::VARCHAR || '}' AS json FROM documents")
def chapters_to_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A JSON object for each chapter: what a line of the chapters' file is."""
    title = F.concat(F.lit("T"), F.col("doc_id").cast("string")).alias("title")
    return table(spark, sf_dir, "documents").select("doc_id", F.to_json(F.struct(title, F.col("text").alias("content"))).alias("json"))


@query("SELECT slug, o_orderkey, made FROM (SELECT concat('s', o_custkey % 400) AS slug, o_orderkey, cast(o_orderdate AS DATE)::VARCHAR AS made, row_number() OVER (PARTITION BY o_custkey % 400 ORDER BY cast(o_orderdate AS DATE)::VARCHAR, o_orderkey) AS r FROM orders) WHERE r = 1")
def dedupe_slug(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The oldest folder of each slug."""
    some = table(spark, sf_dir, "orders").select(F.concat(F.lit("s"), (F.col("o_custkey") % 400).cast("string")).alias("slug"), "o_orderkey", F.col("o_orderdate").cast("date").cast("string").alias("made"))
    return G.first_of(some, ["slug"], ["made", "o_orderkey"])


@query(f"WITH {DOCS} SELECT book_id, title, min(pos) AS pos FROM docs GROUP BY book_id, title")
def dedupe_title(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of chapters with one title the first."""
    return G.first_of(docs(spark, sf_dir).select("book_id", "title", "pos"), ["book_id", "title"], ["pos"])


@query(f"WITH {DOCS} SELECT book_id, pos, title FROM docs WHERE (book_id, title) NOT IN (SELECT book_id, title FROM docs WHERE pos % 6 = 0)")
def completed_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chapters whose title hasn't been completed."""
    rows = docs(spark, sf_dir).select("book_id", "pos", "title")
    return rows.join(rows.where("pos % 6 = 0").select("book_id", "title"), ["book_id", "title"], "left_anti").select("book_id", "pos", "title")


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE EXISTS (SELECT 1 FROM orders WHERE o_orderkey = l_orderkey AND o_orderkey % 3 > 0)")
def segment_semi(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Planned segments of which there is a file."""
    there = table(spark, sf_dir, "orders").where("o_orderkey % 3 > 0").select(F.col("o_orderkey").alias("l_orderkey"))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber").join(there, "l_orderkey", "left_semi")


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE quality = 1)")
def incremental_skip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chapters without a file that isn't empty."""
    done = table(spark, sf_dir, "labels").where("quality = 1").select("doc_id")
    return table(spark, sf_dir, "documents").select("doc_id").join(done, "doc_id", "left_anti")


@query(f"WITH {TITLES} SELECT book_id, chapter_idx, lead(chapter_idx) OVER w AS next_idx, lag(chapter_idx) OVER w AS prev_idx FROM titles WINDOW w AS (PARTITION BY book_id ORDER BY chapter_idx)")
def next_chapter(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = Window.partitionBy("book_id").orderBy("chapter_idx")
    return titles(spark, sf_dir).select("book_id", "chapter_idx", F.lead("chapter_idx").over(order).alias("next_idx"), F.lag("chapter_idx").over(order).alias("prev_idx"))


PARTS = "SELECT p_partkey, p_name, p_brand, CASE p_size % 3 WHEN 0 THEN '' WHEN 1 THEN p_brand END AS series, nullif(p_size % 4, 0) AS tom FROM part"


def parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").selectExpr("p_partkey", "p_name", "p_brand", "CASE p_size % 3 WHEN 0 THEN '' WHEN 1 THEN p_brand END AS series", "nullif(p_size % 4, 0) AS tom")


@query(f"SELECT p_partkey, CASE WHEN series IS NOT NULL AND tom IS NOT NULL THEN series || ' T' || tom ELSE p_name END AS label FROM ({PARTS})")
def book_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parts(spark, sf_dir).select("p_partkey", N.book_label(F.col("series"), F.col("tom"), F.col("p_name")).alias("label"))


@query(f"SELECT p_partkey, CASE WHEN coalesce(series, '') <> '' THEN series || ' — Tom ' || coalesce(tom::VARCHAR, '') ELSE p_name END AS label FROM ({PARTS})")
def album_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parts(spark, sf_dir).select("p_partkey", N.album_label(F.col("series"), F.col("tom"), F.col("p_name")).alias("label"))


@query(f"SELECT p_partkey, coalesce(nullif(series, ''), p_name, 'Unknown title') AS title, coalesce(tom, 0) AS tom FROM ({PARTS})")
def metadata_coalesce(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is given, else what the book says, else the default; an empty text isn't given."""
    return parts(spark, sf_dir).select("p_partkey", F.coalesce(N.truthy(F.col("series")), "p_name", F.lit("Unknown title")).alias("title"), F.coalesce("tom", F.lit(0)).alias("tom"))


MD = "concat('Wstęp', chr(10), substr(text, 1, 30), chr(10), '# Pierwszy ', doc_id, chr(10), text, chr(10), '# Pusty', chr(10), '  ', chr(10), '# Drugi', chr(10), '&nbsp;<b>', substr(text, 1, 90), '</b>')"
_part = sql_strip("p")
_body = sql_strip(sql_replace("replace(" + sql_replace(sql_replace("replace(substr(q, instr(q, chr(10)) + 1), chr(13) || chr(10), chr(10))", "[ \t]+", " "), "\n{3,}", "\n\n") + ", '&nbsp;', ' ')", "<[^>]+>", ""))


@query(
    f"WITH parts AS (SELECT doc_id, unnest(s) AS p, generate_subscripts(s, 1) AS i FROM (SELECT doc_id, string_split({sql_replace(MD, '(?m)^# ', chr(1))}, chr(1)) AS s FROM documents)), "
    f"q AS (SELECT doc_id, i, {_part} AS q FROM parts), "
    f"b AS (SELECT doc_id, i, {sql_strip('split_part(q, chr(10), 1)')} AS title, CASE WHEN instr(q, chr(10)) > 0 THEN {_body} ELSE '' END AS content FROM q WHERE q <> '') "
    "SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS chapter_idx, title, content FROM b WHERE content <> ''"
)
def md_split_chapters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One Markdown text to chapters, cut at level-one headings."""
    return split_chapters(table(spark, sf_dir, "documents").select("doc_id", F.expr(MD.replace("chr(10)", "char(10)")).alias("md")), ["doc_id"], "md")
