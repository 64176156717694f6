"""Positions, transitions and streams of playback events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.operators import playback as P
from lectern.operators.chunking import chunks
from lectern.plans.chapter_queries import CHUNKS, CUT, MERGED, PACKED
from lectern.plans.registry import query
from lectern.session import table
from lectern.streaming.incremental import drained

JSON = "CASE event_id % 5 WHEN 0 THEN concat('{\"slug\":\"b', user_id, '\",\"chapterIndex\":', event_id % 9, '}') WHEN 1 THEN '{broken' WHEN 2 THEN '{\"slug\":\"x\",\"chapterIndex\":\"y\",\"currentTime\":1}' ELSE concat('{\"slug\":\"b', user_id, '\",\"chapterIndex\":', event_id % 9, ',\"currentTime\":', event_id % 70, '.5}') END"


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events")


@query('SELECT event_id, concat(\'b\', user_id) AS slug, (event_id % 9)::INT AS chapter, (event_id % 70) + 0.5::DOUBLE AS "at" FROM events WHERE event_id % 5 > 2')
def resume_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = events(spark, sf_dir).select("event_id", P.parse_resume(F.expr(JSON)).alias("r")).where("r IS NOT NULL")
    return found.select("event_id", "r.slug", F.col("r.chapterIndex").alias("chapter"), F.col("r.currentTime").alias("at"))


@query(
    "WITH b AS (SELECT 's' || user_id AS slug, count(*) % 7 + 1 AS n FROM events WHERE user_id % 4 > 0 GROUP BY user_id), r AS (SELECT event_id AS user_id, 's' || user_id AS slug, event_id % 9 - 1 AS chapter, value - 5 AS sec FROM events) "
    "SELECT user_id, coalesce(b.slug, (SELECT min(slug) FROM b)) AS slug, CASE WHEN n IS NOT NULL AND chapter < n AND chapter >= 0 THEN chapter ELSE 0 END AS chapter, CASE WHEN n IS NOT NULL AND (CASE WHEN chapter < n AND chapter >= 0 THEN chapter ELSE 0 END) = chapter AND sec >= 0 THEN sec ELSE 0.0 END AS \"at\" FROM r LEFT JOIN b USING (slug)"
)
def resume_validate(spark: SparkSession, sf_dir: str) -> DataFrame:
    slug = F.concat(F.lit("s"), F.col("user_id").cast("string"))
    books = events(spark, sf_dir).where("user_id % 4 > 0").groupBy(slug.alias("slug")).agg((F.count("*") % 7 + 1).alias("n_chapters"))
    resumes = events(spark, sf_dir).select(F.col("event_id").alias("user_id"), slug.alias("slug"), (F.col("event_id") % 9 - 1).alias("chapter"), (F.col("value") - 5).alias("at"))
    return P.validated(resumes, books)


@query("SELECT user_id, event_type, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r = 1")
def latest_resume(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.latest(events(spark, sf_dir), "user_id", ["ts", "event_id"], ["event_type", "value"])


KIND = "CASE event_id % 4 WHEN 0 THEN 'ended' WHEN 1 THEN 'next' WHEN 2 THEN 'prev' ELSE 'play' END"


@query(
    f"WITH RECURSIVE b AS (SELECT r_regionkey AS book, r_regionkey % 4 + 1 AS n FROM region), e AS (SELECT event_id, user_id, {KIND} AS kind, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events), "
    "steps(event_id, user_id, i, book, chapter) AS (SELECT NULL::BIGINT, user_id, 0::BIGINT, 0::BIGINT, 0::BIGINT FROM e GROUP BY user_id UNION ALL "
    "SELECT e.event_id, e.user_id, e.i, CASE WHEN forward AND chapter + 1 >= n AND s.book < (SELECT max(book) FROM b) THEN s.book + 1 ELSE s.book END, "
    "CASE WHEN forward AND chapter + 1 < n THEN chapter + 1 WHEN forward AND s.book < (SELECT max(book) FROM b) THEN 0 WHEN kind = 'prev' AND value <= 5 AND chapter > 0 THEN chapter - 1 ELSE chapter END "
    "FROM steps s JOIN b ON b.book = s.book JOIN (SELECT *, kind IN ('ended', 'next') AS forward FROM e) e ON e.user_id = s.user_id AND e.i = s.i + 1) "
    "SELECT event_id, user_id, book, chapter FROM steps WHERE i > 0"
)
def player_transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Players of a catalogue of one book for each region, of one to four chapters."""
    catalogue = table(spark, sf_dir, "region").orderBy("r_regionkey").select((F.col("r_regionkey") % 4 + 1).cast("int").alias("n"))
    df = events(spark, sf_dir).select("event_id", "user_id", "ts", F.expr(KIND).alias("kind"), F.col("value").alias("at"))
    return P.transitions(df, "user_id", ["ts", "event_id"], [r.n for r in catalogue.collect()]).select("event_id", "user_id", "book", "chapter")


@query("SELECT event_id, user_id, event_type FROM (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM events) WHERE before IS NULL OR before <> event_type")
def chapter_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = events(spark, sf_dir).select("event_id", "user_id", "ts", "event_type")
    return P.changes(df, "user_id", ["ts", "event_id"], ["event_type"]).select("event_id", "user_id", "event_type")


@query(f"WITH chapters AS (SELECT doc_id AS book_id, 0 AS pos, 0 AS chapter_idx, text AS content FROM documents), {CUT}, {MERGED}, {PACKED}, {CHUNKS} SELECT book_id AS doc_id, chunk_idx, chunk FROM chunks")
def stream_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents read as a stream up to what is there, each once, and cut into chunks."""
    return drained(spark, f"{sf_dir}/documents.parquet", lambda df: chunks(df.select("doc_id", "text"), content="text", raw=True))
