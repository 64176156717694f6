"""Sources and sinks in round trips through the shared scratch folder, and what is left of the stages around them."""

from __future__ import annotations

import io
import uuid
import zipfile

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.operators.synthesis import split_oversize as halved
from lectern.operators.waveform import combined, recovered
from lectern.plans.registry import query
from lectern.session import shared_folder, table
from lectern.sources import epub, files, markdown


def _folder(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/{uuid.uuid4().hex}"


def _put(spark: SparkSession, folder: str, rows: DataFrame) -> str:
    """Writes the few files (name, content) into a folder; its path."""
    for row in rows.toLocalIterator():
        content = row["content"]
        files.replace_in_place(spark, f"{folder}/{row['name']}", content.encode() if isinstance(content, str) else bytes(content))
    return folder


@query("SELECT concat('T', r_regionkey) AS title, concat(r_name, chr(10), 'żółć \"', r_regionkey, '\"') AS content FROM region")
def scan_chapters_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An array of chapters written as one JSON file and read back."""
    rows = table(spark, sf_dir, "region").select(F.concat(F.lit("T"), F.col("r_regionkey").cast("string")).alias("title"), F.concat("r_name", F.lit('\nżółć "'), F.col("r_regionkey").cast("string"), F.lit('"')).alias("content"))
    array = rows.agg(F.to_json(F.collect_list(F.struct("title", "content"))).alias("content")).select(F.lit("chapters.json").alias("name"), "content")
    return files.read_chapters(spark, f"{_put(spark, _folder(spark), array)}/chapters.json")


@query("SELECT concat('T', doc_id) AS title, text AS content FROM documents")
def scan_chapters_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chapters of all documents written as lines of JSON and read back."""
    path = _folder(spark)
    files.write_chapters(table(spark, sf_dir, "documents").select(F.concat(F.lit("T"), F.col("doc_id").cast("string")).alias("title"), F.col("text").alias("content")), path)
    return spark.read.schema(files.CHAPTERS).json(path)


MD_FILES = (
    "SELECT n_nationkey, concat(lpad(cast(n_nationkey AS string), 2, '0'), '_', lower(n_name), CASE WHEN n_nationkey % 7 = 6 THEN '.txt' ELSE '.md' END) AS name, "
    "CASE n_nationkey % 4 WHEN 0 THEN concat('# ', n_name, char(10), 'Some &nbsp; text  ', n_nationkey) WHEN 1 THEN concat('No heading ', n_nationkey) WHEN 2 THEN concat('#  Two words', char(10), '<b>b</b>') ELSE '  ' END AS content FROM nation"
)


@query(
    "SELECT (row_number() OVER (ORDER BY n_nationkey) - 1)::INT AS chapter_idx, CASE n_nationkey % 4 WHEN 0 THEN n_name WHEN 1 THEN replace(lower(n_name), '_', ' ') ELSE 'Two words' END AS title, "
    "CASE n_nationkey % 4 WHEN 0 THEN 'Some   text ' || n_nationkey WHEN 1 THEN 'No heading ' || n_nationkey ELSE 'b' END AS content FROM nation WHERE n_nationkey % 7 <> 6 AND n_nationkey % 4 < 3"
)
def scan_md_folder(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A folder of Markdown files, in the order of their names; blank files and others are left out."""
    table(spark, sf_dir, "nation").createOrReplaceTempView("_md_nation")
    rows = spark.sql(MD_FILES.replace("FROM nation", "FROM _md_nation")).select("name", "content")
    return markdown.load_folder(spark, _put(spark, _folder(spark), rows))


def _epub(title: str | None, author: str | None, texts: list[str]) -> bytes:
    """A package whose items stand in order and whose spine goes through all but the last of them backwards."""
    out = io.BytesIO()
    said = (f"<dc:title>{title}</dc:title>" if title else "") + (f"<dc:creator>{author}</dc:creator>" if author else "")
    items = "".join(f'<item id="i{k}" href="t/p{k}.xhtml" media-type="application/xhtml+xml"/>' for k in range(len(texts)))
    spine = "".join(f'<itemref idref="i{k}"/>' for k in reversed(range(len(texts) - 1)))
    package = f'<package xmlns="http://www.idpf.org/2007/opf" xmlns:dc="http://purl.org/dc/elements/1.1/"><metadata>{said}</metadata><manifest>{items}</manifest><spine>{spine}</spine></package>'
    with zipfile.ZipFile(out, "w") as book:
        book.writestr("META-INF/container.xml", '<container xmlns="urn:oasis:names:tc:opendocument:xmlns:container"><rootfiles><rootfile full-path="O/content.opf"/></rootfiles></container>')
        book.writestr("O/content.opf", package)
        for k, text in enumerate(texts):
            book.writestr(f"O/t/p{k}.xhtml", text)
    return out.getvalue()


def _books(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The items of a book for each region: a document for each of its nations."""
    nations = table(spark, sf_dir, "nation").groupBy(F.col("n_regionkey").alias("r_regionkey")).agg(F.sort_array(F.collect_list(F.struct("n_nationkey", "n_name"))).alias("own"))
    rows = table(spark, sf_dir, "region").join(nations, "r_regionkey").collect()
    made = []
    for r in rows:
        texts = [f"<html><body><h1>{n['n_name']}</h1><p>{n['n_nationkey']}</p></body></html>" for n in r["own"]]
        made.append((f"b{r['r_regionkey']}.epub", bytearray(_epub(r["r_name"] if r["r_regionkey"] % 2 == 0 else None, "A. Author" if r["r_regionkey"] % 3 == 0 else None, texts))))
    return epub.read_items(spark, _put(spark, _folder(spark), spark.createDataFrame(pd.DataFrame(made, columns=["name", "content"]), "name string, content binary")))


ITEMS = "own AS (SELECT n_regionkey AS r, n_nationkey, n_name, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) - 1 AS k, count(*) OVER (PARTITION BY n_regionkey) AS n FROM nation)"


@query(f"WITH {ITEMS} SELECT concat('b', r, '.epub') AS book, (CASE WHEN k = n - 1 THEN k ELSE n - 2 - k END)::INT AS pos, concat('t/p', k, '.xhtml') AS filename, concat('<html><body><h1>', n_name, '</h1><p>', n_nationkey, '</p></body></html>') AS html FROM own")
def scan_epub(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of packages in reading order: the spine's, then those that the spine leaves out."""
    found = epub.in_reading_order(_books(spark, sf_dir))
    return found.select(F.regexp_extract("book_id", "([^/]*)$", 1).alias("book"), F.col("pos").cast("int").alias("pos"), "filename", "html")


@query("SELECT concat('b', r_regionkey, '.epub') AS book, CASE WHEN r_regionkey % 2 = 0 THEN r_name ELSE 'Unknown title' END AS title, CASE WHEN r_regionkey % 3 = 0 THEN 'A. Author' ELSE 'Unknown author' END AS author FROM region")
def book_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Titles and authors that packages state, or the defaults."""
    found = epub.metadata(_books(spark, sf_dir))
    return found.select(F.regexp_extract("book_id", "([^/]*)$", 1).alias("book"), "title", "author")


@query("SELECT concat('n', n_nationkey, CASE n_nationkey % 4 WHEN 0 THEN '.mp3' WHEN 1 THEN '.wav' WHEN 2 THEN '.MP3' ELSE '.txt' END) AS name, n_nationkey + 1 AS bytes, CASE WHEN n_nationkey % 4 > 1 THEN 'not audio' END AS skipped FROM nation")
def scan_audio_dir(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A folder's files: .mp3 and .wav, and why the others are left out."""
    name = F.concat(F.lit("n"), F.col("n_nationkey").cast("string"), F.element_at(F.array(*map(F.lit, (".mp3", ".wav", ".MP3", ".txt"))), (F.col("n_nationkey") % 4 + 1).cast("int")))
    rows = table(spark, sf_dir, "nation").select(name.alias("name"), F.repeat(F.lit("x"), (F.col("n_nationkey") + 1).cast("int")).alias("content"))
    return files.list_audio(spark, _put(spark, _folder(spark), rows)).select("name", "bytes", "skipped")


META_FILE = "CASE WHEN r_regionkey = 3 THEN '{broken' ELSE concat('{\"slug\":\"s', r_regionkey, '\",\"title\":\"', r_name, '\"', CASE WHEN r_regionkey % 2 = 0 THEN concat(',\"tom\":', r_regionkey) ELSE '' END, ',\"chapters\":[{\"index\":0,\"filename\":\"R0_a.mp3\",\"label\":\"x\"}]}') END"


@query("SELECT concat('s', r_regionkey) AS slug, r_name AS title, coalesce(CASE WHEN r_regionkey % 2 = 0 THEN r_regionkey END, -1)::INT AS tom, '' AS series, 1 AS n_chapters FROM region WHERE r_regionkey <> 3")
def scan_catalogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The meta.json of every book's folder; a broken one is left out, a missing field takes its default."""
    rows = table(spark, sf_dir, "region").select(F.concat(F.lit("b"), F.col("r_regionkey").cast("string"), F.lit("/audio/meta.json")).alias("name"), F.expr(META_FILE).alias("content"))
    found = files.read_catalogue(spark, f"{_put(spark, _folder(spark), rows)}/*/audio/meta.json")
    return found.select("slug", "title", F.coalesce("tom", F.lit(-1)).alias("tom"), F.coalesce("series", F.lit("")).alias("series"), F.size("chapters").alias("n_chapters"))


def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(chapter, seq, frame_rate, samples): each vector as a segment of 16-bit samples at 1 kHz; every eleventh has no file."""

    @F.pandas_udf("binary")
    def sound(vectors: pd.Series) -> pd.Series:
        return vectors.map(lambda v: (v.astype("float64") * 20000).clip(-32768, 32767).astype("<i2").tobytes())

    samples = F.when(F.col("vec_id") % 11 > 0, sound("embedding"))
    return table(spark, sf_dir, "embeddings").select((F.col("vec_id") % 3).alias("chapter"), F.col("vec_id").cast("int").alias("seq"), F.lit(1000).alias("frame_rate"), samples.alias("samples"))


SAMPLES = "least(greatest(trunc(CAST(x AS DOUBLE) * 20000), -32768), 32767)::BIGINT"
HEARD = f"there AS (SELECT vec_id % 3 AS chapter, vec_id, list_transform(embedding, lambda x: {SAMPLES}) AS s FROM embeddings WHERE vec_id % 11 > 0)"


def _heard(df: DataFrame, *keys: str) -> DataFrame:
    """Length and digest of samples: of their decimal numbers, joined by commas."""

    @F.pandas_udf("string")
    def shown(samples: pd.Series) -> pd.Series:
        import numpy as np

        return samples.map(lambda s: ",".join(map(str, np.frombuffer(s, "<i2").tolist())))

    return df.select(*keys, (F.octet_length("samples") / 2).cast("bigint").alias("n_samples"), F.md5(shown("samples").cast("binary")).alias("digest"))


@query(
    f"WITH {HEARD}, ranked AS (SELECT *, row_number() OVER (PARTITION BY chapter ORDER BY vec_id) - 1 AS r, count(*) OVER (PARTITION BY chapter) AS n FROM there), "
    "faded AS (SELECT chapter, r, list_transform(s, lambda x, i: CASE WHEN i <= 5 AND r % 50 > 0 THEN trunc(x * (i - 1) / CAST(5 AS DOUBLE)) WHEN i > len(s) - 5 AND r % 50 < 49 AND r < n - 1 THEN trunc(x * (len(s) - i) / CAST(5 AS DOUBLE)) ELSE x END::BIGINT) AS s FROM ranked), "
    "whole AS (SELECT chapter, flatten(list(s ORDER BY r)) AS s FROM faded GROUP BY chapter) SELECT chapter, len(s) AS n_samples, md5(array_to_string(s, ',')) AS digest FROM whole"
)
def combine_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each chapter's samples, fifty segments to a batch, with fades where two of a batch meet; missing segments are left out."""
    return _heard(combined(segments(spark, sf_dir), ["chapter"]), "chapter")


@query("WITH there AS (SELECT vec_id, list_transform(embedding, lambda x: " + SAMPLES + ") AS s FROM embeddings WHERE vec_id < 20 AND vec_id % 11 > 0) SELECT concat('v', vec_id, '.wav') AS name, len(s) AS duration_ms, len(s) AS n_samples, md5(array_to_string(s, ',')) AS digest FROM there")
def scan_wav(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Twenty segments written as WAV files and read back."""
    folder = _folder(spark)
    files.write_wav(segments(spark, sf_dir).where("seq < 20"), folder, F.concat(F.lit("v"), F.col("seq").cast("string")))
    found = files.read_wav(spark, folder).select(F.regexp_extract("path", "([^/]*)$", 1).alias("name"), "duration_ms", "samples")
    return _heard(found, "name", "duration_ms")


@query("SELECT count(*)::INT AS current_chapter, 7 AS current_chunk, 'a,b' AS done FROM region")
def checkpoint_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _folder(spark)
    state = table(spark, sf_dir, "region").agg(F.count("*").cast("int").alias("current_chapter")).select(F.array(F.lit("a"), F.lit("b")).alias("completed_chapters"), "current_chapter", F.lit(7).alias("current_chunk"))
    files.write_checkpoint(state, path)
    return files.read_checkpoint(spark, path).select("current_chapter", "current_chunk", F.array_join("completed_chapters", ",").alias("done"))


@query("SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN 'speaker.wav' WHEN p_size % 3 = 0 THEN 'voice.wav' WHEN p_size % 5 = 0 THEN 'sample.wav' END AS speaker FROM part")
def first_existing(spark: SparkSession, sf_dir: str) -> DataFrame:
    there = lambda n: F.col("p_size") % n == 0
    return table(spark, sf_dir, "part").select("p_partkey", files.first_existing([(there(2), "speaker.wav"), (there(3), "voice.wav"), (there(5), "sample.wav")]).alias("speaker"))


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_orderkey % 5 > 1 UNION ALL SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_orderkey % 5 <= 1 AND l_linenumber < 3")
def segment_recover(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segments made now; for chapters without any, those stored before."""
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber")
    return recovered(rows.where("l_orderkey % 5 > 1"), rows.where("l_linenumber < 3"), ["l_orderkey"])


@query(
    "WITH RECURSIVE p(doc_id, place, part) AS (SELECT doc_id, '', trim(text, ' ') FROM documents WHERE text IS NOT NULL UNION ALL SELECT doc_id, place || u.k, "
    "trim(CASE u.k WHEN 0 THEN substr(part, 1, place_of - 1) ELSE substr(part, place_of) END, {WHITE}) FROM (SELECT *, CASE WHEN before > 0 THEN before WHEN after > 0 THEN half + after ELSE 0 END AS place_of FROM "
    "(SELECT *, length(part) // 2 AS half, length(part) // 2 + 1 - nullif(instr(reverse(substr(part, 1, length(part) // 2)), ' '), 0) AS before, instr(substr(part, length(part) // 2 + 1), ' ') AS after FROM p WHERE length(part) > 200)) AS q, (VALUES (0), (1)) AS u(k) "
    "WHERE place_of > 0 AND trim(CASE u.k WHEN 0 THEN substr(part, 1, place_of - 1) ELSE substr(part, place_of) END, {WHITE}) <> ''), "
    "leaves AS (SELECT doc_id, place, part FROM p WHERE length(part) <= 200 OR instr(part, ' ') = 0) "
    "SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY place) - 1)::INT AS idx, part FROM leaves".replace("{WHITE}", "concat(' ', chr(9), chr(10), chr(11), chr(12), chr(13))")
)
def split_oversize(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts halved at spaces until every part has at most 200 characters."""
    trimmed = F.trim(F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", F.posexplode(halved(trimmed, 200)).alias("idx", "part"))
