"""Markdown: a folder of chapter files, and one text cut at its headings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lectern.functions.names import md_title
from lectern.functions.text import md_clean_text, strip


def parsed(md: Column) -> Column:
    """array of struct(title, content): parts between level-one headings that have a body; what stands before the first too."""
    parts = F.filter(F.transform(F.split(md, "(?m)^# "), strip), lambda p: p != "")

    def chapter(p: Column) -> Column:
        at = F.instr(p, "\n")
        body = F.when(at > 0, md_clean_text(F.substring(p, at + F.lit(1), F.length(p)))).otherwise(F.lit(""))
        return F.struct(strip(F.split_part(p, F.lit("\n"), F.lit(1))).alias("title"), body.alias("content"))

    return F.filter(F.transform(parts, chapter), lambda c: c["content"] != "")


def split_chapters(df: DataFrame, keys: list[str], md: str) -> DataFrame:
    """Rows (keys, chapter_idx, title, content) of the chapters in a column of Markdown texts."""
    return df.select(*keys, F.posexplode(parsed(F.col(md))).alias("chapter_idx", "c")).select(*keys, "chapter_idx", "c.title", "c.content")


def load_folder(spark: SparkSession, path: str) -> DataFrame:
    """(chapter_idx, title, content) of a folder's ``*.md`` files, in the order of their paths.

    Files of white space only are left out. A missing folder raises; one without files gives no rows.
    """
    jvm = spark._jvm
    folder = jvm.org.apache.hadoop.fs.Path(path)
    fs = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(folder):
        raise FileNotFoundError(path)
    schema = "chapter_idx int, title string, content string"
    if not any(s.getPath().getName().endswith(".md") for s in fs.listStatus(folder)):
        return spark.createDataFrame([], schema)
    raw = spark.read.text(path, wholetext=True, pathGlobFilter="*.md").select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_name").alias("name"), F.col("value").alias("text"))
    has_title = F.col("text").rlike(r"^# [^\n]+")
    body = F.when(has_title, F.regexp_replace("text", r"^# [^\n]+\n?", "")).otherwise(F.col("text"))
    rows = raw.where(strip(F.col("text")) != "").select("path", md_title(F.col("text"), F.col("name")).alias("title"), md_clean_text(body).alias("content"))
    kept = rows.where("content <> ''")
    # The paths alone are numbered; texts stay where they are read.
    number = kept.select("path", (F.row_number().over(Window.orderBy("path")) - 1).alias("chapter_idx"))
    return kept.join(number, "path").select("chapter_idx", "title", "content")
