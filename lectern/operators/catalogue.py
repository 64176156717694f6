"""The catalogue of finished books: files to chapters, books, manifest, and back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CHAPTER = "struct<index:int,filename:string,label:string>"
BOOK = f"struct<slug:string,title:string,author:string,series:string,tom:int,generated_at:string,chapters:array<{CHAPTER}>>"


def r_index(filename: Column, strict: bool = True) -> Column:
    """The number after R at the name's start; strict names have no volume before it. Null if there is none."""
    found = F.regexp_extract(filename, "^R([0-9]+)_" if strict else "^(?:T[0-9]+_)?R([0-9]+)_", 1)
    return F.when(found != "", found.cast("int"))


def listed(files: DataFrame, strict: bool = True) -> DataFrame:
    """Files (book_id, filename) with their index; others go."""
    return files.withColumn("index", r_index(F.col("filename"), strict)).where("index IS NOT NULL AND endswith(filename, '.mp3')")


def labelled(files: DataFrame, titles: DataFrame) -> DataFrame:
    """Listed files with the label of chapter index - 1 (book_id, chapter_idx, title); 0 is the introduction."""
    at = titles.select("book_id", (F.col("chapter_idx") + 1).alias("index"), F.col("title").alias("_title"))
    label = F.when(F.col("index") == 0, F.lit("Wprowadzenie")).otherwise(F.coalesce("_title", F.concat(F.lit("Rozdział "), F.col("index").cast("string"))))
    return files.join(at, ["book_id", "index"], "left").withColumn("label", label).drop("_title")


def books(labels: DataFrame, meta: DataFrame) -> DataFrame:
    """One row for each book of ``meta`` (book_id, slug, title, author, series, tom, generated_at) with its chapters in order.

    Empty series count as missing. Chapters of one book meet in one array; a book has hundreds.
    """
    gathered = labels.groupBy("book_id").agg(F.sort_array(F.collect_list(F.struct("index", "filename", "label"))).alias("chapters"))
    out = meta.join(gathered, "book_id").withColumn("series", F.nullif("series", F.lit("")))
    return out.select("book_id", "slug", "title", "author", "series", "tom", "generated_at", "chapters")


def first_of(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_rank", rank).where("_rank = 1").drop("_rank")


def ordered_concat(df: DataFrame, keys: list[str], order: str, value: str, between: str) -> DataFrame:
    """``value`` of each key's rows, in order, as one text."""
    rows = F.sort_array(F.collect_list(F.struct(order, value)))
    return df.groupBy(*keys).agg(F.array_join(F.transform(rows, lambda x: x[value]), between).alias(value))


def exploded(manifest: DataFrame) -> DataFrame:
    """Chapters of a manifest (json): slug, index, filename, label; null for malformed ones are left out."""
    found = manifest.select(F.from_json("json", f"struct<books:array<{BOOK}>>").alias("m"))
    each = found.select(F.explode("m.books").alias("b"))
    return each.select("b.slug", F.explode("b.chapters").alias("c")).select("slug", "c.*")
