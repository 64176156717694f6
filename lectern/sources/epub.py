"""EPUB containers: documents in reading order and book metadata, from any file system that Spark reads."""

from __future__ import annotations

import io
import posixpath
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ITEMS = "book_id string, item_id string, pos int, spine_pos int, filename string, html string, titles array<string>, creators array<string>, error string"
_DOCUMENTS = ("application/xhtml+xml", "text/html")


def _local(tag: str) -> str:
    return tag.rpartition("}")[2]


def items_of(book_id: str, content: bytes) -> list[tuple]:
    """One row for each document of a container, with its place in the manifest and in the spine (null: not listed).

    A container that can't be read gives one row with only ``error``.
    """
    try:
        with zipfile.ZipFile(io.BytesIO(content)) as container:
            names = set(container.namelist())
            root = next((x.get("full-path", "") for x in ElementTree.fromstring(container.read("META-INF/container.xml")).iter() if _local(x.tag) == "rootfile"), "")
            package = ElementTree.fromstring(container.read(root))
            base = posixpath.dirname(root)
            text = lambda kind: [(x.text or "").strip() for x in package.iter() if _local(x.tag) == kind and x.text]
            spine = [x.get("idref", "") for x in package.iter() if _local(x.tag) == "itemref"]
            titles, creators, rows = text("title"), text("creator"), []
            for x in package.iter():
                if _local(x.tag) != "item" or x.get("media-type") not in _DOCUMENTS:
                    continue
                path = posixpath.normpath(posixpath.join(base, x.get("href", "")))
                if path in names:
                    item = x.get("id", "")
                    at = spine.index(item) if item in spine else None
                    rows.append((book_id, item, len(rows), at, x.get("href", ""), container.read(path).decode("utf-8", "replace"), titles, creators, None))
            return rows
    except (zipfile.BadZipFile, KeyError, ElementTree.ParseError) as error:
        return [(book_id, None, None, None, None, None, None, None, str(error) or type(error).__name__)]


def read_items(spark: SparkSession, path: str) -> DataFrame:
    """ITEMS of all ``*.epub`` files under ``path`` (a folder, a file or a pattern)."""

    def parse(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [x.split()[0] for x in ITEMS.split(", ")]
        for frame in frames:
            rows = [row for book, content in zip(frame["path"], frame["content"], strict=True) for row in items_of(book, content)]
            yield pd.DataFrame(rows, columns=names).astype({"pos": "Int32", "spine_pos": "Int32"})

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.epub").load(path).select("path", "content")
    return files.mapInPandas(parse, ITEMS)


def in_reading_order(items: DataFrame) -> DataFrame:
    """Documents (book_id, pos, filename, html), those of the spine first in its order, then the others."""
    from pyspark.sql import Window

    order = Window.partitionBy("book_id").orderBy(F.col("spine_pos").isNull(), "spine_pos", "pos")
    return items.where("error IS NULL").select("book_id", (F.row_number().over(order) - 1).alias("pos"), "filename", "html")


def metadata(items: DataFrame) -> DataFrame:
    """(book_id, title, author): the first of each that a book states, else the defaults."""
    first = lambda c, default: F.coalesce(F.get(F.first(c, ignorenulls=True), F.lit(0)), F.lit(default))
    return items.groupBy("book_id").agg(first("titles", "Unknown title").alias("title"), first("creators", "Unknown author").alias("author"))


def documents(items: DataFrame) -> DataFrame:
    """Titles and texts of the documents in reading order: the input of ``chapters.routed``."""
    from lectern.operators.chapters import extract_document, html_title

    return in_reading_order(items).select("book_id", "pos", html_title(F.col("html"), F.col("filename")).alias("title"), extract_document(F.col("html")).alias("content"), "filename")
