"""Playback: stored positions, the player's transitions, changes of chapter."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

RESUME = "struct<slug:string,chapterIndex:int,currentTime:double>"


def parse_resume(json: Column) -> Column:
    """struct(slug, chapterIndex, currentTime), null if malformed or a field is missing or of another type."""
    found = F.from_json(json, RESUME)
    whole = found["slug"].isNotNull() & found["chapterIndex"].isNotNull() & found["currentTime"].isNotNull()
    return F.when(whole, found)


def validated(resumes: DataFrame, books: DataFrame) -> DataFrame:
    """Positions (user_id, slug, chapter, at) against books (slug, n_chapters).

    An unknown book starts the first book; a chapter out of range is chapter 0; the time holds only if
    it isn't negative and the chapter hasn't changed.
    """
    first = books.agg(F.min("slug").alias("first"))
    both = resumes.join(books, "slug", "left").crossJoin(F.broadcast(first))
    known = F.col("n_chapters").isNotNull()
    chapter = F.when(known & (F.col("chapter") < F.col("n_chapters")) & (F.col("chapter") >= 0), F.col("chapter")).otherwise(F.lit(0))
    kept = known & (chapter == F.col("chapter")) & (F.col("at") >= 0)
    return both.select("user_id", F.when(known, F.col("slug")).otherwise(F.col("first")).alias("slug"), chapter.alias("chapter"), F.when(kept, F.col("at")).otherwise(F.lit(0.0)).alias("at"))


def latest(events: DataFrame, key: str, order: list[str], values: list[str]) -> DataFrame:
    """The last values of each key, combined before the shuffle."""
    last = F.max_by(F.struct(*values), F.struct(*order))
    return events.groupBy(key).agg(last.alias("x")).select(key, "x.*")


def transitions(events: DataFrame, key: str, order: list[str], chapters: list[int]) -> DataFrame:
    """``events`` with the book and chapter that a key's player is at after each event (kind, at).

    chapters: the number of chapters of each book of the catalogue, in its order. "ended" and "next" go on, after a
    book's last chapter to the next book's first, and stay at the end of the last book. "prev" goes to the
    chapter before, but from a book's first chapter, or after five seconds, only to the chapter's own start.
    A player starts at the first chapter of the first book.

    What an event does depends on where the player is, so each key is folded in order: partitions are sorted and
    read once, and only the place of the key at hand is held.
    """
    places = [(b, c) for b, n in enumerate(chapters) for c in range(n)]
    if not places:
        raise ValueError("a catalogue without chapters has nothing to play")

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: Any = None
        place = 0
        for batch in batches:
            book, chapter = [], []
            for who, kind, at in zip(*(batch[c].to_pylist() for c in (key, "kind", "at")), strict=True):
                if who != now:
                    now, place = who, 0
                if kind in ("ended", "next"):
                    place = min(place + 1, len(places) - 1)
                elif kind == "prev" and at is not None and at <= 5 and places[place][1]:
                    place -= 1
                book.append(places[place][0])
                chapter.append(places[place][1])
            yield batch.append_column("book", pa.array(book, pa.int64())).append_column("chapter", pa.array(chapter, pa.int64()))

    schema = StructType([*events.schema.fields, StructField("book", LongType()), StructField("chapter", LongType())])
    return events.repartition(key).sortWithinPartitions(key, *order).mapInArrow(fold, schema)


def changes(events: DataFrame, key: str, order: list[str], watched: list[str]) -> DataFrame:
    """Rows whose watched values differ from those of the key's row before."""
    before = F.lag(F.struct(*watched)).over(Window.partitionBy(key).orderBy(*order))
    return events.withColumn("_before", before).where(F.col("_before").isNull() | (F.struct(*watched) != F.col("_before"))).drop("_before")
