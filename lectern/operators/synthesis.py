"""Speech synthesis as a pluggable stage, with the retry by halves around it."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

#: A text of so many characters or fewer isn't cut.
SHORTEST = 20
_PART = StructType([StructField("audio_key", StringType()), StructField("duration_ms", LongType())])


class TooLong(Exception):
    """A synthesiser's refusal of a text that is too long for it."""


class Synthesizer(Protocol):
    def load(self) -> None:
        """Called once in each worker task, before the first text."""

    def speak(self, text: str) -> tuple[str, int]:
        """(key of the audio, milliseconds); raises TooLong."""


class StubSynthesizer:
    """No sound: the text's digest, and 60 ms for each character."""

    def load(self) -> None:
        return

    def speak(self, text: str) -> tuple[str, int]:
        return hashlib.md5(text.encode()).hexdigest(), 60 * len(text)


def cut(text: str) -> list[str] | None:
    """The text in two, at the last space before its middle, else the first after it; null if there is none. Blank parts go."""
    middle = len(text) // 2
    at = text.rfind(" ", 0, middle)
    if at < 0:
        at = text.find(" ", middle)
    if at < 0:
        return None
    return [part for part in (text[:at].strip(), text[at:].strip()) if part]


def halves(text: str, fits: Callable[[str], bool]) -> list[str]:
    """The text, cut in two at a space, and its parts again, until every part fits or has no space to be cut at."""
    if fits(text):
        return [text]
    parts = cut(text)
    if parts is None or parts == [text]:
        return [text]
    return [part for half in parts for part in halves(half, fits)]


def split_oversize(text: Column, most: int) -> Column:
    """Parts of at most ``most`` characters, as far as spaces allow."""

    @F.pandas_udf("array<string>")
    def split(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else halves(t, lambda x: len(x) <= most))

    return split(text)


def spoken(synthesizer: Synthesizer, text: str) -> list[tuple[str, int]]:
    """(key of the audio, milliseconds) of the text, or of its parts where the synthesiser refuses it as too long.

    A refused text of more than 20 characters is cut as in ``halves``; parts without a space to cut at raise, as do
    shorter texts.
    """
    try:
        return [synthesizer.speak(text)]
    except TooLong:
        parts = cut(text) if len(text) > SHORTEST else None
        if not parts:
            raise
        return [made for part in parts for made in spoken(synthesizer, part)]


def synthesize(chunks: DataFrame, synthesizer: Synthesizer) -> DataFrame:
    """``chunks`` (with a column chunk) with audio_key, duration_ms, error and parts; a failed chunk fails alone.

    White space at the end goes and a full stop comes where no final mark stands. parts: array of (audio_key, duration_ms), in
    order, more than one where a text was too long; audio_key is the only part's, else the parts' keys joined by "+".
    """
    schema = StructType([*chunks.schema.fields, *(StructField(n, t) for n, t in (("audio_key", StringType()), ("duration_ms", LongType()), ("error", StringType()), ("parts", ArrayType(_PART))))])

    def speak(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        synthesizer.load()
        for frame in frames:
            rows = []
            for text in frame["chunk"]:
                text = (text or "").rstrip()
                if text and text[-1] not in ".!?…":
                    text += "."
                try:
                    made = spoken(synthesizer, text)
                    rows.append(("+".join(k for k, _ in made), sum(ms for _, ms in made), None, [{"audio_key": k, "duration_ms": ms} for k, ms in made]))
                except Exception as error:  # noqa: BLE001
                    rows.append((None, 0, str(error) or type(error).__name__, []))
            keys, lengths, errors, parts = (list(x) for x in zip(*rows, strict=True)) if rows else ([], [], [], [])
            yield frame.assign(audio_key=keys, duration_ms=lengths, error=errors, parts=parts)

    return chunks.mapInPandas(speak, schema)
