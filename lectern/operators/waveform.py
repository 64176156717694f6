"""Sample-level work on segments: fades, silence, combining. Lengths alone are in ``audio``."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BATCH = 50


def _n(rate: int, ms: float) -> int:
    return int(rate * ms / 1000)


def nonsilent(samples: np.ndarray, rate: int, threshold: float, least_ms: int) -> list[tuple[int, int]]:
    """[start, end) in ms of what lies between silences of ``least_ms`` or more, by loudness of each millisecond."""
    step = max(1, _n(rate, 1))
    frames = len(samples) // step
    if not frames:
        return []
    power = np.sqrt((samples[: frames * step].astype(float).reshape(frames, step) ** 2).mean(axis=1))
    loud = 20 * np.log10(np.maximum(power, 1e-9) / 32768) > threshold
    edges = np.flatnonzero(np.diff(np.r_[0, loud.astype(np.int8), 0]))
    ranges: list[tuple[int, int]] = []
    for start, end in edges.reshape(-1, 2).tolist():
        if ranges and start - ranges[-1][1] < least_ms:
            ranges[-1] = ranges[-1][0], end
        else:
            ranges.append((start, end))
    return ranges


def faded(samples: np.ndarray, rate: int, in_ms: int, out_ms: int) -> np.ndarray:
    """Louder from nothing at the start, softer to nothing at the end, in equal steps from sample to sample."""
    out = samples.astype(np.int64)
    a, b = min(_n(rate, in_ms), len(out)), min(_n(rate, out_ms), len(out))
    if a:
        out[:a] = np.trunc(out[:a] * np.arange(a) / a)
    if b:
        out[-b:] = np.trunc(out[-b:] * np.arange(b - 1, -1, -1) / b)
    return out.astype(np.int16)


def trimmed(samples: np.ndarray, rate: int, threshold: float = -65, keep: int = 400, saving: int = 500) -> np.ndarray:
    """Without a long silence at the end."""
    ranges, length = nonsilent(samples, rate, threshold, 800), len(samples) * 1000 // rate
    if not ranges:
        return samples
    end = min(ranges[-1][1] + keep, length)
    return samples[: _n(rate, end)] if end < length - saving else samples


def stretched(samples: np.ndarray, rate: int, factor: float = 1.5, threshold: float = -35, least_ms: int = 150) -> np.ndarray:
    """Silences longer by ``factor``, speech as it is; unchanged without speech or with a factor of 1 or less."""
    ranges, length = nonsilent(samples, rate, threshold, least_ms), len(samples) * 1000 // rate
    if not ranges or factor <= 1:
        return samples
    out, last = [], 0
    for start, end in ranges:
        out += [np.zeros(_n(rate, int((start - last) * factor)), np.int16), samples[_n(rate, start) : _n(rate, end)]]
        last = end
    out.append(np.zeros(_n(rate, int((length - last) * factor)), np.int16))
    return np.concatenate(out)


def prepared(samples: np.ndarray, rate: int) -> np.ndarray:
    """A synthesised chunk: faded in, its end trimmed, faded out."""
    return faded(trimmed(faded(samples, rate, 10, 0), rate), rate, 0, 20)


def combined(segments: DataFrame, keys: list[str], crossfade: int = 100, pause_stretch: float = 1.0) -> DataFrame:
    """(keys, frame_rate, samples): one row for each key from rows (keys, seq, frame_rate, samples), in the order of seq.

    samples: 16-bit little-endian samples as bytes; rows with null samples, segments without a file, are left out. A
    pause_stretch above 1 stretches each segment's silences. Fifty segments make a batch. Where two of a batch meet and
    crossfade is positive, the end of the one and the start of the other fade for 5 ms; batches are put together as they are.
    A task holds one batch of segments, and in the last step one chapter.
    """
    fade = 5 if crossfade > 0 else 0
    kinds = dict(segments.dtypes)
    schema = ", ".join(f"`{k}` {kinds[k]}" for k in keys) + ", batch bigint, frame_rate int, samples binary"

    def join(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("seq")
        rate = int(group["frame_rate"].iloc[0])
        parts = [np.frombuffer(x, "<i2") for x in group["samples"]]
        parts = [stretched(x, rate, pause_stretch) if pause_stretch > 1 else x for x in parts]
        parts = [faded(x, rate, fade if i else 0, fade if i < len(parts) - 1 else 0) for i, x in enumerate(parts)]
        row = [group[k].iloc[0] for k in keys] + [int(group["batch"].iloc[0]), rate, np.concatenate(parts).astype("<i2").tobytes()]
        return pd.DataFrame([row], columns=[*keys, "batch", "frame_rate", "samples"])

    there = segments.where("samples IS NOT NULL")
    # Segments are counted without their samples.
    number = F.row_number().over(Window.partitionBy(*keys).orderBy("seq")) - 1
    batch = there.select(*keys, "seq").withColumn("batch", F.floor(number / BATCH))
    batches = there.select(*keys, "seq", "frame_rate", "samples").join(batch, [*keys, "seq"]).groupBy(*keys, "batch").applyInPandas(join, schema)
    whole = F.sort_array(F.collect_list(F.struct("batch", "frame_rate", "samples")))
    out = batches.groupBy(*keys).agg(whole.alias("b"))
    samples = F.aggregate("b", F.lit(b"").cast("binary"), lambda a, x: F.concat(a, x["samples"]))
    return out.select(*keys, F.get("b", F.lit(0))["frame_rate"].alias("frame_rate"), samples.alias("samples"))


def recovered(made: DataFrame, stored: DataFrame, keys: list[str]) -> DataFrame:
    """Segments just made; for keys without any, those that are stored from before."""
    return made.unionByName(stored.join(made.select(*keys).distinct(), keys, "left_anti"))
