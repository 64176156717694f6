"""Lengths of audio: ranges of speech, stretched, trimmed and padded silence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def nonsilent_ranges(frames: DataFrame, threshold: float) -> DataFrame:
    """(seg_id, start_ms, end_ms): runs of frames (seg_id, ms, dbfs) louder than the threshold."""
    order = Window.partitionBy("seg_id").orderBy("ms")
    loud = frames.withColumn("loud", F.col("dbfs") > threshold)
    turned = (F.col("loud") != F.lag("loud", 1, False).over(order)).cast("int")
    islands = loud.withColumn("turned", turned).withColumn("island", F.sum("turned").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    return islands.where("loud").groupBy("seg_id", "island").agg(F.min("ms").alias("start_ms"), (F.max("ms") + 1).alias("end_ms")).drop("island")


def stretched(ranges: DataFrame, total: Column, factor: float) -> DataFrame:
    """Each range with the stretched silence before it (gap_ms) and, for the last, after it (trailing_ms)."""
    order = Window.partitionBy("seg_id").orderBy("start_ms")
    gap = F.col("start_ms") - F.lag("end_ms", 1, 0).over(order)
    is_last = F.lead("start_ms").over(order).isNull()
    trailing = F.when(is_last, F.floor(F.greatest(total - F.col("end_ms"), F.lit(0)) * factor)).otherwise(F.lit(0))
    return ranges.select("seg_id", "start_ms", F.floor(gap * factor).alias("gap_ms"), (F.col("end_ms") - F.col("start_ms")).alias("speech_ms"), trailing.alias("trailing_ms"))


def trimmed(ranges: DataFrame, total: Column, keep: int = 400, saving: int = 500) -> DataFrame:
    """(seg_id, kept_ms): up to ``keep`` after the last speech, if that saves more than ``saving``."""
    end = F.least(F.col("last_end") + keep, total)
    return ranges.groupBy("seg_id").agg(F.max("end_ms").alias("last_end")).select("seg_id", F.when(end < total - saving, end).otherwise(total).alias("kept_ms"))


def padded(duration: Column, pad: int) -> Column:
    return duration + 2 * pad
