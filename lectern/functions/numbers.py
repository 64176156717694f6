"""Times and positions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def format_time(seconds: Column) -> Column:
    """``m:ss``, from an hour on ``h:mm:ss``."""
    whole = F.floor(seconds)
    h, m, s = (F.floor(whole / 3600), F.floor(whole % 3600 / 60), whole % 60)
    two = lambda x: F.lpad(x.cast("string"), 2, "0")
    return F.when(h > 0, F.concat(h.cast("string"), F.lit(":"), two(m), F.lit(":"), two(s))).otherwise(F.concat(m.cast("string"), F.lit(":"), two(s)))


def clamp(value: Column, low: Column, high: Column) -> Column:
    return F.greatest(low, F.least(value, high))


def progress_fraction(current: Column, duration: Column) -> Column:
    """0 where the duration is 0 or less."""
    return F.when(duration > 0, current / duration).otherwise(F.lit(0.0))
