"""Playback positions as streaming state: the last position of each listener."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

SCHEMA = "user_id bigint, slug string, chapter int, at double"


def keep_latest(key: tuple[Any, ...], frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """Replace a listener's position by the newest of the batch, unless the one held is newer."""
    best = state.get if state.exists else None
    for frame in frames:
        if len(frame):
            last = frame.iloc[frame["ms"].to_numpy()[::-1].argmax() * -1 - 1]
            if best is None or last["ms"] >= best[0]:
                best = (int(last["ms"]), last["slug"], int(last["chapter"]), float(last["at"]))
    if best is not None:
        state.update(best)
        yield pd.DataFrame([(key[0], best[1], best[2], best[3])], columns=["user_id", "slug", "chapter", "at"])


def positions(stream: DataFrame) -> DataFrame:
    """(user_id, slug, chapter, at) updates from position events (user_id, ms, slug, chapter, at)."""
    return stream.groupBy("user_id").applyInPandasWithState(keep_latest, SCHEMA, "ms bigint, slug string, chapter int, at double", "update", GroupStateTimeout.NoTimeout)
