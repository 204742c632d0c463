"""Frame-to-frame spans: what changed since the last frame of a line, with state for each line."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def dirty_stream(spans: DataFrame) -> DataFrame:
    """spans: frame, y, x0, x1 (equal for an empty line). Gives the union of each line's span with its last one."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        before = state.get if state.exists else (0, 0)
        out = []
        for row in pd.concat(list(batches)).sort_values("frame").itertuples():
            now = (int(row.x0), int(row.x1))
            both = [s for s in (before, now) if s[0] < s[1]]
            if both:
                out.append((int(row.frame), key[0], min(s[0] for s in both), max(s[1] for s in both)))
            before = now
        state.update(before)
        yield pd.DataFrame(out, columns=["frame", "y", "x0", "x1"])

    return spans.groupBy("y").applyInPandasWithState(step, "frame int, y int, x0 int, x1 int", "x0 int, x1 int", "append", GroupStateTimeout.NoTimeout)
