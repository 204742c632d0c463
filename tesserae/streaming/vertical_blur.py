"""A vertical blur over lines that arrive in order: Structured Streaming with state for each column.

The state of an (image, column) is the lines that boxes of later lines can still reach. Line y goes out when
line y + radius has come, and the rest when the image's end mark (a row with `last` set) has. Lines of a batch
are put in order here; a line that comes after its turn is an error, as it would change what has gone out.
Push mode keeps the image's height: nothing is written above the first or below the last line.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

SCHEMA = "image_id int, x int, y int, r int, g int, b int, a int"
STATE = "ys array<int>, rs array<int>, gs array<int>, bs array<int>, alphas array<int>, next int"


def stream_blur(lines: DataFrame, radius: int) -> DataFrame:
    """lines: image_id, x, y, r, g, b, a, last (an end mark: its y is one past the last line)."""
    size = 2 * radius + 1

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held: dict[int, tuple] = {}
        start = 0
        if state.exists:
            ys, rs, gs, bs, alphas, start = state.get
            held = {y: (r, g, b, a) for y, r, g, b, a in zip(ys, rs, gs, bs, alphas, strict=True)}
        rows = pd.concat(list(batches)).sort_values("y")
        end = None
        for row in rows.itertuples():
            if row.last:
                end = int(row.y)
            elif state.exists and row.y - radius < start:
                raise ValueError(f"line {row.y} comes after its turn")
            else:
                held[int(row.y)] = (int(row.r), int(row.g), int(row.b), int(row.a))
        top = end if end is not None else max([start, *(y - radius + 1 for y in held)])
        out = []
        for y in range(start, top):
            near = [held[k] for k in range(y - radius, y + radius + 1) if k in held]
            alpha = sum(p[3] for p in near)
            if alpha >= size:
                out.append((key[0], key[1], y, *(sum(p[k] * p[3] for p in near) // alpha for k in range(3)), alpha // size))
        if end is not None:
            state.remove()
        else:
            kept = sorted(y for y in held if y >= top - radius)
            state.update((kept, *([held[y][k] for y in kept] for k in range(4)), top))
        yield pd.DataFrame(out, columns=["image_id", "x", "y", "r", "g", "b", "a"])

    return lines.groupBy("image_id", "x").applyInPandasWithState(step, SCHEMA, STATE, "append", GroupStateTimeout.NoTimeout)
