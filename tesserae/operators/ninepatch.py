"""Nine-patch images: corners keep their size, edges stretch along one axis, the middle along both."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesserae.functions.fixed import ONE, Matrix, single
from tesserae.operators.blend import overwrite
from tesserae.operators.geometry import Rect, crop, move, sample_nearest


@dataclass(frozen=True)
class Axis:
    """One axis: source starts and sizes of the three parts, where they go, and their output sizes."""

    starts: tuple[int, int, int]
    sizes: tuple[int, int, int]
    offsets: tuple[float, float, float]
    lengths: tuple[float, float, float]

    @classmethod
    def plan(cls, size: int, low: int, high: int, output: float) -> Axis:
        """Fixed parts low and high of a source of that size, stretched to output.

        Where the output can't hold both fixed parts they share it in proportion, and nothing is
        left for the middle.
        """
        fixed = low + high
        if output < fixed and fixed > 0:
            ratio = single(output / fixed)
            lengths = (single(low * ratio), 0.0, single(high * ratio))
        else:
            lengths = (float(low), single(output - low - high), float(high))
        return cls((0, low, size - high), (low, size - fixed, high), (0.0, lengths[0], single(output - lengths[2])), lengths)

    def part(self, k: int) -> tuple[int, int, float, float] | None:
        """(source start, source size, scale, offset) of a part, with the overlap of fixed parts into a stretched middle."""
        if self.sizes[k] <= 0:
            return None
        start, size, offset = self.starts[k], self.sizes[k], self.offsets[k]
        if self.sizes[1] > 0 and self.lengths[1] >= 1 and k != 1:
            size += 1
            if k == 2:
                start, offset = start - 1, offset - 1
        return start, size, single(self.lengths[k] / self.sizes[k]), offset


#: The middle first, then edges, then corners, as (row, column): later parts cover earlier ones.
ORDER = [(1, 1), (0, 1), (1, 0), (1, 2), (2, 1), (0, 0), (0, 2), (2, 0), (2, 2)]


def patches(width: int, height: int, left: int, top: int, right: int, bottom: int, out_w: float, out_h: float, pivot: tuple[int, int] = (0, 0), at: tuple[float, float] = (0, 0)) -> list[tuple[int, Rect, Matrix]]:
    """(rank, source rectangle, matrix) of each patch that isn't empty."""
    xs, ys = Axis.plan(width, left, right, out_w), Axis.plan(height, top, bottom, out_h)
    found = []
    for rank, (row, col) in enumerate(ORDER):
        x, y = xs.part(col), ys.part(row)
        if x is None or y is None:
            continue
        tx, ty = single(x[3] - pivot[0] / ONE + at[0]), single(y[3] - pivot[1] / ONE + at[1])
        found.append((rank, (x[0], y[0], x[0] + x[1], y[0] + y[1]), Matrix(x[2], 0.0, 0.0, y[2], tx, ty)))
    return found


def fill(df: DataFrame, size: tuple[int, int], bounds: tuple[int, int, int, int], output: tuple[float, float], pivot: tuple[int, int] = (0, 0), at: tuple[float, float] = (0, 0), view: Matrix | None = None, rect: Rect | None = None) -> DataFrame:
    """A nine-patch (fixed left, top, right, bottom in bounds) stretched to the output size; parts overwrite."""
    parts = []
    for rank, source, m in patches(*size, *bounds, *output, pivot, at):
        own = move(crop(df, source), -source[0], -source[1])
        parts.append(sample_nearest(own, view @ m if view else m, rect=rect).withColumn("rank", F.lit(rank)))
    return overwrite(reduce(DataFrame.unionByName, parts))


def stretch_spans(df: DataFrame, width: int, height: int) -> DataFrame:
    """image_id and the fixed parts (left, top, right, bottom) that the black border pixels of a nine-patch mark."""
    black = (F.col("r") == 0) & (F.col("g") == 0) & (F.col("b") == 0) & (F.col("a") > 0)
    top = black & (F.col("y") == 0) & F.col("x").between(1, width - 2)
    side = black & (F.col("x") == 0) & F.col("y").between(1, height - 2)
    marks = df.groupBy("image_id").agg(F.min(F.when(top, F.col("x"))).alias("x0"), F.max(F.when(top, F.col("x"))).alias("x1"), F.min(F.when(side, F.col("y"))).alias("y0"), F.max(F.when(side, F.col("y"))).alias("y1"))
    low = lambda c: F.coalesce(F.col(c) - 1, F.lit(0)).cast("int")
    high = lambda c, size: F.coalesce(F.lit(size - 2) - F.col(c), F.lit(0)).cast("int")
    return marks.select("image_id", low("x0").alias("left"), low("y0").alias("top"), high("x1", width).alias("right"), high("y1", height).alias("bottom"))
