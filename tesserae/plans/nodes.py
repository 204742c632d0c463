"""Immutable plan nodes and their lowering to DataFrames.

Lowering hands two things down: the product of all matrices above a node, and the rectangle that
is asked for. So every source is sampled once, under one matrix (also when a filter or a blur
stands between two transforms: the source is transformed, then blurred along the screen's axes),
and each source reads only what the rectangle needs; a blur asks for as much more as it smears.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tesserae.functions import formats, pixels
from tesserae.functions.fixed import ONE, Matrix
from tesserae.operators import blend, blur, geometry, ninepatch
from tesserae.operators.geometry import Rect

IDENTITY = Matrix()
COLUMNS = ["image_id", "y", "x", "r", "g", "b", "a"]


class PlanError(ValueError):
    """A plan that can't run; status is the code that says why."""

    status = 1


class CycleError(PlanError):
    status = 1


class NoUpstreamError(PlanError):
    status = 2


class NoDownstreamError(PlanError):
    status = 3


class Node:
    """A plan node. Subclasses say what they read (children) and what they give (lower)."""

    @property
    def children(self) -> tuple[Node, ...]:
        return ()

    def lower(self, view: Matrix, rect: Rect | None) -> DataFrame:
        raise NotImplementedError

    def __rshift__(self, wrap):
        """node >> (function from a node to a node)."""
        return wrap(self)


@dataclass(frozen=True, eq=False)
class Image(Node):
    """A source: pixels of images of one size, with a pivot (fixed point) that lands on the world's origin."""

    pixels: DataFrame
    width: int
    height: int
    pivot: tuple[int, int] = (0, 0)
    matrix: Matrix = IDENTITY
    bilinear: bool = False
    fade: int = geometry.ALL_EDGES
    color_key: tuple[tuple[int, int, int, int], tuple[int, int, int, int]] | None = None
    palette: DataFrame | None = None  # pixels then hold an index in idx
    palette_id: int = 0

    def lower(self, view: Matrix, rect: Rect | None) -> DataFrame:
        df = self.pixels if self.palette is None else formats.expand_palette(self.pixels, self.palette, self.palette_id)
        df = df.select(*COLUMNS)
        if self.color_key:
            df = pixels.color_key(df, *self.color_key)
        m = view @ self.matrix
        if self.bilinear:
            return geometry.sample_bilinear(df, m, (self.width, self.height), self.pivot, self.fade, rect)
        return geometry.sample_nearest(df, m, self.pivot, rect)


@dataclass(frozen=True, eq=False)
class NinePatch(Node):
    """A stretched source; bounds are its fixed left, top, right and bottom."""

    pixels: DataFrame
    width: int
    height: int
    bounds: tuple[int, int, int, int]
    output: tuple[float, float]
    pivot: tuple[int, int] = (0, 0)
    matrix: Matrix = IDENTITY

    def lower(self, view: Matrix, rect: Rect | None) -> DataFrame:
        return ninepatch.fill(self.pixels.select(*COLUMNS), (self.width, self.height), self.bounds, self.output, self.pivot, view=view @ self.matrix, rect=rect)


@dataclass(frozen=True, eq=False)
class _One(Node):
    child: Node

    @property
    def children(self):
        return (self.child,)


@dataclass(frozen=True, eq=False)
class Affine(_One):
    """A transform; it holds a matrix only and joins it to those above."""

    matrix: Matrix = IDENTITY

    def lower(self, view, rect):
        return self.child.lower(view @ self.matrix, rect)


@dataclass(frozen=True, eq=False)
class Filter(_One):
    """A filter of single pixels, by name."""

    name: str = ""
    params: tuple[float, ...] = ()

    def lower(self, view, rect):
        margin = pixels.margin_of(self.name, *self.params)
        out = pixels.apply(self.child.lower(view, geometry.grown(rect, margin, margin)), self.name, *self.params)
        return geometry.crop(out, rect) if margin else out


@dataclass(frozen=True, eq=False)
class Blur(_One):
    """A box blur along one axis of the screen."""

    axis: str = "x"
    radius: int = 5
    passes: int = 1

    def lower(self, view, rect):
        reach = self.radius * self.passes
        more = geometry.grown(rect, reach if self.axis == "x" else 0, reach if self.axis == "y" else 0)
        return geometry.crop(blur.box_blur(self.child.lower(view, more), self.axis, self.radius, self.passes), rect)


@dataclass(frozen=True, eq=False)
class Composite(Node):
    """Layers, the first in front."""

    layers: tuple[Node, ...]
    matrix: Matrix = IDENTITY

    @property
    def children(self):
        return self.layers

    def lower(self, view, rect):
        return blend.composite_under(blend.stacked([n.lower(view @ self.matrix, rect) for n in self.layers]))


@dataclass(frozen=True, eq=False)
class Matte(Node):
    """front over back by the mask's alpha; any may be missing."""

    front: Node | None
    back: Node | None
    mask: Node | None

    @property
    def children(self):
        return tuple(n for n in (self.front, self.back, self.mask) if n is not None)

    def lower(self, view, rect):
        front, back, mask = (None if n is None else n.lower(view, rect) for n in (self.front, self.back, self.mask))
        if mask is None:
            return back if back is not None else front.where(F.lit(False))
        return blend.matte(mask.select("image_id", "y", "x", F.col("a").alias("v")), front, back)


@dataclass(frozen=True, eq=False)
class Render(_One):
    """The screen: its size, and the pivot (whole pixels) at which the world's origin lies."""

    width: int = 0
    height: int = 0
    pivot: tuple[int, int] = (0, 0)
    tile: tuple[int, int] = (0, 0)

    @property
    def rect(self) -> Rect:
        px, py = self.pivot
        return -px, -py, self.width - px, self.height - py

    def lower(self, view, rect):
        return self.child.lower(view, self.rect)

    def tile_of(self) -> Column:
        """The number of the tile that a pixel lies in, row by row."""
        x0, y0, _, _ = self.rect
        w, h = self.tile[0] or self.width, self.tile[1] or self.height
        across = -(-self.width // w)
        return (F.floor((F.col("y") - y0) / h) * across + F.floor((F.col("x") - x0) / w)).cast("int")

    def tiles(self) -> list[Rect]:
        """The screen's tiles in world coordinates."""
        x0, y0, x1, y1 = self.rect
        w, h = self.tile[0] or self.width, self.tile[1] or self.height
        return [(x, y, min(x + w, x1), min(y + h, y1)) for y in range(y0, y1, h) for x in range(x0, x1, w)]


@dataclass(frozen=True)
class Sink:
    """A target: size, pivot (whole pixels), a matrix on the way there, and a format."""

    sink_id: int
    width: int
    height: int
    pivot: tuple[int, int] = (0, 0)
    matrix: Matrix = IDENTITY
    fmt: str = "RGBA8_Straight"

    def lower(self, frame: DataFrame, push: Matrix) -> DataFrame:
        m = Matrix.move(*self.pivot) @ self.matrix @ push
        return geometry.sample_nearest(frame, m, rect=(0, 0, self.width, self.height)).select(F.lit(self.sink_id).alias("sink_id"), *COLUMNS)

    def encoded(self, frame: DataFrame, push: Matrix = IDENTITY) -> DataFrame:
        """sink_id, image_id, y, x, code in the sink's format."""
        return formats.encode(self.lower(frame, push), self.fmt).select("sink_id", "image_id", "y", "x", "code")


@dataclass(frozen=True, eq=False)
class Plan:
    """A screen and its sinks. Matrices of distributors on the way are part of push."""

    render: Render | None
    sinks: tuple[Sink, ...] = ()
    push: Matrix = field(default_factory=Matrix)

    def validate(self) -> None:
        if self.render is None or self.render.child is None:
            raise NoUpstreamError("nothing feeds the screen")
        path: list[Node] = []

        def walk(node: Node) -> None:
            if node in path:
                raise CycleError("a node is above itself")
            path.append(node)
            for child in node.children:
                walk(child)
            path.pop()

        walk(self.render)

    def frame(self) -> DataFrame:
        """The screen's pixels in world coordinates."""
        self.validate()
        return self.render.lower(IDENTITY, None).select(*COLUMNS)

    def tiled(self, tile_of: Callable[[Render], Column] | None = None) -> DataFrame:
        """The frame, each image's tile in one partition; tile_of (Render.tile_of unless given) numbers the tiles.

        A tile is a partition of one plan, so there may be any number of them.
        """
        number = (tile_of or Render.tile_of)(self.render)
        return self.frame().repartition("image_id", number)

    def to_df(self) -> DataFrame:
        """What all sinks get."""
        if not self.sinks:
            raise NoDownstreamError("no sink takes the screen")
        frame = self.frame()
        out = None
        for s in self.sinks:
            part = s.lower(frame, self.push)
            out = part if out is None else out.unionByName(part)
        return out


def canvas(width: int, height: int) -> tuple[int, int]:
    """The centre as a fixed-point pivot."""
    return width * ONE // 2, height * ONE // 2
