"""One object over the engine, as a front end uses it: images by id, a graph, its sinks and figures.

Nothing runs until a result is read; results are DataFrames.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserae.functions import formats
from tesserae.operators import bounds, geometry
from tesserae.plans import graph, nodes
from tesserae.sources import images as files

PIXEL = "image_id int, y int, x int, r int, g int, b int, a int"


class Evaluator:
    """Images, a graph and its sinks, over a screen of a size."""

    def __init__(self, spark: SparkSession, width: int, height: int):
        self.spark, self.size, self.origin, self.tile = spark, (width, height), (0, 0), (0, 0)
        self.checkerboard = self.overlay = False
        self.images: dict[int, tuple[DataFrame, int, int]] = {}
        self.formats: dict[int, str] = {}
        self.palettes: dict[int, DataFrame] = {}
        self.nodes: list[dict] = []
        self.edges: list[dict] = []
        self.sinks: dict[str, str] = {}
        self.done: nodes.Plan | None = None

    # the screen

    def set_canvas_size(self, width: int, height: int) -> None:
        self.size = (width, height)

    def set_dst_origin(self, x: float, y: float) -> None:
        self.origin = (int(x), int(y))

    def set_tile_size(self, width: int, height: int) -> None:
        self.tile = (width, height)

    def set_debug_checkerboard(self, on: bool) -> None:
        self.checkerboard = on

    def set_debug_data_range(self, on: bool) -> None:
        self.overlay = on

    # images

    def store_image(self, image_id: int, pixels: DataFrame, width: int, height: int) -> None:
        """Pixels (image_id, y, x and channels, or an index in idx)."""
        self.images[image_id], self.formats[image_id] = (pixels, width, height), "RGBA8_Straight"

    def store_image_with_format(self, image_id: int, pixels: DataFrame, width: int, height: int, fmt: str) -> None:
        """Pixels as they come back from a format."""
        self.images[image_id], self.formats[image_id] = (formats.decode(formats.encode(pixels, fmt), fmt), width, height), fmt

    def store_native_image(self, image_id: int, lines: DataFrame, width: int, height: int, fmt: str) -> None:
        """Lines (image_id, y, data) of a format's bytes; those of an indexed one become indices."""
        self.images[image_id], self.formats[image_id] = (files.from_native(lines, fmt, width), width, height), fmt

    def allocate_image(self, image_id: int, width: int, height: int) -> None:
        self.store_image(image_id, self.spark.createDataFrame([], PIXEL), width, height)

    def set_image_palette(self, image_id: int, palette: DataFrame) -> None:
        self.palettes[image_id] = palette

    def clear_image_palette(self, image_id: int) -> None:
        self.palettes.pop(image_id, None)

    def get_image(self, image_id: int) -> DataFrame:
        """Codes of an image in its own format: its sink's pixels after evaluate_graph(), else what was stored."""
        df = self.get_image_as_rgba8(image_id)
        return formats.encode(df, self.formats.get(image_id, "RGBA8_Straight")).select("image_id", "y", "x", "code")

    def get_image_as_rgba8(self, image_id: int) -> DataFrame:
        sink = next((s for s in (self.done.sinks if self.done else ()) if s.sink_id == image_id), None)
        if sink is not None:
            return self._sink(sink)
        df, palette = self.images[image_id][0], self.palettes.get(image_id)
        if palette is not None:
            df = formats.expand_palette(df, palette)
        elif "idx" in df.columns:
            df = formats.decode(df, self.formats[image_id], "idx")
        return df.select(*nodes.COLUMNS)

    # the graph

    def set_nodes(self, found: list[Mapping]) -> None:
        self.nodes = [dict(n) for n in found]

    def set_connections(self, found: list[Mapping]) -> None:
        self.edges = [dict(e) for e in found]

    def evaluate_graph(self) -> int:
        """Status: 0, or why the graph has no plan."""
        stored = {}
        for k, (df, w, h) in self.images.items():
            palette = self.palettes.get(k)
            stored[k] = (df, w, h, palette) if palette is not None else (self.get_image_as_rgba8(k) if "idx" in df.columns else df, w, h)
        named = [{**n, "format": self.sinks[n["id"]]} if n["id"] in self.sinks else n for n in self.nodes]
        try:
            plan = graph.from_dict(named, self.edges, stored, *self.size, self.origin, self.tile)
            plan.validate()
            if not plan.sinks:
                raise nodes.NoDownstreamError("no sink takes the screen")
        except nodes.PlanError as problem:
            self.done = None
            return problem.status
        self.done = plan
        return 0

    def set_sink_format(self, node_id: str, fmt: str) -> None:
        self.sinks[node_id] = fmt

    def get_sink_preview(self, node_id: str) -> DataFrame:
        """A sink's pixels as they come back from its format."""
        wanted = next(n["imageId"] for n in self.nodes if n["id"] == node_id)
        sink = next(s for s in self.done.sinks if s.sink_id == wanted)
        return formats.decode(sink.encoded(self._frame(), self.done.push), sink.fmt).select(*nodes.COLUMNS)

    def _frame(self) -> DataFrame:
        frame = self.done.frame()
        if self.overlay:
            frame = bounds.range_overlay(frame, bounds.spans(frame), bounds.boxes(frame), bounds.spans(frame))
        return geometry.checkerboard(frame, *(self.tile if all(self.tile) else (8, 8))) if self.checkerboard else frame

    def _sink(self, sink: nodes.Sink) -> DataFrame:
        return sink.lower(self._frame(), self.done.push).select(*nodes.COLUMNS)

    # figures

    def get_perf_metrics(self) -> DataFrame:
        """By sink: pixels of the screen asked for, pixels there, and the efficiency."""
        w, h = self.size
        counts = [self._sink(s).groupBy().agg(F.count("*").alias("used"), F.count_distinct("image_id").alias("n")).withColumn("sink_id", F.lit(s.sink_id)) for s in self.done.sinks]
        out = counts[0]
        for c in counts[1:]:
            out = out.unionByName(c)
        requested = F.col("n") * (w * h)
        return out.select("sink_id", requested.alias("requested"), "used", F.when(requested > 0, F.col("used") / requested).otherwise(F.lit(1.0)).alias("efficiency"))

    def get_format_metrics(self) -> DataFrame:
        """By format and direction, how many images or sinks use it."""
        rows = [(f, "decode") for f in self.formats.values()] + [(s.fmt, "encode") for s in (self.done.sinks if self.done else ())]
        return self.spark.createDataFrame(rows, "fmt string, op string").groupBy("fmt", "op").agg(F.count("*").alias("calls"))

