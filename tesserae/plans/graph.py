"""Plans from declarative graphs: lists of nodes and connections, as a front end sends them.

Node types: image, ninepatch, filter, affine, composite, matte, distributor, sink; the screen has
the fixed id "renderer". Connections go from a node to a node's port; composite ports are
in1, in2, ... (in1 in front), a matte's are in1 (front), in2 (back) and in3 (mask).
"""

from __future__ import annotations

import json
from collections.abc import Mapping

from pyspark.sql import DataFrame

from tesserae.functions.fixed import Matrix, cut_fixed, single
from tesserae.operators.geometry import ALL_EDGES
from tesserae.plans.nodes import Affine, Blur, Composite, CycleError, Filter, Image, Matte, NinePatch, Node, NoUpstreamError, Plan, Render, Sink

SCREEN = "renderer"
#: Filters that are blurs: axis, radius, passes.
BLURS = {"horizontalBlur": "x", "verticalBlur": "y"}


def matrix_of(spec: Mapping | None) -> Matrix:
    if not spec:
        return Matrix()
    return Matrix(*(single(float(spec.get(k, d))) for k, d in (("a", 1), ("b", 0), ("c", 0), ("d", 1), ("tx", 0), ("ty", 0))))


def _pivot(spec: Mapping) -> tuple[int, int]:
    p = spec.get("pivot") or {"x": spec.get("originX", 0), "y": spec.get("originY", 0)}
    return cut_fixed(float(p.get("x", 0))), cut_fixed(float(p.get("y", 0)))


def _color(spec: Mapping | None) -> tuple[int, int, int, int]:
    return tuple(int((spec or {}).get(c, 0)) for c in "rgba")


def from_dict(nodes: list[Mapping], edges: list[Mapping], images: Mapping[int, tuple], width: int = 0, height: int = 0, pivot: tuple[int, int] | None = (0, 0), tile: tuple[int, int] = (0, 0)) -> Plan:
    """A plan; images by id: pixels, width, height, and for indexed ones their palette.

    A screen without a size has that of the first sink, and a pivot of None is its centre.
    """
    by_id = {n["id"]: n for n in nodes}
    into: dict[tuple[str, str], str] = {}
    out_of: dict[str, list[str]] = {}
    for e in edges:
        into.setdefault((e["toNodeId"], e.get("toPortId", "in")), e["fromNodeId"])  # a port takes one connection
        out_of.setdefault(e["fromNodeId"], []).append(e["toNodeId"])

    def source(target: str, *ports: str) -> str | None:
        return next((into[target, p] for p in ports if (target, p) in into), None)

    def build(node_id: str | None, path: tuple[str, ...]) -> Node | None:
        if node_id is None or node_id not in by_id:
            return None
        if node_id in path:
            raise CycleError(f"node {node_id} is above itself")
        n, path = by_id[node_id], (*path, node_id)
        kind, m = n["type"], matrix_of(n.get("matrix"))
        one = lambda *ports: build(source(node_id, *(ports or ("in", "in1"))), path)
        if kind == "image":
            df, w, h, *palette = images[n["imageId"]]
            key = n.get("colorKey")
            fade = int(n.get("edgeFade", ALL_EDGES))
            return Image(df, w, h, _pivot(n), m, bool(n.get("bilinear")), fade, (_color(key), _color(n.get("colorKeyReplace"))) if key else None, palette[0] if palette else None)
        if kind == "ninepatch":
            df, w, h = images[n["imageId"]][:3]
            return NinePatch(df, w, h, tuple(n["bounds"]), (float(n.get("outputWidth", w)), float(n.get("outputHeight", h))), _pivot(n), m)
        if kind == "affine":
            child = one()
            return child and Affine(child, m)
        if kind == "filter":
            child, name, params = one(), n.get("filterType", ""), tuple(n.get("filterParams", ()))
            if child is None or not n.get("independent", True):
                return child
            if name in BLURS:
                radius, passes = (*map(int, params), 5, 1)[:2] if params else (5, 1)
                return Blur(child, BLURS[name], radius, passes if len(params) > 1 else 1)
            return Filter(child, name, params)
        if kind == "composite":
            layers = [build(source(node_id, f"in{k + 1}"), path) for k in range(max(2, len(n.get("inputs", ()))))]
            layers = tuple(x for x in layers if x is not None)
            return Composite(layers, m) if layers else None
        if kind == "matte":
            return Matte(one("in1"), one("in2"), one("in3"))
        raise ValueError(f"a {kind} node can't feed another")

    def sinks(node_id: str, push: Matrix, path: tuple[str, ...]) -> list[Sink]:
        found = []
        for target in out_of.get(node_id, []):
            if target in path:
                raise CycleError(f"node {target} is below itself")
            n = by_id.get(target)
            if n is None:
                continue
            m = matrix_of(n.get("matrix"))
            if n["type"] == "sink" and n.get("imageId", -1) >= 0:
                p = (int(n.get("pivotX", 0)), int(n.get("pivotY", 0)))
                found.append(Sink(n["imageId"], int(n.get("outputWidth", width)), int(n.get("outputHeight", height)), p, m @ push, n.get("format", "RGBA8_Straight")))
            elif n["type"] in ("affine", "distributor"):
                found += sinks(target, m @ push, (*path, target))
        return found

    child = build(source(SCREEN, "in", "in1"), ())
    if child is None:
        raise NoUpstreamError("nothing feeds the screen")
    found = tuple(sinks(SCREEN, Matrix(), ()))
    if found:
        width, height = width or found[0].width, height or found[0].height
    return Plan(Render(child, width, height, (width // 2, height // 2) if pivot is None else pivot, tile), found)


def to_json(nodes: list[Mapping], edges: list[Mapping]) -> str:
    """The state of a graph, to be kept and read by from_json()."""
    return json.dumps({"nodes": [dict(n) for n in nodes], "connections": [dict(e) for e in edges]}, sort_keys=True)


def from_json(text: str) -> tuple[list[dict], list[dict]]:
    state = json.loads(text)
    return state["nodes"], state["connections"]
