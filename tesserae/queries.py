"""Registered queries of the raster engine and their SQL oracles.

Each query runs over a whole derived relation; its oracle computes the same in another way
(lookups by joins where the engine pushes pixels forward, nested windows where it sums events).
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserae import api
from tesserae.functions import fixed
from tesserae.functions import formats as fm
from tesserae.functions import pixels as pf
from tesserae.functions.fixed import HALF, ONE, Inverse, Matrix
from tesserae.operators import blend, blur, bounds, geometry, metrics, ninepatch
from tesserae.plans import builder, graph, nodes
from tesserae.sources import fixtures as fx
from tesserae.sources import images
from tesserae.streaming import dirty, run, vertical_blur

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
P = ["image_id", "y", "x", "r", "g", "b", "a"]


def query(oracle: str | None = None, name: str | None = None):
    """Register a query with its oracle."""

    def add(function):
        key = name or function.__name__
        QUERIES[key] = function
        if oracle:
            ORACLES[key] = oracle
        return function

    return add


def ints(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.select(*(F.col(c).cast("int").alias(c) for c in columns))


def _out(select: str, tables: str, *more: str) -> str:
    return f"with {tables}{''.join(', ' + m for m in more)} {select}"


# --- scans, crops, single pixels ---------------------------------------------------------------


@query(_out("select image_id, y - 8 as y, x - 8 as x, r, g, b, a from px where x between 8 and 47 and y between 8 and 39", fx.PX))
def scan_crop(spark, sf_dir):
    return geometry.move(geometry.crop(fx.px(spark, sf_dir), (8, 8, 48, 40)), -8, -8).select(*P)


@query(_out("select image_id, y + 2 as y, x - 3 as x, r, g, b, a from px", fx.PX))
def translate_shift(spark, sf_dir):
    return geometry.sample_nearest(fx.px(spark, sf_dir), Matrix.move(-3.0, 2.0)).select(*P)


@query(_out("select * from px where (x // 8 + y // 8) % 2 = 0", fx.PX))
def checkerboard_skip(spark, sf_dir):
    return geometry.checkerboard(fx.px(spark, sf_dir), 8, 8).select(*P)


@query(_out("select * from px where not (x between 10 and 29 and y between 5 and 24)", fx.PX))
def clear_rect(spark, sf_dir):
    return geometry.clear(fx.px(spark, sf_dir), (10, 5, 30, 25)).select(*P)


def _bright(c: str, add: int) -> str:
    return f"greatest(0, least(255, {c} + {add}))"


@query(_out(f"select image_id, y, x, {', '.join(_bright(c, 51) + ' as ' + c for c in 'rgb')}, a from px", fx.PX))
def brightness(spark, sf_dir):
    return pf.brightness(fx.px(spark, sf_dir), 0.2).select(*P)


@query(_out("select image_id, y, x, ((r + g + b) // 3)::int as r, ((r + g + b) // 3)::int as g, ((r + g + b) // 3)::int as b, a from px", fx.PX))
def grayscale_mean(spark, sf_dir):
    return pf.grayscale(fx.px(spark, sf_dir)).select(*P)


@query(_out("select image_id, y, x, r, g, b, ((a * 153) >> 8)::int as a from px", fx.PX))
def alpha_scale(spark, sf_dir):
    return pf.alpha_scale(fx.px(spark, sf_dir), 0.6).select(*P)


@query(
    _out(
        f"select image_id, y, x, m as r, m as g, m as b, ((a * 128) >> 8)::int as a from (select *, (({' + '.join(_bright(c, -76) for c in 'rgb')}) // 3)::int as m from px)",
        fx.PX,
    )
)
def filter_chain(spark, sf_dir):
    df = fx.px(spark, sf_dir)
    for name, params in (("brightness", (-0.3,)), ("grayscale", ()), ("alpha", (0.5,)), ("no such filter", ())):
        df = pf.apply(df, name, *params)
    return df.select(*P)


@query(
    _out(
        "select image_id, y, x, case when k then 255 else r end as r, case when k then 0 else g end as g, case when k then 255 else b end as b, case when k then 64 else a end as a "
        "from (select *, r = 17 and g = 74 and a = 255 as k from (select image_id, y, x, r, (g // 37 * 37)::int as g, 0 as b, a from px))",
        fx.PX,
    )
)
def color_key(spark, sf_dir):
    df = fx.px(spark, sf_dir).selectExpr("image_id", "y", "x", "r", "cast(g div 37 * 37 as int) g", "0 b", "a")
    return pf.color_key(df, (17, 74, 0, 255), (255, 0, 255, 64)).select(*P)


@query(_out("select image_id, y, x, least(65535, (r * (a + 1) * 39321::bigint) >> 16)::int as r, ((g * (a + 1) * 39321::bigint) >> 16)::int as g, ((b * (a + 1) * 39321::bigint) >> 16)::int as b, ((255 * (a + 1) * 39321::bigint) >> 16)::int as a from px", fx.PX))
def alpha_scale_v1(spark, sf_dir):
    return pf.alpha_scale_premultiplied(fm.premultiplied(fx.px(spark, sf_dir)), 0.6).select(*P)


# --- formats -----------------------------------------------------------------------------------

_ENC565 = "((r // 8) * 2048 + (g // 4) * 32 + b // 8)::int"
_LUMA = "((77 * r + 150 * g + 29 * b + 128) >> 8)::int"


@query(_out(f"select image_id, y, x, {_ENC565} as code from px", fx.PX))
def enc_rgb565(spark, sf_dir):
    return fm.encode(fx.px(spark, sf_dir), "RGB565_BE").select("image_id", "y", "x", "code")


@query(_out("select image_id, y, x, ((c // 2048) * 8 + (c // 2048) // 4)::int as r, (((c // 32) % 64) * 4 + ((c // 32) % 64) // 16)::int as g, ((c % 32) * 8 + (c % 32) // 4)::int as b, 255 as a from e", fx.PX, f"e as (select *, {_ENC565} as c from px)"))
def dec_rgb565(spark, sf_dir):
    return fm.decode(fm.encode(fx.px(spark, sf_dir), "RGB565_LE"), "RGB565_LE").select(*P)


@query(_out("select image_id, y, x, ((c % 256) * 256 + c // 256)::int as code from e", fx.PX, f"e as (select *, {_ENC565} as c from px)"))
def swap565(spark, sf_dir):
    return fm.convert(fm.encode(fx.px(spark, sf_dir), "RGB565_BE"), "RGB565_BE", "RGB565_LE").select("image_id", "y", "x", "code")


_ENC332 = "((r // 32) * 32 + (g // 32) * 4 + b // 64)::int"


@query(_out(f"select image_id, y, x, {_ENC332} as code from px", fx.PX))
def enc_rgb332(spark, sf_dir):
    return fm.encode(fx.px(spark, sf_dir), "RGB332").select("image_id", "y", "x", "code")


@query(_out("select image_id, y, x, (((c // 32) * 73) // 2)::int as r, ((((c // 4) % 8) * 73) // 2)::int as g, ((c % 4) * 85)::int as b, 255 as a from e", fx.PX, f"e as (select *, {_ENC332} as c from px)"))
def dec_rgb332(spark, sf_dir):
    return fm.decode(fm.encode(fx.px(spark, sf_dir), "RGB332"), "RGB332").select(*P)


@query(_out("select image_id, y, x, (b * 65536 + g * 256 + r)::int as code from px", fx.PX))
def bgr_swap(spark, sf_dir):
    return fm.convert(fm.encode(fx.px(spark, sf_dir), "RGB888"), "RGB888", "BGR888").select("image_id", "y", "x", "code")


@query(_out("select image_id, y, x, a as r, a as g, a as b, a from px", fx.PX))
def alpha8_rt(spark, sf_dir):
    return fm.decode(fm.encode(fx.px(spark, sf_dir), "Alpha8"), "Alpha8").select(*P)


@query(_out(f"select image_id, y, x, {_LUMA} as code from px", fx.PX))
def gray8_bt601(spark, sf_dir):
    return fm.encode(fx.px(spark, sf_dir), "Grayscale8").select("image_id", "y", "x", "code")


def _quantised(bits: int) -> None:
    step = 255 // ((1 << bits) - 1)

    @query(_out(f"select image_id, y, x, v as r, v as g, v as b, 255 as a from (select *, (({_LUMA} >> {8 - bits}) * {step})::int as v from px)", fx.PX), name=f"gray{bits}_quant")
    def run(spark, sf_dir):
        return fm.decode(fm.encode(fx.px(spark, sf_dir), f"Grayscale{bits}_MSB"), f"Grayscale{bits}_MSB").select(*P)

    per = 8 // bits

    @query(_out(f"select image_id, y, (x // {per})::int as byte, sum(({_LUMA} >> {8 - bits}) << ((x % {per}) * {bits}))::int as v from px group by 1, 2, 3", fx.PX), name=f"bitpack{bits}_lsb")
    def pack(spark, sf_dir):
        return fm.pack_rows(fm.encode(fx.px(spark, sf_dir), f"Grayscale{bits}_LSB"), f"Grayscale{bits}_LSB")


for _bits in (1, 2, 4):
    _quantised(_bits)


@query(_out(f"select image_id, y, ((x + 3) // 8)::int as byte, sum(({_LUMA} >> 7) << (7 - (x + 3) % 8))::int as v from px group by 1, 2, 3", fx.PX))
def bitpack_rows(spark, sf_dir):
    return fm.pack_rows(fm.encode(fx.px(spark, sf_dir), "Grayscale1_MSB"), "Grayscale1_MSB", offset=3)


@query(
    _out(
        "select distinct p.image_id, p.y, ((p.x // 4) * 4 + k)::int as x, coalesce(q.v, 0)::int as code from px p cross join (select unnest([0, 1, 2, 3]) as k) "
        f"left join (select image_id, y, x, {_LUMA} >> 6 as v from px) q on q.image_id = p.image_id and q.y = p.y and q.x = (p.x // 4) * 4 + k",
        fx.PX,
    )
)
def bitunpack_rows(spark, sf_dir):
    return fm.unpack_rows(fm.pack_rows(fm.encode(fx.px(spark, sf_dir), "Index2_MSB"), "Index2_MSB"), "Index2_MSB")


@query(_out("select i.image_id, i.y, i.x, coalesce(p.r, 0) as r, coalesce(p.g, 0) as g, coalesce(p.b, 0) as b, coalesce(p.a, 0) as a from idx i left join pal p on p.idx = i.idx", fx.IDX, fx.PAL))
def palette_expand(spark, sf_dir):
    return fm.expand_palette(fx.idx(spark, sf_dir), fx.pal(spark, sf_dir)).select(*P)


_FRAMES = "cycled as (select f::int as frame, ((idx + f * 16) % 256)::int as idx, r, g, b, a from pal cross join range(4) t(f))"


@query(_out("select i.image_id, i.y, i.x, coalesce(p.r, 0) as r, coalesce(p.g, 0) as g, coalesce(p.b, 0) as b, coalesce(p.a, 0) as a from idx i left join cycled p on p.frame = i.image_id % 4 and p.idx = i.idx", fx.IDX, fx.PAL, _FRAMES))
def palette_frames(spark, sf_dir):
    """A palette that turns with the frame, under fixed indices."""
    cycled = fx.pal(spark, sf_dir).crossJoin(F.broadcast(spark.range(4))).selectExpr("cast(id as int) frame", "cast((idx + id * 16) % 256 as int) idx", "r", "g", "b", "a")
    return fm.expand_versions(fx.idx(spark, sf_dir).selectExpr("image_id", "y", "x", "image_id % 4 frame", "idx"), cycled).select(*P)


@query(_out("select image_id, y, x, ((v * v + 127) // 255)::int as v from mask", fx.MASK))
def lut_map(spark, sf_dir):
    return fm.map_values(fx.mask(spark, sf_dir), [(v * v + 127) // 255 for v in range(256)])


@query(_out(f"select image_id, y, x, {_ENC565} as code from (select i.image_id, i.y, i.x, coalesce(p.r, 0) as r, coalesce(p.g, 0) as g, coalesce(p.b, 0) as b from idx i left join pal p on p.idx = i.idx)", fx.IDX, fx.PAL))
def palette_to_565(spark, sf_dir):
    return fm.convert(fx.idx(spark, sf_dir).withColumnRenamed("idx", "code"), "Index8", "RGB565_BE", fx.pal(spark, sf_dir)).select("image_id", "y", "x", "code")


@query(_out("select image_id, y, x, r * (a + 1) // (a + 1) as r, g * (a + 1) // (a + 1) as g, b * (a + 1) // (a + 1) as b, a from px", fx.PX))
def premultiplied_rt(spark, sf_dir):
    return ints(fm.straight(fm.premultiplied(fx.px(spark, sf_dir))), P)


# --- layers ------------------------------------------------------------------------------------

_T = "(acc.a * 255 + v.a * (255 - acc.a))"
_W = f"((acc.a * 65280 + ({_T} >> 1)) // {_T})"
_MIX = ", ".join(f"'{c}': ((acc.{c} * {_W} + v.{c} * (256 - {_W})) >> 8)::int" for c in "rgb")
_FOLD = f"""list_reduce(list_prepend({{'z': -1, 'r': 0, 'g': 0, 'b': 0, 'a': 0}}, list_sort(list({{'z': z, 'r': r, 'g': g, 'b': b, 'a': a}}))),
  lambda acc, v: case when v.a = 0 or acc.a = 255 then acc when acc.a = 0 then v else {{'z': v.z, {_MIX}, 'a': (({_T} + 127) // 255)::int}} end)"""
_COMPOSITE = f"select image_id, y, x, p.r as r, p.g as g, p.b as b, p.a as a from (select image_id, y, x, {_FOLD} as p from layers group by 1, 2, 3) where p.a > 0"


@query(_out(_COMPOSITE, fx.LAYERS))
def composite_under(spark, sf_dir):
    return blend.composite_under(fx.layers(spark, sf_dir))


@query(_out(_COMPOSITE, fx.LAYERS))
def composite_opaque_cut(spark, sf_dir):
    return blend.composite_under(fx.layers(spark, sf_dir), cut=True)


@query(_out("select image_id, y, x, z, r, g, b, a from (select *, min(case when a = 255 then z end) over (partition by image_id, y, x) as front from layers) where front is null or z <= front", fx.LAYERS))
def opaque_cut(spark, sf_dir):
    return blend.opaque_cut(fx.layers(spark, sf_dir)).select("image_id", "y", "x", "z", *"rgba")


_OVER = ", ".join(f"'{c}': (v.{c} + ((acc.{c}::bigint * (65535 - v.a)) >> 16))::int" for c in "rgba")


@query(
    _out(
        f"""select image_id, y, x, p.r as r, p.g as g, p.b as b, p.a as a from (select image_id, y, x,
  list_reduce(list_prepend({{'z': -1, 'r': 0, 'g': 0, 'b': 0, 'a': 0}}, list_sort(list({{'z': z, 'r': r * (a + 1), 'g': g * (a + 1), 'b': b * (a + 1), 'a': 255 * (a + 1)}}))),
  lambda acc, v: case when v.a <= 255 then acc when v.a >= 65280 or acc.a = 0 then v else {{'z': v.z, {_OVER}}} end) as p from layers group by 1, 2, 3)""",
        fx.LAYERS,
    )
)
def composite_v1_over(spark, sf_dir):
    return blend.composite_over(fm.premultiplied(fx.layers(spark, sf_dir)))


@query(_out("select image_id, y, x, p.r as r, p.g as g, p.b as b, p.a as a from (select image_id, y, x, max(struct_pack(z := z, r := r, g := g, b := b, a := a)) as p from layers group by 1, 2, 3)", fx.LAYERS))
def overwrite_placement(spark, sf_dir):
    return blend.overwrite(fx.layers(spark, sf_dir).withColumn("rank", F.struct("z", *"rgba"))).select(*P)


def _front(spark, sf_dir):
    """The front-most layer of each cell, where a front-most layer is one of the first three."""
    df = fx.layers(spark, sf_dir).where("z < 3")
    return blend.overwrite(df.withColumn("rank", F.struct(-F.col("z"), *"rgba")))


_FRONT = "front as (select image_id, y, x, p.r as r, p.g as g, p.b as b, p.a as a from (select image_id, y, x, max(struct_pack(z := -z, r := r, g := g, b := b, a := a)) as p from layers where z < 3 group by 1, 2, 3))"


def _matte(mask: bool, front: bool, back: bool) -> str:
    """The documented formula over outer joins; a missing input has no rows."""
    m = "coalesce(m.v, 0)" if mask else "0"
    full = f"({m} + ({m} >> 7))"
    fg = lambda c: f"coalesce(f.{c}, 0)" if front else "0"
    bg = lambda c: f"coalesce(k.{c}, 0)" if back else "0"
    cols = ", ".join(f"(({bg(c)} * (256 - {full}) + {fg(c)} * {full}) >> 8)::int as {c}" for c in "rgba")
    cells = "select image_id, y, x from px union select image_id, y, x from front union select image_id, y, x from mask"
    joins = " ".join(f"left join {t} {n} on {n}.image_id = c.image_id and {n}.y = c.y and {n}.x = c.x" for t, n in (("mask", "m"), ("front", "f"), ("px", "k")))
    return _out(f"select * from (select c.image_id, c.y, c.x, {cols} from ({cells}) c {joins}) where a > 0", fx.PX, fx.MASK, fx.LAYERS, _FRONT)


@query(_matte(True, True, True))
def matte_blend(spark, sf_dir):
    return blend.matte(fx.mask(spark, sf_dir), _front(spark, sf_dir), fx.px(spark, sf_dir))


@query(_matte(False, True, True))
def matte_no_mask(spark, sf_dir):
    return blend.matte(None, _front(spark, sf_dir), fx.px(spark, sf_dir))


@query(_matte(True, True, False))
def matte_no_bg(spark, sf_dir):
    return blend.matte(fx.mask(spark, sf_dir), _front(spark, sf_dir), None)


@query(_matte(True, False, True))
def matte_no_fg(spark, sf_dir):
    return blend.matte(fx.mask(spark, sf_dir), None, fx.px(spark, sf_dir))


# --- affine ------------------------------------------------------------------------------------


def _grid(table: str, box: geometry.Rect) -> str:
    x0, y0, x1, y1 = box
    return f"(select image_id, gy::int as y, gx::int as x from (select distinct image_id from {table}) cross join range({y0}, {y1}) ys(gy) cross join range({x0}, {x1}) xs(gx))"


def _position(inv: Inverse, pivot=(0, 0)) -> tuple[str, str]:
    bx, by = inv.base(*pivot)
    return f"(g.x * {inv.a}::bigint + g.y * {inv.b}::bigint + {bx})", f"(g.x * {inv.c}::bigint + g.y * {inv.d}::bigint + {by})"


def _nearest(m: Matrix, pivot=(0, 0), table: str = "px", cols: str = "r, g, b, a", rect: geometry.Rect | None = None) -> str:
    left, top, right, bottom = geometry.bounds_of(m, (64, 64), pivot)
    sx, sy = _position(m.inverse(), pivot)
    picked = ", ".join(f"p.{c.strip()}" for c in cols.split(","))
    return f"select g.image_id, g.y, g.x, {picked} from {_grid(table, rect or (left - 2, top - 2, right + 2, bottom + 2))} g join {table} p on p.image_id = g.image_id and p.x = {sx} >> 16 and p.y = {sy} >> 16"


SCALE2, ROT45, ROT90 = Matrix.scale(2.0, 1.5), Matrix.turn(math.pi / 4), Matrix.turn(math.pi / 2)
CENTER = (32 * ONE, 32 * ONE)
CHAIN = Matrix.move(10.5, -3.25) @ Matrix.turn(0.3, 1.25, 0.75) @ Matrix.move(4.0, 7.0)


@query(_out(_nearest(SCALE2), fx.PX))
def affine_scale2(spark, sf_dir):
    return geometry.sample_nearest(fx.px(spark, sf_dir), SCALE2).select(*P)


@query(_out(_nearest(ROT45, CENTER), fx.PX))
def affine_rot45(spark, sf_dir):
    return geometry.sample_nearest(fx.px(spark, sf_dir), ROT45, CENTER).select(*P)


@query(_out(_nearest(ROT90, CENTER), fx.PX))
def affine_rot90(spark, sf_dir):
    return geometry.sample_nearest(fx.px(spark, sf_dir), ROT90, CENTER).select(*P)


@query(_out(_nearest(ROT45, CENTER, rect=(-10, -10, 20, 5)), fx.PX))
def affine_pruned(spark, sf_dir):
    return geometry.sample_nearest(fx.px(spark, sf_dir), ROT45, CENTER, rect=(-10, -10, 20, 5)).select(*P)


def _bounds_sql(m: Matrix, pivot=(0, 0)) -> str:
    return _out(f"select image_id, min(x) as x0, min(y) as y0, max(x) + 1 as x1, max(y) + 1 as y1 from ({_nearest(m, pivot)}) group by 1", fx.PX)


@query(_bounds_sql(CHAIN, CENTER))
def affine_bounds(spark, sf_dir):
    return ints(bounds.boxes(geometry.sample_nearest(fx.px(spark, sf_dir), CHAIN, CENTER)), ["image_id", "x0", "y0", "x1", "y1"])


def _bilinear(m: Matrix, fade: int, pivot=(0, 0), plane: bool = False) -> str:
    """Four lookups with clamped coordinates."""
    left, top, right, bottom = geometry.bounds_of(m, (64, 64), pivot)
    px, py = _position(m.inverse(), pivot)
    low_x, high_x = -HALF if fade & geometry.LEFT else 0, 64 * ONE + (HALF if fade & geometry.RIGHT else 0)
    low_y, high_y = -HALF if fade & geometry.TOP else 0, 64 * ONE + (HALF if fade & geometry.BOTTOM else 0)
    cells = f"select g.*, (({px} - {HALF}) >> 16)::int as sx, (({py} - {HALF}) >> 16)::int as sy, ((({px} - {HALF}) >> 8) & 255)::int as fx, ((({py} - {HALF}) >> 8) & 255)::int as fy from {_grid('gray64' if plane else 'px', (left - 3, top - 3, right + 3, bottom + 3))} g where {px} >= {low_x} and {px} < {high_x} and {py} >= {low_y} and {py} < {high_y}"
    gone = {"0x": f"(sx < 0 and {bool(fade & geometry.LEFT)})", "1x": f"(sx >= 63 and {bool(fade & geometry.RIGHT)})", "0y": f"(sy < 0 and {bool(fade & geometry.TOP)})", "1y": f"(sy >= 63 and {bool(fade & geometry.BOTTOM)})"}
    corners = [(i, j) for i in (0, 1) for j in (0, 1)]
    table = "gray64" if plane else "px"
    joins = " ".join(f"left join {table} p{i}{j} on p{i}{j}.image_id = c.image_id and p{i}{j}.x = greatest(0, least(63, c.sx + {i})) and p{i}{j}.y = greatest(0, least(63, c.sy + {j}))" for i, j in corners)
    live = {(i, j): f"case when {gone[f'{i}x']} or {gone[f'{j}y']} then 0 else 1 end" for i, j in corners}
    if plane:
        w = {(0, 0): "(256 - fx) * (256 - fy)", (1, 0): "fx * (256 - fy)", (0, 1): "(256 - fx) * fy", (1, 1): "fx * fy"}
        value = " + ".join(f"{w[k]} * coalesce(p{k[0]}{k[1]}.v, 0) * ({live[k]})" for k in corners)
        seen = " or ".join(f"p{i}{j}.v is not null" for i, j in corners)
        return _out(f"select c.image_id, c.y, c.x, (({value}) >> 16)::int as v from ({cells}) c {joins} where {seen}", fx.GRAY64)
    w = {(1, 1): "((fx * fy) >> 8)", (1, 0): "((fx * (256 - fy)) >> 8)", (0, 1): "(((256 - fx) * fy) >> 8)"}
    w[0, 0] = f"(256 - {w[1, 1]} - {w[1, 0]} - {w[0, 1]})"
    value = lambda c: " + ".join(f"{w[k]} * coalesce(p{k[0]}{k[1]}.{c}, 0)" + (f" * ({live[k]})" if c == "a" else "") for k in corners)
    cols = ", ".join(f"(({value(c)}) >> 8)::int as {c}" for c in "rgba")
    normal = "select image_id, y, x, r, g, b, a from"
    return _out(f"{normal} (select c.image_id, c.y, c.x, {cols} from ({cells}) c {joins}) where a > 0", fx.PX)


HALF_STEP = Matrix(1.0, 0.0, 0.0, 1.0, 0.5, 0.25)
SKEW = Matrix(1.75, 0.25, -0.5, 1.25, 3.0, 2.0)


@query(_bilinear(HALF_STEP, geometry.ALL_EDGES))
def bilinear_half(spark, sf_dir):
    return geometry.sample_bilinear(fx.px(spark, sf_dir), HALF_STEP, (64, 64)).where("a > 0").select(*P)


@query(_bilinear(SKEW, geometry.LEFT | geometry.BOTTOM, CENTER))
def bilinear_edge_fade(spark, sf_dir):
    return geometry.sample_bilinear(fx.px(spark, sf_dir), SKEW, (64, 64), CENTER, geometry.LEFT | geometry.BOTTOM).where("a > 0").select(*P)


@query(_bilinear(SKEW, 0, plane=True))
def bilinear_1ch(spark, sf_dir):
    return geometry.sample_bilinear_plane(fx.gray64(spark, sf_dir), SKEW, (64, 64), fade=0)


EACH = [Matrix.turn(0.3, 1.25, 0.75), Matrix(1.5, 0.25, 0.0, 1.25, 3.7, -2.3)]


def _rounded(m: Matrix, pivot, table: str) -> str:
    left, top, right, bottom = geometry.bounds_of(m, (64, 64), pivot)
    inv = m.inverse(True)
    sx, sy = _position(inv, pivot)
    return f"select g.image_id, g.y, g.x, p.r, p.g, p.b, p.a from {_grid('px', (left - 120, top - 120, right + 120, bottom + 120))} g join {table} p on p.image_id = g.image_id and p.x = {sx} >> 16 and p.y = {sy} >> 16"


@query(_out(_rounded(EACH[1], (0, 0), "one"), fx.PX, f"one as ({_rounded(EACH[0], CENTER, 'px')})"))
def affine_v1(spark, sf_dir):
    """First generation: sampled at each of two matrices."""
    return geometry.sample_each(fx.px(spark, sf_dir), EACH, CENTER).select(*P)


@query(_out(f"select y, min(x) as x0, max(x) + 1 as x1 from ({_nearest(CHAIN, CENTER, 'full_image')}) group by 1", "full_image as (select 0 as image_id, (i // 64)::int as y, (i % 64)::int as x, 0 as r, 0 as g, 0 as b, 255 as a from range(4096) t(i))"))
def affine_row_spans(spark, sf_dir):
    lines = spark.range(-200, 200).selectExpr("cast(id as int) y")
    return geometry.row_spans(lines, CHAIN, (64, 64), CENTER).select("y", "x0", "x1")


# --- blurs -------------------------------------------------------------------------------------


def _blur_sql(source: str, axis: str, radius: int, passes: int) -> str:
    """Grown cells, then sums over a range window, once a pass."""
    line = "y" if axis == "x" else "x"
    for _ in range(passes):
        cells = f"(select image_id, {line}, {axis} + d as {axis}, 0 as r, 0 as g, 0 as b, 0 as a from {source} cross join range(-{radius}, {radius + 1}) ds(d))"
        dense = f"(select image_id, {line}, {axis}, max(r) as r, max(g) as g, max(b) as b, max(a) as a from (select image_id, {line}, {axis}, r, g, b, a from {source} union all select * from {cells}) group by 1, 2, 3)"
        w = f"over (partition by image_id, {line} order by {axis} range between {radius} preceding and {radius} following)"
        sums = f"(select image_id, {line}, {axis}, sum(r * a) {w} as r, sum(g * a) {w} as g, sum(b * a) {w} as b, sum(a) {w} as a from {dense})"
        source = f"(select image_id, {line}, {axis}::int as {axis}, (r // a)::int as r, (g // a)::int as g, (b // a)::int as b, (a // {2 * radius + 1})::int as a from {sums} where a >= {2 * radius + 1})"
    return source


_SEEN = "(select * from px where a > 0)"


@query(_out(f"select * from {_blur_sql(_SEEN, 'x', 3, 1)}", fx.PX))
def hblur_p1(spark, sf_dir):
    return blur.box_blur(fx.px(spark, sf_dir), "x", 3).select(*P)


@query(_out(f"select * from {_blur_sql(_SEEN, 'x', 2, 3)}", fx.PX))
def hblur_p3(spark, sf_dir):
    return blur.box_blur(fx.px(spark, sf_dir), "x", 2, 3).select(*P)


@query(_out(f"select * from {_blur_sql(_SEEN, 'y', 3, 1)}", fx.PX))
def vblur_p1(spark, sf_dir):
    return blur.box_blur(fx.px(spark, sf_dir), "y", 3).select(*P)


@query(_out(f"select * from {_blur_sql(_blur_sql(_SEEN, 'x', 2, 1), 'y', 2, 1)}", fx.PX))
def blur2d(spark, sf_dir):
    return blur.blur_2d(fx.px(spark, sf_dir), 2).select(*P)


def _mean_sql(source: str, axis: str, line: str, radius: int) -> str:
    w = f"over (partition by image_id, {line} order by {axis} range between {radius} preceding and {radius} following)"
    return f"(select image_id, y, x, {', '.join(f'(sum({c}) {w} // count(*) {w})::int as {c}' for c in 'rgba')} from {source})"


@query(_out(f"select * from {_mean_sql(_mean_sql('px', 'x', 'y', 2), 'y', 'x', 2)}", fx.PX))
def boxblur_v1(spark, sf_dir):
    return blur.mean_blur(fx.px(spark, sf_dir), 2).select(*P)


# --- nine-patches ------------------------------------------------------------------------------


def _patch_sql(output, size=(64, 64), fixed=(12, 10, 9, 14)) -> str:
    parts = []
    for rank, (x0, y0, x1, y1), m in ninepatch.patches(*size, *fixed, *output):
        inv = m.inverse()
        if inv is None:
            continue
        sx, sy = _position(inv)
        grid = _grid("px", (-3, -3, int(output[0]) + 4, int(output[1]) + 4))
        parts.append(
            f"select g.image_id, g.y, g.x, p.r, p.g, p.b, p.a, {rank} as rank from {grid} g join px p on p.image_id = g.image_id and p.x - {x0} = {sx} >> 16 and p.y - {y0} = {sy} >> 16 "
            f"where p.x >= {x0} and p.x < {x1} and p.y >= {y0} and p.y < {y1}"
        )
    return _out("select image_id, y, x, p.r as r, p.g as g, p.b as b, p.a as a from (select image_id, y, x, arg_max(struct_pack(r := r, g := g, b := b, a := a), rank) as p from parts group by 1, 2, 3)", fx.PX, f"parts as ({' union all '.join(parts)})")


@query(_patch_sql((150.0, 97.5)))
def ninepatch_fill(spark, sf_dir):
    return ninepatch.fill(fx.px(spark, sf_dir), (64, 64), (12, 10, 9, 14), (150.0, 97.5)).select(*P)


@query(_patch_sql((15.0, 18.0)))
def ninepatch_shrink(spark, sf_dir):
    return ninepatch.fill(fx.px(spark, sf_dir), (64, 64), (12, 10, 9, 14), (15.0, 18.0)).select(*P)


_BORDER = "bordered as (select image_id, y, x, case when (y = 0 and x % 5 = image_id % 5 and x > 9) or (x = 0 and y between 20 and 40 + image_id % 7) then 0 else r + 1 end as r, case when y = 0 or x = 0 then 0 else g end as g, case when y = 0 or x = 0 then 0 else b end as b, 255 as a from px)"


@query(
    _out(
        "select image_id, coalesce(min(x) filter (t) - 1, 0)::int as \"left\", coalesce(min(y) filter (s) - 1, 0)::int as top, coalesce(62 - max(x) filter (t), 0)::int as \"right\", coalesce(62 - max(y) filter (s), 0)::int as bottom "
        "from (select *, r = 0 and g = 0 and b = 0 and a > 0 and y = 0 and x between 1 and 62 as t, r = 0 and g = 0 and b = 0 and a > 0 and x = 0 and y between 1 and 62 as s from bordered) group by 1",
        fx.PX,
        _BORDER,
    )
)
def ninepatch_meta(spark, sf_dir):
    df = fx.px(spark, sf_dir).selectExpr(
        "image_id", "y", "x",
        "case when (y = 0 and x % 5 = image_id % 5 and x > 9) or (x = 0 and y between 20 and 40 + image_id % 7) then 0 else r + 1 end r",
        "case when y = 0 or x = 0 then 0 else g end g", "case when y = 0 or x = 0 then 0 else b end b", "255 a",
    )
    return ninepatch.stretch_spans(df, 64, 64)


# --- bounds ------------------------------------------------------------------------------------


@query(_out("select image_id, min(x) as x0, min(y) as y0, max(x) + 1 as x1, max(y) + 1 as y1 from (select image_id, x + 3 as x, y - 5 as y from px union all select image_id, x, y from layers) group by 1", fx.PX, fx.LAYERS))
def aabb_union(spark, sf_dir):
    both = geometry.move(fx.px(spark, sf_dir), 3, -5).select("image_id", "y", "x").unionByName(fx.layers(spark, sf_dir).select("image_id", "y", "x"))
    return ints(bounds.boxes(both), ["image_id", "x0", "y0", "x1", "y1"])


@query(_out("select image_id, y, min(x) as x0, max(x) + 1 as x1 from layers where a = 255 group by 1, 2", fx.LAYERS))
def scanline_ranges(spark, sf_dir):
    return ints(bounds.spans(fx.layers(spark, sf_dir).where("a = 255")), ["image_id", "y", "x0", "x1"])


@query(_out("select image_id, y, min(x) as x0, max(x) + 1 as x1 from (select image_id, y, x, case when v < 200 then 0 else v end as v from mask) where v <> 0 group by 1, 2", fx.MASK))
def mask_trim(spark, sf_dir):
    return ints(bounds.mask_spans(fx.mask(spark, sf_dir).withColumn("v", F.when(F.col("v") < 200, 0).otherwise(F.col("v")))), ["image_id", "y", "x0", "x1"])


_SPANS = {
    "m": "select image_id, y, min(x) as x0, max(x) + 1 as x1 from mask where v >= 230 group by 1, 2",
    "f": "select image_id, y, min(x) as x0, max(x) + 1 as x1 from layers where z = 0 group by 1, 2",
    "k": "select image_id, y, min(x) as x0, max(x) + 1 as x1 from px where a = 255 and r > 200 group by 1, 2",
}


@query(
    _out(
        "select image_id, y, min(x0)::int as x0, max(x1)::int as x1 from (select * from k union all select m.image_id, m.y, greatest(m.x0, f.x0), least(m.x1, f.x1) from m join f using (image_id, y) where greatest(m.x0, f.x0) < least(m.x1, f.x1)) group by 1, 2",
        fx.PX, fx.MASK, fx.LAYERS, *(f"{n} as ({s})" for n, s in _SPANS.items()),
    )
)
def matte_ranges(spark, sf_dir):
    back = bounds.spans(fx.px(spark, sf_dir).where("a = 255 and r > 200"))
    front = bounds.spans(fx.layers(spark, sf_dir).where("z = 0"))
    return ints(bounds.matte_spans(back, bounds.spans(fx.mask(spark, sf_dir).where("v >= 230")), front), ["image_id", "y", "x0", "x1"])


@query(_out("select tx::int as tile_x, ty::int as tile_y, rect_id from rects join range(0, 5) xs(tx) on x0 < (tx + 1) * 12 and x0 + w > tx * 12 join range(0, 4) ys(ty) on y0 < (ty + 1) * 12 and y0 + h > ty * 12", fx.RECTS))
def tile_overlap(spark, sf_dir):
    return bounds.tile_overlaps(fx.rects(spark, sf_dir), 12, 5, 4)


@query(_out("select coalesce(p.y, n.y) as y, coalesce(p.image_id, n.image_id) as image_id, least(p.x0, n.x0)::int as x0, greatest(p.x1, n.x1)::int as x1 from p full join n on p.image_id = n.image_id and p.y = n.y", fx.LAYERS, "p as (select image_id, y, min(x) as x0, max(x) + 1 as x1 from layers where z = 5 group by 1, 2)", "n as (select image_id, y, min(x) as x0, max(x) + 1 as x1 from layers where z = 6 group by 1, 2)"))
def dirty_spans(spark, sf_dir):
    df = fx.layers(spark, sf_dir)
    both = bounds.dirty_spans(bounds.spans(df.where("z = 5")), bounds.spans(df.where("z = 6")), ["image_id", "y"])
    return ints(both, ["y", "image_id", "x0", "x1"])


@query(
    _out(
        "select p.image_id, p.y, p.x, case when not inside then 255 when not within then 0 else r end as r, case when not inside then 0 when not within then 100 else g end as g, case when inside and within then b else 255 end as b, case when inside and within then a else 255 end as a "
        "from (select px.*, coalesce(px.x >= o.x0 and px.x < o.x1 and px.y >= o.y0 and px.y < o.y1, false) as inside, coalesce(px.x >= s.x0 and px.x < s.x1, false) as within from px left join o using (image_id) left join s on s.image_id = px.image_id and s.y = px.y) p",
        fx.PX, "o as (select image_id, min(x) as x0, min(y) as y0, max(x) + 1 as x1, max(y) + 1 as y1 from px where b > 250 group by 1)", "s as (select image_id, y, min(x) as x0, max(x) + 1 as x1 from px where b > 250 group by 1, 2)",
    )
)
def range_overlay(spark, sf_dir):
    df = fx.px(spark, sf_dir)
    part = df.where("b > 250")
    return bounds.range_overlay(df, bounds.spans(part), bounds.boxes(part)).select(*P)


# --- metrics -----------------------------------------------------------------------------------

_LOG = """log as (select l_linenumber as node, l_returnflag as fmt, l_linestatus as op, (l_orderkey % 97)::bigint as ms, (l_quantity * 4)::bigint as requested, l_quantity::bigint as used,
  floor(l_extendedprice)::bigint as bytes, (l_orderkey * 10 + l_linenumber)::bigint as label from lineitem)"""


def _log(spark, sf_dir):
    return fx.table(spark, sf_dir, "lineitem").selectExpr(
        "l_linenumber node", "l_returnflag fmt", "l_linestatus op", "l_orderkey % 97 ms", "cast(l_quantity * 4 as bigint) requested", "cast(l_quantity as bigint) used",
        "cast(floor(l_extendedprice) as bigint) bytes", "l_orderkey * 10 + l_linenumber label",
    )


@query(_out("select node, count(*) as calls, sum(ms)::bigint as time_sum, sum(requested)::bigint as requested, sum(used)::bigint as used, (max((bytes, label)))[1] as largest, (max((bytes, label)))[2] as largest_label, floor(sum(used) / sum(requested) * 1000)::int as efficiency_pm from log group by 1", _LOG))
def node_metrics(spark, sf_dir):
    out = metrics.node_metrics(_log(spark, sf_dir), "node", "ms", "requested", "used", "bytes", "label")
    return out.withColumn("efficiency_pm", F.floor(F.col("efficiency") * 1000).cast("int")).drop("efficiency", "waste")


@query(_out("select fmt, op, count(*) as calls, sum(requested)::bigint as pixels, grouping(fmt, op)::int as level from log group by cube (fmt, op)", _LOG))
def format_metrics_cube(spark, sf_dir):
    return metrics.format_cube(_log(spark, sf_dir), "fmt", "op", "requested")


@query(_out("select (a // 32)::int as bucket, count(*) as n from layers group by 1", fx.LAYERS))
def alpha_histogram(spark, sf_dir):
    return metrics.alpha_histogram(fx.layers(spark, sf_dir))


@query("select user_id, max(now)::bigint as peak, sum(d)::bigint as final from (select user_id, d, sum(d) over (partition by user_id order by event_id rows unbounded preceding) as now from (select user_id, event_id, case when event_id % 3 = 0 then -1 else 1 end * floor(value)::bigint as d from events)) group by 1")
def running_peak(spark, sf_dir):
    log = fx.table(spark, sf_dir, "events").selectExpr("user_id", "event_id", "case when event_id % 3 = 0 then -1 else 1 end * cast(floor(value) as bigint) d")
    return metrics.running_peak(log, "user_id", ["event_id"], "d")


# --- plans: transforms gathered at the sources, sinks, graphs ------------------------------------

INNER, OUTER = Matrix.move(4.0, 7.0) @ Matrix.turn(0.2), Matrix.scale(1.5, 0.8)


def _source(spark, sf_dir, matrix: Matrix = Matrix()) -> nodes.Image:
    return nodes.Image(fx.px(spark, sf_dir), 64, 64, CENTER, matrix)


@query(_out(f"select image_id, y, x, r, g, b, a from {_blur_sql(f'(select * from ({_nearest(OUTER @ INNER, CENTER)}) where a > 0)', 'x', 2, 1)} where x between -60 and 59 and y between -40 and 39", fx.PX))
def affine_chain(spark, sf_dir):
    """A blur between two transforms: the source is transformed by both, then blurred along the screen."""
    inside = nodes.Affine(nodes.Blur(nodes.Affine(_source(spark, sf_dir), INNER), "x", 2), OUTER)
    return nodes.Plan(nodes.Render(inside, 120, 80, (60, 40))).frame()


@query(_out(f"select image_id, y, x, r, g, b, a from {_blur_sql(f'(select * from ({_nearest(OUTER @ INNER, CENTER)}) where a > 0)', 'x', 2, 1)} where x between -60 and 59 and y between -40 and 39", fx.PX))
def affine_chain_tiled(spark, sf_dir):
    inside = nodes.Affine(nodes.Blur(nodes.Affine(_source(spark, sf_dir), INNER), "x", 2), OUTER)
    return nodes.Plan(nodes.Render(inside, 120, 80, (60, 40), (60, 50))).tiled()


SPIN = Matrix.turn(0.5, 0.75, 0.75)


@query(
    _out(
        f"select 1 as sink_id, image_id, (y + 20)::int as y, (x + 24)::int as x, r, g, b, a from screen where y between -20 and 19 and x between -24 and 23 "
        f"union all select 2, image_id, y, x, r, g, b, a from ({_nearest(Matrix.move(30.0, 30.0) @ SPIN, (0, 0), 'screen', rect=(0, 0, 60, 60))})",
        fx.PX, f"screen as (select * from ({_nearest(Matrix(), CENTER)}) where x between -32 and 31 and y between -32 and 31)",
    )
)
def distribute_sinks(spark, sf_dir):
    sinks = (nodes.Sink(1, 48, 40, (24, 20)), nodes.Sink(2, 60, 60, (30, 30), SPIN))
    return ints(nodes.Plan(nodes.Render(_source(spark, sf_dir), 64, 64, (32, 32)), sinks).to_df(), ["sink_id", *P])


@query(
    _out(
        f"select 7 as sink_id, image_id, y, x, {_ENC565} as code from ({_nearest(Matrix.move(30.0, 30.0) @ SPIN, (0, 0), 'screen', rect=(0, 0, 60, 60))})",
        fx.PX, f"screen as (select * from ({_nearest(Matrix(), CENTER)}) where x between -32 and 31 and y between -32 and 31)",
    )
)
def sink_affine(spark, sf_dir):
    frame = nodes.Plan(nodes.Render(_source(spark, sf_dir), 64, 64, (32, 32))).frame()
    return ints(nodes.Sink(7, 60, 60, (30, 30), SPIN, "RGB565_BE").encoded(frame), ["sink_id", "image_id", "y", "x", "code"])


GRAPH_NODES = [
    {"id": "a", "type": "image", "imageId": 1, "pivot": {"x": 32, "y": 32}},
    {"id": "turn", "type": "affine", "matrix": {"a": 0.5, "d": 0.5, "tx": 6, "ty": -2}},
    {"id": "dark", "type": "filter", "filterType": "brightness", "filterParams": [-0.2], "independent": True},
    {"id": "b", "type": "image", "imageId": 2, "pivot": {"x": 32, "y": 32}},
    {"id": "both", "type": "composite", "inputs": [{"id": "in1"}, {"id": "in2"}]},
    {"id": "out", "type": "sink", "imageId": 9, "outputWidth": 64, "outputHeight": 64, "pivotX": 32, "pivotY": 32},
]
GRAPH_EDGES = [
    {"fromNodeId": "a", "toNodeId": "dark", "toPortId": "in"},
    {"fromNodeId": "dark", "toNodeId": "turn", "toPortId": "in"},
    {"fromNodeId": "turn", "toNodeId": "both", "toPortId": "in1"},
    {"fromNodeId": "b", "toNodeId": "both", "toPortId": "in2"},
    {"fromNodeId": "both", "toNodeId": "renderer", "toPortId": "in"},
    {"fromNodeId": "renderer", "toNodeId": "out", "toPortId": "in"},
]
_SMALL = Matrix(0.5, 0.0, 0.0, 0.5, 6.0, -2.0)


@query(
    _out(
        f"select 9 as sink_id, image_id, (y + 32)::int as y, (x + 32)::int as x, p.r as r, p.g as g, p.b as b, p.a as a from (select image_id, y, x, {_FOLD} as p from layers group by 1, 2, 3) where p.a > 0",
        fx.PX,
        f"layers as (select image_id, y, x, 0 as z, {', '.join(_bright(c, -51) + ' as ' + c for c in 'rgb')}, a from ({_nearest(_SMALL, CENTER)}) where x between -32 and 31 and y between -32 and 31 "
        f"union all select image_id, y, x, 1, g, r, b, 200 from ({_nearest(Matrix(), CENTER)}) where x between -32 and 31 and y between -32 and 31)",
    )
)
def graph_from_dict(spark, sf_dir):
    px = fx.px(spark, sf_dir)
    other = px.selectExpr("image_id", "y", "x", "g r", "r g", "b", "200 a")
    plan = graph.from_dict(GRAPH_NODES, GRAPH_EDGES, {1: (px, 64, 64), 2: (other, 64, 64)}, 64, 64, (32, 32))
    return ints(plan.to_df(), ["sink_id", *P])


@query(
    _out(
        "select image_id, y, x, r, g, b, a from cells",
        "cells as (select 5 as image_id, (i // 48)::int as y, (i % 48)::int as x, case when ((i % 48) // 6 + (i // 48) // 6) % 2 = 0 then 255 else 0 end as r, case when ((i % 48) // 6 + (i // 48) // 6) % 2 = 0 then 255 else 0 end as g, case when ((i % 48) // 6 + (i // 48) // 6) % 2 = 0 then 255 else 0 end as b, 255 as a from range(48 * 32) t(i))",
    )
)
def test_pattern(spark, sf_dir):
    return images.pattern(spark, "checker", 48, 32, 6, 5)


# --- what the tables above don't use: registries, native bytes, read-back, the facade ------------


def _values(names: str, rows: list[tuple]) -> str:
    return f"select * from (values {', '.join(str(r) for r in rows)}) t({names})"


@query(_out("select image_id, y, x, case when (x // 6) % 2 = 0 then 65535 else 0 end as code from cells", "cells as (select 1 as image_id, (i // 48)::int as y, (i % 48)::int as x from range(48 * 32) t(i))"))
def pattern_columns_565(spark, sf_dir):
    return fm.encode(images.pattern(spark, "columns", 48, 32, 6, 1), "RGB565_BE").select("image_id", "y", "x", "code")


@query(_out("select image_id, y, x, case when (y // 6) % 2 = 0 then 255 else 0 end as code from cells", "cells as (select 2 as image_id, (i // 48)::int as y, (i % 48)::int as x from range(48 * 32) t(i))"))
def pattern_rows_332(spark, sf_dir):
    return fm.encode(images.pattern(spark, "rows", 48, 32, 6, 2), "RGB332").select("image_id", "y", "x", "code")


@query(_out("select image_id, y, x, (v * 255)::int as code from (select image_id, y, x, case when floor(sqrt((x * 2 + 1 - 48) ** 2 + (y * 2 + 1 - 32) ** 2) / 12)::int % 2 = 0 then 1 else 0 end as v from cells)", "cells as (select 3 as image_id, (i // 48)::int as y, (i % 48)::int as x from range(48 * 32) t(i))"))
def pattern_target_gray(spark, sf_dir):
    return fm.encode(images.pattern(spark, "target", 48, 32, 6, 3), "Grayscale8").select("image_id", "y", "x", "code")


@query(_values("name, bits", [(f.name, f.bits) for f in fm.FORMATS.values()] + [("no such format", 32)]))
def fmt_lookup(spark, sf_dir):
    """Formats by name; an unknown one is RGBA8."""
    return spark.createDataFrame([(n, fm.lookup(n).bits) for n in [*fm.FORMATS, "no such format"]], "name string, bits int")


@query(_out("select image_id, y, x, r, g, b, a from px", fx.PX))
def rgba8_rt(spark, sf_dir):
    return fm.decode(fm.encode(fx.px(spark, sf_dir), "RGBA8_Straight"), "RGBA8_Straight").select(*P)


@query(_out("select image_id, y, x, 255 - r as r, g, b, a from px", fx.PX))
def user_filter(spark, sf_dir):
    """A filter of one's own by name."""
    pf.register("invert red", lambda df: df.withColumn("r", 255 - F.col("r")))
    return pf.apply(fx.px(spark, sf_dir), "invert red").select(*P)


@query(_out("select image_id, y, x, (r // 16) * 16 as r, (g // 16) * 16 as g, (b // 16) * 16 as b, 255 as a from px", fx.PX))
def user_format(spark, sf_dir):
    """A pixel format of one's own: four bits a colour."""
    read = lambda c: (F.shiftright(c, 8) * 16, F.shiftright(c, 4).bitwiseAND(F.lit(15)) * 16, c.bitwiseAND(F.lit(15)) * 16, F.lit(255))
    write = lambda r, g, b, a: F.shiftleft(F.shiftright(r, 4), 8).bitwiseOR(F.shiftright(g, 4) * 16).bitwiseOR(F.shiftright(b, 4))
    fm.register(fm.Format("RGB444", 12, read, write))
    return ints(fm.decode(fm.encode(fx.px(spark, sf_dir), "RGB444"), "RGB444"), P)


@query(_out("select k, (v >> 16)::bigint as low, (-((-v) >> 16))::bigint as high, ((v + 32768) >> 16)::bigint as near, (v // 65536)::bigint as cut, ((v * w) >> 16)::bigint as product, ((v * 65536) // w)::bigint as quotient from t", "t as (select (l_orderkey * 10 + l_linenumber)::bigint as k, ((l_partkey - 500) * 7919 + l_suppkey)::bigint as v, (l_suppkey * 331 + 77)::bigint as w from lineitem)"))
def fixed_scalars(spark, sf_dir):
    t = fx.table(spark, sf_dir, "lineitem").selectExpr("cast(l_orderkey * 10 + l_linenumber as bigint) k", "cast((l_partkey - 500) * 7919 + l_suppkey as bigint) v", "cast(l_suppkey * 331 + 77 as bigint) w")
    v, w = F.col("v"), F.col("w")
    return t.select("k", fixed.floor_column(v).alias("low"), fixed.ceil_column(v).alias("high"), fixed.round_column(v).alias("near"), fixed.whole_column(v).alias("cut"), fixed.mul_column(v, w).alias("product"), fixed.div_column(v, w).alias("quotient"))


@query(_out("select image_id, y, x, ((r // 8) * 8 + r // 32)::int as r, ((g // 4) * 4 + g // 64)::int as g, ((b // 8) * 8 + b // 32)::int as b, 255 as a from px", fx.PX))
def native_565(spark, sf_dir):
    """Lines of native bytes out and in again."""
    lines = images.to_native(fx.px(spark, sf_dir), "RGB565_LE", 64)
    there = fx.px(spark, sf_dir).select("image_id", "y", "x")
    return images.from_native(lines, "RGB565_LE", 64).join(there, ["image_id", "y", "x"], "left_semi").select(*P)


@query(_out("select image_id, y, string_agg(coalesce(printf('%02X%02X%02X%02X', r, g, b, a), '00000000'), '' order by x) as line from (select l.image_id, l.y, c.x, r, g, b, a from (select distinct image_id, y from px) l cross join (select unnest(range(64)) as x) c left join px using (image_id, y, x)) group by 1, 2", fx.PX))
def dense_lines(spark, sf_dir):
    """Lines read back as bytes, zero where no pixel is."""
    return images.dense_rows(fx.px(spark, sf_dir), 64).select("image_id", "y", F.hex("data").alias("line"))


@query(_out("select i.image_id, ys.y::int as y, xs.x::int as x, coalesce(r, 0) as r, coalesce(g, 0) as g, coalesce(b, 0) as b, coalesce(a, 0) as a from (select distinct image_id from px) i cross join range(50, 70) ys(y) cross join range(56, 72) xs(x) left join px p on p.image_id = i.image_id and p.y = ys.y and p.x = xs.x", fx.PX))
def dense_tile(spark, sf_dir):
    return images.dense_tile(fx.px(spark, sf_dir), (56, 50, 72, 70)).select(*P)


@query(_out(f"select image_id, y, ((y * 7) % 64)::int as x, ({_LUMA} >> 6)::int as code from px where x = (y * 7) % 64", fx.PX))
def bit_random_read(spark, sf_dir):
    """One pixel of each packed line, without unpacking the others."""
    packed = fm.pack_rows(fm.encode(fx.px(spark, sf_dir), "Grayscale2_MSB"), "Grayscale2_MSB")
    lines = packed.groupBy("image_id", "y").agg(F.unhex(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("byte", "v"))), lambda p: F.lpad(F.hex(p["v"].cast("long")), 2, "0")), "")).alias("data"))
    x = ((F.col("y") * 7) % 64).cast("int")
    return lines.select("image_id", "y", x.alias("x"), fm.read_pixel(F.col("data"), x, "Grayscale2_MSB").alias("code")).where("code is not null")


@query(
    _out(
        f"select d.image_id, d.y, c.x::int as x, coalesce(e.code, 0) as code from (select coalesce(p.y, n.y) as y, coalesce(p.image_id, n.image_id) as image_id, least(p.x0, n.x0)::int as x0, greatest(p.x1, n.x1)::int as x1 from p full join n on p.image_id = n.image_id and p.y = n.y) d, unnest(range(d.x0, d.x1)) c(x) left join e on e.image_id = d.image_id and e.y = d.y and e.x = c.x",
        fx.LAYERS, "p as (select image_id, y, min(x) as x0, max(x) + 1 as x1 from layers where z = 5 group by 1, 2)", "n as (select image_id, y, min(x) as x0, max(x) + 1 as x1 from layers where z = 6 group by 1, 2)",
        f"e as (select image_id, y, x, max({_ENC565}) as code from layers where z = 6 group by 1, 2, 3)",
    )
)
def dirty_pixels(spark, sf_dir):
    """What a display gets of the dirty spans, in its format."""
    df = fx.layers(spark, sf_dir)
    both = bounds.dirty_spans(bounds.spans(df.where("z = 5")), bounds.spans(df.where("z = 6")), ["image_id", "y"])
    out = bounds.dirty_pixels(both, df.where("z = 6"), ["image_id", "y"])
    return ints(out.groupBy("image_id", "y", "x").agg(F.max("code").alias("code")), ["image_id", "y", "x", "code"])


@query(
    _out(
        "select image_id, y, x, case when e then (r1 + 0) // 2 else r1 end as r, case when e then (g1 + 255) // 2 else g1 end as g, case when e then (b1 + 100) // 2 else b1 end as b, case when e or o then 255 else a0 end as a from ("
        "select *, case when o then (r0 * 55 + 255 * 200) // 255 else r0 end as r1, case when o then (g0 * 55 + 140 * 200) // 255 else g0 end as g1, case when o then (b0 * 55) // 255 else b0 end as b1 from ("
        "select p.image_id, p.y, p.x, case when not inside then 255 when not within then 0 else r end as r0, case when not inside then 0 when not within then 100 else g end as g0, case when inside and within then b else 255 end as b0, case when inside and within then a else 255 end as a0, o, e "
        "from (select px.*, coalesce(px.x >= o.x0 and px.x < o.x1 and px.y >= o.y0 and px.y < o.y1, false) as inside, coalesce(px.x >= s.x0 and px.x < s.x1, false) as within, coalesce(px.x = l.x0 or px.x = l.x1 - 1, false) as o, coalesce(px.x = s.x0 or px.x = s.x1 - 1, false) as e "
        "from px left join o using (image_id) left join s on s.image_id = px.image_id and s.y = px.y left join l on l.image_id = px.image_id and l.y = px.y) p))",
        fx.PX, "o as (select image_id, min(x) as x0, min(y) as y0, max(x) + 1 as x1, max(y) + 1 as y1 from px where b > 250 group by 1)", "s as (select image_id, y, min(x) as x0, max(x) + 1 as x1 from px where b > 250 group by 1, 2)", "l as (select image_id, y, min(x) as x0, max(x) + 1 as x1 from px where b > 200 group by 1, 2)",
    )
)
def range_markers(spark, sf_dir):
    df = fx.px(spark, sf_dir)
    part = df.where("b > 250")
    return ints(bounds.range_overlay(df, bounds.spans(part), bounds.boxes(part), bounds.spans(df.where("b > 200"))), P)


@query(_out(f"select * from {_mean_sql(_mean_sql('px', 'x', 'y', 3), 'y', 'x', 3)}", fx.PX))
def filter_v1_blur(spark, sf_dir):
    """First-generation filters by name: blur without a radius, and an unknown name."""
    return pf.apply_first(pf.apply_first(fx.px(spark, sf_dir), "blur"), "no such filter").select(*P)


@query(_out("select node, (sum(used) // 2)::bigint as least, sum(requested)::bigint as requested, floor((sum(used) // 2) / sum(requested) * 1000)::int as split_pm from log group by 1", _LOG))
def split_estimate(spark, sf_dir):
    log = _log(spark, sf_dir).groupBy("node").agg(F.call_function("div", F.sum("used"), F.lit(2)).alias("least"), F.sum("requested").alias("requested"))
    out = metrics.split_estimate(log, "node", "least", "requested")
    return out.select("node", "least", "requested", F.floor(F.col("split") * 1000).cast("int").alias("split_pm"))


@query("select user_id, count(*) filter (d > 0 and now <= 12) as hits, count(*) filter (d > 0 and now > 12) as misses, least(max(now), 12)::bigint as peak from (select user_id, d, sum(d) over (partition by user_id order by event_id rows unbounded preceding) as now from (select user_id, event_id, case when event_id % 3 = 0 then -1 else 1 end as d from events)) group by 1")
def pool_counters(spark, sf_dir):
    log = fx.table(spark, sf_dir, "events").selectExpr("user_id", "event_id", "case when event_id % 3 = 0 then -1 else 1 end change")
    return metrics.pool_counters(log, "user_id", ["event_id"], 12)


@query(_out(f"select image_id, y, x, r, g, b, a from {_blur_sql(_SEEN, 'x', 2, 1)} where x between 8 and 39 and y between 4 and 35", fx.PX))
def filter_margin(spark, sf_dir):
    """A filter of one's own that reads beyond its output: the plan asks its source for so much more."""
    pf.register("soften", lambda df, radius: blur.box_blur(df, "x", int(radius)), lambda radius: int(radius))
    soft = nodes.Filter(nodes.Image(fx.px(spark, sf_dir), 64, 64), "soften", (2,))
    return nodes.Plan(nodes.Render(soft, 32, 32, (-8, -4))).frame()


@query(_out("select image_id, y, x, r, g, b, a from (select i.image_id, i.y, i.x, coalesce(p.r, 0) as r, coalesce(p.g, 0) as g, coalesce(p.b, 0) as b, coalesce(p.a, 0) as a from idx i left join pal p on p.idx = i.idx) where x < 40 and y < 30", fx.IDX, fx.PAL))
def graph_palette(spark, sf_dir):
    """An indexed source with its palette in a graph; the screen has its sink's size."""
    found = [{"id": "i", "type": "image", "imageId": 1}, {"id": "s", "type": "sink", "imageId": 4, "outputWidth": 40, "outputHeight": 30}]
    edges = [{"fromNodeId": "i", "toNodeId": "renderer", "toPortId": "in"}, {"fromNodeId": "renderer", "toNodeId": "s", "toPortId": "in"}]
    return graph.from_dict(found, edges, {1: (fx.idx(spark, sf_dir), 64, 64, fx.pal(spark, sf_dir))}).to_df().select(*P)


@query(_out("select image_id, (y + 32)::int as y, (x + 32)::int as x, case when k then 0 else r end as r, case when k then 200 else g end as g, case when k then 0 else b end as b, case when k then 255 else a end as a from (select image_id, y - 32 as y, x - 32 as x, (r // 64 * 64)::int as r, 0 as g, 0 as b, 255 as a, r // 64 = 2 as k from px)", fx.PX))
def graph_color_key(spark, sf_dir):
    found = [
        {"id": "i", "type": "image", "imageId": 1, "pivot": {"x": 32, "y": 32}, "colorKey": {"r": 128, "g": 0, "b": 0, "a": 255}, "colorKeyReplace": {"g": 200, "a": 255}},
        {"id": "s", "type": "sink", "imageId": 4, "outputWidth": 64, "outputHeight": 64, "pivotX": 32, "pivotY": 32},
    ]
    edges = [{"fromNodeId": "i", "toNodeId": "renderer", "toPortId": "in"}, {"fromNodeId": "renderer", "toNodeId": "s", "toPortId": "in"}]
    flat = fx.px(spark, sf_dir).selectExpr("image_id", "y", "x", "cast(r div 64 * 64 as int) r", "0 g", "0 b", "255 a")
    return graph.from_dict(found, edges, {1: (flat, 64, 64)}, pivot=None).to_df().select(*P)


@query(ORACLES["affine_chain"])
def tiles_of_ones_own(spark, sf_dir):
    """Tiles by a rule of one's own: columns of ten pixels."""
    inside = nodes.Affine(nodes.Blur(nodes.Affine(_source(spark, sf_dir), INNER), "x", 2), OUTER)
    return nodes.Plan(nodes.Render(inside, 120, 80, (60, 40))).tiled(lambda screen: F.floor(F.col("x") / 10))


@query(ORACLES["graph_from_dict"])
def graph_saved(spark, sf_dir):
    """The graph after its state was kept and read."""
    px = fx.px(spark, sf_dir)
    other = px.selectExpr("image_id", "y", "x", "g r", "r g", "b", "200 a")
    plan = graph.from_dict(*graph.from_json(graph.to_json(GRAPH_NODES, GRAPH_EDGES)), {1: (px, 64, 64), 2: (other, 64, 64)}, 64, 64, (32, 32))
    return ints(plan.to_df(), ["sink_id", *P])


@query(ORACLES["graph_from_dict"])
def graph_connected(spark, sf_dir):
    """The same graph connected by hand: a wrong connection is taken away, and a port that is taken refuses."""
    b = builder.Builder()
    made = {n["id"]: b.add(n["id"], n["type"], **{k: v for k, v in n.items() if k not in ("id", "type")}) for n in GRAPH_NODES}
    made["b"] >> made["turn"]
    made["turn"].disconnect_all()
    made["a"] >> made["dark"] >> made["turn"]
    ends = [made["turn"].connect_to(made["both"], "in1"), made["both"].connect_from(made["b"], "in2"), made["b"].connect_to(made["dark"])]
    assert ends == [True, True, False]
    made["both"] >> graph.SCREEN >> made["out"]
    px = fx.px(spark, sf_dir)
    other = px.selectExpr("image_id", "y", "x", "g r", "r g", "b", "200 a")
    return ints(b.plan({1: (px, 64, 64), 2: (other, 64, 64)}, width=64, height=64, pivot=(32, 32)).to_df(), ["sink_id", *P])


@query(f"select image_id, y, x, r, g, b, a from ({ORACLES['graph_from_dict']})")
def evaluator(spark, sf_dir):
    """The graph through the facade, read back by image id."""
    e = api.Evaluator(spark, 64, 64)
    e.set_dst_origin(32, 32)
    px = fx.px(spark, sf_dir)
    e.store_image(1, px, 64, 64)
    e.store_image(2, px.selectExpr("image_id", "y", "x", "g r", "r g", "b", "200 a"), 64, 64)
    e.set_nodes(GRAPH_NODES)
    e.set_connections(GRAPH_EDGES)
    assert e.evaluate_graph() == 0
    return ints(e.get_image_as_rgba8(9), P)


@query(f"select image_id, y, x, ((c // 2048) * 8 + (c // 2048) // 4)::int as r, (((c // 32) % 64) * 4 + ((c // 32) % 64) // 16)::int as g, ((c % 32) * 8 + (c % 32) // 4)::int as b, 255 as a from (select *, {_ENC565} as c from ({ORACLES['graph_from_dict']}))")
def evaluator_preview(spark, sf_dir):
    """A sink's preview in its format."""
    e = api.Evaluator(spark, 64, 64)
    e.set_dst_origin(32, 32)
    px = fx.px(spark, sf_dir)
    e.store_image(1, px, 64, 64)
    e.store_image(2, px.selectExpr("image_id", "y", "x", "g r", "r g", "b", "200 a"), 64, 64)
    e.set_nodes(GRAPH_NODES)
    e.set_connections(GRAPH_EDGES)
    e.set_sink_format("out", "RGB565_BE")
    assert e.evaluate_graph() == 0
    return ints(e.get_sink_preview("out"), P)


@query(_values("given, status", [("complete", 0), ("circle", 1), ("no source", 2), ("no sink", 3)]))
def plan_status(spark, sf_dir):
    """What a graph that can't run says."""
    circle = [*GRAPH_EDGES[1:], {"fromNodeId": "turn", "toNodeId": "dark", "toPortId": "in"}]
    rows = []
    for given, edges in (("complete", GRAPH_EDGES), ("circle", circle), ("no source", GRAPH_EDGES[-1:]), ("no sink", GRAPH_EDGES[:-1])):
        e = api.Evaluator(spark, 64, 64)
        for k in (1, 2):
            e.store_image(k, fx.px(spark, sf_dir), 64, 64)
        e.set_nodes(GRAPH_NODES)
        e.set_connections(edges)
        rows.append((given, e.evaluate_graph()))
    return spark.createDataFrame(rows, "given string, status int")


# --- streams -----------------------------------------------------------------------------------


@query(_out(f"select image_id, x, y, r, g, b, a from {_blur_sql(_SEEN, 'y', 2, 1)} where y between 0 and 63", fx.PX))
def stream_vblur(spark, sf_dir):
    """Lines in order, in two micro-batches, then each column's end mark."""
    px = fx.px(spark, sf_dir).select("image_id", "x", "y", *"rgba", F.lit(False).alias("last"))
    ends = px.select("image_id", "x").distinct().select("image_id", "x", F.lit(64).alias("y"), *(F.lit(0).alias(c) for c in "rgba"), F.lit(True).alias("last"))
    seen = px.where("a > 0")
    batches = [seen.where("y < 40"), seen.where("y >= 40").unionByName(ends)]
    return run.run_batches(spark, batches, lambda s: vertical_blur.stream_blur(s, 2), "vblur")


@query(
    _out(
        "select z as frame, (image_id * 64 + y)::int as y, least(x0, coalesce(lag(x0) over w, x0))::int as x0, greatest(x1, coalesce(lag(x1) over w, x1))::int as x1 from s window w as (partition by image_id, y order by z)",
        fx.LAYERS,
        "s as (select image_id, y, z, min(x) as x0, max(x) + 1 as x1 from layers group by 1, 2, 3)",
    )
)
def stream_dirty_spans(spark, sf_dir):
    """Layers as frames: each line's span joined with its last one."""
    spans = fx.layers(spark, sf_dir).groupBy("image_id", "y", "z").agg(F.min("x").alias("x0"), (F.max("x") + 1).alias("x1"))
    spans = spans.selectExpr("z frame", "cast(image_id * 64 + y as int) y", "x0", "x1")
    return run.run_batches(spark, [spans.where("frame < 3"), spans.where("frame >= 3")], dirty.dirty_stream, "dirty")
