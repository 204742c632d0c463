import itertools
import math
import random

import numpy as np
import pytest

from tesserae.functions import formats as fm
from tesserae.functions import pixels as pf
from tesserae.functions.fixed import ONE, Matrix, ceil_fixed, cut_fixed, div_fixed, floor_fixed, from_fixed, mul_fixed, near_fixed, round_fixed
from tesserae.operators import blend, blur, geometry, ninepatch
from tesserae.plans import graph, nodes
from tesserae.sources import images

SCHEMA = "image_id int, y int, x int, r int, g int, b int, a int"


def frame(spark, pixels):
    return spark.createDataFrame([(0, y, x, *c) for (x, y), c in pixels.items()], SCHEMA)


def cells(df):
    return {(r.x, r.y): (r.r, r.g, r.b, r.a) for r in df.collect() if r.a}


def hashed(w=16, h=16):
    return {(x, y): ((17 * x + 31 * y) & 255, (53 * x + 7 * y) & 255, (11 * x + 43 * y) & 255, 255) for x in range(w) for y in range(h)}


def test_fixed_point():
    assert [floor_fixed(v) for v in (-1, 0, ONE - 1, -ONE)] == [-1, 0, 0, -1]
    assert [ceil_fixed(v) for v in (-1, 1, ONE)] == [0, 1, 1] and [round_fixed(v) for v in (ONE // 2, -ONE // 2)] == [1, 0]
    assert cut_fixed(-0.99999) == -65535 and near_fixed(0.7071067) == 46341 and from_fixed(-3 * ONE // 2) == -1
    assert mul_fixed(3 * ONE // 2, -ONE) == -3 * ONE // 2 and div_fixed(-ONE, 3 * ONE) == -21845
    assert Matrix(1, 1, 1, 1).inverse() is None
    m = Matrix.move(3, 4) @ Matrix.scale(2, 2)
    assert (m.a, m.tx, m.ty) == (2, 3, 4)


@pytest.mark.parametrize("m", [Matrix.move(2.5, -3.75), Matrix.scale(2, 0.5), Matrix.turn(0.7, 1.3, 0.8), Matrix(-1.0, 0.25, 0.5, 1.5, 4.25, 1.0), Matrix.scale(0.1, 0.1)])
def test_nearest_equals_lookup(spark, m):
    source, pivot = hashed(), (5 * ONE // 2, 5 * ONE // 2)
    inv = m.inverse()
    bx, by = inv.base(*pivot)
    want = {}
    for x, y in itertools.product(range(-50, 60), repeat=2):
        p = ((inv.a * x + inv.b * y + bx) >> 16, (inv.c * x + inv.d * y + by) >> 16)
        if p in source:
            want[x, y] = source[p]
    df = frame(spark, source)
    assert cells(geometry.sample_nearest(df, m, pivot)) == want
    rect = (-3, -2, 9, 11)
    assert cells(geometry.sample_nearest(df, m, pivot, rect)) == {k: v for k, v in want.items() if -3 <= k[0] < 9 and -2 <= k[1] < 11}


def test_sampling_is_narrow(spark):
    df = geometry.sample_nearest(frame(spark, hashed()), Matrix.turn(0.4))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Join" not in plan


def test_singular_matrix_gives_nothing(spark):
    assert geometry.sample_nearest(frame(spark, hashed()), Matrix(0, 0, 0, 0)).count() == 0
    assert geometry.sample_bilinear(frame(spark, hashed()), Matrix(0, 0, 0, 0), (16, 16)).count() == 0


def test_bilinear_ramp(spark):
    ramp = spark.createDataFrame([(0, y, x, 60 * x + 40 * y) for x in range(3) for y in range(3)], "image_id int, y int, x int, v int")
    out = {(r.x, r.y): r.v for r in geometry.sample_bilinear_plane(ramp, Matrix.move(-0.5, -0.5), (3, 3), fade=0).collect()}
    assert all(abs(out[x, y] - (60 * (x + 0.5) + 40 * (y + 0.5))) <= 1 for x in range(2) for y in range(2))


def test_all_format_pairs_by_rgba(spark):
    colors = {(0, 0): (255, 0, 0, 255), (1, 0): (0, 255, 0, 200), (2, 0): (0, 0, 255, 128), (3, 0): (128, 128, 128, 255)}
    df = frame(spark, colors)
    names = [n for n in fm.FORMATS if not n.startswith("Index")]
    for a, b in itertools.permutations(names[:8], 2):
        code = fm.encode(df, a)
        got = fm.convert(code, a, b).select("x", "code").collect()
        want = fm.encode(fm.decode(code, a), b).select("x", "code").collect()
        assert sorted(got) == sorted(want), (a, b)
    assert len(fm.FORMATS) == 21 and fm.lookup("nothing").name == "RGBA8_Straight"


def test_rgba_codes_round_trip(spark):
    df = frame(spark, {(0, 0): (255, 1, 2, 3), (1, 0): (0, 128, 255, 255)})
    assert cells(fm.decode(fm.encode(df, "RGBA8_Straight"), "RGBA8_Straight")) == cells(df)


@pytest.mark.parametrize("fmt", ["Index1_MSB", "Index2_LSB", "Grayscale4_MSB"])
@pytest.mark.parametrize("offset", [0, 3, 8, 9])
def test_packing_round_trip(spark, fmt, offset):
    top = 1 << fm.lookup(fmt).bits
    rng = random.Random(offset)
    rows = [(0, y, x, rng.randrange(top)) for y in range(2) for x in range(16)]
    df = spark.createDataFrame(rows, "image_id int, y int, x int, code int")
    back = {(r.y, r.x): r.code for r in fm.unpack_rows(fm.pack_rows(df, fmt, offset=offset), fmt, offset).collect()}
    assert all(back[y, x] == v for _, y, x, v in rows)


def scalar_under(layers):
    d = (0, 0, 0, 0)
    for s in layers:
        if s[3] == 0 or d[3] == 255:
            continue
        if d[3] == 0:
            d = s
            continue
        t = d[3] * 255 + s[3] * (255 - d[3])
        w = (d[3] * 65280 + (t >> 1)) // t
        d = (*((d[k] * w + s[k] * (256 - w)) >> 8 for k in range(3)), (t + 127) // 255)
    return d


def test_composite_against_scalar(spark):
    rng = random.Random(1)
    alphas = [0, 1, 64, 127, 128, 192, 254, 255]
    stacks = {x: [(*(rng.randrange(256) for _ in range(3)), rng.choice(alphas)) for _ in range(4)] for x in range(400)}
    df = spark.createDataFrame([(0, 0, x, z, *c) for x, s in stacks.items() for z, c in enumerate(s)], "image_id int, y int, x int, z int, r int, g int, b int, a int")
    want = {(x, 0): scalar_under(s) for x, s in stacks.items() if scalar_under(s)[3]}
    assert cells(blend.composite_under(df)) == want
    assert cells(blend.composite_under(blend.opaque_cut(df))) == want


def test_transparent_layer_is_neutral_and_opaque_front_hides(spark):
    back, clear = frame(spark, hashed(4, 4)), frame(spark, {(x, y): (9, 9, 9, 0) for x in range(4) for y in range(4)})
    front = frame(spark, {(x, y): (1, 2, 3, 255) for x in range(4) for y in range(4)})
    assert cells(blend.composite_under(blend.stacked([clear, back]))) == cells(back)
    assert cells(blend.composite_under(blend.stacked([front, back]))) == cells(front)


def scalar_blur(row, radius, passes):
    for _ in range(passes):
        out = {}
        for x in range(min(row) - radius, max(row) + radius + 1):
            near = [row[k] for k in range(x - radius, x + radius + 1) if k in row]
            a = sum(p[3] for p in near)
            if a // (2 * radius + 1):
                out[x] = (*(sum(p[k] * p[3] for p in near) // a for k in range(3)), a // (2 * radius + 1))
        row = out
    return row


@pytest.mark.parametrize("radius,passes", [(1, 1), (3, 3), (10, 1), (127, 2)])
def test_blur_against_scalar(spark, radius, passes):
    rng = random.Random(radius)
    row = {x: (rng.randrange(256), rng.randrange(256), rng.randrange(256), rng.randrange(256)) for x in range(40) if rng.random() < 0.8}
    want = scalar_blur({x: c for x, c in row.items() if c[3]}, radius, passes)
    assert cells(blur.box_blur(frame(spark, {(x, 0): c for x, c in row.items()}), "x", radius, passes)) == {(x, 0): c for x, c in want.items()}
    assert cells(blur.box_blur(frame(spark, {(0, x): c for x, c in row.items()}), "y", radius, passes)) == {(0, x): c for x, c in want.items()}


def test_blur_grows_and_zero_radius_is_identity(spark):
    solid = frame(spark, {(x, 0): (255, 255, 255, 255) for x in range(-16, 16)})
    xs = [x for x, _ in cells(blur.box_blur(solid, "x", 10))]
    assert (min(xs), max(xs) + 1) == (-26, 26)
    assert cells(blur.box_blur(solid, "x", 0)) == cells(solid)
    plan = blur.box_blur(solid, "x", 2, 3)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1


def test_matte_fades_once_without_a_front(spark):
    back = frame(spark, {(0, 0): (200, 100, 50, 255), (1, 0): (10, 20, 30, 255)})
    mask = spark.createDataFrame([(0, 0, 0, 128)], "image_id int, y int, x int, v int")
    full = 128 + 1
    faded = tuple(v * (256 - full) >> 8 for v in (200, 100, 50, 255))
    assert cells(blend.matte(mask, None, back)) == {(0, 0): faded, (1, 0): (10, 20, 30, 255)}


def test_tiled_equals_whole(spark):
    source = nodes.Image(frame(spark, hashed()), 16, 16, (8 * ONE, 8 * ONE))
    inside = nodes.Affine(nodes.Blur(nodes.Blur(nodes.Affine(source, Matrix.turn(0.3)), "x", 2, 2), "y", 1), Matrix.scale(1.5, 1.25))
    whole = nodes.Plan(nodes.Render(inside, 40, 36, (20, 18), (13, 7)))
    assert cells(whole.frame()) == cells(whole.tiled())


def test_regions_reach_the_source(spark, tmp_path):
    frame(spark, hashed()).write.parquet(str(tmp_path / "px"))
    source = nodes.Image(spark.read.parquet(str(tmp_path / "px")), 16, 16)
    plan = nodes.Plan(nodes.Render(nodes.Blur(source, "x", 2), 4, 3)).frame()._jdf.queryExecution().executedPlan().toString()
    filters = plan[plan.index("PushedFilters") :]
    assert "GreaterThanOrEqual(x,-2)" in filters and "LessThanOrEqual(x,5)" in filters


def test_nine_patch_corners_keep_their_size(spark):
    out = cells(ninepatch.fill(frame(spark, hashed()), (16, 16), (4, 3, 5, 2), (40.0, 30.0)))
    source = hashed()
    assert set(out) == {(x, y) for x in range(40) for y in range(30)}
    assert all(out[x, y] == source[x, y] for x in range(4) for y in range(3))
    assert all(out[39 - x, 29 - y] == source[15 - x, 15 - y] for x in range(5) for y in range(2))


def test_nine_patch_axis_shrinks_in_proportion():
    axis = ninepatch.Axis.plan(20, 6, 4, 5.0)
    assert axis.lengths == (3.0, 0.0, 2.0) and axis.offsets[2] == 3.0
    assert ninepatch.Axis.plan(20, 6, 4, 30.0).part(2) == (15, 5, 1.0, 25.0)


def test_graph_errors(spark):
    image = {1: (frame(spark, hashed()), 16, 16)}
    edge = lambda a, b, p="in": {"fromNodeId": a, "toNodeId": b, "toPortId": p}
    with pytest.raises(nodes.NoUpstreamError):
        graph.from_dict([], [], image, 8, 8)
    loop = [{"id": "f", "type": "affine"}, {"id": "g", "type": "affine"}]
    with pytest.raises(nodes.CycleError):
        graph.from_dict(loop, [edge("f", "g"), edge("g", "f"), edge("g", "renderer")], image, 8, 8)
    plan = graph.from_dict([{"id": "i", "type": "image", "imageId": 1}], [edge("i", "renderer")], image, 8, 8)
    assert len(cells(plan.frame())) == 64
    with pytest.raises(nodes.NoDownstreamError):
        plan.to_df()
    blurred = graph.from_dict(
        [{"id": "i", "type": "image", "imageId": 1}, {"id": "b", "type": "filter", "filterType": "horizontalBlur", "filterParams": [2, 2]}, {"id": "m", "type": "matte"}],
        [edge("i", "b"), edge("b", "m", "in2"), edge("m", "renderer")], image, 8, 8,
    )
    assert isinstance(blurred.render.child.back, nodes.Blur) and blurred.render.child.back.passes == 2
    assert graph.from_json(graph.to_json([{"id": "i"}], [])) == ([{"id": "i"}], [])


def test_filters(spark):
    df = frame(spark, {(0, 0): (250, 10, 128, 255)})
    assert cells(pf.brightness(df, 0.1))[0, 0] == (255, 35, 153, 255)
    assert cells(pf.brightness(df, -0.1))[0, 0] == (225, 0, 103, 255)
    assert cells(pf.apply(df, "unknown", 1)) == cells(df)
    pf.register("invert", lambda d: d.withColumns({c: 255 - d[c] for c in "rgb"}))
    assert cells(pf.apply(df, "invert"))[0, 0] == (5, 245, 127, 255)


def test_images_in_and_out(spark, tmp_path):
    rng = np.random.default_rng(0)
    data = rng.integers(0, 256, (5, 7, 4))
    data[..., 3] = np.maximum(1, data[..., 3])
    df = images.from_arrays(spark, {3: data})
    (row,) = images.encode_png(df, 7, 5).collect()
    (tmp_path / "i.png").write_bytes(row.png)
    back = images.read_images(spark, str(tmp_path / "i.png"))
    got = {(r.x, r.y): (r.r, r.g, r.b, r.a) for r in back.collect()}
    assert got == {(x, y): tuple(data[y, x].tolist()) for x in range(7) for y in range(5)}


@pytest.mark.parametrize("angle", [0, 45, 90, 135, 180, 225, 270, 315])
@pytest.mark.parametrize("pivot", [(0, 0), (2, 3), (4, 6)])
def test_boxes_of_turned_images(spark, angle, pivot):
    m = Matrix.turn(math.radians(angle))
    fixed = (pivot[0] * ONE, pivot[1] * ONE)
    df = frame(spark, {(x, y): (x + 1, y, 0, 255) for x in range(4) for y in range(6)})
    out = cells(geometry.sample_nearest(df, m, fixed))
    left, top, right, bottom = geometry.bounds_of(m, (4, 6), fixed)
    assert out and all(left - 1 <= x <= right and top - 1 <= y <= bottom for x, y in out)
    if angle % 90 == 0:
        assert len(out) == 24


def test_command_line(spark, tmp_path):
    from tesserae import cli

    data = np.full((4, 6, 4), 100)
    data[..., 3] = 255
    (row,) = images.encode_png(images.from_arrays(spark, {0: data}), 6, 4).collect()
    (tmp_path / "in.png").write_bytes(row.png)
    assert cli.main([str(tmp_path / "in.png"), "-o", str(tmp_path / "out"), "--brightness", "0.2", "--grayscale", "--blur", "1", "--alpha", "0.5"]) == 0
    out = {(r.x, r.y): (r.r, r.g, r.b, r.a) for r in images.read_images(spark, str(tmp_path / "out/in.png")).collect()}
    assert len(out) == 24 and out[2, 2] == (151, 151, 151, 127)
