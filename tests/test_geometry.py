"""Alignment points, boxes, measures inside a row and atlases on planes larger than the queries' 8 x 8."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from framequery.functions import pixels as px
from framequery.functions import planes as pn
from framequery.operators import atlas as at
from framequery.operators import crops as cr
from framequery.operators import local as lo
from framequery.sources import register, ser


def scene(side=64, seed=3):
    rnd = np.random.default_rng(seed)
    small = rnd.random((side // 4, side // 4))
    image = np.kron(small, np.ones((4, 4)))
    for _ in range(3):  # soft, so that costs are smooth
        image = (image + np.roll(image, 1, 0) + np.roll(image, -1, 0) + np.roll(image, 1, 1) + np.roll(image, -1, 1)) / 5
    return image


def found(plane, reference, gx=0.0, gy=0.0, grid=(4, 4), half=8, radius=4):
    return lo.gated(lo.point_costs(plane, reference, gx, gy, grid, half, radius))


@pytest.mark.parametrize("dx, dy, gx, gy", [(2, -1, 0, 0), (3, 2, 1, 0), (-2, 1, 0, 2)])
def test_shifts_of_whole_pixels(dx, dy, gx, gy):
    """The frame is the reference moved against (dx, dy): sampling it at x - shift gives the reference back."""
    reference = scene()
    plane = np.roll(reference, (-dy, -dx), (0, 1))
    got = found(plane, reference, gx, gy)
    inner = got[3].reshape(4, 4)[1:3, 1:3]
    assert inner.all()
    assert np.allclose(got[0].reshape(4, 4)[1:3, 1:3], dx - gx, atol=0.15) and np.allclose(got[1].reshape(4, 4)[1:3, 1:3], dy - gy, atol=0.15)


def test_half_a_global_pixel_is_not_lost():
    reference = scene()
    plane = (reference + np.roll(reference, -1, 1)) / 2  # moved by half a pixel
    dx, dy, _, kept = found(plane, reference, 0.5, 0.0)
    assert kept.any() and np.abs(dx[kept]).max() < 0.2 and np.abs(dy[kept]).max() < 0.2


def test_flat_edges_and_far_winners_don_t_count():
    flat = np.full((64, 64), 0.5)
    assert not found(flat, flat)[3].any()
    edge = np.tile((np.arange(64) > 33) * 1.0, (64, 1))  # straight: nothing rises along it
    assert not found(np.roll(edge, 1, 1), edge)[3].any()
    reference = scene()
    dx, dy, _, kept = found(np.roll(reference, (0, -9), (0, 1)), reference)  # beyond the search
    assert (dx[~kept] == 0).all() and (dy[~kept] == 0).all() and not kept.reshape(4, 4)[1:3, 1:3].all()


def test_points_in_spark_equal_numpy(spark):
    reference, planes = scene(), [np.roll(scene(), (k, -k), (0, 1)) for k in range(3)]
    rows = [(k, p.ravel().tolist(), reference.ravel().tolist(), 0.25 * k, 0.0) for k, p in enumerate(planes)] + [(9, None, reference.ravel().tolist(), 0.0, 0.0)]
    frames = spark.createDataFrame(rows, "k long, plane array<double>, reference array<double>, gx double, gy double")
    got = {r.k: r.points for r in lo.point_shifts(frames, (4, 4), 8, 4, 64).collect()}
    assert got[9] is None
    for k, p in enumerate(planes):
        dx, dy, depth, kept = found(p, reference, 0.25 * k)
        assert [(q.ay, q.ax) for q in got[k]] == [(i // 4, i % 4) for i in range(16)]
        assert np.allclose([q.dx for q in got[k]], dx) and np.allclose([q.dy for q in got[k]], dy) and np.allclose([q.depth for q in got[k]], depth) and [q.kept for q in got[k]] == kept.tolist()


def test_border_boxes(spark):
    cases = {(100, 80, 10): (10, 10, 80, 60), (100, 80, 0): (0, 0, 100, 80), (100, 80, -5): (0, 0, 100, 80), (100, 80, 40): None, (0, 80, 1): None, (100, 80, 39): (39, 39, 22, 2)}
    rows = spark.createDataFrame(list(cases), "w int, h int, b int").withColumn("box", cr.border_box(F.col("w"), F.col("h"), F.col("b"))).collect()
    assert {(r.w, r.h, r.b): None if r.box is None else tuple(r.box) for r in rows} == cases


def test_common_and_coverage_boxes(spark):
    shifts = spark.createDataFrame([(1, 1.2, -0.5), (1, -3.0, 0.0), (2, 0.0, 0.0), (3, 9.0, 0.0), (4, None, None)], "c long, dx double, dy double")
    assert {r.c: tuple(r.box) for r in cr.common_boxes(shifts, ["c"], 16, 8).collect()} == {1: (3, 1, 10, 6), 2: (0, 0, 16, 8), 3: (0, 0, 16, 8), 4: (0, 0, 16, 8)}
    rows = [(1, y * 6 + x, 1.0, 10.0 if 1 <= x <= 3 and y >= 2 else 4.0) for y in range(5) for x in range(6)] + [(2, p, 1.0, 0.0) for p in range(30)] + [(3, p, 2.0, 7.0) for p in range(30)]
    coverage = spark.createDataFrame(rows, "c long, px int, value double, coverage double")
    boxes = cr.coverage_boxes(coverage, ["c"], 6, 5, 0.5)
    assert {r.c: tuple(r.box) for r in boxes.collect()} == {1: (1, 2, 3, 3), 2: (0, 0, 6, 5), 3: (0, 0, 6, 5)}
    cut = cr.cropped_pixels(coverage, boxes, ["c"], 6)
    assert sorted((r.x, r.y, r.px) for r in cut.where("c = 1").collect()) == [(x, y, y * 3 + x) for x in range(3) for y in range(3)]
    plane = spark.createDataFrame([(list(map(float, range(30))),)], "plane array<double>").crossJoin(boxes.where("c = 1"))
    assert plane.select(cr.cropped_plane(F.col("plane"), F.col("box"), 6)).first()[0] == [float((y + 2) * 6 + x + 1) for y in range(3) for x in range(3)]


def test_centroids_and_profile(spark):
    y, x = np.mgrid[0:32, 0:32]
    disc = np.where((x - 17.0) ** 2 + (y - 14.0) ** 2 <= 36, 0.9, 0.05) + 0.01 * np.sin(x)
    frames = spark.createDataFrame([(0, disc.ravel().tolist()), (1, [0.0] * 1024)], "k long, plane array<double>")
    p = F.col("plane")
    got = frames.select("k", pn.bright_centroid(p, 32).alias("a"), pn.excess_centroid(p, 32).alias("b"), pn.disc_centroid(p, 32).alias("c"), pn.polar_profile(p, 32, F.lit(17.0), F.lit(14.0), 14).alias("r")).orderBy("k").collect()
    for name in "abc":
        assert math.isclose(got[0][name].cx, 17, abs_tol=0.2) and math.isclose(got[0][name].cy, 14, abs_tol=0.2)
    assert got[1].a.cx is None and got[1].b.cx is None and (got[1].c.cx, got[1].c.cy) == (16, 16)
    profile = got[0].r
    assert all(abs(v - 0.9) < 0.03 for v in profile[:5]) and all(abs(v - 0.05) < 0.03 for v in profile[8:])


def test_dual_zone_table():
    table = px.dual_zone_table(1025)
    assert table[0] == 0 and table[512] == 0.5 and table[1024] == 1 and table[768] == 0.75
    assert all(a < b for a, b in zip(table, table[1:])) and table[100] > 2 * 100 / 1024


def test_atlas_of_long_and_large_captures(spark, tmp_path):
    register(spark)
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "a.ser").write_bytes(ser.synthetic(w=20, h=10, n=103))
    (folder / "b.ser").write_bytes(ser.synthetic(w=6, h=6, n=2, depth=16))
    (folder / "c.ser").write_bytes(ser.synthetic(w=4, h=2, n=1, color_id=17))
    (folder / "none.ser").write_bytes(ser.synthetic(w=4, h=2, n=0))
    heads, frames = spark.read.format("ser").option("headersOnly", "true").load(str(folder)), spark.read.format("ser").load(str(folder))
    plan = at.atlas_plan(heads, 10, longest=10, least=1)
    assert {r.path[-5:]: tuple(r)[1:] for r in plan.collect()} == {"a.ser": (103, 11, 10, 10, 5), "b.ser": (2, 1, 2, 6, 6), "c.ser": (1, 1, 1, 4, 2)}
    tight = {r.path[-5:]: r.stride for r in at.atlas_plan(heads, 1500, budget=10 * 5 * 4 * 3, longest=10, least=1).collect()}
    assert tight["a.ser"] == 35  # three pictures fit
    at.build_atlas(frames, plan, str(tmp_path / "atlas"))
    near = at.nearest_pictures(spark, str(tmp_path / "atlas"), frames.select("path", "frame_idx")).collect()
    for r in near:
        if r.path.endswith("a.ser"):
            assert r.atlas_idx == min(9, math.floor(r.frame_idx / 11 + 0.5)) * 11 and bytes(r.rgba[:4]) == bytes([(0x10 + r.atlas_idx) & 255] * 3 + [255])
    assert len(near) == 106 and {len(r.rgba) for r in near if r.path.endswith("c.ser")} == {32}
    with pytest.raises(Exception):
        at.build_atlas(frames, plan, str(tmp_path / "atlas"))  # an atlas isn't written over


def test_pictures_of_mosaics_and_words():
    raw = np.arange(16, dtype=np.uint8)
    assert at.picture(raw, 4, 4, 8, "bayerGBRG", 1, 1) == bytes([4, (0 + 5) // 2, 1, 255])
    assert at.picture(np.array([0x1234, 0xFFFF], "<u2").view(np.uint8), 2, 1, 16, "mono", 2, 1) == bytes([0x12] * 3 + [255] * 5)
    assert at.picture(np.array([1, 2, 3], np.uint8), 1, 1, 8, "bgr", 1, 1) == bytes([3, 2, 1, 255])
