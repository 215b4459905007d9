"""Alignment points, crops by coverage, measures inside a row, atlases and the two-zone tone table, with DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framequery.functions import pixels as px
from framequery.functions import planes as pn
from framequery.operators import atlas as at
from framequery.operators import crops as cr
from framequery.operators import export as ex
from framequery.operators import local as lo
from framequery.operators import reduce as rd
from framequery.plans.frame_queries import SQL_PIXELS, _frames
from framequery.plans.pixel_queries import _referred
from framequery.plans.stack_queries import SQL_DX, SQL_DY, _drift, _sql_moved
from framequery.plans.writer_queries import _raw
from framequery.session import shared_path
from framequery.sources import register

_OWN = ("capture_id", "frame_idx")


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet")


def rg06_point_shifts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """2 x 2 alignment points of each frame against the first of its capture, after global shifts of half and quarter pixels."""
    f = _referred(spark, sf_dir).withColumns({"gx": (F.col("frame_idx") % 3 - 1) * F.lit(0.5), "gy": (F.col("frame_idx") % 2) * F.lit(0.25)})
    p = lo.point_shifts(f, (2, 2), 2, 2, 8).select(*_OWN, F.inline("points"))
    return p.select(*_OWN, "ay", "ax", F.round("dx", 6).alias("dx"), F.round("dy", 6).alias("dy"), F.round("depth", 6).alias("depth"), "kept")


def pr04_border_box(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("event_id")
    box = cr.border_box(n % 50, n % 37, n % 23 - 3)
    return _events(spark, sf_dir).select("event_id", *(box[k].alias(k) for k in ("x", "y", "w", "h")))


def _coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rd.coverage_mean(rd.shifted(_frames(spark, sf_dir), *_drift(), "null"), F.lit(1.0) + F.col("frame_idx") % 2)


def pr04_common_area(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The coverage mean of a capture, cropped to what all its frames share."""
    boxes = cr.common_boxes(_frames(spark, sf_dir).select("capture_id", *(d.alias(n) for d, n in zip(_drift(), ("dx", "dy")))), ["capture_id"], 8, 8)
    return cr.cropped_pixels(_coverage(spark, sf_dir), boxes, ["capture_id"], 8).select("capture_id", "px", "x", "y", F.round("value", 6).alias("value"))


def ag38_coverage_box(spark: SparkSession, sf_dir: str) -> DataFrame:
    boxes = cr.coverage_boxes(_coverage(spark, sf_dir), ["capture_id"], 8, 8, 0.8)
    return boxes.select("capture_id", *(F.col(f"box.{k}").alias(k) for k in ("x", "y", "w", "h")))


def pr04_coverage_crop(spark: SparkSession, sf_dir: str) -> DataFrame:
    coverage = _coverage(spark, sf_dir)
    boxes = cr.coverage_boxes(coverage, ["capture_id"], 8, 8, 0.8)
    return cr.cropped_pixels(coverage, boxes, ["capture_id"], 8).select("capture_id", "px", "x", "y", F.round("value", 6).alias("value"))


def ag25_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = {"bright": pn.bright_centroid(F.col("plane"), 8), "excess": pn.excess_centroid(F.col("plane"), 8), "disc": pn.disc_centroid(F.col("plane"), 8)}
    centres = _frames(spark, sf_dir).select(*_OWN, *(c.alias(n) for n, c in found.items()))
    return centres.select(*_OWN, *(F.round(F.col(n)[a], 6).alias(f"{n}_{a}") for n in found for a in ("cx", "cy")))


def ag42_polar_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean value at radii 0 to 5 around the bright centroid, over 64 directions."""
    f = _frames(spark, sf_dir).withColumn("c", pn.bright_centroid(F.col("plane"), 8))
    p = f.select(*_OWN, F.posexplode(pn.polar_profile(F.col("plane"), 8, F.col("c.cx"), F.col("c.cy"), 6)).alias("r", "v"))
    return p.select(*_OWN, "r", F.round("v", 6).alias("v"))


def sc18_atlas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An atlas of 20 pictures of 4 x 4 pixels at most for each written capture, and the picture nearest to every frame."""
    register(spark)
    captures, folder = shared_path(spark, "captures"), shared_path(spark, "atlas")
    ex.write_captures(_raw(spark, sf_dir), captures, index="frame_idx")
    plan = at.atlas_plan(spark.read.format("ser").option("headersOnly", "true").load(captures), 20, longest=4, least=4)
    frames = spark.read.format("ser").load(captures)
    at.build_atlas(frames, plan, folder)
    near = at.nearest_pictures(spark, folder, frames.select("path", "frame_idx"))
    return near.select(F.element_at(F.split("path", "/"), -1).alias("name"), "frame_idx", "entry", "atlas_idx", "w", "h", F.hex("rgba").alias("rgba"))


def px11_dual_zone(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Planes through the two-zone table."""
    table = F.array(*map(F.lit, px.dual_zone_table(256)))
    toned = _frames(spark, sf_dir).select(*_OWN, F.transform("plane", lambda v: px.tone_lookup(v, table)).alias("plane"))
    return toned.select(*_OWN, F.posexplode("plane").alias("px", "v")).select(*_OWN, "px", F.round("v", 6).alias("v"))


_COVER = f"{SQL_PIXELS}, {_sql_moved(SQL_DX, SQL_DY, 'null')}, cov AS (SELECT capture_id, p, sum(v * (1 + frame_idx % 2)) / sum(1.0::DOUBLE + frame_idx % 2) AS value, sum(1.0::DOUBLE + frame_idx % 2) AS coverage FROM moved WHERE v IS NOT NULL GROUP BY ALL)"
_BOX = """lit AS (SELECT *, max(coverage) OVER (PARTITION BY capture_id) AS peak FROM cov),
box AS (SELECT capture_id, min(p % 8)::INT AS x, min(p // 8)::INT AS y, (max(p % 8) - min(p % 8) + 1)::INT AS w, (max(p // 8) - min(p // 8) + 1)::INT AS h FROM lit WHERE coverage >= 0.8::DOUBLE * peak GROUP BY capture_id)"""
_IN_BOX = "SELECT capture_id, ((p // 8 - y) * w + p % 8 - x)::INT AS px, (p % 8 - x)::INT AS x, (p // 8 - y)::INT AS y, round(value, 6) AS value FROM cov JOIN box USING (capture_id) WHERE p % 8 BETWEEN x AND x + w - 1 AND p // 8 BETWEEN y AND y + h - 1"
_BRIGHT = "b AS (SELECT capture_id, frame_idx, sum(x * v) / sum(v) AS cx, sum(y * v) / sum(v) AS cy FROM px WHERE v > 0.3::DOUBLE * list_max(e)::DOUBLE AND v > 0 GROUP BY ALL)"
_TAP = "e[(least(greatest(floor(sy)::INT + {j}, 0), 7) * 8 + least(greatest(floor(sx)::INT + {i}, 0), 7)) + 1]::DOUBLE"
_TAPS = " + ".join(f"{_TAP.format(i=i, j=j)} * {'(sx - floor(sx))' if i else '(1 - sx + floor(sx))'} * {'(sy - floor(sy))' if j else '(1 - sy + floor(sy))'}" for i in (0, 1) for j in (0, 1))
_TONE = "(CASE WHEN {k} / 255::DOUBLE < 0.5 THEN 0.5::DOUBLE * asinh(40 * {k} / 255::DOUBLE) / asinh(20::DOUBLE) ELSE {k} / 255::DOUBLE END)"

QUERIES = {
    "rg06_point_shifts": (
        rg06_point_shifts,
        f"""WITH f AS (SELECT label, vec_id, embedding AS e, arg_min(embedding, vec_id) OVER (PARTITION BY label) AS r, (vec_id % 3 - 1) * 0.5::DOUBLE AS gx, (vec_id % 2) * 0.25::DOUBLE AS gy FROM embeddings),
c AS (SELECT label, vec_id, e, ay, ax, cand, r[(4 * ay + 2 + j) * 8 + 4 * ax + 2 + i + 1]::DOUBLE AS base, 4 * ax + 2 + i - gx - (cand % 5 - 2) AS sx, 4 * ay + 2 + j - gy - (cand // 5 - 2) AS sy
  FROM f, range(2) a(ay), range(2) b(ax), range(25) k(cand), (VALUES (-2), (0)) u(i), (VALUES (-2), (0)) v(j)),
s AS (SELECT label, vec_id, ay, ax, cand, sum(CASE WHEN sx >= 0.5 AND sx < 7.5 AND sy >= 0.5 AND sy < 7.5 THEN abs(base - ({_TAPS})) ELSE 0 END) AS sad FROM c GROUP BY ALL),
l AS (SELECT label, vec_id, ay, ax, list(sad ORDER BY cand) AS s, avg(sad) AS mean, arg_min(cand, (sad, cand)) AS win FROM s GROUP BY ALL),
w AS (SELECT *, s[win + 1] AS c, s[win] AS x0, s[win + 2] AS x1, s[win - 4] AS y0, s[win + 6] AS y1, 1 - s[win + 1] / mean AS depth, win % 5 BETWEEN 1 AND 3 AND win // 5 BETWEEN 1 AND 3 AS inner_win FROM l),
k AS (SELECT *, coalesce(inner_win AND depth >= 0.1::DOUBLE AND least(x0, x1, y0, y1) - c >= 0.04::DOUBLE * mean, false) AS kept FROM w)
SELECT label AS capture_id, vec_id AS frame_idx, ay::INT AS ay, ax::INT AS ax, CASE WHEN kept THEN round(win % 5 - 2 + least(greatest(0.5::DOUBLE * (x0 - x1) / (x0 - 2 * c + x1), -0.5), 0.5), 6) ELSE 0 END AS dx,
  CASE WHEN kept THEN round(win // 5 - 2 + least(greatest(0.5::DOUBLE * (y0 - y1) / (y0 - 2 * c + y1), -0.5), 0.5), 6) ELSE 0 END AS dy, round(depth, 6) AS depth, kept FROM k""",
    ),
    "pr04_border_box": (
        pr04_border_box,
        """WITH e AS (SELECT event_id, event_id % 50 AS w, event_id % 37 AS h, greatest(event_id % 23 - 3, 0) AS b FROM events), c AS (SELECT *, w > 2 * b AND h > 2 * b AS ok FROM e)
SELECT event_id, CASE WHEN ok THEN b::INT END AS x, CASE WHEN ok THEN b::INT END AS y, CASE WHEN ok THEN (w - 2 * b)::INT END AS w, CASE WHEN ok THEN (h - 2 * b)::INT END AS h FROM c""",
    ),
    "pr04_common_area": (
        pr04_common_area,
        f"WITH {_COVER}, s AS (SELECT label AS capture_id, vec_id AS frame_idx FROM embeddings), d AS (SELECT capture_id, max(ceil(abs({SQL_DX})))::INT AS x, max(ceil(abs({SQL_DY})))::INT AS y FROM s GROUP BY ALL), box AS (SELECT capture_id, x, y, 8 - 2 * x AS w, 8 - 2 * y AS h FROM d) {_IN_BOX}",
    ),
    "ag38_coverage_box": (ag38_coverage_box, f"WITH {_COVER}, {_BOX} SELECT * FROM box"),
    "pr04_coverage_crop": (pr04_coverage_crop, f"WITH {_COVER}, {_BOX} {_IN_BOX}"),
    "ag25_centroids": (
        ag25_centroids,
        f"""WITH {SQL_PIXELS}, {_BRIGHT}, m AS (SELECT *, 0.25::DOUBLE * list_max(e)::DOUBLE AS cut, list_sort(e)[33]::DOUBLE AS bg FROM px),
w AS (SELECT *, greatest(v - cut, 0) AS wx, greatest(v - bg, 0) AS wd FROM m),
o AS (SELECT capture_id, frame_idx, sum(x * wx) / sum(wx) AS ex, sum(y * wx) / sum(wx) AS ey, CASE WHEN sum(wd) > 1e-6 THEN sum(x * wd) / sum(wd) ELSE 4 END AS dx, CASE WHEN sum(wd) > 1e-6 THEN sum(y * wd) / sum(wd) ELSE 4 END AS dy FROM w GROUP BY ALL)
SELECT capture_id, frame_idx, round(cx, 6) AS bright_cx, round(cy, 6) AS bright_cy, round(ex, 6) AS excess_cx, round(ey, 6) AS excess_cy, round(dx, 6) AS disc_cx, round(dy, 6) AS disc_cy FROM o LEFT JOIN b USING (capture_id, frame_idx)""",
    ),
    "ag42_polar_profile": (
        ag42_polar_profile,
        f"""WITH {SQL_PIXELS}, {_BRIGHT}, f AS (SELECT label AS capture_id, vec_id AS frame_idx, embedding AS e FROM embeddings),
s AS (SELECT capture_id, frame_idx, e, r::INT AS r, cx + r * cos(2 * pi() * d / 64) AS sx, cy + r * sin(2 * pi() * d / 64) AS sy FROM f JOIN b USING (capture_id, frame_idx), range(6) a(r), range(64) k(d)),
v AS (SELECT capture_id, frame_idx, r, CASE WHEN floor(sx) >= 0 AND floor(sy) >= 0 AND floor(sx) < 7 AND floor(sy) < 7 THEN {_TAPS} END AS v FROM s)
SELECT capture_id, frame_idx, r, round(coalesce(avg(v), 0), 6) AS v FROM v GROUP BY ALL""",
    ),
    "sc18_atlas": (
        sc18_atlas,
        """WITH f AS (SELECT label, list_transform(embedding, lambda v: floor(least(greatest(v::DOUBLE, 0), 1) * 255)::INT) AS e, (row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1)::INT AS i, count(*) OVER (PARTITION BY label) AS n FROM embeddings),
s AS (SELECT *, ceil(n / least(20, n))::INT AS stride FROM f), k AS (SELECT *, ceil(n / stride)::INT AS entries, greatest(0, least(ceil(n / stride)::INT - 1, floor(i / stride::DOUBLE + 0.5)::INT)) AS entry FROM s),
a AS (SELECT label, (i // stride)::INT AS entry, i AS atlas_idx, CASE WHEN label % 2 = 0
  THEN array_to_string([format('{:02X}{:02X}{:02X}FF', e[(q // 4 * 16 + q % 4 * 2) + 1], (e[(q // 4 * 16 + q % 4 * 2) + 2] + e[(q // 4 * 16 + q % 4 * 2) + 9]) // 2, e[(q // 4 * 16 + q % 4 * 2) + 10]) for q in range(16)], '')
  ELSE array_to_string([format('{:02X}{:02X}{:02X}FF', e[(q // 4 * 16 + q % 4 * 2) + 1], e[(q // 4 * 16 + q % 4 * 2) + 1], e[(q // 4 * 16 + q % 4 * 2) + 1]) for q in range(16)], '') END AS rgba FROM s WHERE i % stride = 0)
SELECT 'capture-' || k.label || '.ser' AS name, k.i AS frame_idx, k.entry, a.atlas_idx, 4 AS w, 4 AS h, a.rgba FROM k JOIN a ON a.label = k.label AND a.entry = k.entry""",
    ),
    "px11_dual_zone": (
        px11_dual_zone,
        f"""WITH {SQL_PIXELS}, t AS (SELECT *, least(greatest(v, 0), 1) * 255 AS at_, floor(least(greatest(v, 0), 1) * 255) AS k FROM px), u AS (SELECT *, {_TONE.format(k='k')} AS a, {_TONE.format(k='least(k + 1, 255)')} AS b FROM t)
SELECT capture_id, frame_idx, p::INT AS px, round(a + (b - a) * (at_ - k), 6) AS v FROM u""",
    ),
}
