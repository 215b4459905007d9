"""Mosaic, tone and header queries over `embeddings` and `events`, with DuckDB SQL."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framequery.functions import pixels as px
from framequery.functions import rules as ru
from framequery.functions import stats
from framequery.plans.frame_queries import _frames
from framequery.plans.pixel_queries import _SQL_RGB, _rgb
from framequery.sources import report, ser

_OWN = ["capture_id", "frame_idx"]
_COLORS = ("mono", "bayerRGGB", "rgb", "bgr")
_PATTERNS = ("bayerRGGB", "bayerGRBG", "bayerGBRG", "bayerBGGR")


def _mosaics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames as mosaics in 0..1: the pattern follows the capture, every third frame is upside down."""
    plane = F.transform("plane", lambda v: px.unit(v * F.lit(0.25) + F.lit(0.5)))
    return _frames(spark, sf_dir).select(*_OWN, plane.alias("plane"), (F.col("capture_id") % 4).cast("int").alias("pattern"), (F.col("frame_idx") % 3 == 0).alias("flip"))


#: Shared SQL: a mosaic's pixels, and one at an offset with the edge repeated.
_SQL_MOSAIC = """m AS (SELECT label AS capture_id, vec_id AS frame_idx, (label % 4) & 1 AS rx, ((label % 4) >> 1) & 1 AS ry,
  list_transform(embedding, lambda v: least(greatest(v::DOUBLE * 0.25 + 0.5, 0), 1)) AS e, vec_id % 3 = 0 AS flip FROM embeddings),
p AS (SELECT *, i % 8 AS x, i // 8 AS y FROM m, range(64) r(i))"""


def _at(dx: int, dy: int) -> str:
    return f"e[least(greatest(y + {dy}, 0), 7) * 8 + least(greatest(x + {dx}, 0), 7) + 1]"


def _images(mosaics: DataFrame, image_of) -> DataFrame:
    """(capture_id, frame_idx, px, r, g, b) of image_of(mosaic, pattern name, flip): one map, no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            capture, frame, planes, pattern, flip = (batch.column(k) for k in range(5))
            for k in range(batch.num_rows):
                plane = planes[k].values.to_numpy()
                side = int(round(len(plane) ** 0.5))
                image = image_of(plane.reshape(side, side), _PATTERNS[pattern[k].as_py()], flip[k].as_py()).reshape(-1, 3)
                n = len(image)
                yield pa.RecordBatch.from_arrays(
                    [pa.repeat(capture[k], n), pa.repeat(frame[k], n), pa.array(np.arange(n), pa.int32()), *(pa.array(image[:, c]) for c in range(3))],
                    names=[*_OWN, "px", "r", "g", "b"],
                )

    kinds = {c: mosaics.schema[c].dataType.simpleString() for c in _OWN}
    rgb = mosaics.select(*_OWN, "plane", "pattern", "flip").mapInArrow(run, ", ".join([*(f"{c} {t}" for c, t in kinds.items()), "px int, r double, g double, b double"]))
    return rgb.select(*_OWN, "px", *(F.round(c, 6).alias(c) for c in "rgb"))


def sc08_demosaic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _images(_mosaics(spark, sf_dir), lambda mosaic, color, flip: ser.demosaic(mosaic, color, flip))


def _half_planes(mosaic: np.ndarray, color: str) -> list[np.ndarray]:
    return [ser.bayer_channel(mosaic, color, c) for c in "RGB"]


def sc09_channel_planes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _images(_mosaics(spark, sf_dir), lambda mosaic, color, _: np.stack(_half_planes(mosaic, color), axis=-1)).withColumnRenamed("px", "cell")


def pr10_combine_channels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _images(_mosaics(spark, sf_dir), lambda mosaic, color, _: ser.combine_channels(*_half_planes(mosaic, color), color))


def px03_channel_normalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _rgb(spark, sf_dir)
    return c.select("event_id", *(F.round(px.channel_normalise(F.col(x), o, s), 6).alias(x) for x, o, s in (("r", 0.25, 1.5), ("g", 0.0, 1.0), ("b", 0.125, 0.75))))


def px08_highlights_shadows(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = px.highlights_shadows(F.col("r"), F.col("g"), F.col("b"), -0.5, 0.4)
    return _rgb(spark, sf_dir).select("event_id", *(F.round(v, 6).alias(x) for x, v in zip("rgb", out, strict=True)))


def px12_linearise(spark: SparkSession, sf_dir: str) -> DataFrame:
    gamma = px.capture_gamma((F.col("event_id") % 260).cast("double"))
    return _rgb(spark, sf_dir).select("event_id", F.round(gamma, 6).alias("gamma"), F.round(px.linearise(F.col("r") - F.lit(0.2), gamma), 6).alias("v"))


def px13_add_detail(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Detail of a plane against its mirror image, shrunk, and added again."""
    f = _frames(spark, sf_dir).withColumn("detail", F.zip_with("plane", F.reverse("plane"), lambda a, b: a - b))
    both = F.zip_with("plane", "detail", lambda a, d: px.add_shrunk(a, d, 0.75, 0.25))
    return f.select(*_OWN, F.posexplode(both).alias("px", "v")).withColumn("v", F.round("v", 6))


def px21_mask_blend(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A plane and its mirror image mixed by a 4 x 4 mask."""
    mask = F.array(*(F.lit(((k * 5) % 16) / 15) for k in range(16)))

    def mixed(a: F.Column, i: F.Column) -> F.Column:
        m = px.mask_at(mask, i % 8, F.floor(i / 8), 4, 8)
        return a + (F.get("plane", 63 - i) - a) * m

    return _frames(spark, sf_dir).select(*_OWN, F.posexplode(F.transform("plane", mixed)).alias("px", "v")).withColumn("v", F.round("v", 6))


def ag31_thumbnail_stretch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """8-bit values of each event type stretched between their 1 and 99.5 percentiles; flat ones stay."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_type", "event_id", (F.floor(F.col("value")) % 256).cast("int").alias("v"))
    counts = e.groupBy("event_type", "v").agg(F.count(F.lit(1)).alias("n"))
    bounds = stats.thumbnail_bounds(counts, ["event_type"], "v")
    s = (F.col("v") - F.col("lo")) * (F.lit(255.0) / (F.col("hi") - F.col("lo")))
    out = F.when(F.col("hi") > F.col("lo") + 1, F.floor(F.greatest(F.lit(0.0), F.least(F.lit(255.0), F.round(s, 9))))).otherwise(F.col("v"))
    # One row an event type.
    return e.join(F.broadcast(bounds), "event_type").select("event_id", out.cast("int").alias("v"))


def sc13_header_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id")
    day = F.date_format(F.date_add(F.lit("2021-03-05"), (F.col("event_id") % 900).cast("int")), "yyyy-MM-dd")
    kinds = [F.concat(day, F.lit("T21:05:09.250")), F.concat(F.lit("  "), day, F.lit("T21:05:09 ")), day, F.concat(day, F.lit("T21:05:09+02:00")), F.lit("soon"), F.lit("")]
    raw = F.when(F.col("event_id") % 7 < 6, F.get(F.array(*kinds), (F.col("event_id") % 7).cast("int")))
    return e.select("event_id", F.unix_millis(ru.header_date(raw)).alias("ms"))


def sk10_capture_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reports of made-up headers, one an event."""
    e, n = spark.read.parquet(f"{sf_dir}/events.parquet"), F.col("event_id")
    frames, each = (n % 900).cast("int"), n % 1000 + 1
    ticks = F.when(n % 4 == 0, F.lit(0)).otherwise(F.lit(637500000000000000) + n * 10000000)
    heads = e.select(
        n, F.concat(F.lit("/captures/"), F.col("event_type"), F.lit("-"), n, F.lit(".ser")).alias("path"), (n % 640 + 1).cast("int").alias("w"), (n % 480 + 1).cast("int").alias("h"),
        F.when(n % 2 == 0, 8).otherwise(16).alias("depth"), F.get(F.array(*(F.lit(c) for c in _COLORS)), (n % 4).cast("int")).alias("color"), frames.alias("frame_count"),
        each.alias("bytes_per_frame"), F.lit("cam").alias("instrument"), F.lit("").alias("observer"), F.lit("80 mm").alias("telescope"), ticks.alias("ticks_utc"),
    )
    return report.ser_report(heads).select("event_id", "report")


def sf08_color_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    return e.select("event_id", ru.color_label(F.col("event_id") % 21 - 1).alias("label"))


def ru04_auto_keep(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    return e.select("event_id", ru.auto_keep_percent((F.col("event_id") % 203) / F.lit(200.0)).alias("percent"))


def ru14_colour_defaults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Captures whose white balance, normalisation and fringe correction are switched on, and whether that is a change."""
    e, n = spark.read.parquet(f"{sf_dir}/events.parquet"), F.col("event_id")
    extension = F.get(F.array(*map(F.lit, ("SER", "avi", "Mov", "tif", "ser"))), (n % 5).cast("int"))
    colour = ru.colour_camera(extension, F.when(n % 11 > 0, n % 18))
    return e.select("event_id", (colour | (n % 2 == 0)).alias("auto_wb"), (colour & ((n % 2 > 0) | (n % 3 > 0))).alias("changed"))


_SQL_HALF = """h AS (SELECT capture_id, frame_idx, rx, ry, c, c % 4 AS cx, c // 4 AS cy,
  e[(2 * (c // 4) + ry) * 8 + 2 * (c % 4) + rx + 1] AS r, e[(2 * (c // 4) + 1 - ry) * 8 + 2 * (c % 4) + 1 - rx + 1] AS b,
  (e[(2 * (c // 4) + ry) * 8 + 2 * (c % 4) + 1 - rx + 1] + e[(2 * (c // 4) + 1 - ry) * 8 + 2 * (c % 4) + rx + 1]) / 2 AS g FROM m, range(16) q(c))"""


def _sampled(plane: str, ox: str, oy: str) -> str:
    """SQL: a half-size plane (list of 16) sampled bilinearly for the full-size pixel (x, y)."""
    fx, fy = f"((x - {ox}) * 0.5::DOUBLE)", f"((y - {oy}) * 0.5::DOUBLE)"
    x0, y0 = f"least(greatest(floor({fx}), 0), 3)::INT", f"least(greatest(floor({fy}), 0), 3)::INT"
    wx, wy = f"least(greatest({fx} - {x0}, 0), 1)", f"least(greatest({fy} - {y0}, 0), 1)"
    x1, y1 = f"least({x0} + 1, 3)", f"least({y0} + 1, 3)"
    return f"round((1 - {wy}) * ({plane}[{y0} * 4 + {x0} + 1] * (1 - {wx}) + {plane}[{y0} * 4 + {x1} + 1] * {wx}) + {wy} * ({plane}[{y1} * 4 + {x0} + 1] * (1 - {wx}) + {plane}[{y1} * 4 + {x1} + 1] * {wx}), 6)"


_NEAR_X, _NEAR_Y = f"({_at(-1, 0)} + {_at(1, 0)})", f"({_at(0, -1)} + {_at(0, 1)})"
_FAR_X, _FAR_Y = f"({_at(-2, 0)} + {_at(2, 0)})", f"({_at(0, -2)} + {_at(0, 2)})"
_CORNERS = f"({_at(-1, -1)} + {_at(1, -1)} + {_at(-1, 1)} + {_at(1, 1)})"
_SQL_SIDES = "least(greatest({}, 0), 1)"
_SQL_MASK = "[" + ", ".join(f"{((k * 5) % 16) / 15!r}::DOUBLE" for k in range(16)) + "]"
_SQL_MASK_AT = _sampled("mk", "0.5", "0.5").removeprefix("round(").removesuffix(", 6)")

QUERIES = {
    "sc08_demosaic": (
        sc08_demosaic,
        f"""WITH {_SQL_MOSAIC}, q AS (SELECT *, {_at(0, 0)} AS c, {_SQL_SIDES.format(f"(4 * {_at(0, 0)} + 2 * ({_NEAR_X} + {_NEAR_Y}) - {_FAR_X} - {_FAR_Y}) / 8")} AS gr,
  {_SQL_SIDES.format(f"(5 * {_at(0, 0)} + 4 * {_NEAR_X} - {_CORNERS} - {_FAR_X} + 0.5 * {_FAR_Y}) / 8")} AS ac, {_SQL_SIDES.format(f"(5 * {_at(0, 0)} + 4 * {_NEAR_Y} - {_CORNERS} - {_FAR_Y} + 0.5 * {_FAR_X}) / 8")} AS al,
  {_SQL_SIDES.format(f"(6 * {_at(0, 0)} + 2 * {_CORNERS} - 1.5 * ({_FAR_X} + {_FAR_Y})) / 8")} AS ot, x % 2 = rx AS ix, y % 2 = ry AS iy FROM p)
SELECT capture_id, frame_idx, (CASE WHEN flip THEN 63 - i ELSE i END)::INT AS px,
  round(CASE WHEN ix AND iy THEN c WHEN NOT ix AND NOT iy THEN ot WHEN iy THEN ac ELSE al END, 6) AS r, round(CASE WHEN ix = iy THEN gr ELSE c END, 6) AS g,
  round(CASE WHEN NOT ix AND NOT iy THEN c WHEN ix AND iy THEN ot WHEN iy THEN al ELSE ac END, 6) AS b FROM q""",
    ),
    "sc09_channel_planes": (sc09_channel_planes, f"WITH {_SQL_MOSAIC}, {_SQL_HALF} SELECT capture_id, frame_idx, c::INT AS cell, round(r, 6) AS r, round(g, 6) AS g, round(b, 6) AS b FROM h"),
    "pr10_combine_channels": (
        pr10_combine_channels,
        f"""WITH {_SQL_MOSAIC}, {_SQL_HALF}, l AS (SELECT capture_id, frame_idx, any_value(rx) AS rx, any_value(ry) AS ry, list(r ORDER BY c) AS lr, list(g ORDER BY c) AS lg, list(b ORDER BY c) AS lb FROM h GROUP BY ALL),
f AS (SELECT *, i % 8 AS x, i // 8 AS y FROM l, range(64) z(i))
SELECT capture_id, frame_idx, i::INT AS px, {_sampled("lr", "rx", "ry")} AS r, {_sampled("lg", "0.5", "0.5")} AS g, {_sampled("lb", "(1 - rx)", "(1 - ry)")} AS b FROM f""",
    ),
    "px03_channel_normalise": (px03_channel_normalise, f"WITH {_SQL_RGB} SELECT event_id, round((r - 0.25) * 1.5, 6) AS r, round(g, 6) AS g, round((b - 0.125) * 0.75, 6) AS b FROM c"),
    "px08_highlights_shadows": (
        px08_highlights_shadows,
        f"""WITH {_SQL_RGB}, y AS (SELECT *, 0.2126::DOUBLE * r + 0.7152::DOUBLE * g + 0.0722::DOUBLE * b AS y FROM c),
t AS (SELECT *, least(greatest((y - 0.5) / 0.5, 0), 1) AS h, least(greatest(y / 0.5, 0), 1) AS s FROM y),
n AS (SELECT *, CASE WHEN y > 1e-4 THEN least(greatest(y - 0.25 * h * h * (3 - 2 * h) + 0.2 * (1 - s * s * (3 - 2 * s)), 0), 1) / y ELSE 1 END AS k FROM t)
SELECT event_id, {", ".join(f"round(least(greatest({x} * k, 0), 1), 6) AS {x}" for x in "rgb")} FROM n""",
    ),
    "px12_linearise": (
        px12_linearise,
        f"WITH {_SQL_RGB}, k AS (SELECT event_id, r - 0.2::DOUBLE AS v, greatest(0.1::DOUBLE, least(4::DOUBLE, (event_id % 260) / 50::DOUBLE)) AS k FROM c) SELECT event_id, round(k, 6) AS gamma, round(CASE WHEN k <> 1 AND v >= 0 THEN power(v, k) ELSE v END, 6) AS v FROM k",
    ),
    "px13_add_detail": (
        px13_add_detail,
        """WITH p AS (SELECT label AS capture_id, vec_id AS frame_idx, i, embedding[i + 1]::DOUBLE AS a, embedding[i + 1]::DOUBLE - embedding[64 - i]::DOUBLE AS d FROM embeddings, range(64) r(i))
SELECT capture_id, frame_idx, i::INT AS px, round(a + sign(d) * greatest(abs(d) - 0.25, 0) * 0.75, 6) AS v FROM p""",
    ),
    "px21_mask_blend": (
        px21_mask_blend,
        f"""WITH p AS (SELECT label AS capture_id, vec_id AS frame_idx, i, i % 8 AS x, i // 8 AS y, {_SQL_MASK} AS mk, embedding[i + 1]::DOUBLE AS a, embedding[64 - i]::DOUBLE AS b FROM embeddings, range(64) r(i))
SELECT capture_id, frame_idx, i::INT AS px, round(a + (b - a) * ({_SQL_MASK_AT}), 6) AS v FROM p""",
    ),
    "ag31_thumbnail_stretch": (
        ag31_thumbnail_stretch,
        """WITH e AS (SELECT event_type, event_id, (floor(value)::BIGINT % 256)::INT AS v FROM events), n AS (SELECT event_type, v, count(*) AS n FROM e GROUP BY ALL),
c AS (SELECT event_type, v, sum(n) OVER (PARTITION BY event_type ORDER BY v) AS c, sum(n) OVER (PARTITION BY event_type) AS t FROM n),
b AS (SELECT event_type, min(v) FILTER (c >= t // 100) AS lo, min(v) FILTER (c >= t - t // 200) AS hi FROM c GROUP BY ALL)
SELECT event_id, (CASE WHEN hi > lo + 1 THEN floor(greatest(0, least(255, round((v - lo) * (255::DOUBLE / (hi - lo)), 9)))) ELSE v END)::INT AS v FROM e JOIN b USING (event_type)""",
    ),
    "sk10_capture_reports": (
        sk10_capture_reports,
        """WITH c AS (SELECT *, ['mono', 'bayerRGGB', 'rgb', 'bgr'][event_id % 4 + 1] AS color FROM events)
SELECT event_id, json_object('bytesPerFrame', event_id % 1000 + 1, 'captureDateUTC', CASE WHEN event_id % 4 > 0 THEN strftime(make_timestamp(1614403200000000 + event_id * 1000000), '%Y-%m-%dT%H:%M:%SZ') END,
  'colorID', color, 'colorIsBayer', color = 'bayerRGGB', 'colorIsMono', color = 'mono', 'colorIsRGB', color IN ('rgb', 'bgr'), 'filename', event_type || '-' || event_id || '.ser', 'frameCount', event_id % 900,
  'imageHeight', event_id % 480 + 1, 'imageWidth', event_id % 640 + 1, 'instrument', 'cam', 'observer', '', 'pixelDepth', CASE WHEN event_id % 2 = 0 THEN 8 ELSE 16 END, 'telescope', '80 mm',
  'totalBytes', (event_id % 900) * (event_id % 1000 + 1))::VARCHAR AS report FROM c""",
    ),
    "sc13_header_dates": (
        sc13_header_dates,
        """WITH d AS (SELECT event_id, (DATE '2021-03-05' + (event_id % 900)::INT)::TIMESTAMP AS d FROM events)
SELECT event_id, CASE event_id % 7 WHEN 0 THEN epoch_ms(d) + 75909250 WHEN 1 THEN epoch_ms(d) + 75909000 WHEN 2 THEN epoch_ms(d) WHEN 3 THEN epoch_ms(d) + 68709000 END AS ms FROM d""",
    ),
    "sf08_color_labels": (
        sf08_color_labels,
        "SELECT event_id, CASE event_id % 21 - 1 " + " ".join(f"WHEN {k} THEN '{v}'" for k, v in ru.COLOR_LABELS.items()) + " END AS label FROM events",
    ),
    "ru04_auto_keep": (ru04_auto_keep, "SELECT event_id, greatest(1, least(99, floor((event_id % 203) / 200::DOUBLE * 100 + 0.5)))::INT AS percent FROM events"),
    "ru14_colour_defaults": (
        ru14_colour_defaults,
        """WITH e AS (SELECT event_id, CASE WHEN event_id % 5 IN (1, 2) THEN true WHEN event_id % 5 = 3 THEN false ELSE event_id % 11 > 0 AND event_id % 18 IN (8, 9, 10, 11, 16, 17) END AS c FROM events)
SELECT event_id, c OR event_id % 2 = 0 AS auto_wb, c AND (event_id % 2 > 0 OR event_id % 3 > 0) AS changed FROM e""",
    ),
}
