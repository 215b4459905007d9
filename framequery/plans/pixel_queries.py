"""Tone and colour queries over `embeddings` and `lineitem`, and spectral ones (rows only), with DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framequery.functions import pixels as px
from framequery.operators import reduce as rd
from framequery.operators import spectral as sp
from framequery.operators.point_spread import point_spread
from framequery.plans import spectral_sql as sql
from framequery.plans.frame_queries import _frames

_OWN = ["capture_id", "frame_idx"]
_CURVE = px.catmull_rom_table([(0.0, 0.0), (0.25, 0.2), (0.75, 0.85), (1.0, 1.0)], 33)
_LIST = "[" + ", ".join(f"{v!r}::DOUBLE" for v in _CURVE) + "]"


def _rgb(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as colours: three channels in 0 .. 1.2."""
    e, n = spark.read.parquet(f"{sf_dir}/events.parquet"), F.col("event_id")
    return e.select(n, ((n % 17) / F.lit(15.7)).alias("r"), ((n % 13) / F.lit(11.3)).alias("g"), ((n % 11) / F.lit(8.9)).alias("b"))


_SQL_RGB = "c AS (SELECT event_id, (event_id % 17) / 15.7::DOUBLE AS r, (event_id % 13) / 11.3::DOUBLE AS g, (event_id % 11) / 8.9::DOUBLE AS b FROM events)"


def pr01_luma(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = [F.col(x) for x in "rgb"]
    return _rgb(spark, sf_dir).select("event_id", F.round(px.luma709(*c), 6).alias("luma709"), F.round(px.luma601(*c), 6).alias("luma601"))


def px02_white_balance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rgb(spark, sf_dir).select("event_id", F.round(px.white_balance(F.col("r"), 0.125, 1.5), 6).alias("r"), F.round(px.white_balance(F.col("b"), 0.0625, 0.75), 6).alias("b"))


def px04_purple(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rgb(spark, sf_dir).select("event_id", F.round(px.purple_factor(F.col("r"), F.col("g"), F.col("b"), 0.8), 5).alias("factor"))


def px05_highlights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rgb(spark, sf_dir).select("event_id", F.round(px.highlight_knee(F.col("b"), 0.8), 6).alias("b"))


def px06_tone_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = F.col("r")
    return _rgb(spark, sf_dir).select(
        "event_id", F.round(px.auto_stretch(r, F.lit(0.1), F.lit(0.9), 2.0), 6).alias("stretched"), F.round(px.brightness_contrast(r, 0.05, 1.25), 6).alias("contrast"),
        F.round(px.smoothstep(0.2, 0.7, r), 6).alias("smooth"), F.round(px.saturate(r, px.luma709(r, F.col("g"), F.col("b")), 1.5), 6).alias("saturated"),
        F.round(px.gamma(r, 1 / 2.2), 6).alias("encoded"), F.round(px.soft_threshold(r - F.lit(0.5), 0.1), 6).alias("soft"),
    )


def px10_tone_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = F.array(*map(F.lit, _CURVE))
    return _rgb(spark, sf_dir).select("event_id", F.round(px.tone_lookup(F.col("g"), table), 6).alias("g"))


def pr06_rotate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rd.exploded(_frames(spark, sf_dir).withColumn("plane", F.reverse("plane"))).select(*_OWN, "px", F.round("v", 6).alias("v"))


def ag28_fft_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sp.fft_bands(_frames(spark, sf_dir), 8).select(*_OWN, F.round("mid", 6).alias("mid"), F.round("high", 6).alias("high"))


def _referred(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each frame beside the first plane of its capture."""
    f = _frames(spark, sf_dir)
    first = f.groupBy(F.col("capture_id").alias("_capture")).agg(F.min_by("plane", "frame_idx").alias("reference"))
    return f.join(first, F.col("capture_id").eqNullSafe(F.col("_capture"))).select(*_OWN, "plane", "reference")


def _shift_columns(shifts: DataFrame) -> DataFrame:
    return shifts.select(*_OWN, F.round("dx", 6).alias("dx"), F.round("dy", 6).alias("dy"))


def rg01_phase_correlation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shift_columns(sp.phase_correlation(_referred(spark, sf_dir), "reference", 8))


def rg02_phase_correlation_hann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shift_columns(sp.phase_correlation(_referred(spark, sf_dir), "reference", 8, window=True))


def rg02_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both passes at the size of 8x8 frames."""
    return _shift_columns(sp.cascade_correlation(_referred(spark, sf_dir), "reference", 8, coarse=4, radius=1, least=8))


def rg08_point_spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Made-up 96x96 scenes, one a frame: a disc, a slanted edge or nothing, each as soft as the frame's index says."""
    f = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.col("label").alias("capture_id"), F.col("vec_id").alias("frame_idx"))
    soft = F.lit(0.5) + (F.col("frame_idx") % 5) * F.lit(0.25)

    def scene(p):
        x, y = (p % 96) - F.lit(48.0), F.floor(p / 96) - F.lit(48.0)
        depth = F.when(F.col("frame_idx") % 3 == 0, F.lit(30.0) - F.sqrt(x * x + y * y)).when(F.col("frame_idx") % 3 == 1, x * F.lit(0.96) + y * F.lit(0.28))
        return F.coalesce(F.lit(0.8) / (F.lit(1.0) + F.exp(-depth / soft)), F.lit(0.0))

    made = f.withColumn("plane", F.transform(F.sequence(F.lit(0), F.lit(96 * 96 - 1)), scene))
    got = point_spread(made, 96)
    return got.select(*_OWN, "spread_of", *(F.round(c, 4).alias(c) for c in ("sigma", "confidence", "x", "y")))


def _mapped(f):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return rd.exploded(sp.map_planes(_frames(spark, sf_dir), f, 8)).select(*_OWN, "px", F.round("v", 6).alias("v"))

    return run


QUERIES = {
    "pr01_luma": (pr01_luma, f"WITH {_SQL_RGB} SELECT event_id, round(0.2126::DOUBLE * r + 0.7152::DOUBLE * g + 0.0722::DOUBLE * b, 6) AS luma709, round(0.299::DOUBLE * r + 0.587::DOUBLE * g + 0.114::DOUBLE * b, 6) AS luma601 FROM c"),
    "pr06_rotate": (pr06_rotate, "SELECT label AS capture_id, vec_id AS frame_idx, p::INT AS px, round(embedding[64 - p]::DOUBLE, 6) AS v FROM embeddings, range(64) r(p)"),
    "px02_white_balance": (px02_white_balance, f"WITH {_SQL_RGB} SELECT event_id, round(greatest((r - 0.125) * 1.5, 0), 6) AS r, round(greatest((b - 0.0625) * 0.75, 0), 6) AS b FROM c"),
    "px04_purple": (
        px04_purple,
        f"""WITH {_SQL_RGB}, m AS (SELECT *, greatest(r, g, b) AS t, greatest(r, g, b) - least(r, g, b) AS d FROM c),
h AS (SELECT *, CASE WHEN d = 0 THEN NULL WHEN t = r THEN (g - b) / d WHEN t = g THEN (b - r) / d + 2 ELSE (r - g) / d + 4 END * 60 AS a FROM m),
n AS (SELECT *, least(abs((CASE WHEN a < 0 THEN a + 360 ELSE a END) - 290), 360 - abs((CASE WHEN a < 0 THEN a + 360 ELSE a END) - 290)) AS near FROM h)
SELECT event_id, round(CASE WHEN t > 0 AND d / t >= 0.05 AND near < 30 THEN 1 - 0.8::DOUBLE * power(cos(near / 30 * pi() / 2), 2) ELSE 1 END, 5) AS factor FROM n""",
    ),
    "px05_highlights": (px05_highlights, f"WITH {_SQL_RGB} SELECT event_id, round(CASE WHEN b <= 0.8 THEN b ELSE 0.8::DOUBLE + 0.2::DOUBLE * tanh((b - 0.8::DOUBLE) / 0.2::DOUBLE) END, 6) AS b FROM c"),
    "px06_tone_chain": (
        px06_tone_chain,
        f"""WITH {_SQL_RGB}, s AS (SELECT *, least(greatest((r - 0.2::DOUBLE) / 0.5::DOUBLE, 0), 1) AS t, 0.2126::DOUBLE * r + 0.7152::DOUBLE * g + 0.0722::DOUBLE * b AS l FROM c)
SELECT event_id, round(power(least(greatest((r - 0.1::DOUBLE) / 0.8::DOUBLE, 0), 1), 0.5::DOUBLE), 6) AS stretched, round(greatest((r - 0.5::DOUBLE) * 1.25::DOUBLE + 0.55::DOUBLE, 0), 6) AS contrast, round(t * t * (3 - 2 * t), 6) AS smooth,
  round(greatest(l + (r - l) * 1.5::DOUBLE, 0), 6) AS saturated, round(power(r, 1 / 2.2::DOUBLE), 6) AS encoded, round(sign(r - 0.5::DOUBLE) * greatest(abs(r - 0.5::DOUBLE) - 0.1::DOUBLE, 0), 6) AS soft FROM s""",
    ),
    "px10_tone_lookup": (
        px10_tone_lookup,
        f"WITH {_SQL_RGB}, t AS (SELECT event_id, least(greatest(g, 0), 1) * 32 AS k, {_LIST} AS l FROM c) SELECT event_id, round(l[floor(k)::INT + 1] + (l[least(floor(k)::INT + 1, 32) + 1] - l[floor(k)::INT + 1]) * (k - floor(k)), 6) AS g FROM t",
    ),
    "ag28_fft_bands": (ag28_fft_bands, sql.fft_bands()),
    "rg01_phase_correlation": (rg01_phase_correlation, None),
    "rg02_phase_correlation_hann": (rg02_phase_correlation_hann, None),
    "rg02_cascade": (rg02_cascade, None),
    "rg08_point_spread": (rg08_point_spread, None),
    "px14_unsharp": (_mapped(lambda p: sp.unsharp(p + 0.5, 1.0, 0.5, (0.25, 0.75))), sql.unsharp(1.0, 0.5, 0.25, 0.75, 0.5)),
    "px15_guided_filter": (_mapped(lambda p: sp.guided_filter(p, 1)), sql.guided(8e-4)),
    "px22_denoise": (_mapped(lambda p: sp.denoise(p, 60)), sql.wavelet([1.0] * 6, 1.0, 0.015)),
    "px16_wavelet": (_mapped(lambda p: sp.wavelet_sharpen(p, [1.5, 1.2, 1.0], 0.8, 0.01)), sql.wavelet([1.5, 1.2, 1.0], 0.8, 0.01)),
    "px17_richardson_lucy": (_mapped(lambda p: sp.richardson_lucy(p + 0.5, 0.8, 5)), sql.richardson_lucy(0.8, 5, 0.5)),
    "px18_wiener": (_mapped(lambda p: sp.wiener(p + 0.5, 0.8, 50.0)), sql.wiener(0.8, 50.0, 0.5)),
    "px19_bilateral": (_mapped(lambda p: sp.bilateral(p, 1, 1.0, 0.2)), sql.bilateral(1.0, 0.2)),
}
