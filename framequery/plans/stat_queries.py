"""Summary, percentile and registration queries over `embeddings` and `events`, with DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framequery.functions import stats
from framequery.operators import frames as fr
from framequery.operators import reduce as rd
from framequery.plans.frame_queries import SQL_PIXELS, SQL_SCORES, _frames

_OWN = ["capture_id", "frame_idx"]


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet")


def _long(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rd.exploded(_frames(spark, sf_dir))


#: Events read as shifts: quarter pixels, with one event in 25 thrown far off.
def _shifts(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _events(spark, sf_dir)
    far = F.when(F.col("event_id") % 25 == 7, F.lit(40.0)).otherwise(F.lit(0.0))
    return e.select("user_id", "event_id", ((F.col("event_id") % 9) * F.lit(0.25) + far).alias("dx"), ((F.col("event_id") % 7) * F.lit(0.25) - far).alias("dy"))


_SQL_SHIFTS = """sh AS (SELECT user_id, event_id, (event_id % 9) * 0.25::DOUBLE + CASE WHEN event_id % 25 = 7 THEN 40 ELSE 0 END AS dx,
  (event_id % 7) * 0.25::DOUBLE - CASE WHEN event_id % 25 = 7 THEN 40 ELSE 0 END AS dy FROM events)"""
_SQL_RANKED = "rk AS (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY value) - 1 AS r, count(*) OVER (PARTITION BY user_id) AS n FROM events)"


def _sql_p(p: float) -> str:
    return f"max(CASE WHEN r = floor((n - 1) * {p}::DOUBLE + 0.5) THEN value END)"


def ag18_nearest_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.nearest_ranks(_events(spark, sf_dir), ["user_id"], "value", {"p10": 0.1, "p50": 0.5, "p90": 0.9})


def ag19_luma_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = stats.nearest_ranks(_long(spark, sf_dir), ["capture_id"], "v", {"lo": 0.01, "mid": 0.5, "hi": 0.99})
    good = F.col("hi") > F.col("lo") + F.lit(1e-4)
    return p.select("capture_id", *(F.round(F.when(good, F.col(c)), 6).alias(c) for c in ("lo", "mid", "hi")))


def ag20_upper_median(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = _frames(spark, sf_dir)
    return f.select(*_OWN, F.round(stats.upper_median(F.array_sort("plane")), 6).alias("median"))


def ag22_mad(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = stats.median_and_mad(_events(spark, sf_dir), ["user_id"], "value")
    return m.select("user_id", F.round("median", 6).alias("median"), F.round("mad", 6).alias("mad"))


def ag23_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = fr.sharpness(_frames(spark, sf_dir)).select("capture_id", "score")
    ends = s.groupBy("capture_id").agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("least"), F.max("score").alias("most"))
    out = ends.join(stats.nearest_ranks(s, ["capture_id"], "score", {"p10": 0.1, "p50": 0.5, "p90": 0.9}), "capture_id")
    return out.select("capture_id", "n", *(F.round(c, 6).alias(c) for c in ("least", "p10", "p50", "p90", "most")))


def ag25_centroid(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = stats.centroid(_long(spark, sf_dir), _OWN, F.col("v"))
    return c.select(*_OWN, F.round("cx", 6).alias("cx"), F.round("cy", 6).alias("cy"))


def rg05_centroid_shift(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = stats.centroid(_long(spark, sf_dir), _OWN, F.col("v"))
    first = c.groupBy("capture_id").agg(F.min_by(F.struct("cx", "cy"), F.col("frame_idx")).alias("ref"))
    return c.join(first, "capture_id").select(*_OWN, F.round(F.col("ref.cx") - F.col("cx"), 6).alias("dx"), F.round(F.col("ref.cy") - F.col("cy"), 6).alias("dy"))


def ag24_jitter(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _shifts(spark, sf_dir)
    return s.groupBy("user_id").agg(F.round(F.sqrt(F.avg(F.col("dx") * F.col("dx") + F.col("dy") * F.col("dy"))), 6).alias("jitter"))


def ag26_half_flux_radius(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.half_flux_radius(_long(spark, sf_dir), _OWN).select(*_OWN, F.round("hfr", 5).alias("hfr"))


def ag27_concentration(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.concentration(_long(spark, sf_dir), _OWN).select(*_OWN, F.round("concentration", 6).alias("concentration"))


def ag29_histogram256(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.histogram(_events(spark, sf_dir), ["event_type"], F.col("value") / F.lit(512.0))


def ag30_stretch_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = stats.stretch_bounds(stats.histogram(_events(spark, sf_dir), ["event_type"], F.col("value") / F.lit(512.0)), ["event_type"])
    return b.select("event_type", F.round("lo", 6).alias("lo"), F.round("hi", 6).alias("hi"))


def ag32_frame_probe(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _long(spark, sf_dir).groupBy(*_OWN).agg(F.min("v").alias("least"), F.max("v").alias("most"), F.avg("v").alias("mean"))
    return p.select(*_OWN, *(F.round(c, 6).alias(c) for c in ("least", "most", "mean")))


def ag33_rmse(spark: SparkSession, sf_dir: str) -> DataFrame:
    long = _long(spark, sf_dir)
    eight = F.floor(F.least(F.greatest(F.col("v") + F.lit(0.5), F.lit(0.0)), F.lit(1.0)) * F.lit(255.0) + F.lit(0.5))
    lit = long.withColumn("b", eight)
    first = lit.groupBy("capture_id").agg(F.min("frame_idx").alias("ref"))
    ref = lit.join(first, "capture_id").where("frame_idx = ref").select("capture_id", "px", F.col("b").alias("a"))
    d = (F.col("a") - F.col("b")) / F.lit(255.0)
    return lit.join(ref, ["capture_id", "px"]).groupBy(*_OWN).agg(F.round(F.sqrt(F.avg(d * d)), 6).alias("rmse"))


def ag34_pilot_shift_spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Deviation of the first 30 shifts per user; multi-AP is given up where an axis exceeds 5 px."""
    from pyspark.sql import Window

    ranked = _shifts(spark, sf_dir).withColumn("r", F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")))
    s = ranked.where("r <= 30").groupBy("user_id").agg(F.stddev_pop("dx").alias("sx"), F.stddev_pop("dy").alias("sy"))
    return s.select("user_id", F.round("sx", 6).alias("sx"), F.round("sy", 6).alias("sy"), (F.greatest("sx", "sy") > 5.0).alias("suppress"))


def ag38_bounding_box(spark: SparkSession, sf_dir: str) -> DataFrame:
    long = _long(spark, sf_dir)
    peak = long.groupBy(*_OWN).agg(F.max("v").alias("peak"))
    lit = long.join(peak, _OWN).where((F.col("peak") > 0) & (F.col("v") >= F.lit(0.5) * F.col("peak")))
    box = lit.groupBy(*_OWN).agg(F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1"))
    return box.select(*_OWN, F.greatest(F.lit(0), F.col("x0") - 1).alias("x0"), F.least(F.lit(7), F.col("x1") + 1).alias("x1"), F.greatest(F.lit(0), F.col("y0") - 1).alias("y0"), F.least(F.lit(7), F.col("y1") + 1).alias("y1"))


def ag36_gray_world(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Captures as channels: offset the 5th percentile, scale the first channel's mean above it over the own mean."""
    long = _long(spark, sf_dir)
    off = stats.nearest_ranks(long, ["capture_id"], "v", {"off": 0.05})
    means = long.join(off, "capture_id").groupBy("capture_id", "off").agg(F.avg(F.greatest(F.col("v") - F.col("off"), F.lit(0.0))).alias("mean"))
    ref = means.where("capture_id = 0").select(F.col("mean").alias("ref"))  # one row
    return means.crossJoin(F.broadcast(ref)).select("capture_id", F.round("off", 6).alias("off"), F.round(F.col("ref") / F.col("mean"), 6).alias("scale"))


def ag37_channel_normalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = stats.nearest_ranks(_long(spark, sf_dir), ["capture_id"], "v", {"lo": 0.01, "hi": 0.99})
    ref = p.where("capture_id = 0").select(F.col("lo").alias("rlo"), F.col("hi").alias("rhi"))  # one row
    scale = F.when(F.col("hi") > F.col("lo") + F.lit(1e-6), F.try_divide(F.col("rhi") - F.col("rlo"), F.col("hi") - F.col("lo"))).otherwise(F.lit(1.0))
    return p.crossJoin(F.broadcast(ref)).withColumn("scale", scale).select("capture_id", F.round("scale", 6).alias("scale"), F.round(F.col("rlo") - F.col("lo") * F.col("scale"), 6).alias("off"))


def ru03_keep_recommendation(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = stats.keep_recommendation(_events(spark, sf_dir), ["user_id"], "value")
    return k.select("user_id", "n", F.round("fraction", 6).alias("fraction"), F.col("n_keep").cast("long").alias("n_keep"))


def fi05_shift_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.shift_outliers(_shifts(spark, sf_dir), ["user_id"])


def wn06_drift_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = stats.drift_fold(_shifts(spark, sf_dir), "user_id", "event_id", F.col("event_id") % 50 == 3)
    return f.select("user_id", "event_id", F.round("dx", 4).alias("dx"), F.round("dy", 4).alias("dy"))


_SQL_CENTROID = "c AS (SELECT capture_id, frame_idx, sum(x * greatest(v, 0)) / sum(greatest(v, 0)) AS cx, sum(y * greatest(v, 0)) / sum(greatest(v, 0)) AS cy FROM px GROUP BY ALL)"
_SQL_PXRANK = "pr AS (SELECT capture_id, v AS value, row_number() OVER (PARTITION BY capture_id ORDER BY v) - 1 AS r, count(*) OVER (PARTITION BY capture_id) AS n FROM px)"
_SQL_HIST = "h AS (SELECT event_type, least(255, floor(least(greatest(value / 512, 0), 1) * 255))::INT AS bin, count(*) AS n FROM events GROUP BY ALL)"

QUERIES = {
    "ag18_nearest_rank": (ag18_nearest_rank, f"WITH {_SQL_RANKED} SELECT user_id, {_sql_p(0.1)} AS p10, {_sql_p(0.5)} AS p50, {_sql_p(0.9)} AS p90 FROM rk GROUP BY user_id"),
    "ag19_luma_percentiles": (
        ag19_luma_percentiles,
        f"WITH {SQL_PIXELS}, {_SQL_PXRANK}, q AS (SELECT capture_id, {_sql_p(0.01)} AS lo, {_sql_p(0.5)} AS mid, {_sql_p(0.99)} AS hi FROM pr GROUP BY ALL) SELECT capture_id, round(CASE WHEN hi > lo + 1e-4 THEN lo END, 6) AS lo, round(CASE WHEN hi > lo + 1e-4 THEN mid END, 6) AS mid, round(CASE WHEN hi > lo + 1e-4 THEN hi END, 6) AS hi FROM q",
    ),
    "ag20_upper_median": (ag20_upper_median, "SELECT label AS capture_id, vec_id AS frame_idx, round(list_sort(embedding)[len(embedding) // 2 + 1]::DOUBLE, 6) AS median FROM embeddings"),
    "ag22_mad": (
        ag22_mad,
        "WITH m AS (SELECT user_id, median(value) AS median FROM events GROUP BY ALL) SELECT user_id, round(any_value(median), 6) AS median, round(median(abs(value - median)) * 1.4826, 6) AS mad FROM events JOIN m USING (user_id) GROUP BY user_id",
    ),
    "ag23_distribution": (
        ag23_distribution,
        f"WITH {SQL_SCORES}, rk AS (SELECT capture_id, score AS value, row_number() OVER (PARTITION BY capture_id ORDER BY score) - 1 AS r, count(*) OVER (PARTITION BY capture_id) AS n FROM scores) SELECT capture_id, count(*) AS n, round(min(value), 6) AS least, round({_sql_p(0.1)}, 6) AS p10, round({_sql_p(0.5)}, 6) AS p50, round({_sql_p(0.9)}, 6) AS p90, round(max(value), 6) AS most FROM rk GROUP BY ALL",
    ),
    "ag25_centroid": (ag25_centroid, f"WITH {SQL_PIXELS}, {_SQL_CENTROID} SELECT capture_id, frame_idx, round(cx, 6) AS cx, round(cy, 6) AS cy FROM c"),
    "rg05_centroid_shift": (
        rg05_centroid_shift,
        f"WITH {SQL_PIXELS}, {_SQL_CENTROID} SELECT capture_id, frame_idx, round(first_value(cx) OVER w - cx, 6) AS dx, round(first_value(cy) OVER w - cy, 6) AS dy FROM c WINDOW w AS (PARTITION BY capture_id ORDER BY frame_idx)",
    ),
    "ag24_jitter": (ag24_jitter, f"WITH {_SQL_SHIFTS} SELECT user_id, round(sqrt(avg(dx * dx + dy * dy)), 6) AS jitter FROM sh GROUP BY ALL"),
    "ag26_half_flux_radius": (
        ag26_half_flux_radius,
        f"""WITH {SQL_PIXELS}, {_SQL_CENTROID}, b AS (SELECT capture_id, frame_idx, floor(sqrt((x - cx) * (x - cx) + (y - cy) * (y - cy)) / 0.5)::INT AS bin, sum(v) AS flux FROM px JOIN c USING (capture_id, frame_idx) WHERE v > 0 GROUP BY ALL),
r AS (SELECT *, sum(flux) OVER (PARTITION BY capture_id, frame_idx ORDER BY bin) AS cum, sum(flux) OVER (PARTITION BY capture_id, frame_idx) / 2 AS half FROM b)
SELECT capture_id, frame_idx, round(min_by((bin + (half - (cum - flux)) / flux) * 0.5::DOUBLE, bin), 5) AS hfr FROM r WHERE cum >= half GROUP BY ALL""",
    ),
    "ag27_concentration": (ag27_concentration, f"WITH {SQL_PIXELS} SELECT capture_id, frame_idx, round(CASE WHEN max(v) > 0 THEN least(1, max(v) / sum(greatest(v, 0))) ELSE 0 END, 6) AS concentration FROM px GROUP BY ALL"),
    "ag29_histogram256": (ag29_histogram256, f"WITH {_SQL_HIST} SELECT * FROM h"),
    "ag30_stretch_bounds": (
        ag30_stretch_bounds,
        f"WITH {_SQL_HIST}, r AS (SELECT *, sum(n) OVER (PARTITION BY event_type ORDER BY bin) AS c, sum(n) OVER (PARTITION BY event_type) AS t FROM h) SELECT event_type, round(min(CASE WHEN c >= t * 0.005::DOUBLE THEN bin END) / 255::DOUBLE, 6) AS lo, round(min(CASE WHEN c >= t * 0.995::DOUBLE THEN bin END) / 255::DOUBLE, 6) AS hi FROM r GROUP BY ALL",
    ),
    "ag32_frame_probe": (ag32_frame_probe, f"WITH {SQL_PIXELS} SELECT capture_id, frame_idx, round(min(v), 6) AS least, round(max(v), 6) AS most, round(avg(v), 6) AS mean FROM px GROUP BY ALL"),
    "ag33_rmse": (
        ag33_rmse,
        f"""WITH {SQL_PIXELS}, b AS (SELECT capture_id, frame_idx, p, floor(least(greatest(v + 0.5::DOUBLE, 0), 1) * 255 + 0.5::DOUBLE) AS b FROM px), f AS (SELECT capture_id, min(frame_idx) AS frame_idx FROM b GROUP BY ALL),
r AS (SELECT capture_id, p, b AS a FROM b JOIN f USING (capture_id, frame_idx)) SELECT capture_id, frame_idx, round(sqrt(avg(power((a - b) / 255, 2))), 6) AS rmse FROM b JOIN r USING (capture_id, p) GROUP BY ALL""",
    ),
    "ag34_pilot_shift_spread": (
        ag34_pilot_shift_spread,
        f"WITH {_SQL_SHIFTS}, r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS r FROM sh) SELECT user_id, round(stddev_pop(dx), 6) AS sx, round(stddev_pop(dy), 6) AS sy, greatest(stddev_pop(dx), stddev_pop(dy)) > 5 AS suppress FROM r WHERE r <= 30 GROUP BY ALL",
    ),
    "ag36_gray_world": (
        ag36_gray_world,
        f"WITH {SQL_PIXELS}, {_SQL_PXRANK}, o AS (SELECT capture_id, {_sql_p(0.05)} AS off FROM pr GROUP BY ALL), m AS (SELECT capture_id, off, avg(greatest(v - off, 0)) AS mean FROM px JOIN o USING (capture_id) GROUP BY ALL) SELECT capture_id, round(off, 6) AS off, round((SELECT mean FROM m WHERE capture_id = 0) / mean, 6) AS scale FROM m",
    ),
    "ag37_channel_normalise": (
        ag37_channel_normalise,
        f"WITH {SQL_PIXELS}, {_SQL_PXRANK}, q AS (SELECT capture_id, {_sql_p(0.01)} AS lo, {_sql_p(0.99)} AS hi FROM pr GROUP BY ALL), z AS (SELECT q.*, r.lo AS rlo, CASE WHEN q.hi > q.lo + 1e-6 THEN (r.hi - r.lo) / (q.hi - q.lo) ELSE 1 END AS scale FROM q, (SELECT * FROM q WHERE capture_id = 0) r) SELECT capture_id, round(scale, 6) AS scale, round(rlo - lo * scale, 6) AS off FROM z",
    ),
    "ag38_bounding_box": (
        ag38_bounding_box,
        f"WITH {SQL_PIXELS}, k AS (SELECT *, max(v) OVER (PARTITION BY capture_id, frame_idx) AS peak FROM px) SELECT capture_id, frame_idx, greatest(0, min(x) - 1)::INT AS x0, least(7, max(x) + 1)::INT AS x1, greatest(0, min(y) - 1)::INT AS y0, least(7, max(y) + 1)::INT AS y1 FROM k WHERE peak > 0 AND v >= 0.5::DOUBLE * peak GROUP BY ALL",
    ),
    "ru03_keep_recommendation": (
        ru03_keep_recommendation,
        f"""WITH {_SQL_RANKED}, q AS (SELECT user_id, {_sql_p(0.9)} AS p90 FROM rk GROUP BY ALL), c AS (SELECT user_id, count(*) AS n, least(greatest(count(*) FILTER (value >= 0.5::DOUBLE * p90) / count(*)::DOUBLE, 0.20::DOUBLE), 0.75::DOUBLE) AS f FROM events JOIN q USING (user_id) GROUP BY ALL),
k AS (SELECT user_id, n, least(greatest(ceil(n * f - 1e-9::DOUBLE), greatest(50, least(n, 100))), n)::BIGINT AS n_keep FROM c) SELECT user_id, n, round(n_keep / n::DOUBLE, 6) AS fraction, n_keep FROM k""",
    ),
    "fi05_shift_outliers": (
        fi05_shift_outliers,
        f"""WITH {_SQL_SHIFTS}, m AS (SELECT user_id, median(dx) AS mx, median(dy) AS my FROM sh GROUP BY ALL), s AS (SELECT user_id, any_value(mx) AS mx, any_value(my) AS my, median(abs(dx - mx)) * 1.4826 AS sx, median(abs(dy - my)) * 1.4826 AS sy FROM sh JOIN m USING (user_id) GROUP BY user_id),
f AS (SELECT sh.*, abs(dx - mx) > greatest(4 * sx, 1.5) OR abs(dy - my) > greatest(4 * sy, 1.5) AS far FROM sh JOIN s USING (user_id))
SELECT user_id, event_id, dx, dy, far AND count(*) OVER w >= 20 AND sum(far::INT) OVER w <= count(*) OVER w * 0.15 AS dropped FROM f WINDOW w AS (PARTITION BY user_id)""",
    ),
    "wn06_drift_fold": (
        wn06_drift_fold,
        f"""WITH RECURSIVE {_SQL_SHIFTS}, o AS (SELECT user_id, event_id, dx, dy, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS r FROM sh),
f(user_id, r, h) AS (
  SELECT user_id, 1::BIGINT, [{{'i': event_id, 'dx': CASE WHEN event_id % 50 = 3 THEN 0 ELSE dx END, 'dy': CASE WHEN event_id % 50 = 3 THEN 0 ELSE dy END}}] FROM o WHERE r = 1
  UNION ALL
  SELECT user_id, r, list_append(list_slice(h, greatest(1, len(h) - 3), len(h)), CASE WHEN event_id % 50 = 3 THEN {{'i': event_id, 'dx': 0::DOUBLE, 'dy': 0::DOUBLE}} WHEN sqrt(power(dx - px, 2) + power(dy - py, 2)) > 10 THEN {{'i': event_id, 'dx': px, 'dy': py}} ELSE {{'i': event_id, 'dx': dx, 'dy': dy}} END)
  FROM (SELECT o.user_id, o.r, o.event_id, o.dx, o.dy, f.h, len(f.h) AS k,
    f.h[len(f.h)].dx + coalesce(list_sum(list_transform(range(1, len(f.h)), lambda j: (f.h[j + 1].dx - f.h[j].dx) / (f.h[j + 1].i - f.h[j].i))) / greatest(len(f.h) - 1, 1), 0) AS px,
    f.h[len(f.h)].dy + coalesce(list_sum(list_transform(range(1, len(f.h)), lambda j: (f.h[j + 1].dy - f.h[j].dy) / (f.h[j + 1].i - f.h[j].i))) / greatest(len(f.h) - 1, 1), 0) AS py
    FROM f JOIN o ON o.user_id = f.user_id AND o.r = f.r + 1))
SELECT user_id, h[len(h)].i AS event_id, round(h[len(h)].dx, 4) AS dx, round(h[len(h)].dy, 4) AS dy FROM f""",
    ),
}
