"""Planning, decision, join and text queries, with DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from framequery.functions import pixels as px
from framequery.functions import stats
from framequery.operators import catalog as ct
from framequery.operators import frames as fr
from framequery.operators import planning as pl
from framequery.operators import reduce as rd
from framequery.plans.frame_queries import SQL_KEPT, SQL_PIXELS, SQL_SCORES, _frames
from framequery.plans.rule_queries import _SQL_HEADERS, _headers, _read

_OWN = ["capture_id", "frame_idx"]
_SQL_LAP = SQL_SCORES.rsplit(",\nscores AS", 1)[0]


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "events")


def fi07_cell_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    lit = _frames(spark, sf_dir).withColumn("plane", F.transform("plane", lambda v: F.greatest(v, F.lit(0.0))))
    p = pl.cell_plan(lit, 2)
    return p.select(*_OWN, "cy", "cx", F.round("score", 5).alias("score"), F.round("luma", 6).alias("luma"), "kept")


def fi08_cell_reject(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells of a capture whose mean score is among the lowest quarter."""
    m = rd.cell_scores(_frames(spark, sf_dir), 4).groupBy("capture_id", "cy", "cx").agg(F.avg("score").alias("mean"))
    w = Window.partitionBy("capture_id").orderBy("mean", "cy", "cx")
    n = F.count(F.lit(1)).over(Window.partitionBy("capture_id"))
    return m.withColumn("kept", F.row_number().over(w) > F.floor(n * F.lit(0.25))).select("capture_id", "cy", "cx", "kept")


def fi10_disc_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pl.disc_tiles(_frames(spark, sf_dir), 2, 0.25, 0.5)


def fi11_mask_disc(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = _frames(spark, sf_dir)
    return rd.exploded(f.withColumn("plane", pl.mask_disc(F.col("plane"), 0.5))).select(*_OWN, "px", F.round("v", 6).alias("v"))


def fi13_public_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _events(spark, sf_dir).withColumn("flagged", F.get_json_object("props", "$.k").cast("int") % 3 == 0)
    return e.where((F.col("event_type") == "view") & ~F.col("flagged")).select("event_id", "value")


def fi15_engage_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Captures as channels of one picture: spread of their 99th percentiles over 30 %, and highlights at 0.98."""
    p = stats.nearest_ranks(rd.exploded(_frames(spark, sf_dir)), ["capture_id"], "v", {"hi": 0.99})
    a = p.agg(F.max("hi").alias("top"), F.min("hi").alias("low"))
    return a.select(F.round("top", 6).alias("top"), (F.try_divide(F.col("top") - F.col("low"), F.col("top")) > 0.3).alias("normalise"), (F.col("top") >= 0.98).alias("suppress"))


def fi16_chroma_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _events(spark, sf_dir).select("event_id", ((F.col("event_id") % 13) - 6).cast("double").alias("dx"), ((F.col("event_id") % 11) - 5).cast("double").alias("dy"))
    sane = (F.abs("dx") <= 5) & (F.abs("dy") <= 5)
    return e.select("event_id", *(F.when(sane, F.col(c)).otherwise(F.lit(0.0)).alias(c) for c in ("dx", "dy")))


def ag02_partial_variance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pl.merged_variance(pl.variance_partials(_frames(spark, sf_dir), 2), _OWN).select(*_OWN, F.round("score", 6).alias("score"))


def _radial(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean value per whole radius around the middle of the plane."""
    r = F.floor(F.sqrt((F.col("x") - F.lit(3.5)) * (F.col("x") - F.lit(3.5)) + (F.col("y") - F.lit(3.5)) * (F.col("y") - F.lit(3.5)))).cast("int")
    return rd.exploded(_frames(spark, sf_dir)).groupBy(*_OWN, r.alias("r")).agg(F.avg("v").alias("v"))


def ag42_radial_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _radial(spark, sf_dir).withColumn("v", F.round("v", 6))


def wn11_edge_spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    """|p(r) - p(r - 1)| of the radial profile of each frame."""
    w = Window.partitionBy(*_OWN).orderBy("r")
    steps = _radial(spark, sf_dir).withColumn("step", F.round(F.abs(F.col("v") - F.lag("v").over(w)), 6))
    return steps.where("step IS NOT NULL").select(*_OWN, "r", "step")


def wn04_weight_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = fr.keep_top_percent(fr.sharpness(_frames(spark, sf_dir)), 25)
    return fr.with_quality_weight(kept).select(*_OWN, F.round("weight", 6).alias("weight"))


def wn08_cumulative(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = stats.histogram(_events(spark, sf_dir), ["event_type"], F.col("value") / F.lit(512.0), 64)
    w = Window.partitionBy("event_type").orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    return h.select("event_type", "bin", F.sum("n").over(w).alias("c"))


def wn09_uploading(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy("event_id")
    size = F.floor(F.col("value") / 50)
    return _events(spark, sf_dir).select("event_id", F.coalesce(size != F.lag(size).over(w), F.lit(False)).alias("uploading"))


def tk05_reference_subset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The reference's frames at keep 25 %: clamp(25 div 5, 2, 20) = 5 % of a capture."""
    return fr.keep_top_percent(fr.sharpness(_frames(spark, sf_dir)), min(20, max(2, 25 // 5))).select(*_OWN, "rank")


def tk09_newest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _events(spark, sf_dir).groupBy("event_type").agg(F.max_by("event_id", F.struct("ts", "event_id")).alias("event_id"))


def tk11_best_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pl.best_window(_frames(spark, sf_dir), 4, 0.35).select(*_OWN, "x0", "y0", F.round("score", 5).alias("score"))


def tk12_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "pages").orderBy("url", "page_id").limit(20).select("page_id", "url")


def sm04_sparse_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = _frames(spark, sf_dir).groupBy("capture_id").agg(F.count(F.lit(1)).cast("int").alias("n"))
    at = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: F.floor(i * F.col("n") / 8).cast("int"))
    return n.select("capture_id", F.explode(F.array_distinct(at)).alias("pos"))


def jo01_frame_shift(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = _frames(spark, sf_dir).select(*_OWN)
    shifts = f.where("frame_idx % 3 <> 0").select(*_OWN, (F.col("frame_idx") * F.lit(0.5)).alias("dx"))
    return f.join(shifts, _OWN, "left").select(*_OWN, F.coalesce("dx", F.lit(0.0)).alias("dx"))


def jo07_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    d, labels = _read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels")
    return d.join(labels.where("quality = 1"), "doc_id", "left_semi").select("doc_id", "source")


def jo08_unseen(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "documents").join(_read(spark, sf_dir, "labels"), "doc_id", "left_anti").select("doc_id", "source")


def jo09_quality_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _events(spark, sf_dir).select("event_id", F.concat(F.lit("/cap/"), (F.col("event_id") % 900).cast("string")).alias("path"), (F.col("event_id") % 4).cast("string").alias("fp"))
    cache = e.where("event_id < 900").select("path", "fp", F.col("event_id").cast("double").alias("quality"))
    return pl.cached_quality(e, cache, "path", "fp", "quality").select("event_id", "quality")


def jo14_sibling(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _events(spark, sf_dir)
    stem = (F.floor(F.col("event_id") / 3)).alias("stem")
    files = e.select(stem).distinct()
    found = e.where("event_id % 5 <> 0").select(stem, F.expr("element_at(array('tif', 'png', 'jpg'), cast(event_id % 3 + 1 AS int))").alias("ext"))
    return pl.first_sibling(files, found, "stem", "ext", ["png", "tif", "tiff"])


def jo15_channels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Captures 0, 1 and 2 as red, green and blue planes of one picture per rank."""
    w = Window.partitionBy("capture_id").orderBy("frame_idx")
    f = fr.sharpness(_frames(spark, sf_dir)).withColumn("k", F.row_number().over(w)).where("capture_id < 3")
    return f.groupBy("k").pivot("capture_id", [0, 1, 2]).agg(F.round(F.first("score"), 6)).toDF("k", "r", "g", "b").where("r IS NOT NULL AND g IS NOT NULL AND b IS NOT NULL")


def so03_json_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Union of two key sets less the ignored ones."""
    e = _events(spark, sf_dir)
    a, b = e.where("event_id % 2 = 0").select("user_id"), e.where("event_id % 3 = 0").select("user_id")
    ignored = e.where("value > 400").select("user_id")
    return a.union(b).distinct().join(ignored.distinct(), "user_id", "left_anti")


def sf10_baseline_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = F.split("url", "/")
    return _read(spark, sf_dir, "pages").select("page_id", F.concat(F.element_at(parts, -2), F.lit("__"), F.regexp_replace(F.element_at(parts, -1), "[^A-Za-z0-9.]+", "-")).alias("key"))


def sf12_iso_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("event_id")
    text = F.when(n % 3 == 0, F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss")).when(n % 3 == 1, F.date_format("ts", "yyyy-MM-dd")).otherwise(F.lit("soon"))
    day = F.coalesce(F.try_to_timestamp(text, F.lit("yyyy-MM-dd'T'HH:mm:ss")), F.try_to_timestamp(text, F.lit("yyyy-MM-dd")))
    return _events(spark, sf_dir).select("event_id", F.date_format(day, "yyyy-MM-dd HH:mm:ss").alias("at"))


def sf13_trail(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("event_id")
    ops = F.filter(F.array(F.when(n % 2 == 0, F.lit("sharp")), F.when(n % 3 == 0, F.lit("stab")), F.when(n % 5 == 0, F.lit("tone"))), lambda x: x.isNotNull())
    return _events(spark, sf_dir).select("event_id", F.concat_ws("+", ops).alias("trail"), F.left(F.md5(n.cast("string")), F.lit(8)).alias("short"))


def pr14_marked_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The per-frame step on marked frames only, and its name on their trail."""
    f = _frames(spark, sf_dir).withColumns({"marked": F.col("frame_idx") % 4 == 0, "applied": F.array(F.lit("load"))})
    stepped = f.withColumns({"plane": F.when(F.col("marked"), F.transform("plane", lambda v: v * 2)).otherwise(F.col("plane")), "applied": F.when(F.col("marked"), F.array_append("applied", F.lit("gain"))).otherwise(F.col("applied"))})
    return stepped.select(*_OWN, F.round(F.get("plane", F.lit(9)), 6).alias("v"), F.concat_ws(">", "applied").alias("applied"))


def pr03_half_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    long = rd.exploded(_frames(spark, sf_dir))
    return long.groupBy(*_OWN, F.floor(F.col("y") / 2).cast("int").alias("y"), F.floor(F.col("x") / 2).cast("int").alias("x")).agg(F.round(F.avg("v"), 6).alias("v"))


def pr04_border_crop(spark: SparkSession, sf_dir: str) -> DataFrame:
    long = rd.exploded(_frames(spark, sf_dir))
    return long.where(F.col("x").between(2, 5) & F.col("y").between(1, 6)).select(*_OWN, (F.col("x") - 2).alias("x"), (F.col("y") - 1).alias("y"), F.round("v", 6).alias("v"))


def ru06_patch_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = _headers(spark, sf_dir)
    active = F.when(F.col("event_id") % 3 == 0, (F.col("event_id") % 10) / F.lit(10.0))
    return h.select("event_id", pl.patch_fallback(F.col("target"), F.col("event_id") % 3 * 7, F.col("frames") + 64, active).alias("patch"))


def ru05_grids(spark: SparkSession, sf_dir: str) -> DataFrame:
    disc = F.when(F.col("event_id") % 2 == 0, F.col("value"))
    tile, overlap = pl.deconvolution_tile(F.col("event_id") % 3000 + 200, disc)
    return _events(spark, sf_dir).select("event_id", pl.alignment_grid(F.col("event_id") % 3000 + 200, F.col("event_id") % 25 + 8, disc).alias("grid"), tile.alias("tile"), overlap.alias("overlap"))


def ru07_refined_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pl.refined_grid(rd.cell_scores(_frames(spark, sf_dir), 4), _OWN, 4, 0, 8)


def ru13_remap(spark: SparkSession, sf_dir: str) -> DataFrame:
    m, w = (F.col("event_id") % 10) / F.lit(10.0), (F.col("event_id") % 7) / F.lit(7.0)
    n = F.col("event_id")
    return _events(spark, sf_dir).select("event_id", pl.remap_mode(m, w).alias("mode"), pl.accumulator(n % 4 == 0, n % 3, n % 2).alias("accumulator"))


def rg03_parabola(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy("event_id")
    e = _events(spark, sf_dir).select("event_id", F.lag("value").over(w).alias("l"), "value", F.lead("value").over(w).alias("r")).where("l IS NOT NULL AND r IS NOT NULL")
    return e.select("event_id", F.round(pl.parabola(F.col("l"), F.col("value"), F.col("r")), 6).alias("offset"))


def rg06_sad_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = _frames(spark, sf_dir)
    ref = f.groupBy("capture_id").agg(F.min_by("plane", "frame_idx").alias("plane"))
    return pl.sad_search(f, ref).select(*_OWN, "dx", "dy", F.round("sad", 6).alias("sad"))


def px20_radial_blend(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mix of a plane and its double, fading from radius 1.5 to 3.5 around the middle."""
    long = rd.exploded(_frames(spark, sf_dir))
    r = F.sqrt((F.col("x") - F.lit(3.5)) * (F.col("x") - F.lit(3.5)) + (F.col("y") - F.lit(3.5)) * (F.col("y") - F.lit(3.5)))
    t = px.smoothstep(1.5, 3.5, r)
    return long.select(*_OWN, "px", F.round(F.col("v") * 2 * (F.lit(1.0) - t) + F.col("v") * t, 6).alias("v"))


def sk09_metrics_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One JSON row per capture: kept counts at several percentages, in rising order; scores are computed once."""
    s = fr.sharpness(_frames(spark, sf_dir)).select("capture_id", "frame_idx", "score")
    w = Window.partitionBy("capture_id")
    ranked = s.withColumns({"rank": F.row_number().over(w.orderBy(F.col("score").desc(), "frame_idx")), "n": F.count(F.lit(1)).over(w)})
    percents = ranked.withColumn("keepPercent", F.explode(F.array(*map(F.lit, (20, 40, 60))))).where(F.col("rank") <= F.greatest(F.lit(1), F.expr("n * keepPercent div 100")))
    per = percents.groupBy("capture_id", "keepPercent").agg(F.count(F.lit(1)).alias("frames"))
    rows = per.groupBy("capture_id").agg(F.array_sort(F.collect_list(F.struct("keepPercent", "frames"))).alias("keepPercents"))
    return rows.select("capture_id", F.to_json(F.struct("keepPercents")).alias("metrics"))


def sk12_telemetry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Validate, then limit by hour and producer, then force the application's name."""
    e = _events(spark, sf_dir)
    valid = e.where((F.col("value") >= 1) & (F.col("event_type") != "error"))
    ok = ct.rate_limited(valid, "user_id", "ts", "event_id", 5).where("accepted")
    return ok.select("event_id", "user_id", F.lit("framequery").alias("app"))


def sk03_export_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames of a range with a stride, thinned evenly to 8 per capture, both ends among them."""
    w = Window.partitionBy("capture_id")
    f = _frames(spark, sf_dir).where(F.col("frame_idx").between(20, 400) & ((F.col("frame_idx") - 20) % 2 == 0)).select(*_OWN)
    r = f.withColumns({"i": F.row_number().over(w.orderBy("frame_idx")) - 1, "n": F.count(F.lit(1)).over(w).cast("int")})
    return r.where(F.array_contains(ct.even_pick(F.col("n"), 8), F.col("i"))).select(*_OWN)


_SQL_RADIAL = f"{SQL_PIXELS}, rp AS (SELECT capture_id, frame_idx, floor(sqrt((x - 3.5::DOUBLE) * (x - 3.5::DOUBLE) + (y - 3.5::DOUBLE) * (y - 3.5::DOUBLE)))::INT AS r, avg(v) AS v FROM px GROUP BY ALL)"
_SQL_FR = "fr AS (SELECT label AS capture_id, vec_id AS frame_idx FROM embeddings)"
_INNER = "p % 8 BETWEEN 1 AND 6 AND p // 8 BETWEEN 1 AND 6"
_SQL_SAD = ", ".join(
    f"{{'sad': list_sum([abs(r[p + 1]::DOUBLE - e[p - {dy * 8 + dx} + 1]::DOUBLE) for p in range(64) if {_INNER}]) / 36, 'far': {dx * dx + dy * dy}, 'dx': {dx}, 'dy': {dy}}}" for dy in (-1, 0, 1) for dx in (-1, 0, 1)
)

QUERIES = {
    "fi07_cell_plan": (
        fi07_cell_plan,
        f"""WITH l AS (SELECT label AS capture_id, vec_id AS frame_idx, list_transform(embedding, lambda v: greatest(v, 0)) AS e FROM embeddings),
px AS (SELECT capture_id, frame_idx, p, p % 8 AS x, p // 8 AS y, e[p + 1]::DOUBLE AS v, e FROM l, range(64) r(p)),
a AS (SELECT *, CASE WHEN x % 4 BETWEEN 1 AND 2 AND y % 4 BETWEEN 1 AND 2 THEN abs(e[p]::DOUBLE + e[p + 2]::DOUBLE + e[p - 7]::DOUBLE + e[p + 9]::DOUBLE + 0.5::DOUBLE * (e[p - 8]::DOUBLE + e[p - 6]::DOUBLE + e[p + 8]::DOUBLE + e[p + 10]::DOUBLE) - 6 * v) ELSE 0 END AS l FROM px),
c AS (SELECT capture_id, frame_idx, (y // 4)::INT AS cy, (x // 4)::INT AS cx, sum(l) AS score, avg(v) AS luma FROM a GROUP BY ALL), k AS (SELECT capture_id, frame_idx, max(v) AS peak FROM px GROUP BY ALL),
d AS (SELECT c.*, luma >= 0.05::DOUBLE * peak AS lit FROM c JOIN k USING (capture_id, frame_idx)), r AS (SELECT *, row_number() OVER (w ORDER BY score, cy, cx) AS r, count(*) OVER w AS n FROM d WINDOW w AS (PARTITION BY capture_id, frame_idx, lit))
SELECT capture_id, frame_idx, cy, cx, round(score, 5) AS score, round(luma, 6) AS luma, lit AND r > floor(0.2::DOUBLE * n + 0.5::DOUBLE) AS kept FROM r""",
    ),
    "fi08_cell_reject": (
        fi08_cell_reject,
        f"WITH {SQL_SCORES}, c AS (SELECT capture_id, frame_idx, (p // 8 // 2)::INT AS cy, (p % 8 // 2)::INT AS cx, var_pop(l) AS s FROM lap GROUP BY ALL), m AS (SELECT capture_id, cy, cx, avg(s) AS mean FROM c GROUP BY ALL) SELECT capture_id, cy, cx, row_number() OVER (PARTITION BY capture_id ORDER BY mean, cy, cx) > 4 AS kept FROM m",
    ),
    "fi10_disc_tiles": (
        fi10_disc_tiles,
        f"WITH {SQL_PIXELS} SELECT capture_id, frame_idx, (y // 2)::INT AS ty, (x // 2)::INT AS tx, avg((v > 0.25::DOUBLE * list_max(e)::DOUBLE)::INT) > 0.5 AS disc FROM px GROUP BY ALL",
    ),
    "fi11_mask_disc": (
        fi11_mask_disc,
        f"WITH {SQL_PIXELS}, m AS (SELECT capture_id, frame_idx, p, v, 0.5::DOUBLE * list_max(e)::DOUBLE AS cut, list_sort(list_filter(e, lambda q: q::DOUBLE <= 0.5::DOUBLE * list_max(e)::DOUBLE)) AS rest FROM px) SELECT capture_id, frame_idx, p::INT AS px, round(CASE WHEN v > cut AND len(rest) > 0 THEN rest[len(rest) // 2 + 1]::DOUBLE ELSE v END, 6) AS v FROM m",
    ),
    "fi13_public_rows": (fi13_public_rows, "SELECT event_id, value FROM events WHERE event_type = 'view' AND NOT (props::JSON->>'$.k')::INT % 3 = 0"),
    "fi15_engage_gates": (
        fi15_engage_gates,
        f"WITH {SQL_PIXELS}, r AS (SELECT capture_id, v, row_number() OVER (PARTITION BY capture_id ORDER BY v) - 1 AS r, count(*) OVER (PARTITION BY capture_id) AS n FROM px), h AS (SELECT capture_id, max(v) FILTER (r = floor((n - 1) * 0.99::DOUBLE + 0.5)) AS hi FROM r GROUP BY ALL) SELECT round(max(hi), 6) AS top, (max(hi) - min(hi)) / max(hi) > 0.3 AS normalise, max(hi) >= 0.98 AS suppress FROM h",
    ),
    "fi16_chroma_cap": (fi16_chroma_cap, "WITH e AS (SELECT event_id, event_id % 13 - 6 AS dx, event_id % 11 - 5 AS dy FROM events) SELECT event_id, CASE WHEN abs(dx) <= 5 AND abs(dy) <= 5 THEN dx ELSE 0 END::DOUBLE AS dx, CASE WHEN abs(dx) <= 5 AND abs(dy) <= 5 THEN dy ELSE 0 END::DOUBLE AS dy FROM e"),
    "ag02_partial_variance": (ag02_partial_variance, f"WITH {SQL_SCORES} SELECT capture_id, frame_idx, round(score, 6) AS score FROM scores"),
    "ag42_radial_profile": (ag42_radial_profile, f"WITH {_SQL_RADIAL} SELECT capture_id, frame_idx, r, round(v, 6) AS v FROM rp"),
    "wn11_edge_spread": (wn11_edge_spread, f"WITH {_SQL_RADIAL}, s AS (SELECT capture_id, frame_idx, r, round(abs(v - lag(v) OVER (PARTITION BY capture_id, frame_idx ORDER BY r)), 6) AS step FROM rp) SELECT * FROM s WHERE step IS NOT NULL"),
    "wn04_weight_curve": (wn04_weight_curve, f"WITH {SQL_KEPT} SELECT capture_id, frame_idx, round(weight, 6) AS weight FROM weighted"),
    "wn08_cumulative": (wn08_cumulative, "WITH h AS (SELECT event_type, least(63, floor(least(greatest(value / 512, 0), 1) * 63))::INT AS bin, count(*) AS n FROM events GROUP BY ALL) SELECT event_type, bin, sum(n) OVER (PARTITION BY event_type ORDER BY bin)::BIGINT AS c FROM h"),
    "wn09_uploading": (wn09_uploading, "SELECT event_id, coalesce(floor(value / 50) <> lag(floor(value / 50)) OVER (PARTITION BY user_id ORDER BY event_id), false) AS uploading FROM events"),
    "tk05_reference_subset": (tk05_reference_subset, f"WITH {SQL_KEPT} SELECT capture_id, frame_idx, rank::INT AS rank FROM ranked WHERE rank <= greatest(1, n * 5 // 100)"),
    "tk09_newest": (tk09_newest, "SELECT event_type, event_id FROM events QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) = 1"),
    "tk11_best_window": (
        tk11_best_window,
        f"""WITH {_SQL_LAP}, v AS (SELECT px.capture_id, px.frame_idx, x, y, v, abs(l) AS a FROM px JOIN lap USING (capture_id, frame_idx, p)),
s AS (SELECT capture_id, frame_idx, (x - i)::INT AS x0, (y - j)::INT AS y0, sum(a) AS score, max(v) AS peak FROM v, range(4) a(i), range(4) b(j) WHERE x - i BETWEEN 0 AND 4 AND y - j BETWEEN 0 AND 4 GROUP BY ALL)
SELECT capture_id, frame_idx, x0, y0, round(score, 5) AS score FROM s WHERE peak < 0.35::DOUBLE QUALIFY row_number() OVER (PARTITION BY capture_id, frame_idx ORDER BY round(score, 9) DESC, y0, x0) = 1""",
    ),
    "tk12_candidates": (tk12_candidates, "SELECT page_id, url FROM pages ORDER BY encode(url), page_id LIMIT 20"),
    "sm04_sparse_positions": (sm04_sparse_positions, f"WITH {_SQL_FR}, n AS (SELECT capture_id, count(*) AS n FROM fr GROUP BY ALL) SELECT DISTINCT capture_id, (i * n // 8)::INT AS pos FROM n, range(8) r(i)"),
    "jo01_frame_shift": (jo01_frame_shift, f"WITH {_SQL_FR} SELECT capture_id, frame_idx, CASE WHEN frame_idx % 3 <> 0 THEN frame_idx * 0.5::DOUBLE ELSE 0 END AS dx FROM fr"),
    "jo07_selection": (jo07_selection, "SELECT doc_id, source FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)"),
    "jo08_unseen": (jo08_unseen, "SELECT doc_id, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)"),
    "jo09_quality_cache": (jo09_quality_cache, "SELECT a.event_id, b.event_id::DOUBLE AS quality FROM events a LEFT JOIN events b ON b.event_id < 900 AND b.event_id % 900 = a.event_id % 900 AND b.event_id % 4 = a.event_id % 4"),
    "jo14_sibling": (
        jo14_sibling,
        "WITH s AS (SELECT event_id // 3 AS stem, CASE WHEN event_id % 5 <> 0 THEN ['tif', 'png', 'jpg'][event_id % 3 + 1] END AS ext FROM events) SELECT stem, CASE WHEN count(*) FILTER (ext = 'png') > 0 THEN 'png' WHEN count(*) FILTER (ext = 'tif') > 0 THEN 'tif' END AS sibling FROM s GROUP BY stem",
    ),
    "jo15_channels": (
        jo15_channels,
        f"WITH {SQL_SCORES}, k AS (SELECT capture_id, score, row_number() OVER (PARTITION BY capture_id ORDER BY frame_idx) AS k FROM scores WHERE capture_id < 3), j AS (SELECT k, max(round(score, 6)) FILTER (capture_id = 0) AS r, max(round(score, 6)) FILTER (capture_id = 1) AS g, max(round(score, 6)) FILTER (capture_id = 2) AS b FROM k GROUP BY k) SELECT k::INT AS k, r, g, b FROM j WHERE r IS NOT NULL AND g IS NOT NULL AND b IS NOT NULL",
    ),
    "so03_json_keys": (so03_json_keys, "SELECT DISTINCT user_id FROM events WHERE (event_id % 2 = 0 OR event_id % 3 = 0) AND user_id NOT IN (SELECT user_id FROM events WHERE value > 400)"),
    "sf10_baseline_key": (sf10_baseline_key, "SELECT page_id, string_split(url, '/')[-2] || '__' || regexp_replace(string_split(url, '/')[-1], '[^A-Za-z0-9.]+', '-', 'g') AS key FROM pages"),
    "sf12_iso_dates": (sf12_iso_dates, "SELECT event_id, CASE event_id % 3 WHEN 0 THEN strftime(ts, '%Y-%m-%d %H:%M:%S') WHEN 1 THEN strftime(ts, '%Y-%m-%d 00:00:00') END AS at FROM events"),
    "sf13_trail": (
        sf13_trail,
        "SELECT event_id, array_to_string(list_filter([CASE WHEN event_id % 2 = 0 THEN 'sharp' END, CASE WHEN event_id % 3 = 0 THEN 'stab' END, CASE WHEN event_id % 5 = 0 THEN 'tone' END], lambda x: x IS NOT NULL), '+') AS trail, left(md5(event_id::VARCHAR), 8) AS short FROM events",
    ),
    "pr14_marked_chain": (pr14_marked_chain, "SELECT label AS capture_id, vec_id AS frame_idx, round(embedding[10]::DOUBLE * CASE WHEN vec_id % 4 = 0 THEN 2 ELSE 1 END, 6) AS v, CASE WHEN vec_id % 4 = 0 THEN 'load>gain' ELSE 'load' END AS applied FROM embeddings"),
    "pr03_half_size": (pr03_half_size, f"WITH {SQL_PIXELS} SELECT capture_id, frame_idx, (y // 2)::INT AS y, (x // 2)::INT AS x, round(avg(v), 6) AS v FROM px GROUP BY capture_id, frame_idx, y // 2, x // 2"),
    "pr04_border_crop": (pr04_border_crop, f"WITH {SQL_PIXELS} SELECT capture_id, frame_idx, (x - 2)::INT AS x, (y - 1)::INT AS y, round(v, 6) AS v FROM px WHERE x BETWEEN 2 AND 5 AND y BETWEEN 1 AND 6"),
    "ru06_patch_fallback": (
        ru06_patch_fallback,
        f"""WITH {_SQL_HEADERS}, d AS (SELECT event_id, target, event_id % 3 * 7 AS prior, frames + 64 AS m, greatest(8, (frames + 64) // 8) AS u, CASE WHEN event_id % 3 = 0 THEN (event_id % 10) / 10.0::DOUBLE END AS a FROM hd)
SELECT event_id, (CASE WHEN a IS NOT NULL THEN CASE WHEN a > 0.60 THEN least(greatest(m // 32, 12), least(24, u)) WHEN a < 0.25 THEN least(greatest(10, 8), least(14, u)) ELSE least(greatest(m // 48, 10), least(20, u)) END
  ELSE least(greatest(CASE WHEN target IN ('Sun', 'Mars') THEN 12 WHEN target IN ('Moon', 'Jupiter') THEN 16 WHEN target = 'Saturn' THEN 18 WHEN prior > 0 THEN prior ELSE 16 END, 8), least(32, u)) END)::INT AS patch FROM d""",
    ),
    "ru05_grids": (
        ru05_grids,
        """WITH d AS (SELECT event_id, event_id % 3000 + 200 AS m, event_id % 25 + 8 AS p, CASE WHEN event_id % 2 = 0 THEN value END AS disc FROM events),
t AS (SELECT *, least(greatest(floor(CASE WHEN disc > 50 THEN disc * 8 ELSE m / 4::DOUBLE END / 100 + 0.5::DOUBLE) * 100, 200), 1024)::INT AS tile FROM d)
SELECT event_id, CASE WHEN disc > 20 THEN least(greatest(floor(disc * 2 / (p * 3) + 0.5::DOUBLE), 6), 24) ELSE least(greatest(floor(m / (p * 8)::DOUBLE + 0.5::DOUBLE), 8), 32) END::INT AS grid, tile, greatest(20, tile // 7)::INT AS overlap FROM t""",
    ),
    "ru07_refined_grid": (
        ru07_refined_grid,
        f"""WITH {SQL_SCORES}, c AS (SELECT capture_id, frame_idx, p // 8 // 2 AS cy, p % 8 // 2 AS cx, var_pop(l) AS s FROM lap GROUP BY ALL), m AS (SELECT capture_id, frame_idx, list_sort(list(s) FILTER (s > 0)) AS l FROM c GROUP BY ALL)
SELECT capture_id, frame_idx, CASE WHEN avg((s > 3 * l[len(l) // 2 + 1])::INT) > 0.05 THEN 8 ELSE 4 END AS grid FROM c JOIN m USING (capture_id, frame_idx) GROUP BY capture_id, frame_idx""",
    ),
    "ru13_remap": (
        ru13_remap,
        "WITH e AS (SELECT event_id, (event_id % 10) / 10.0::DOUBLE AS m, (event_id % 7) / 7.0::DOUBLE AS w FROM events) SELECT event_id, CASE WHEN w > 0.5 AND m >= 0.3::DOUBLE THEN 'wide_bright' WHEN w > 0.5 THEN 'bright_peak' ELSE 'identity' END AS mode, CASE WHEN event_id % 4 = 0 THEN 'two_stage' WHEN event_id % 3 > 1 THEN 'drizzle' WHEN event_id % 2 > 0 THEN 'sigma_clip' ELSE 'standard' END AS accumulator FROM e",
    ),
    "rg03_parabola": (
        rg03_parabola,
        "WITH e AS (SELECT event_id, value AS c, lag(value) OVER w AS l, lead(value) OVER w AS r FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)) SELECT event_id, round(CASE WHEN abs(l - 2 * c + r) < 1e-8 THEN 0 ELSE least(greatest(0.5::DOUBLE * (l - r) / (l - 2 * c + r), -0.5), 0.5) END, 6) AS \"offset\" FROM e WHERE l IS NOT NULL AND r IS NOT NULL",
    ),
    "rg06_sad_search": (
        rg06_sad_search,
        f"""WITH f AS (SELECT label AS capture_id, vec_id AS frame_idx, embedding AS e FROM embeddings), r AS (SELECT capture_id, arg_min(e, frame_idx) AS r FROM f GROUP BY ALL),
a AS (SELECT capture_id, frame_idx, [{_SQL_SAD}] AS a FROM f JOIN r USING (capture_id)), b AS (SELECT *, list_sort(a)[1] AS best, list_sum(list_transform(a, lambda c: c.sad)) / 9 AS mean FROM a)
SELECT capture_id, frame_idx, CASE WHEN best.sad <= 0.9::DOUBLE * mean AND greatest(abs(best.dx), abs(best.dy)) < 1 THEN best.dx ELSE 0 END AS dx, CASE WHEN best.sad <= 0.9::DOUBLE * mean AND greatest(abs(best.dx), abs(best.dy)) < 1 THEN best.dy ELSE 0 END AS dy, round(best.sad, 6) AS sad FROM b""",
    ),
    "px20_radial_blend": (
        px20_radial_blend,
        f"WITH {SQL_PIXELS}, t AS (SELECT *, least(greatest((sqrt((x - 3.5::DOUBLE) * (x - 3.5::DOUBLE) + (y - 3.5::DOUBLE) * (y - 3.5::DOUBLE)) - 1.5::DOUBLE) / 2, 0), 1) AS t FROM px), s AS (SELECT *, t * t * (3 - 2 * t) AS s FROM t) SELECT capture_id, frame_idx, p::INT AS px, round(v * 2 * (1 - s) + v * s, 6) AS v FROM s",
    ),
    "sk09_metrics_json": (
        sk09_metrics_json,
        "WITH n AS (SELECT label AS capture_id, count(*) AS n FROM embeddings GROUP BY ALL) SELECT capture_id, '{\"keepPercents\":[{\"keepPercent\":20,\"frames\":' || greatest(1, n * 20 // 100) || '},{\"keepPercent\":40,\"frames\":' || greatest(1, n * 40 // 100) || '},{\"keepPercent\":60,\"frames\":' || greatest(1, n * 60 // 100) || '}]}' AS metrics FROM n",
    ),
    "sk12_telemetry": (
        sk12_telemetry,
        "SELECT event_id, user_id, 'framequery' AS app FROM events WHERE value >= 1 AND event_type <> 'error' QUALIFY row_number() OVER (PARTITION BY user_id, date_trunc('hour', ts) ORDER BY ts, event_id) <= 5",
    ),
    "sk03_export_frames": (
        sk03_export_frames,
        f"""WITH {_SQL_FR}, c AS (SELECT *, row_number() OVER (PARTITION BY capture_id ORDER BY frame_idx) - 1 AS i, count(*) OVER (PARTITION BY capture_id) AS n FROM fr WHERE frame_idx BETWEEN 20 AND 400 AND (frame_idx - 20) % 2 = 0)
SELECT capture_id, frame_idx FROM c WHERE EXISTS (SELECT 1 FROM range(8) r(t) WHERE t < n AND floor(t * (n - 1) / greatest(least(8, n) - 1, 1)::DOUBLE + 0.5::DOUBLE) = i)""",
    ),
}
