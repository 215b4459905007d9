"""Stack queries over `embeddings` as 8x8 frames, with DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framequery.operators import frames as fr
from framequery.operators import reduce as rd
from framequery.plans.frame_queries import SQL_KEPT, SQL_PIXELS, SQL_SCORES, _frames

_OWN = ["capture_id", "frame_idx"]
#: A made-up drift, exact in binary: dx in -1 .. 1 and dy in -0.5 .. 0.5.
def _drift() -> tuple:
    return ((F.col("frame_idx") % 5) - 2) * F.lit(0.5), ((F.col("frame_idx") % 3) - 1) * F.lit(0.5)


SQL_DX, SQL_DY = "((frame_idx % 5) - 2) * 0.5::DOUBLE", "((frame_idx % 3) - 1) * 0.5::DOUBLE"


def sql_sample(sx: str, sy: str, outside: str) -> str:
    """SQL of rd.sample_bilinear over the array e."""
    if outside == "clamp":
        sx, sy = f"least(greatest({sx}, 0), 7)", f"least(greatest({sy}, 0), 7)"

    def at(dx: int, dy: int) -> str:
        x, y = f"(floor({sx}) + {dx})::INT", f"(floor({sy}) + {dy})::INT"
        if outside == "clamp":
            return f"e[least({y}, 7) * 8 + least({x}, 7) + 1]::DOUBLE"
        return f"CASE WHEN {x} BETWEEN 0 AND 7 AND {y} BETWEEN 0 AND 7 THEN e[{y} * 8 + {x} + 1]::DOUBLE ELSE 0 END"

    fx, fy = f"({sx} - floor({sx}))", f"({sy} - floor({sy}))"
    value = f"({at(0, 0)}) * (1 - {fx}) * (1 - {fy}) + ({at(1, 0)}) * {fx} * (1 - {fy}) + ({at(0, 1)}) * (1 - {fx}) * {fy} + ({at(1, 1)}) * {fx} * {fy}"
    return f"CASE WHEN {sx} BETWEEN 0 AND 7 AND {sy} BETWEEN 0 AND 7 THEN {value} END" if outside == "null" else value


def _kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fr.keep_top_percent(fr.sharpness(_frames(spark, sf_dir)), 25)


def ag03_tile_variance(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = rd.tile_scores(_frames(spark, sf_dir), 2)
    return t.select(*_OWN, "ty", "tx", F.round("score", 6).alias("score"))


def ag04_tile_brightness(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = rd.tile_scores(_frames(spark, sf_dir), 4)
    return t.select(*_OWN, "ty", "tx", F.round("brightness", 6).alias("brightness"))


def ag05_cell_variance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rd.cell_scores(_frames(spark, sf_dir), 3).select(*_OWN, "cy", "cx", F.round("score", 6).alias("score"))


def ag06_cross_laplacian(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rd.cross_laplacian(_frames(spark, sf_dir)).select(*_OWN, F.round("score", 6).alias("score"))


def ag07_mean_plane(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rd.mean_plane(_kept(spark, sf_dir)).select("capture_id", "px", F.round("value", 6).alias("value"))


def ag09_coverage_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    moved = rd.shifted(_frames(spark, sf_dir), *_drift(), "null")
    got = rd.coverage_mean(moved, F.lit(1.0) + F.col("frame_idx") % 2)
    return got.select("capture_id", "px", F.round("value", 6).alias("value"), F.round("coverage", 6).alias("coverage"))


def ag10_sigma_clip_plane(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rd.sigma_clipped_plane(_frames(spark, sf_dir), 2.0).select("capture_id", "px", F.round("value", 6).alias("value"), "n_kept")


def ag11_clipped_mean_rounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rd.sigma_clipped_plane(_frames(spark, sf_dir), 2.0, rounds=2).select("capture_id", "px", F.round("value", 6).alias("value"))


def tk04_region_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rd.region_selection(rd.tile_scores(_frames(spark, sf_dir), 4), 0.8, 1, 3)


def ag12_region_stack(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = _frames(spark, sf_dir)
    stack = rd.region_stack(f, rd.region_selection(rd.tile_scores(f, 4)), 4)
    return stack.select("capture_id", "px", F.round("value", 6).alias("value"))


def wn03_ap_sigmoid_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = rd.sigmoid_weights(rd.cell_scores(_frames(spark, sf_dir), 2), 0.25)
    return w.select(*_OWN, "cy", "cx", "rank", F.round("w", 6).alias("w"))


def ag13_two_stage_stack(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = _frames(spark, sf_dir)
    stack = rd.two_stage_stack(f, rd.sigmoid_weights(rd.cell_scores(f, 2), 0.25), 2)
    return stack.select("capture_id", "px", F.round("value", 6).alias("value"))


def ag14_drizzle2x(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = rd.drizzle(_kept(spark, sf_dir), 2, 0.75)
    return d.select("capture_id", "ox", "oy", F.round("value", 6).alias("value"), F.round("weight", 6).alias("weight"))


def ag15_local_accumulate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames moved by a made-up drift and a made-up 4x4 shift map, then averaged by weight."""
    f = _frames(spark, sf_dir)
    cells = f.select(*_OWN, F.explode(F.sequence(F.lit(0), F.lit(15))).alias("c"))
    ay, ax = F.floor(F.col("c") / 4), F.col("c") % 4
    dx, dy = (((F.col("frame_idx") + ax + ay * 2) % 3) - 1) * F.lit(0.25), (((F.col("frame_idx") + ax * 2 + ay) % 5) - 2) * F.lit(0.125)
    local = cells.select(*_OWN, ay.alias("ay"), ax.alias("ax"), dx.alias("dx"), dy.alias("dy"))
    got = rd.coverage_mean(rd.locally_shifted(f, *_drift(), local, 4), F.lit(1.0) + F.col("frame_idx") % 2)
    return got.select("capture_id", "px", F.round("value", 6).alias("value"))


def _sql_map(value: str) -> str:
    """SQL of the 4x4 map's bilinear sample at (ux, uy); value is of (ax, ay)."""

    def at(i: int, j: int) -> str:
        return value.replace("ax", f"least(floor(ux) + {i}, 3)").replace("ay", f"least(floor(uy) + {j}, 3)")

    parts = (f"({at(i, j)}) * ({'ux - floor(ux)' if i else '1 - ux + floor(ux)'}) * ({'uy - floor(uy)' if j else '1 - uy + floor(uy)'})" for i in (0, 1) for j in (0, 1))
    return " + ".join(parts)


def ag17_calibration_masters(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = _frames(spark, sf_dir)
    dark = rd.mean_plane(f.where(F.col("frame_idx") % 2 == 0))
    flat = rd.master_flat(f.where(F.col("frame_idx") % 2 == 1), dark)
    both = dark.withColumnRenamed("value", "dark").join(flat.withColumnRenamed("value", "flat"), ["capture_id", "px"])
    return both.select("capture_id", "px", F.round("dark", 6).alias("dark"), F.round("flat", 4).alias("flat"))


def px01_calibrate(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = _frames(spark, sf_dir)
    dark = rd.mean_plane(f.where(F.col("frame_idx") % 2 == 0)).withColumnRenamed("value", "dark")
    long = rd.exploded(f.where(F.col("frame_idx") % 2 == 1)).join(dark, ["capture_id", "px"])
    lit = rd.calibrate(F.col("v"), F.col("dark"), F.lit(0.5) + F.col("x") * F.lit(0.125))
    return long.select(*_OWN, "px", F.round(lit, 6).alias("value"))


def pr07_shift_clamp(spark: SparkSession, sf_dir: str) -> DataFrame:
    moved = rd.shifted(_frames(spark, sf_dir), F.lit(1.25), F.lit(-0.5), "clamp")
    return rd.exploded(moved).select(*_OWN, "px", F.round("v", 6).alias("v"))


def pr08_bilinear_shift(spark: SparkSession, sf_dir: str) -> DataFrame:
    moved = rd.shifted(_frames(spark, sf_dir), F.lit(0.5), F.lit(-0.25), "zero")
    return rd.exploded(moved).select(*_OWN, "px", F.round("v", 6).alias("v"))


def pr12_pixel_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    one = rd.exploded(_frames(spark, sf_dir).where("frame_idx = 0")).select("px", "x", "y")
    return rd.tile_of_pixel(one, 2).select("px", "ty", "tx", F.round("w", 6).alias("w"))


def pr13_pixel_tiles_cosine(spark: SparkSession, sf_dir: str) -> DataFrame:
    one = rd.exploded(_frames(spark, sf_dir).where("frame_idx = 0")).select("px", "x", "y")
    return rd.tile_of_pixel(one, 2, cosine=True).groupBy("px", "ty", "tx").agg(F.round(F.sum("w"), 6).alias("w"))


def _sql_tiles(tile: int, source: str, columns: str, cosine: bool = False) -> str:
    m = 8 // tile - 1
    ease = (lambda d: f"(1 - cos(pi() * ({d}))) / 2") if cosine else (lambda d: f"({d})")
    return f"""placed AS (SELECT {columns}, x, y, least(greatest((x + 0.5::DOUBLE) / {tile} - 0.5::DOUBLE, 0), {m}) AS gx, least(greatest((y + 0.5::DOUBLE) / {tile} - 0.5::DOUBLE, 0), {m}) AS gy FROM {source}),
eased AS (SELECT *, floor(gx)::INT AS x0, floor(gy)::INT AS y0, {ease("gx - floor(gx)")} AS fx, {ease("gy - floor(gy)")} AS fy FROM placed),
near AS (SELECT {columns}, least(y0 + dy, {m})::INT AS ty, least(x0 + dx, {m})::INT AS tx,
  (CASE WHEN dx = 1 THEN fx ELSE 1 - fx END) * (CASE WHEN dy = 1 THEN fy ELSE 1 - fy END) AS w
  FROM eased, range(2) a(dx), range(2) b(dy) WHERE (CASE WHEN dx = 1 THEN fx ELSE 1 - fx END) * (CASE WHEN dy = 1 THEN fy ELSE 1 - fy END) > 0)"""


def _sql_cells(grid: int) -> str:
    c = 8 // grid
    return f"cells AS (SELECT capture_id, frame_idx, (p // 8 // {c})::INT AS cy, (p % 8 // {c})::INT AS cx, var_pop(l) AS score FROM lap WHERE p // 8 // {c} < {grid} AND p % 8 // {c} < {grid} GROUP BY ALL)"


def _sql_tile_scores(t: int) -> str:
    return f"tiles AS (SELECT capture_id, frame_idx, (p // 8 // {t})::INT AS ty, (p % 8 // {t})::INT AS tx, var_pop(l) AS score, avg(l) AS brightness FROM lap GROUP BY ALL)"


_SQL_SIGMOID = """ranked AS (SELECT *, row_number() OVER (PARTITION BY capture_id, cy, cx ORDER BY score DESC, frame_idx) - 1 AS rank, count(*) OVER (PARTITION BY capture_id, cy, cx) AS n FROM cells),
weights AS (SELECT *, 1 / (1 + exp((rank - greatest(1, ceil(n * 0.25::DOUBLE))) / greatest(1::DOUBLE, 0.2::DOUBLE * n))) AS w FROM ranked)"""


def _sql_select(fraction: float, lo: int, hi: int) -> str:
    return f"""rt AS (SELECT *, row_number() OVER w AS rank, first_value(score) OVER w AS best FROM tiles WINDOW w AS (PARTITION BY capture_id, ty, tx ORDER BY score DESC, frame_idx)),
sel AS (SELECT capture_id, ty, tx, rank::INT AS rank, frame_idx FROM rt WHERE (rank <= {lo} OR score >= {fraction}::DOUBLE * best) AND rank <= {hi})"""


def _sql_moved(dx: str, dy: str, outside: str) -> str:
    return f"moved AS (SELECT capture_id, frame_idx, p, {sql_sample(f'(x - ({dx}))', f'(y - ({dy}))', outside)} AS v FROM px)"


QUERIES = {
    "ag03_tile_variance": (ag03_tile_variance, f"WITH {SQL_SCORES}, {_sql_tile_scores(2)} SELECT capture_id, frame_idx, ty, tx, round(score, 6) AS score FROM tiles"),
    "ag04_tile_brightness": (ag04_tile_brightness, f"WITH {SQL_SCORES}, {_sql_tile_scores(4)} SELECT capture_id, frame_idx, ty, tx, round(brightness, 6) AS brightness FROM tiles"),
    "ag05_cell_variance": (ag05_cell_variance, f"WITH {SQL_SCORES}, {_sql_cells(3)} SELECT capture_id, frame_idx, cy, cx, round(score, 6) AS score FROM cells"),
    "ag06_cross_laplacian": (
        ag06_cross_laplacian,
        f"WITH {SQL_PIXELS} SELECT capture_id, frame_idx, round(var_pop(e[p]::DOUBLE + e[p + 2]::DOUBLE + e[p - 7]::DOUBLE + e[p + 9]::DOUBLE - 4 * v), 6) AS score FROM px WHERE x BETWEEN 1 AND 6 AND y BETWEEN 1 AND 6 GROUP BY ALL",
    ),
    "ag07_mean_plane": (ag07_mean_plane, f"WITH {SQL_KEPT} SELECT capture_id, p::INT AS px, round(avg(v), 6) AS value FROM px SEMI JOIN kept USING (capture_id, frame_idx) GROUP BY ALL"),
    "ag09_coverage_mean": (
        ag09_coverage_mean,
        f"WITH {SQL_PIXELS}, {_sql_moved(SQL_DX, SQL_DY, 'null')} SELECT capture_id, p::INT AS px, round(sum(v * (1 + frame_idx % 2)) / sum(1.0::DOUBLE + frame_idx % 2), 6) AS value, round(sum(1.0::DOUBLE + frame_idx % 2), 6) AS coverage FROM moved WHERE v IS NOT NULL GROUP BY ALL",
    ),
    "ag10_sigma_clip_plane": (
        ag10_sigma_clip_plane,
        f"WITH {SQL_PIXELS}, st AS (SELECT *, avg(v) OVER w AS mu, stddev_pop(v) OVER w AS sd FROM px WINDOW w AS (PARTITION BY capture_id, p)) SELECT capture_id, p::INT AS px, round(avg(v), 6) AS value, count(*) AS n_kept FROM st WHERE abs(v - mu) <= 2.0::DOUBLE * sd + 1e-12::DOUBLE GROUP BY ALL",
    ),
    "ag11_clipped_mean_rounds": (
        ag11_clipped_mean_rounds,
        f"""WITH {SQL_PIXELS}, a AS (SELECT capture_id, p, v, avg(v) OVER w AS mu, stddev_pop(v) OVER w AS sd FROM px WINDOW w AS (PARTITION BY capture_id, p)),
b AS (SELECT capture_id, p, v, avg(v) OVER w AS mu, stddev_pop(v) OVER w AS sd FROM a WHERE abs(v - mu) <= 2 * sd + 1e-12 WINDOW w AS (PARTITION BY capture_id, p))
SELECT capture_id, p::INT AS px, round(avg(v), 6) AS value FROM b WHERE abs(v - mu) <= 2 * sd + 1e-12 GROUP BY ALL""",
    ),
    "tk04_region_selection": (tk04_region_selection, f"WITH {SQL_SCORES}, {_sql_tile_scores(4)}, {_sql_select(0.8, 1, 3)} SELECT * FROM sel"),
    "ag12_region_stack": (
        ag12_region_stack,
        f"WITH {SQL_SCORES}, {_sql_tile_scores(4)}, {_sql_select(1.0, 1, 1)}, {_sql_tiles(4, 'px', 'capture_id, frame_idx, p, v')} SELECT capture_id, p::INT AS px, round(sum(v * w) / sum(w), 6) AS value FROM near JOIN sel USING (capture_id, ty, tx, frame_idx) GROUP BY ALL",
    ),
    "wn03_ap_sigmoid_weights": (wn03_ap_sigmoid_weights, f"WITH {SQL_SCORES}, {_sql_cells(2)}, {_SQL_SIGMOID} SELECT capture_id, frame_idx, cy, cx, rank::INT AS rank, round(w, 6) AS w FROM weights"),
    "ag13_two_stage_stack": (
        ag13_two_stage_stack,
        f"WITH {SQL_SCORES}, {_sql_cells(2)}, {_SQL_SIGMOID}, {_sql_tiles(4, 'px', 'capture_id, frame_idx, p, v', True)} SELECT capture_id, p::INT AS px, round(sum(v * near.w * weights.w) / sum(near.w * weights.w), 6) AS value FROM near JOIN weights ON near.capture_id = weights.capture_id AND near.frame_idx = weights.frame_idx AND ty = cy AND tx = cx GROUP BY near.capture_id, p".replace("SELECT capture_id, p::INT", "SELECT near.capture_id, p::INT"),
    ),
    "ag14_drizzle2x": (
        ag14_drizzle2x,
        f"""WITH {SQL_KEPT}, d AS (SELECT capture_id, v, x * 2 + i AS ox, y * 2 + j AS oy, (x + 0.125::DOUBLE) * 2 AS x0, (x + 0.875::DOUBLE) * 2 AS x1, (y + 0.125::DOUBLE) * 2 AS y0, (y + 0.875::DOUBLE) * 2 AS y1
  FROM px SEMI JOIN kept USING (capture_id, frame_idx), range(2) a(i), range(2) b(j)),
c AS (SELECT *, greatest(least(x1, ox + 1) - greatest(x0, ox), 0) * greatest(least(y1, oy + 1) - greatest(y0, oy), 0) AS a FROM d)
SELECT capture_id, ox::INT AS ox, oy::INT AS oy, round(CASE WHEN sum(a) > 0 THEN sum(v * a) / sum(a) ELSE 0 END, 6) AS value, round(sum(a), 6) AS weight FROM c GROUP BY ALL""",
    ),
    "ag15_local_accumulate": (
        ag15_local_accumulate,
        f"""WITH {SQL_PIXELS}, u AS (SELECT *, least(greatest((x + 0.5::DOUBLE) / 2 - 0.5::DOUBLE, 0), 3) AS ux, least(greatest((y + 0.5::DOUBLE) / 2 - 0.5::DOUBLE, 0), 3) AS uy FROM px),
s AS (SELECT *, x - ({SQL_DX}) - ({_sql_map("((frame_idx + ax + ay * 2) % 3 - 1) * 0.25::DOUBLE")}) AS sx, y - ({SQL_DY}) - ({_sql_map("((frame_idx + ax * 2 + ay) % 5 - 2) * 0.125::DOUBLE")}) AS sy FROM u),
m AS (SELECT capture_id, frame_idx, p, {sql_sample("sx", "sy", "clamp")} AS v FROM s)
SELECT capture_id, p::INT AS px, round(sum(v * (1 + frame_idx % 2)) / sum(1.0::DOUBLE + frame_idx % 2), 6) AS value FROM m GROUP BY ALL""",
    ),
    "ag17_calibration_masters": (
        ag17_calibration_masters,
        f"""WITH {SQL_PIXELS}, d AS (SELECT capture_id, p, avg(v) AS dark FROM px WHERE frame_idx % 2 = 0 GROUP BY ALL), m AS (SELECT capture_id, p, avg(v) AS value FROM px WHERE frame_idx % 2 = 1 GROUP BY ALL),
j AS (SELECT *, avg(value - dark) OVER (PARTITION BY capture_id) AS mean FROM m JOIN d USING (capture_id, p))
SELECT capture_id, p::INT AS px, round(dark, 6) AS dark, round(CASE WHEN mean > 0 THEN (value - dark) / mean ELSE 1 END, 4) AS flat FROM j""",
    ),
    "px01_calibrate": (
        px01_calibrate,
        f"""WITH {SQL_PIXELS}, d AS (SELECT capture_id, p, avg(v) AS dark FROM px WHERE frame_idx % 2 = 0 GROUP BY ALL)
SELECT capture_id, frame_idx, p::INT AS px, round(greatest(0, (v - dark) / (0.5::DOUBLE + x * 0.125::DOUBLE)), 6) AS value FROM px JOIN d USING (capture_id, p) WHERE frame_idx % 2 = 1""",
    ),
    "pr07_shift_clamp": (pr07_shift_clamp, f"WITH {SQL_PIXELS}, {_sql_moved('1.25::DOUBLE', '-0.5::DOUBLE', 'clamp')} SELECT capture_id, frame_idx, p::INT AS px, round(v, 6) AS v FROM moved"),
    "pr08_bilinear_shift": (pr08_bilinear_shift, f"WITH {SQL_PIXELS}, {_sql_moved('0.5::DOUBLE', '-0.25::DOUBLE', 'zero')} SELECT capture_id, frame_idx, p::INT AS px, round(v, 6) AS v FROM moved"),
    "pr12_pixel_tiles": (pr12_pixel_tiles, f"WITH one AS (SELECT p, p % 8 AS x, p // 8 AS y FROM range(64) r(p)), {_sql_tiles(2, 'one', 'p')} SELECT p::INT AS px, ty, tx, round(w, 6) AS w FROM near"),
    "pr13_pixel_tiles_cosine": (pr13_pixel_tiles_cosine, f"WITH one AS (SELECT p, p % 8 AS x, p // 8 AS y FROM range(64) r(p)), {_sql_tiles(2, 'one', 'p', True)} SELECT p::INT AS px, ty, tx, round(sum(w), 6) AS w FROM near GROUP BY ALL"),
}
