"""Planning of alignment cells, geometry decisions, small registrations and catalogue joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from framequery.functions.rules import clamp
from framequery.operators.frames import SIDE, lapd
from framequery.operators.reduce import exploded


def cell_plan(frames: DataFrame, grid: int, reject: float = 0.2, min_luma: float = 0.05, side: int = SIDE) -> DataFrame:
    """(capture_id, frame_idx, cy, cx, score, luma, kept): score is the sum of |LAPD| over the inside of each cell (0 for
    cells under 3 pixels), luma its mean. Cells darker than min_luma x the frame's peak go first, then the lowest
    `reject` of the rest by score (rounded half up)."""
    cell = side // grid
    long = exploded(frames)
    field = frames.select("capture_id", "frame_idx", F.posexplode(lapd(F.col("plane"), side)).alias("px", "l"))
    placed = long.join(field, ["capture_id", "frame_idx", "px"]).withColumns({"cy": F.floor(F.col("y") / cell).cast("int"), "cx": F.floor(F.col("x") / cell).cast("int")})
    placed = placed.where((F.col("cy") < grid) & (F.col("cx") < grid))
    inside = (F.col("x") % cell).between(1, cell - 2) & (F.col("y") % cell).between(1, cell - 2)
    frame = Window.partitionBy("capture_id", "frame_idx")
    peaks = placed.withColumn("_peak", F.greatest(F.lit(0.0), F.max("v").over(frame)))
    cells = peaks.groupBy("capture_id", "frame_idx", "cy", "cx", "_peak").agg(F.sum(F.when(inside, F.abs("l")).otherwise(F.lit(0.0))).alias("score"), F.avg("v").alias("luma"))
    lit = cells.withColumn("_lit", F.col("luma") >= F.lit(min_luma) * F.col("_peak"))
    by = Window.partitionBy("capture_id", "frame_idx", "_lit")
    ranked = lit.withColumns({"_r": F.row_number().over(by.orderBy("score", "cy", "cx")), "_n": F.count(F.lit(1)).over(by)})
    kept = F.col("_lit") & (F.col("_r") > F.floor(F.lit(reject) * F.col("_n") + F.lit(0.5)))
    return ranked.select("capture_id", "frame_idx", "cy", "cx", "score", "luma", kept.alias("kept"))


def disc_tiles(frames: DataFrame, tile: int, level: float = 0.9, share: float = 0.5, side: int = SIDE) -> DataFrame:
    """(capture_id, frame_idx, ty, tx, disc): more than `share` of a tile's pixels are above level x the frame's peak."""
    peak = F.array_max("plane")
    long = exploded(frames.withColumn("_peak", peak))
    bright = (F.col("v") > F.lit(level) * F.col("_peak")).cast("double")
    return long.groupBy("capture_id", "frame_idx", F.floor(F.col("y") / tile).cast("int").alias("ty"), F.floor(F.col("x") / tile).cast("int").alias("tx")).agg((F.avg(bright) > share).alias("disc"))


def mask_disc(plane: Column, level: float = 0.9) -> Column:
    """Pixels above level x peak become the upper median of the others (the plane itself where there are none)."""
    cut = F.lit(level) * F.array_max(plane)
    rest = F.array_sort(F.filter(plane, lambda v: v <= cut))
    fill = F.get(rest, F.floor(F.size(rest) / 2).cast("int"))
    return F.transform(plane, lambda v: F.when((v > cut) & (F.size(rest) > 0), fill).otherwise(v))


def patch_fallback(target: Column, prior: Column, min_dim: Column, active: Column) -> Column:
    """Half patch without a measured PSF: by the share of active cells where it is known, else by target."""
    upper = F.greatest(F.lit(8), F.floor(min_dim / 8))
    base = F.when(target.isin("Sun", "Mars"), 12).when(target.isin("Moon", "Jupiter"), 16).when(target == "Saturn", 18).otherwise(F.when(prior > 0, prior).otherwise(16))

    def held(v: Column, low: int, high: int) -> Column:
        return F.least(F.greatest(v, F.lit(low)), F.least(F.lit(high), upper))

    by_ratio = F.when(active > 0.60, held(F.floor(min_dim / 32), 12, 24)).when(active < 0.25, held(F.lit(10), 8, 14)).otherwise(held(F.floor(min_dim / 48), 10, 20))
    return F.when(active.isNotNull(), by_ratio).otherwise(held(base, 8, 32)).cast("int")


def alignment_grid(min_dim: Column, patch: Column, disc_radius: Column) -> Column:
    """Cells a side: from a disc over 20 px (6..24), else from the frame (8..32)."""
    disc = clamp(F.round(disc_radius * 2 / (patch * 3)), 6, 24)
    return F.when(disc_radius > 20, disc).otherwise(clamp(F.round(min_dim / (patch * 8)), 8, 32)).cast("int")


def deconvolution_tile(min_dim: Column, disc_radius: Column) -> tuple[Column, Column]:
    """Tile (to 100, 200..1024) and overlap (a seventh, 20 at least)."""
    raw = F.when(disc_radius > 50, disc_radius * 8).otherwise(min_dim / 4)
    tile = clamp(F.round(raw / 100) * 100, 200, 1024).cast("int")
    return tile, F.greatest(F.lit(20), F.floor(tile / 7)).cast("int")


def refined_grid(scores: DataFrame, by: list[str], grid: int, patch: int, side: int, most: int = 32) -> DataFrame:
    """(by, grid): doubled where over 5 % of cells exceed three times the upper median of positive scores, as long as
    the new cells hold a patch."""
    w = Window.partitionBy(*by)
    lit = scores.where(F.col("score") > 0).withColumns({"_r": F.row_number().over(w.orderBy("score")) - 1, "_n": F.count(F.lit(1)).over(w)})
    median = lit.where(F.col("_r") == F.floor(F.col("_n") / 2)).select(*by, F.col("score").alias("_median"))
    hot = scores.join(median, by, "left").groupBy(*by).agg(F.avg(F.coalesce(F.col("score") > 3 * F.col("_median"), F.lit(False)).cast("double")).alias("_hot"))
    wanted = min(most, 2 * grid)
    fits = wanted > grid and side // wanted >= 2 * patch
    return hot.select(*by, F.when((F.col("_hot") > 0.05) & F.lit(fits), F.lit(wanted)).otherwise(F.lit(grid)).alias("grid"))


def remap_mode(median: Column, white: Column) -> Column:
    """Output tone by the picture's median and 99.8th percentile."""
    return F.when((white > 0.5) & (median >= 0.3), "wide_bright").when(white > 0.5, "bright_peak").otherwise("identity")


def accumulator(two_stage: Column, drizzle_scale: Column, sigma: Column) -> Column:
    return F.when(two_stage, "two_stage").when(drizzle_scale > 1, "drizzle").when(sigma > 0, "sigma_clip").otherwise("standard")


def parabola(left: Column, centre: Column, right: Column) -> Column:
    """Sub-pixel peak of three values, within half a pixel; 0 where they lie on a line."""
    bend = left - F.lit(2.0) * centre + right
    return F.when(F.abs(bend) < 1e-8, F.lit(0.0)).otherwise(clamp(F.try_divide(F.lit(0.5) * (left - right), bend), -0.5, 0.5))


def sad_search(frames: DataFrame, reference: DataFrame, radius: int = 1, side: int = SIDE) -> DataFrame:
    """(capture_id, frame_idx, dx, dy, sad): whole-pixel shift of least mean absolute difference to the capture's
    reference plane, over the pixels that every shift covers; (0, 0) unless the least is 10 % below the mean of all
    candidates and not on the border of the search. The reference is one plane a capture."""
    inner = F.filter(F.sequence(F.lit(0), F.lit(side * side - 1)), lambda p: (p % side).between(radius, side - 1 - radius) & F.floor(p / side).between(radius, side - 1 - radius))
    tries = [(dx, dy) for dy in range(-radius, radius + 1) for dx in range(-radius, radius + 1)]

    def cost(dx: int, dy: int) -> Column:
        n = (side - 2 * radius) ** 2
        total = F.aggregate(inner, F.lit(0.0), lambda s, p: s + F.abs(F.get("ref", p) - F.get("plane", (p - dy * side - dx).cast("int"))))
        return F.struct((total / n).alias("sad"), F.lit(dx * dx + dy * dy).alias("far"), F.lit(dx).alias("dx"), F.lit(dy).alias("dy"))

    met = frames.join(reference.select("capture_id", F.col("plane").alias("ref")), "capture_id").withColumn("_all", F.array(*(cost(*t) for t in tries)))
    held = met.select("capture_id", "frame_idx", "_all", F.array_min("_all").alias("_best"))
    mean = F.aggregate("_all", F.lit(0.0), lambda s, c: s + c["sad"]) / len(tries)
    good = (F.col("_best.sad") <= F.lit(0.9) * mean) & (F.greatest(F.abs("_best.dx"), F.abs("_best.dy")) < radius)
    return held.select("capture_id", "frame_idx", F.when(good, F.col("_best.dx")).otherwise(0).alias("dx"), F.when(good, F.col("_best.dy")).otherwise(0).alias("dy"), F.col("_best.sad").alias("sad"))


def best_window(frames: DataFrame, size: int, saturated: float, side: int = SIDE) -> DataFrame:
    """(capture_id, frame_idx, x0, y0, score): the window of greatest |LAPD| sum without a saturated pixel; ties go to
    the upper left. Summed-area by explosion: each pixel goes to the size^2 windows that hold it."""
    field = frames.select("capture_id", "frame_idx", F.posexplode(lapd(F.col("plane"), side)).alias("px", "l"))
    long = exploded(frames).join(field, ["capture_id", "frame_idx", "px"])
    last = side - size
    spots = F.explode(F.array(*(F.struct((F.col("x") - i).alias("x0"), (F.col("y") - j).alias("y0")) for i in range(size) for j in range(size))))
    windows = long.withColumn("_s", spots).where(F.col("_s.x0").between(0, last) & F.col("_s.y0").between(0, last))
    sums = windows.groupBy("capture_id", "frame_idx", "_s.x0", "_s.y0").agg(F.sum(F.abs("l")).alias("score"), F.max("v").alias("_peak")).where(F.col("_peak") < saturated)
    by = Window.partitionBy("capture_id", "frame_idx").orderBy(F.round("score", 9).desc(), "y0", "x0")
    return sums.withColumn("_r", F.row_number().over(by)).where("_r = 1").select("capture_id", "frame_idx", "x0", "y0", "score")


def variance_partials(frames: DataFrame, group: int, side: int = SIDE) -> DataFrame:
    """(capture_id, frame_idx, gy, gx, s, q, n): sums, sums of squares and counts of the LAPD field per square group."""
    field = frames.select("capture_id", "frame_idx", F.posexplode(lapd(F.col("plane"), side)).alias("px", "l"))
    gy, gx = F.floor(F.floor(F.col("px") / side) / group).cast("int"), F.floor((F.col("px") % side) / group).cast("int")
    return field.groupBy("capture_id", "frame_idx", gy.alias("gy"), gx.alias("gx")).agg(F.sum("l").alias("s"), F.sum(F.col("l") * F.col("l")).alias("q"), F.count(F.lit(1)).alias("n"))


def merged_variance(partials: DataFrame, by: list[str]) -> DataFrame:
    """Variance of merged partials, held at 0 from below."""
    m = partials.groupBy(*by).agg(F.sum("s").alias("s"), F.sum("q").alias("q"), F.sum("n").alias("n"))
    mean = F.col("s") / F.col("n")
    return m.select(*by, F.greatest(F.lit(0.0), F.col("q") / F.col("n") - mean * mean).alias("score"))


def first_sibling(files: DataFrame, siblings: DataFrame, key: str, ext: str, order: list[str]) -> DataFrame:
    """files with the sibling of the same key whose extension comes first in `order`; NULL for none."""
    rank = F.array_position(F.array(*map(F.lit, order)), F.col(ext))
    best = siblings.where(rank > 0).groupBy(key).agg(F.min_by(ext, rank).alias("sibling"))
    return files.join(best, key, "left")


def cached_quality(files: DataFrame, cache: DataFrame, path: str, fingerprint: str, value: str) -> DataFrame:
    """files with the cached value where path and fingerprint both agree; a changed file misses."""
    return files.join(cache.select(path, fingerprint, value), [path, fingerprint], "left")
