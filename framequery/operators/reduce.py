"""Reducing the kept frames of a capture to one image: means, clipped means, tiles, drizzle, calibration masters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from framequery.operators.frames import SIDE, lapd, variance


def exploded(frames: DataFrame, side: int = SIDE) -> DataFrame:
    """frames with one row per pixel (px, x, y, v) beside all columns but the plane."""
    rest = [c for c in frames.columns if c != "plane"]
    long = frames.select(*rest, F.posexplode("plane").alias("px", "v"))
    return long.withColumns({"x": F.col("px") % side, "y": F.floor(F.col("px") / side).cast("int")})


def mean_plane(frames: DataFrame, by: tuple[str, ...] = ("capture_id",)) -> DataFrame:
    """Plain mean of each pixel."""
    return exploded(frames).groupBy(*by, "px").agg(F.avg("v").alias("value"))


def sample_bilinear(plane: Column, sx: Column, sy: Column, side: int = SIDE, outside: str = "null") -> Column:
    """The plane at (sx, sy) from its four neighbours. outside: 'null' drops samples beyond the frame, 'zero' reads the
    missing neighbours as 0, 'clamp' repeats the edge."""
    if outside == "clamp":
        top = F.lit(float(side - 1))
        sx, sy = F.least(F.greatest(sx, F.lit(0.0)), top), F.least(F.greatest(sy, F.lit(0.0)), top)
    x0, y0 = F.floor(sx), F.floor(sy)
    fx, fy = sx - x0, sy - y0

    def at(dx: int, dy: int) -> Column:
        x, y = x0 + dx, y0 + dy
        if outside == "clamp":
            x, y = F.least(x, F.lit(side - 1)), F.least(y, F.lit(side - 1))
            return F.get(plane, (y * side + x).cast("int"))
        inside = x.between(0, side - 1) & y.between(0, side - 1)
        return F.when(inside, F.get(plane, (y * side + x).cast("int"))).otherwise(F.lit(0.0))

    one = F.lit(1.0)
    value = at(0, 0) * (one - fx) * (one - fy) + at(1, 0) * fx * (one - fy) + at(0, 1) * (one - fx) * fy + at(1, 1) * fx * fy
    if outside == "null":
        return F.when(sx.between(0, side - 1) & sy.between(0, side - 1), value)
    return value


def shifted(frames: DataFrame, dx: Column, dy: Column, outside: str = "zero", side: int = SIDE) -> DataFrame:
    """Each frame moved by (dx, dy): pixel (x, y) reads (x - dx, y - dy). The plane stays an array in its row."""

    def one(p: Column) -> Column:
        return sample_bilinear(F.col("plane"), (p % side) - F.col("_dx"), F.floor(p / side) - F.col("_dy"), side, outside)

    moved = frames.withColumns({"_dx": dx.cast("double"), "_dy": dy.cast("double")})
    return moved.withColumn("plane", F.transform(F.sequence(F.lit(0), F.size("plane") - 1), one)).drop("_dx", "_dy")


def locally_shifted(frames: DataFrame, dx: Column, dy: Column, local: DataFrame, grid: int, side: int = SIDE) -> DataFrame:
    """Each frame moved by (dx, dy) plus a shift map's bilinear sample at each pixel; edges repeat.
    local: (capture_id, frame_idx, ay, ax, dx, dy), one row a cell of a grid x grid map. A frame without a map, or a
    cell without a row, has the local shift 0. The map joins its frame as one small array."""
    cell = F.struct((F.col("ay") * grid + F.col("ax")).cast("int"), F.struct(F.col("dx").cast("double").alias("x"), F.col("dy").cast("double").alias("y")))
    maps = local.groupBy(F.col("capture_id").alias("_capture"), F.col("frame_idx").alias("_frame")).agg(F.map_from_entries(F.collect_list(cell)).alias("_held"))
    zero = F.struct(F.lit(0.0).alias("x"), F.lit(0.0).alias("y"))
    flat = F.transform(F.sequence(F.lit(0), F.lit(grid * grid - 1)), lambda c: F.coalesce(F.try_element_at("_held", c), zero))
    own = F.col("capture_id").eqNullSafe(F.col("_capture")) & (F.col("frame_idx") == F.col("_frame"))
    moved = frames.withColumns({"_dx": dx.cast("double"), "_dy": dy.cast("double")}).join(maps, own, "left").withColumn("_flat", flat)
    moved = moved.withColumns({f"_map_{a}": F.col("_flat").getField(a) for a in ("x", "y")})

    def from_map(p: Column) -> Column:
        ux, uy = ((v + F.lit(0.5)) * F.lit(grid / side) - F.lit(0.5) for v in (p % side, F.floor(p / side)))
        both = {a: sample_bilinear(F.col(f"_map_{a}"), ux, uy, grid, "clamp") for a in ("x", "y")}
        return F.struct(((p % side) - F.col("_dx") - both["x"]).alias("x"), (F.floor(p / side) - F.col("_dy") - both["y"]).alias("y"))

    at = F.transform(F.sequence(F.lit(0), F.size("plane") - 1), from_map)
    read = F.transform("_at", lambda s: sample_bilinear(F.col("plane"), s["x"], s["y"], side, "clamp"))
    return moved.withColumn("_at", at).withColumn("plane", read).select(frames.columns)


def coverage_mean(frames: DataFrame, weight: Column) -> DataFrame:
    """Weighted mean over the samples that lie in their frame; NULL samples carry no weight, and weights have a floor."""
    long = exploded(frames.withColumn("_w", weight)).where(F.col("v").isNotNull())
    return long.groupBy("capture_id", "px").agg(
        (F.sum(F.col("v") * F.col("_w")) / F.greatest(F.sum("_w"), F.lit(1e-6))).alias("value"), F.sum("_w").alias("coverage")
    )


def sigma_clipped_plane(frames: DataFrame, k: float = 2.5, rounds: int = 1) -> DataFrame:
    """(capture_id, px, value, n_kept): `rounds` times, the values further than k population deviations from a pixel's
    mean go and both are taken anew. Where none is left the mean before stays and n_kept is 0.

    A round sums map-side and joins its moments back as one plane a capture, so pixels never shuffle by themselves."""

    def moments(held: DataFrame, before: Column) -> DataFrame:
        long = held.select("capture_id", F.posexplode(F.arrays_zip(F.col("plane").alias("v"), before.alias("b"))).alias("px", "z"))
        mu, sd = F.avg("z.v"), F.stddev_pop("z.v")
        return long.groupBy("capture_id", "px").agg(
            F.coalesce(mu, F.max("z.b.mu")).alias("mu"), F.coalesce(sd, F.max("z.b.sd")).alias("sd"), F.count("z.v").alias("n_kept")
        )

    held = frames.select("capture_id", "plane")
    none = F.transform("plane", lambda _: F.lit(None).cast("struct<mu:double,sd:double>"))
    found = moments(held, none)
    for _ in range(rounds):
        plane = F.transform(F.array_sort(F.collect_list(F.struct("px", "mu", "sd"))), lambda m: F.struct(m["mu"].alias("mu"), m["sd"].alias("sd")))
        bounds = found.groupBy(F.col("capture_id").alias("_capture")).agg(plane.alias("_bounds"))
        met = held.join(bounds, F.col("capture_id").eqNullSafe(F.col("_capture")))
        near = F.zip_with("plane", "_bounds", lambda v, b: F.when(F.abs(v - b["mu"]) <= F.lit(k) * b["sd"] + F.lit(1e-12), v))
        cut = met.select("capture_id", near.alias("plane"), "_bounds")
        found, held = moments(cut, F.col("_bounds")), cut.select("capture_id", "plane")
    return found.select("capture_id", "px", F.col("mu").alias("value"), "n_kept")


def clipped_mean(values: Column, k: float = 2.5, rounds: int = 3) -> Column:
    """Iterated sigma-clipped mean of an array: clip around the mean, take the mean anew; an empty rest keeps the mean.
    NULL for an empty array. Later rounds that change nothing give the same mean, so no early stop is needed."""

    def stats(v: Column) -> Column:
        n = F.size(v).cast("double")
        mean = F.aggregate(v, F.lit(0.0), lambda a, x: a + x) / n
        return F.struct(mean.alias("mu"), F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + (x - mean) * (x - mean)) / n).alias("sd"))

    # A fold over rounds whose state holds the surviving values, so that each round reads them once.
    def again(state: Column, _: Column) -> Column:
        kept = F.filter(state["v"], lambda x: F.abs(x - state["mu"]) <= F.lit(k) * state["sd"] + F.lit(1e-12))
        s = stats(kept)
        return F.when(F.size(kept) == 0, state).otherwise(F.struct(kept.alias("v"), s["mu"].alias("mu"), s["sd"].alias("sd")))

    first = F.struct(values.alias("v"), stats(values)["mu"].alias("mu"), stats(values)["sd"].alias("sd"))
    folded = F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), first, again)
    return F.when(F.size(values) > 0, folded["mu"])


def tile_scores(frames: DataFrame, tile: int, side: int = SIDE) -> DataFrame:
    """(capture_id, frame_idx, ty, tx, score, brightness): variance and mean of the LAPD field per tile. The mean is
    the so-called brightness, which averages Laplacian values."""
    field = frames.select("capture_id", "frame_idx", F.posexplode(lapd(F.col("plane"), side)).alias("px", "l"))
    ty, tx = F.floor(F.floor(F.col("px") / side) / tile).cast("int"), F.floor((F.col("px") % side) / tile).cast("int")
    return field.groupBy("capture_id", "frame_idx", ty.alias("ty"), tx.alias("tx")).agg(F.var_pop("l").alias("score"), F.avg("l").alias("brightness"))


def cell_scores(frames: DataFrame, grid: int, side: int = SIDE) -> DataFrame:
    """Variance of the LAPD field per cell of a grid; floor(side / grid) pixels a cell, the remainder is ignored."""
    cell = side // grid
    field = frames.select("capture_id", "frame_idx", F.posexplode(lapd(F.col("plane"), side)).alias("px", "l"))
    cy, cx = F.floor(F.floor(F.col("px") / side) / cell).cast("int"), F.floor((F.col("px") % side) / cell).cast("int")
    placed = field.withColumns({"cy": cy, "cx": cx}).where((F.col("cy") < grid) & (F.col("cx") < grid))
    return placed.groupBy("capture_id", "frame_idx", "cy", "cx").agg(F.var_pop("l").alias("score"))


def cross_laplacian(frames: DataFrame, side: int = SIDE) -> DataFrame:
    """Variance of the 4-neighbour Laplacian over the interior only."""
    plane = F.col("plane")
    inner = F.filter(F.sequence(F.lit(0), F.size(plane) - 1), lambda p: (p % side).between(1, side - 2) & F.floor(p / side).between(1, side - 2))
    values = F.transform(
        inner, lambda p: F.get(plane, p - 1) + F.get(plane, p + 1) + F.get(plane, p - side) + F.get(plane, p + side) - F.lit(4.0) * F.get(plane, p)
    )
    return frames.withColumn("_l", values).withColumn("score", variance(F.col("_l"))).drop("_l")


def tile_of_pixel(long: DataFrame, tile: int, side: int = SIDE, cosine: bool = False) -> DataFrame:
    """Each pixel's four nearest tiles with bilinear or raised-cosine weights (they sum to 1): rows (.., ty, tx, w)."""
    tiles = side // tile
    fx = F.least(F.greatest((F.col("x") + F.lit(0.5)) / tile - F.lit(0.5), F.lit(0.0)), F.lit(float(tiles - 1)))
    fy = F.least(F.greatest((F.col("y") + F.lit(0.5)) / tile - F.lit(0.5), F.lit(0.0)), F.lit(float(tiles - 1)))

    def ease(d: Column) -> Column:
        return (F.lit(1.0) - F.cos(F.lit(3.141592653589793) * d)) / F.lit(2.0) if cosine else d

    placed = long.withColumns({"_x0": F.floor(fx).cast("int"), "_y0": F.floor(fy).cast("int"), "_fx": ease(fx - F.floor(fx)), "_fy": ease(fy - F.floor(fy))})

    def corner(dx: int, dy: int) -> Column:
        w = (F.col("_fx") if dx else F.lit(1.0) - F.col("_fx")) * (F.col("_fy") if dy else F.lit(1.0) - F.col("_fy"))
        return F.struct(F.least(F.col("_y0") + dy, F.lit(tiles - 1)).alias("ty"), F.least(F.col("_x0") + dx, F.lit(tiles - 1)).alias("tx"), w.alias("w"))

    near = placed.withColumn("_t", F.explode(F.array(corner(0, 0), corner(1, 0), corner(0, 1), corner(1, 1)))).where(F.col("_t.w") > 0)
    return near.select(*long.columns, "_t.ty", "_t.tx", F.col("_t.w").alias("w"))


def region_selection(tiles: DataFrame, fraction: float = 1.0, min_k: int = 1, max_k: int = 1) -> DataFrame:
    """Per tile the best frames: while the score is at least fraction x best, min_k at least and max_k at most."""
    by = Window.partitionBy("capture_id", "ty", "tx").orderBy(F.col("score").desc(), F.col("frame_idx"))
    ranked = tiles.withColumns({"rank": F.row_number().over(by), "best": F.first("score").over(by)})
    good = (F.col("rank") <= min_k) | (F.col("score") >= F.lit(fraction) * F.col("best"))
    return ranked.where(good & (F.col("rank") <= max_k)).select("capture_id", "ty", "tx", "rank", "frame_idx")


def pixel_weight(p: Column, weights: Column, tile: int, side: int = SIDE, cosine: bool = False) -> Column:
    """Pixel p's blend of the weights of its four nearest tiles (an array in row order), as tile_of_pixel blends them."""
    tiles = side // tile
    gx = F.least(F.greatest((p % side + F.lit(0.5)) / tile - F.lit(0.5), F.lit(0.0)), F.lit(float(tiles - 1)))
    gy = F.least(F.greatest((F.floor(p / side) + F.lit(0.5)) / tile - F.lit(0.5), F.lit(0.0)), F.lit(float(tiles - 1)))

    def axis(g: Column, far: int) -> tuple[Column, Column]:
        d = g - F.floor(g)
        d = (F.lit(1.0) - F.cos(F.lit(3.141592653589793) * d)) / F.lit(2.0) if cosine else d
        return F.least(F.floor(g) + far, F.lit(tiles - 1)), d if far else F.lit(1.0) - d

    total = F.lit(0.0)
    for dy in (0, 1):
        for dx in (0, 1):
            (ty, fy), (tx, fx) = axis(gy, dy), axis(gx, dx)
            total = total + fx * fy * F.get(weights, (ty * tiles + tx).cast("int"))
    return total


def tile_weighted_mean(frames: DataFrame, weights: DataFrame, tile: int, side: int = SIDE, cosine: bool = False) -> DataFrame:
    """(capture_id, px, value): mean of frames by weights (capture_id, frame_idx, ty, tx, w) of their tiles, blended between
    tiles. A frame's weights join it as one small array, so frames without any never explode and pixels only sum."""
    tiles = side // tile
    held = F.map_from_entries(F.collect_list(F.struct((F.col("ty") * tiles + F.col("tx")).cast("int"), "w")))
    own = weights.groupBy("capture_id", "frame_idx").agg(held.alias("_held"))
    flat = F.transform(F.sequence(F.lit(0), F.lit(tiles * tiles - 1)), lambda t: F.coalesce(F.try_element_at("_held", t), F.lit(0.0)))
    met = frames.select("capture_id", "frame_idx", "plane").join(own, ["capture_id", "frame_idx"]).withColumn("_flat", flat)
    weighed = F.transform("plane", lambda v, p: F.struct(v.alias("v"), pixel_weight(p, F.col("_flat"), tile, side, cosine).alias("w")))
    long = met.select("capture_id", F.posexplode(weighed).alias("px", "z")).where(F.col("z.w") > 0)
    return long.groupBy("capture_id", "px").agg((F.sum(F.col("z.v") * F.col("z.w")) / F.sum("z.w")).alias("value"))


def region_stack(frames: DataFrame, selection: DataFrame, tile: int, side: int = SIDE) -> DataFrame:
    """Blend of the frames selected per tile: equal weights within a tile, bilinear weights between tiles."""
    share = F.lit(1.0) / F.count(F.lit(1)).over(Window.partitionBy("capture_id", "ty", "tx"))
    return tile_weighted_mean(frames, selection.withColumn("w", share), tile, side)


def sigmoid_weights(cells: DataFrame, fraction: float) -> DataFrame:
    """Rank-sigmoid weight of each frame in each cell: 1 / (1 + e^((rank - k) / max(1, 0.2 n))), rank from 0."""
    by = Window.partitionBy("capture_id", "cy", "cx")
    n = F.count(F.lit(1)).over(by)
    k = F.greatest(F.lit(1), F.ceil(n * F.lit(min(1.0, max(0.01, fraction)))))
    rank = F.row_number().over(by.orderBy(F.col("score").desc(), F.col("frame_idx"))) - 1
    return cells.withColumn("rank", rank).withColumn("w", F.lit(1.0) / (F.lit(1.0) + F.exp((F.col("rank") - k) / F.greatest(F.lit(1.0), F.lit(0.2) * n))))


def two_stage_stack(frames: DataFrame, weights: DataFrame, grid: int, side: int = SIDE) -> DataFrame:
    """Per-cell weights, blended between cells by raised cosines: Sum(v b w) / Sum(b w) per pixel."""
    own = weights.select("capture_id", "frame_idx", F.col("cy").alias("ty"), F.col("cx").alias("tx"), "w")
    return tile_weighted_mean(frames, own, side // grid, side, cosine=True)


def drizzle(frames: DataFrame, scale: int, pixfrac: float, side: int = SIDE) -> DataFrame:
    """Each pixel drops a square of pixfrac input pixels on a grid `scale` times finer; outputs average by overlap area.
    Rows (capture_id, ox, oy, value, weight) of all output pixels; those that nothing falls on have value 0."""
    half = pixfrac / 2
    long = exploded(frames).select("capture_id", "x", "y", "v")
    edges = {
        "x0": (F.col("x") + F.lit(0.5 - half)) * scale, "x1": (F.col("x") + F.lit(0.5 + half)) * scale,
        "y0": (F.col("y") + F.lit(0.5 - half)) * scale, "y1": (F.col("y") + F.lit(0.5 + half)) * scale,
    }
    drops = long.withColumns(edges)
    reach = range(scale)
    out = F.explode(F.array(*(F.struct((F.col("x") * scale + i).alias("ox"), (F.col("y") * scale + j).alias("oy")) for i in reach for j in reach)))
    cells = drops.withColumn("o", out).select("*", "o.ox", "o.oy")
    wide = F.least(F.col("x1"), F.col("ox") + F.lit(1.0)) - F.greatest(F.col("x0"), F.col("ox").cast("double"))
    high = F.least(F.col("y1"), F.col("oy") + F.lit(1.0)) - F.greatest(F.col("y0"), F.col("oy").cast("double"))
    area = F.greatest(wide, F.lit(0.0)) * F.greatest(high, F.lit(0.0))
    summed = cells.withColumn("a", area).groupBy("capture_id", "ox", "oy").agg(F.sum(F.col("v") * F.col("a")).alias("s"), F.sum("a").alias("weight"))
    return summed.select("capture_id", "ox", "oy", F.when(F.col("weight") > 0, F.try_divide("s", "weight")).otherwise(F.lit(0.0)).alias("value"), "weight")


def master_flat(flats: DataFrame, dark: DataFrame) -> DataFrame:
    """(capture_id, px, value): mean flat less dark, over its own mean; 1 where that mean isn't positive."""
    less = mean_plane(flats).join(dark.withColumnRenamed("value", "dark"), ["capture_id", "px"]).withColumn("d", F.col("value") - F.col("dark"))
    mean = F.avg("d").over(Window.partitionBy("capture_id"))
    return less.select("capture_id", "px", F.when(mean > 0, F.try_divide(F.col("d"), mean)).otherwise(F.lit(1.0)).alias("value"))


def calibrate(light: Column, dark: Column, flat: Column) -> Column:
    """max(0, (light - dark) / flat), without the division where the flat is at most 1e-4."""
    less = light - dark
    return F.greatest(F.lit(0.0), F.when(flat > F.lit(1e-4), F.try_divide(less, flat)).otherwise(less))
