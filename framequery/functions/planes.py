"""Measures of a plane inside its row: centroids and the polar profile. No pixel leaves the row, so none is shuffled."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from framequery.functions.stats import upper_median


def moments(plane: Column, side: int, weight: Callable[[Column], Column]) -> Column:
    """(s, x, y): the sum of the positive weights, and of them times column and row."""
    zero = F.struct(F.lit(0.0).alias("s"), F.lit(0.0).alias("x"), F.lit(0.0).alias("y"))
    weights = F.transform(plane, lambda v, p: F.struct(F.greatest(weight(v), F.lit(0.0)).alias("w"), p.alias("p")))

    def add(a: Column, z: Column) -> Column:
        w, p = z["w"], z["p"]
        return F.struct((a["s"] + w).alias("s"), (a["x"] + w * (p % side)).alias("x"), (a["y"] + w * F.floor(p / side)).alias("y"))

    return F.aggregate(weights, zero, add)


def once(value: Column, f: Callable[[Column], Column]) -> Column:
    """f of a value that is worked out once a row, not once for each use and each pixel."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def _centre(found: Column, least: float = 0.0, fallback: float | None = None) -> Column:
    other = F.lit(fallback).cast("double")
    return once(found, lambda m: F.struct(*(F.when(m["s"] > least, m[a] / m["s"]).otherwise(other).alias(f"c{a}") for a in ("x", "y"))))


def bright_centroid(plane: Column, side: int, level: float = 0.30) -> Column:
    """(cx, cy) of the pixels above level x the peak, weighted by their value; NULL where there are none."""
    return once(F.lit(level) * F.array_max(plane), lambda cut: _centre(moments(plane, side, lambda v: F.when(v > cut, v).otherwise(F.lit(0.0)))))


def excess_centroid(plane: Column, side: int, level: float = 0.25) -> Column:
    """(cx, cy) weighted by what pixels have over level x the peak; NULL without a positive peak."""
    return once(F.lit(level) * F.array_max(plane), lambda cut: _centre(moments(plane, side, lambda v: F.when(cut > 0, v - cut).otherwise(F.lit(0.0)))))


def disc_centroid(plane: Column, side: int) -> Column:
    """(cx, cy) weighted by what pixels have over the background, the plane's upper median; the middle where nothing
    stands out."""
    return once(upper_median(F.array_sort(plane)), lambda background: _centre(moments(plane, side, lambda v: v - background), 1e-6, side / 2))


def polar_profile(plane: Column, side: int, cx: Column, cy: Column, radii: int, directions: int = 64) -> Column:
    """Mean value at each whole radius around (cx, cy), over evenly spread directions, bilinear; places whose four pixels
    aren't all inside don't count, and 0 stands where none counts."""
    turns = [2.0 * math.pi * d / directions for d in range(directions)]
    rays = F.array(*(F.struct(F.lit(math.cos(t)).alias("dx"), F.lit(math.sin(t)).alias("dy")) for t in turns))

    def at(r: Column) -> Column:
        def value(ray: Column) -> Column:
            x, y = cx + r * ray["dx"], cy + r * ray["dy"]
            x0, y0 = F.floor(x), F.floor(y)
            fx, fy = x - x0, y - y0
            p = (y0 * side + x0).cast("int")
            inside = (x0 >= 0) & (y0 >= 0) & (x0 + 1 < side) & (y0 + 1 < side)
            top = (1 - fx) * F.get(plane, p) + fx * F.get(plane, p + 1)
            low = (1 - fx) * F.get(plane, p + side) + fx * F.get(plane, p + side + 1)
            return F.when(inside, (1 - fy) * top + fy * low)

        seen = F.filter(F.transform(rays, value), lambda v: v.isNotNull())
        total = F.aggregate(seen, F.lit(0.0), lambda a, v: a + v)
        return F.when(F.size(seen) > 0, total / F.size(seen)).otherwise(F.lit(0.0))

    return F.transform(F.sequence(F.lit(0), F.lit(radii - 1)), lambda r: at(r.cast("double")))


def sampled(plane: Column, w: int, h: int, x: Column, y: Column) -> Column:
    """Bilinear value of a plane at (x, y), in pixels from the first one's centre; places outside are those of the edge."""
    x, y = F.least(F.greatest(x, F.lit(0.0)), F.lit(w - 1.0)), F.least(F.greatest(y, F.lit(0.0)), F.lit(h - 1.0))
    x0, y0 = F.floor(x).cast("int"), F.floor(y).cast("int")
    x1, y1 = F.least(x0 + 1, F.lit(w - 1)), F.least(y0 + 1, F.lit(h - 1))
    fx, fy = x - x0, y - y0
    top = (1 - fx) * F.get(plane, y0 * w + x0) + fx * F.get(plane, y0 * w + x1)
    low = (1 - fx) * F.get(plane, y1 * w + x0) + fx * F.get(plane, y1 * w + x1)
    return (1 - fy) * top + fy * low


def resampled(plane: Column, w: int, h: int, to_w: int, to_h: int) -> Column:
    """A w x h plane at another size, sampled bilinearly at the centres of the new pixels."""

    def value(k: Column) -> Column:
        x, y = k % to_w, F.floor(k / to_w)
        return sampled(plane, w, h, (x + F.lit(0.5)) * F.lit(w / to_w) - F.lit(0.5), (y + F.lit(0.5)) * F.lit(h / to_h) - F.lit(0.5))

    return F.transform(F.sequence(F.lit(0), F.lit(to_w * to_h - 1)), value)


def moved(plane: Column, w: int, h: int, dx: Column | float, dy: Column | float) -> Column:
    """A plane moved by (dx, dy) pixels, sampled bilinearly; the edge is repeated. Red and blue planes so moved align with
    green."""
    return F.transform(plane, lambda _, k: sampled(plane, w, h, k % w - dx, F.floor(k / w) - dy))


def half_flux_radius(plane: Column, side: int, width: float = 0.5) -> Column:
    """Radius around the flux centroid that holds half the positive flux, linear inside its radial bin; NULL where no value
    is positive."""
    total = moments(plane, side, lambda v: v)

    def radius(m: Column) -> Column:
        def bin_of(p: Column) -> Column:
            dx, dy = p % side - m["x"] / m["s"], F.floor(p / side) - m["y"] / m["s"]
            return F.floor(F.sqrt(dx * dx + dy * dy) / F.lit(width))

        lit = F.filter(F.transform(plane, lambda v, p: F.struct(bin_of(p).alias("bin"), v.alias("v"))), lambda z: z["v"] > 0)
        half = m["s"] / 2
        start = F.struct(F.lit(-1).cast("long").alias("bin"), F.lit(0.0).alias("before"), F.lit(0.0).alias("flux"))

        def add(a: Column, z: Column) -> Column:
            same = F.struct(a["bin"].alias("bin"), a["before"].alias("before"), (a["flux"] + z["v"]).alias("flux"))
            later = F.struct(z["bin"].alias("bin"), (a["before"] + a["flux"]).alias("before"), z["v"].alias("flux"))
            return F.when(a["bin"] == z["bin"], same).when(a["before"] + a["flux"] >= half, a).otherwise(later)

        end = F.aggregate(F.array_sort(lit), start, add)
        return F.get(F.transform(F.array(end), lambda a: (a["bin"] + (half - a["before"]) / a["flux"]) * F.lit(width)), F.lit(0))

    return F.get(F.transform(F.array(total), lambda m: F.when(m["s"] > 0, radius(m))), F.lit(0))
