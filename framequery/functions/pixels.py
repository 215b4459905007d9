"""Colour and tone of pixels as column expressions; each takes and gives values that are 1 at full scale."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def unit(v: Column) -> Column:
    return F.least(F.greatest(v, F.lit(0.0)), F.lit(1.0))


def luma709(r: Column, g: Column, b: Column) -> Column:
    return F.lit(0.2126) * r + F.lit(0.7152) * g + F.lit(0.0722) * b


def luma601(r: Column, g: Column, b: Column) -> Column:
    return F.lit(0.299) * r + F.lit(0.587) * g + F.lit(0.114) * b


def white_balance(v: Column, offset: Column | float, scale: Column | float) -> Column:
    return F.greatest((v - offset) * scale, F.lit(0.0))


def _from_purple(r: Column, g: Column, b: Column) -> tuple[Column, Column]:
    """Whether a pixel has colour (saturation of 5 % or more), and how far its hue is from 290 degrees."""
    top, low = F.greatest(r, g, b), F.least(r, g, b)
    span = top - low
    sector = F.when(top == r, F.try_divide(g - b, span)).when(top == g, F.try_divide(b - r, span) + F.lit(2.0)).otherwise(F.try_divide(r - g, span) + F.lit(4.0))
    hue = F.pmod(F.lit(60.0) * sector + F.lit(360.0), F.lit(360.0))
    off = F.abs(hue - F.lit(290.0))
    return (top > 0) & (F.try_divide(span, top) >= F.lit(0.05)), F.least(off, F.lit(360.0) - off)


def purple_factor(r: Column, g: Column, b: Column, strength: float = 1.0) -> Column:
    """Factor on the saturation: 1 - strength cos^2 within 30 degrees of hue 290; 1 for grey (saturation under 5 %)."""
    coloured, near = _from_purple(r, g, b)
    wave = F.cos(near / F.lit(30.0) * F.lit(1.5707963267948966))
    return F.when(coloured & (near < 30), F.lit(1.0) - F.lit(strength) * wave * wave).otherwise(F.lit(1.0))


def purple_gate(r: Column, g: Column, b: Column, least: float = 0.005) -> Column:
    """Aggregate over pixels: whether this share of them or more is purple, so that fringes are worth reducing."""
    coloured, near = _from_purple(r, g, b)
    return F.avg(F.coalesce(coloured & (near <= 30), F.lit(False)).cast("double")) >= F.lit(least)


def highlight_knee(v: Column, knee: float) -> Column:
    """Above the knee: knee + (1 - knee) tanh((v - knee) / (1 - knee))."""
    room = F.lit(1.0 - knee)
    return F.when(v <= F.lit(knee), v).otherwise(F.lit(knee) + room * F.tanh((v - F.lit(knee)) / room))


def auto_stretch(v: Column, low: Column, high: Column, gamma: float = 1.0) -> Column:
    return F.pow(unit(F.try_divide(v - low, F.greatest(high - low, F.lit(1e-6)))), F.lit(1.0 / gamma))


def brightness_contrast(v: Column, brightness: float, contrast: float) -> Column:
    return F.greatest((v - F.lit(0.5)) * F.lit(contrast) + F.lit(0.5) + F.lit(brightness), F.lit(0.0))


def smoothstep(a: float, b: float, v: Column) -> Column:
    t = unit((v - F.lit(a)) / F.lit(b - a))
    return t * t * (F.lit(3.0) - F.lit(2.0) * t)


def saturate(c: Column, luma: Column, amount: float) -> Column:
    return F.greatest(luma + (c - luma) * F.lit(amount), F.lit(0.0))


def tone_lookup(v: Column, table: Column) -> Column:
    """Linear lookup of v in a table over 0..1."""
    top = F.size(table) - 1
    at = unit(v) * top
    k = F.least(F.floor(at).cast("int"), top)
    a, b = F.get(table, k), F.get(table, F.least(k + 1, top))
    return a + (b - a) * (at - k)


def gamma(v: Column, power: float) -> Column:
    return F.pow(F.greatest(v, F.lit(0.0)), F.lit(power))


def soft_threshold(v: Column, t: float) -> Column:
    return F.signum(v) * F.greatest(F.abs(v) - F.lit(t), F.lit(0.0))


def catmull_rom_table(points: list[tuple[float, float]], size: int = 1024) -> list[float]:
    """A tone table through the points (x rising from 0 to 1), by Catmull-Rom splines, held to 0..1."""
    xs, ys = [p[0] for p in points], [p[1] for p in points]
    out = []
    k = 0
    for i in range(size):
        x = i / (size - 1)
        while k < len(xs) - 2 and x > xs[k + 1]:
            k += 1
        t = (x - xs[k]) / max(1e-9, xs[k + 1] - xs[k])
        p0, p1, p2, p3 = ys[max(0, k - 1)], ys[k], ys[k + 1], ys[min(len(ys) - 1, k + 2)]
        y = 0.5 * (2 * p1 + (p2 - p0) * t + (2 * p0 - 5 * p1 + 4 * p2 - p3) * t * t + (3 * p1 - p0 - 3 * p2 + p3) * t**3)
        out.append(min(1.0, max(0.0, y)))
    return out


def dual_zone_table(size: int = 1024, beta: float = 20.0) -> list[float]:
    """A tone table of two zones: below one half an asinh stretch that ends in one half, so that what is faint beside a
    disc is lifted; from there on the identity, so that the disc stays as it is."""
    at = (i / (size - 1) for i in range(size))
    return [0.5 * math.asinh(2 * t * beta) / math.asinh(beta) if t < 0.5 else t for t in at]


def channel_normalise(v: Column, offset: Column | float, scale: Column | float) -> Column:
    """As white_balance, but nothing is held at 0."""
    return (v - offset) * scale


def highlights_shadows(r: Column, g: Column, b: Column, highlights: float, shadows: float) -> tuple[Column, Column, Column]:
    """Luma moved up or down above and below one half; the colour keeps its ratios."""
    y = luma709(r, g, b)
    moved = unit(y + F.lit(highlights * 0.5) * smoothstep(0.5, 1.0, y) + F.lit(shadows * 0.5) * (F.lit(1.0) - smoothstep(0.0, 0.5, y)))
    ratio = F.when(y > F.lit(1e-4), F.try_divide(moved, y)).otherwise(F.lit(1.0))
    return tuple(unit(c * ratio) for c in (r, g, b))


def capture_gamma(slider: Column) -> Column:
    """Gamma of a camera's slider (50 is 1), held to 0.1 .. 4; 1 where it isn't a number."""
    raw = slider / F.lit(50.0)
    return F.when(F.isnan(raw) | raw.isNull() | (F.abs(raw) == F.lit(float("inf"))), F.lit(1.0)).otherwise(F.greatest(F.lit(0.1), F.least(F.lit(4.0), raw)))


def linearise(v: Column, gamma_of: Column) -> Column:
    """v to the power gamma; negative values, and all where gamma is 1 or no positive number, stay."""
    return F.when((gamma_of > 0) & (gamma_of != 1.0) & (v >= 0), F.pow(v, gamma_of)).otherwise(v)


def add_shrunk(base: Column, layer: Column, amount: float, threshold: float) -> Column:
    """base plus a layer of detail, shrunk towards 0 by the threshold, times the amount."""
    return base + soft_threshold(layer, threshold) * F.lit(amount)


def mask_at(mask: Column, x: Column, y: Column, grid: int, side: int) -> Column:
    """A grid x grid mask (array, row-major) sampled bilinearly at a pixel of a square plane; cells hold their centres."""

    def axis(p: Column) -> tuple[Column, Column, Column]:
        at = (p + F.lit(0.5)) / F.lit(side / grid) - F.lit(0.5)
        low = F.greatest(F.lit(0), F.least(F.floor(at), F.lit(grid - 1)))
        return low, F.least(low + 1, F.lit(grid - 1)), unit(at - low)

    (x0, x1, wx), (y0, y1, wy) = axis(x), axis(y)

    def cell(cx: Column, cy: Column) -> Column:
        return F.get(mask, (cy * grid + cx).cast("int"))

    top, low = cell(x0, y0) * (F.lit(1.0) - wx) + cell(x1, y0) * wx, cell(x0, y1) * (F.lit(1.0) - wx) + cell(x1, y1) * wx
    return top * (F.lit(1.0) - wy) + low * wy
