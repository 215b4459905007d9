"""Local shifts at alignment points, by block matching."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from framequery.operators.spectral import _schema, _with

# How far below the mean a winner must be, and how much costs must rise beside it, as shares of the mean.
MIN_DEPTH, MIN_RISE = 0.10, 0.04
SHIFTS = "points array<struct<ay:int,ax:int,dx:double,dy:double,depth:double,kept:boolean>>"


def resampled(plane: np.ndarray, gx: float, gy: float, margin: int) -> tuple[np.ndarray, np.ndarray]:
    """The plane at (x - gx, y - gy) for all whole x and y up to `margin` outside it, bilinear with the edge's values, and
    where such a place is more than half a pixel inside."""
    h, w = plane.shape

    def axis(n: int, g: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        at = np.arange(-margin, n + margin) - g
        low = np.floor(at).astype(int)
        return np.clip(low, 0, n - 1), np.clip(low + 1, 0, n - 1), at - low, (at >= 0.5) & (at < n - 0.5)

    (x0, x1, wx, in_x), (y0, y1, wy, in_y) = axis(w, gx), axis(h, gy)
    rows = plane[y0] * (1 - wy)[:, None] + plane[y1] * wy[:, None]
    return rows[:, x0] * (1 - wx) + rows[:, x1] * wx, in_y[:, None] & in_x


def point_costs(plane: np.ndarray, reference: np.ndarray, gx: float, gy: float, grid: tuple[int, int], half: int, radius: int) -> np.ndarray:
    """[point, candidate row, candidate column] -> sum of absolute differences over every second pixel of the patch."""
    h, w = plane.shape
    rows, columns = grid
    cy, cx = (n * (np.arange(k) + 0.5) / k for n, k in ((h, rows), (w, columns)))
    off = np.arange(-half, half, 2)
    y = np.repeat(cy.astype(int), columns)[:, None, None] + off[:, None]
    x = np.tile(cx.astype(int), rows)[:, None, None] + off[None, :]
    y, x = np.broadcast_arrays(y, x)
    inside = (y >= 0) & (y < h) & (x >= 0) & (x < w)
    margin = half + radius + 1
    moved, whole = resampled(plane, gx, gy, margin)
    base = reference[np.clip(y, 0, h - 1), np.clip(x, 0, w - 1)]
    sy, sx = np.clip(y, -half - 1, h + half) + margin, np.clip(x, -half - 1, w + half) + margin
    side = 2 * radius + 1
    costs = np.empty((len(y), side, side))
    for dy in range(-radius, radius + 1):
        for dx in range(-radius, radius + 1):
            at = (sy - dy, sx - dx)
            costs[:, dy + radius, dx + radius] = np.where(inside & whole[at], np.abs(base - moved[at]), 0.0).sum(axis=(1, 2))
    return costs


def gated(costs: np.ndarray, min_depth: float = MIN_DEPTH, min_rise: float = MIN_RISE) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """dx, dy, depth and kept of each point. The candidate of least cost (the first of equal ones, by rows) wins. It counts
    if it is min_depth below the mean of all, inside the search, and costs rise by min_rise of the mean beside it along
    both axes; a parabola through it and its neighbours gives the fraction, half a pixel at most. Else the shift is 0."""
    n, side, _ = costs.shape
    radius, flat = side // 2, costs.reshape(n, -1)
    win, mean, each = flat.argmin(axis=1), flat.mean(axis=1), np.arange(n)
    wy, wx = win // side, win % side
    least = flat[each, win]
    depth = np.where(mean > 1e-6, 1 - least / np.where(mean > 1e-6, mean, 1), 0.0)
    inner = (wx > 0) & (wx < side - 1) & (wy > 0) & (wy < side - 1)
    iy, ix = np.clip(wy, 1, side - 2), np.clip(wx, 1, side - 2)
    left, right, up, down = costs[each, iy, ix - 1], costs[each, iy, ix + 1], costs[each, iy - 1, ix], costs[each, iy + 1, ix]
    rise = np.minimum(np.minimum(left, right), np.minimum(up, down)) - least
    kept = inner & (depth >= min_depth) & (rise >= min_rise * mean)

    def fraction(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        bend = a - 2 * least + b
        safe = np.abs(bend) > 1e-8
        return np.where(safe, np.clip(0.5 * (a - b) / np.where(safe, bend, 1), -0.5, 0.5), 0.0)

    return np.where(kept, wx - radius + fraction(left, right), 0.0), np.where(kept, wy - radius + fraction(up, down), 0.0), depth, kept


def point_shifts(frames: DataFrame, grid: tuple[int, int], half: int, radius: int, side: int, reference: str = "reference", gx: str = "gx", gy: str = "gy") -> DataFrame:
    """frames with `points`: for each of grid (rows, columns) alignment points, in rows, the local shift that is left after
    the frame's global shift (gx, gy) to its reference, its depth and whether it counts (see gated).

    frames: square planes with `side` pixels a row, each beside its own reference (joined before, a row a capture). One
    map; a task holds a batch of planes and one frame's costs. NULL planes, references or shifts give NULL.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for plane, ref, x, y in zip(*(batch.column(batch.schema.get_field_index(c)) for c in ("plane", reference, gx, gy)), strict=True):
                if not all(v.is_valid for v in (plane, ref, x, y)):
                    out.append(None)
                    continue
                a, b = (v.values.to_numpy(zero_copy_only=False).reshape(-1, side) for v in (plane, ref))
                dx, dy, depth, kept = (v.tolist() for v in gated(point_costs(a, b, x.as_py(), y.as_py(), grid, half, radius)))
                out.append([{"ay": k // grid[1], "ax": k % grid[1], "dx": dx[k], "dy": dy[k], "depth": depth[k], "kept": kept[k]} for k in range(len(dx))])
            kind = pa.list_(pa.struct([("ay", pa.int32()), ("ax", pa.int32()), ("dx", pa.float64()), ("dy", pa.float64()), ("depth", pa.float64()), ("kept", pa.bool_())]))
            yield _with(batch, {"points": pa.array(out, kind)})

    return frames.mapInArrow(run, _schema(frames, SHIFTS))
