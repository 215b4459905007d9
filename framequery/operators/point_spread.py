"""Width of a frame's point spread, from the limb of a disc or from the cleanest step edge: numpy over Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from framequery.operators.spectral import _planes, _schema, _with

# Gates and windows of the two estimates.
EMPTY, FLAT, SIGMA = 0.02, 0.005, (0.5, 5.0)
LIMB = {"lit": 0.30, "pixels": 100, "radius": 20, "share": 0.45, "margin": 0.9, "directions": 64, "reach": 1.5, "texture": 0.30, "inner": (0.2, 0.7), "limb": (0.7, 1.3), "window": 6, "tail": 14}
EDGE = {"border": 16, "peak": 0.01, "share": 0.3, "clipped": (0.95, 0.98), "candidates": 50, "patch": 4, "step_at": 4, "wobble": 12.0, "step": 0.05, "half": 10, "window": 8, "off": 2, "confidence": 3.0}


def _sample(plane: np.ndarray, x: np.ndarray, y: np.ndarray, outside: float) -> np.ndarray:
    """plane at (x, y) from four neighbours; `outside` where one of them is missing."""
    h, w = plane.shape
    x0, y0 = np.floor(x).astype(int), np.floor(y).astype(int)
    inside = (x0 >= 0) & (y0 >= 0) & (x0 + 1 < w) & (y0 + 1 < h)
    i, j = np.where(inside, y0, 0), np.where(inside, x0, 0)
    fx, fy = x - x0, y - y0
    upper = plane[i, j] * (1 - fx) + plane[i, j + 1] * fx
    lower = plane[i + 1, j] * (1 - fx) + plane[i + 1, j + 1] * fx
    return np.where(inside, upper * (1 - fy) + lower * fy, outside)


def _spread(slope: np.ndarray, peak: int, first: int, last: int, tail: np.ndarray) -> tuple[float, float] | None:
    """(sigma, confidence) of a line spread by its second moment about the peak, less the tail's upper median."""
    base = float(np.sort(tail)[len(tail) // 2]) if len(tail) else 0.0
    at = np.arange(first, last + 1)
    mass = np.maximum(slope[at] - base, 0.0)
    if mass.sum() <= 1e-6:
        return None
    sigma = np.sqrt(((at - peak) ** 2 * mass).sum() / mass.sum())
    return float(np.clip(sigma, *SIGMA)), float(max(0.0, slope[peak] - base) / max(base, 1e-4))


def limb_spread(plane: np.ndarray) -> dict | None:
    """sigma, confidence, centre and radius by the mean radial profile of a disc, whose outer side alone counts. None where
    there is no whole disc on a dark ground, or its face is too uneven."""
    h, w = plane.shape
    top = plane.max()
    if min(h, w) <= 64 or not top > EMPTY:
        return None
    y, x = np.nonzero(plane > LIMB["lit"] * top)
    n, light = len(x), plane[y, x]
    radius = float(np.sqrt(n / np.pi))
    if n <= LIMB["pixels"] or radius <= LIMB["radius"] or n >= LIMB["share"] * plane.size:
        return None
    cx, cy = float((x * light).sum() / light.sum()), float((y * light).sum() / light.sum())
    margin = LIMB["margin"] * radius
    if not (margin < cx < w - margin and margin < cy < h - margin):
        return None
    r = np.arange(max(64, int(radius * LIMB["reach"]) + 1))
    turn = 2 * np.pi * np.arange(LIMB["directions"]) / LIMB["directions"]
    rays = _sample(plane, cx + np.cos(turn)[:, None] * r, cy + np.sin(turn)[:, None] * r, np.nan)
    seen = (~np.isnan(rays)).sum(axis=0)
    profile = np.nansum(rays, axis=0) / np.maximum(seen, 1)
    inner, limb = ((max(1, int(radius * a)), min(len(r) - 1, int(radius * b))) for a, b in (LIMB["inner"], LIMB["limb"]))
    face = profile[inner[0] : inner[1] + 1][seen[inner[0] : inner[1] + 1] > 0]
    if len(face) > 4 and face.mean() > 1e-4 and face.std() / face.mean() > LIMB["texture"]:
        return None
    slope = np.abs(np.diff(profile, prepend=profile[0]))
    if limb[1] <= limb[0]:
        return None
    peak = limb[0] + int(slope[limb[0] : limb[1] + 1].argmax())
    if slope[peak] <= FLAT:
        return None
    start = peak + LIMB["tail"]
    found = _spread(slope, peak, peak, min(len(r) - 1, peak + LIMB["window"]), slope[start:] if start < len(r) - 1 else slope[:0])
    if found is None:
        return None
    return {"sigma": found[0], "confidence": found[1], "cx": cx, "cy": cy, "radius": radius}


def _gradient(plane: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sobel gradients; 0 on the outermost pixels."""
    gx, gy = np.zeros_like(plane), np.zeros_like(plane)
    rows, columns = plane[:-2] + 2 * plane[1:-1] + plane[2:], plane[:, :-2] + 2 * plane[:, 1:-1] + plane[:, 2:]
    gx[1:-1, 1:-1], gy[1:-1, 1:-1] = rows[:, 2:] - rows[:, :-2], columns[2:] - columns[:-2]
    return gx, gy


def edge_candidates(plane: np.ndarray, gx: np.ndarray, gy: np.ndarray) -> np.ndarray:
    """(y, x) of the steepest edge pixels: peaks along their own gradient, clear of the border and of clipped pixels."""
    size, b = np.hypot(gx, gy), EDGE["border"]
    within = np.zeros(plane.shape, bool)
    within[b:-b, b:-b] = True
    top = size[within].max()
    if not top > EDGE["peak"]:
        return np.empty((0, 2), int)
    floor, share = EDGE["clipped"]
    clipped = np.pad(plane >= max(floor, share * plane.max()), 2)
    near = np.lib.stride_tricks.sliding_window_view(clipped, (5, 5)).any(axis=(2, 3))
    y, x = np.nonzero(within & ~near & (size >= max(top * EDGE["share"], EDGE["peak"])))
    own = size[y, x]
    nx, ny = gx[y, x] / own, gy[y, x] / own
    crest = (_sample(size, x + nx, y + ny, 0.0) <= own) & (_sample(size, x - nx, y - ny, 0.0) <= own)
    y, x, own = y[crest], x[crest], own[crest]
    best = np.argsort(-own, kind="stable")[: EDGE["candidates"]]
    return np.stack([y[best], x[best]], axis=1)


def edge_scores(plane: np.ndarray, gx: np.ndarray, gy: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(wobble in degrees, step) of candidates: the circular deviation of the axes in a patch, weighed by the gradient,
    and the contrast across the edge."""
    size, axis = np.hypot(gx, gy), 2 * np.arctan2(gy, gx)
    o = np.arange(-EDGE["patch"], EDGE["patch"] + 1)
    y, x = at[:, 0, None, None] + o[:, None], at[:, 1, None, None] + o[None, :]
    weight = np.where(size[y, x] < 1e-6, 0.0, size[y, x])
    mean = (weight * np.exp(1j * (axis[y, x] - axis[at[:, 0], at[:, 1]][:, None, None]))).sum(axis=(1, 2)) / weight.sum(axis=(1, 2))
    wobble = np.degrees(np.sqrt(-2 * np.log(np.clip(np.abs(mean), 1e-3, 0.999))) / 2)
    own = size[at[:, 0], at[:, 1]]
    nx, ny = (g[at[:, 0], at[:, 1]] / own * EDGE["step_at"] for g in (gx, gy))
    ends = [_sample(plane, at[:, 1] + s * nx, at[:, 0] + s * ny, 0.0) for s in (1, -1)]
    return wobble, np.abs(ends[0] - ends[1])


def edge_spread(plane: np.ndarray) -> dict | None:
    """sigma, confidence and place by the best step edge: the mean line spread of parallel lines across it. None where no
    edge is clean."""
    h, w = plane.shape
    if min(h, w) < 2 * EDGE["border"] + 32 or not plane.max() > EMPTY:
        return None
    gx, gy = _gradient(plane)
    at = edge_candidates(plane, gx, gy)
    if not len(at):
        return None
    wobble, step = edge_scores(plane, gx, gy, at)
    k = int((step / (1 + wobble / 10)).argmax())
    if wobble[k] > EDGE["wobble"] or step[k] < EDGE["step"]:
        return None
    cy, cx = (int(v) for v in at[k])
    nx, ny = np.array([gx[cy, cx], gy[cy, cx]]) / np.hypot(gx[cy, cx], gy[cy, cx])
    o = np.arange(-EDGE["half"], EDGE["half"] + 1)
    x, y = cx - o[:, None] * ny + o * nx, cy + o[:, None] * nx + o * ny
    whole = ((x >= 1) & (x < w - 2) & (y >= 1) & (y < h - 2)).all(axis=1)
    if not whole.any():
        return None
    slope = np.abs(np.diff(_sample(plane, x[whole], y[whole], 0.0), axis=1, prepend=0)).mean(axis=0)
    slope[0] = 0.0
    peak = int(slope.argmax())
    if slope[peak] <= FLAT or abs(peak - EDGE["half"]) > EDGE["off"]:
        return None
    far = np.abs(np.arange(len(o)) - peak) > EDGE["window"]
    far[0] = False
    found = _spread(slope, peak, max(1, peak - EDGE["window"]), min(len(o) - 1, peak + EDGE["window"]), slope[far])
    if found is None or found[1] < EDGE["confidence"]:
        return None
    return {"sigma": found[0], "confidence": found[1], "x": float(cx), "y": float(cy), "wobble": float(wobble[k]), "step": float(step[k])}


def point_spread(frames: DataFrame, side: int) -> DataFrame:
    """frames with `spread_of` ('limb', 'edge' or NULL), sigma, confidence and the place (x, y): the limb's where there is a
    disc, else the best edge's, else NULL. One map over planes, no shuffle."""

    def one(plane: np.ndarray) -> tuple:
        limb = limb_spread(plane)
        if limb:
            return "limb", limb["sigma"], limb["confidence"], limb["cx"], limb["cy"]
        edge = edge_spread(plane)
        return ("edge", edge["sigma"], edge["confidence"], edge["x"], edge["y"]) if edge else (None,) * 5

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [one(p) for p in _planes(batch, side)]
            kinds = [pa.string()] + [pa.float64()] * 4
            yield _with(batch, {n: pa.array([f[k] for f in found], kinds[k]) for k, n in enumerate(("spread_of", "sigma", "confidence", "x", "y"))})

    return frames.mapInArrow(run, _schema(frames, "spread_of string, sigma double, confidence double, x double, y double"))
