"""Operators on whole planes that need FFTs or wide stencils: numpy over Arrow batches, one plane a row.

All are maps over frames (`plane ARRAY<DOUBLE>`). A reference is a closure of one frame's size, or the name of a column
that holds each row's own.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame


def _planes(batch: pa.RecordBatch, side: int, name: str = "plane") -> np.ndarray:
    flat = batch.column(batch.schema.get_field_index(name)).flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(-1, side, side)


def _with(batch: pa.RecordBatch, columns: dict[str, np.ndarray | pa.Array]) -> pa.RecordBatch:
    keep = [i for i, n in enumerate(batch.schema.names) if n != "plane"]
    return pa.RecordBatch.from_arrays([*(batch.column(i) for i in keep), *(v if isinstance(v, pa.Array) else pa.array(v) for v in columns.values())], names=[*(batch.schema.names[i] for i in keep), *columns])


def _schema(frames: DataFrame, extra: str) -> str:
    return ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in frames.schema if f.name != "plane"), extra])


def map_planes(frames: DataFrame, f: Callable[[np.ndarray], np.ndarray], side: int) -> DataFrame:
    """frames with each plane replaced by f(planes); f takes and gives (n, side, side)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = f(_planes(batch, side)).reshape(batch.num_rows, -1)
            keep = [i for i, n in enumerate(batch.schema.names) if n != "plane"]
            planes = pa.ListArray.from_arrays(pa.array(np.arange(batch.num_rows + 1, dtype=np.int32) * side * side), pa.array(out.ravel()))
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in keep), planes], names=[*(batch.schema.names[i] for i in keep), "plane"])

    return frames.mapInArrow(run, _schema(frames, "plane array<double>"))


def fft_bands(frames: DataFrame, side: int) -> DataFrame:
    """Shares of spectral energy at radii [n/8, n/4) and n/4 or more; the constant term is left out."""
    f = np.fft.fftfreq(side) * side
    r = np.hypot(*np.meshgrid(f, f))
    mid, high, some = (r >= side / 8) & (r < side / 4), r >= side / 4, r > 0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            e = np.abs(np.fft.fft2(_planes(batch, side))) ** 2
            total = np.maximum(e[:, some].sum(axis=1), 1e-30)
            yield _with(batch, {"mid": e[:, mid].sum(axis=1) / total, "high": e[:, high].sum(axis=1) / total})

    return frames.mapInArrow(run, _schema(frames, "mid double, high double"))


def _parabola(left: np.ndarray, centre: np.ndarray, right: np.ndarray) -> np.ndarray:
    d = left - 2 * centre + right
    safe = np.where(np.abs(d) < 1e-8, 1.0, d)
    return np.where(np.abs(d) < 1e-8, 0.0, np.clip(0.5 * (left - right) / safe, -0.5, 0.5))


def _peak_shift(cross: np.ndarray, side: int, near: tuple[np.ndarray, np.ndarray] | None = None, radius: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """(dx, dy) of each cross spectrum's peak, signed, with a parabola's sub-pixel part; (0, 0) without any energy.
    near: peaks are sought within radius of these (x, y), around the edges."""
    size = np.abs(cross)
    flat = size.max(axis=(1, 2)) < 1e-12
    c = np.fft.ifft2(cross / np.maximum(size, 1e-12)).real
    i = np.arange(len(c))
    searched = c
    if near is not None:
        away = [np.abs(np.arange(side) - (v[:, None] % side)) for v in near]
        far_x, far_y = (np.minimum(d, side - d) > radius for d in away)
        searched = np.where(far_y[:, :, None] | far_x[:, None, :], -np.inf, c)
    k = searched.reshape(len(c), -1).argmax(axis=1)
    y, x = k // side, k % side
    dx = x + _parabola(c[i, y, (x - 1) % side], c[i, y, x], c[i, y, (x + 1) % side])
    dy = y + _parabola(c[i, (y - 1) % side, x], c[i, y, x], c[i, (y + 1) % side, x])
    dx, dy = (np.where(v > side / 2, v - side, v) for v in (dx, dy))
    return np.where(flat, 0.0, dx), np.where(flat, 0.0, dy)


def _hann(planes: np.ndarray) -> np.ndarray:
    """planes without their mean under a Hann window."""
    side = planes.shape[-1]
    return (planes - planes.mean(axis=(-2, -1), keepdims=True)) * np.outer(np.hanning(side + 1)[:-1], np.hanning(side + 1)[:-1])


def _resized(planes: np.ndarray, side: int) -> np.ndarray:
    """planes sampled bilinearly to side x side; cells hold their centres."""
    for axis in (1, 2):
        n = planes.shape[axis]
        at = np.clip((np.arange(side) + 0.5) * n / side - 0.5, 0, n - 1)
        low = np.floor(at).astype(int)
        share = np.expand_dims(at - low, tuple(k for k in range(3) if k != axis))
        planes = np.take(planes, low, axis=axis) * (1 - share) + np.take(planes, np.minimum(low + 1, n - 1), axis=axis) * share
    return planes


def phase_correlation(frames: DataFrame, reference: np.ndarray | str, side: int, window: bool = False) -> DataFrame:
    """(dx, dy) = reference - frame by the peak of the normalised cross spectrum, with a parabola's sub-pixel part.
    window: subtract the mean and apply a Hann window first. A frame without any energy gives (0, 0) and is kept."""

    def prepared(p: np.ndarray) -> np.ndarray:
        return _hann(p) if window else p

    own = reference if isinstance(reference, str) else None
    ref = None if own else np.fft.fft2(prepared(reference.reshape(side, side)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spectrum = np.fft.fft2(prepared(_planes(batch, side, own))) if own else ref
            dx, dy = _peak_shift(spectrum * np.conj(np.fft.fft2(prepared(_planes(batch, side)))), side)
            yield _with(batch.drop_columns([own]) if own else batch, {"dx": dx, "dy": dy})

    return frames.mapInArrow(run, _schema(frames.drop(own) if own else frames, "dx double, dy double"))


def cascade_correlation(frames: DataFrame, reference: str, side: int, coarse: int = 256, radius: int = 8, least: int = 64) -> DataFrame:
    """(dx, dy) = reference - frame in two passes under Hann windows: planes sampled to coarse x coarse give a first shift;
    at the largest power of two that fits (1024 at most) the peak within radius of it counts. Under least pixels the
    first shift stands. So no far basin of noise wins. reference: the column of each row's reference plane."""
    fine = 1 << (min(side, 1024).bit_length() - 1)

    def cross(frame: np.ndarray, own: np.ndarray, n: int) -> np.ndarray:
        return np.fft.fft2(_hann(_resized(own, n))) * np.conj(np.fft.fft2(_hann(_resized(frame, n))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            frame, own = _planes(batch, side), _planes(batch, side, reference)
            dx, dy = _peak_shift(cross(frame, own, coarse), coarse)
            n = coarse
            if fine >= least:
                n = fine
                near = tuple(np.rint(v * n / coarse).astype(int) for v in (dx, dy))
                dx, dy = _peak_shift(cross(frame, own, n), n, near, radius)
            yield _with(batch.drop_columns([reference]), {"dx": dx * side / n, "dy": dy * side / n})

    return frames.mapInArrow(run, _schema(frames.drop(reference), "dx double, dy double"))


def region_correlation(frames: DataFrame, reference: np.ndarray | str, side: int, region: tuple[float, float, float, float], least: int = 64) -> DataFrame:
    """phase_correlation within a region (x, y, width, height as shares of the plane, 8 pixels at least), sampled to the
    largest power of two that fits (1024 at most). reference: one plane for all, or the column of each frame's own.
    (dx, dy) are pixels of the plane; NULL where that is under least."""
    x, y = (max(0, min(side - 8, round(v * side))) for v in region[:2])
    w, h = (max(8, min(side - o, round(v * side))) for v, o in zip(region[2:], (x, y), strict=True))
    n = 1 << (min(w, h, 1024).bit_length() - 1)

    def spectrum(planes: np.ndarray) -> np.ndarray:
        return np.fft.fft2(_hann(_resized(planes[:, y : y + h, x : x + w], n)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one = None if isinstance(reference, str) else spectrum(reference.reshape(1, side, side))
        for batch in batches:
            if n < least:
                none = pa.nulls(batch.num_rows, pa.float64())
                yield _with(batch, {"dx": none, "dy": none})
                continue
            ref = spectrum(_planes(batch, side, reference)) if one is None else one
            dx, dy = _peak_shift(ref * np.conj(spectrum(_planes(batch, side))), n)
            yield _with(batch, {"dx": dx * w / n, "dy": dy * h / n})

    return frames.mapInArrow(run, _schema(frames, "dx double, dy double"))


def channel_shifts(images: DataFrame, side: int, cap: float = 5.0, target: int = 256) -> DataFrame:
    """(red_dx, red_dy, blue_dx, blue_dy) of images (red, green and blue planes): green - channel by phase correlation at
    the largest power of two up to target, in pixels. A channel moved by over cap on an axis gives (0, 0): noise."""
    n = 1 << (min(target, side).bit_length() - 1)
    channels = ("red", "green", "blue")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spectra = {}
            for c in channels:
                flat = batch.column(batch.schema.get_field_index(c)).flatten().to_numpy(zero_copy_only=False)
                spectra[c] = np.fft.fft2(_hann(_resized(flat.reshape(-1, side, side), n)))
            found = {}
            for c in ("red", "blue"):
                dx, dy = (v * side / n for v in _peak_shift(spectra["green"] * np.conj(spectra[c]), n))
                sane = (np.abs(dx) <= cap) & (np.abs(dy) <= cap)
                found |= {f"{c}_dx": np.where(sane, dx, 0.0), f"{c}_dy": np.where(sane, dy, 0.0)}
            keep = [i for i, name in enumerate(batch.schema.names) if name not in channels]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in keep), *map(pa.array, found.values())], names=[*(batch.schema.names[i] for i in keep), *found])

    own = [f"`{f.name}` {f.dataType.simpleString()}" for f in images.schema if f.name not in channels]
    return images.mapInArrow(run, ", ".join([*own, "red_dx double, red_dy double, blue_dx double, blue_dy double"]))


def gaussian_blur(planes: np.ndarray, sigma: float) -> np.ndarray:
    """Separable Gaussian blur with clamped edges."""
    radius = max(1, int(np.ceil(3 * sigma)))
    k = np.exp(-0.5 * (np.arange(-radius, radius + 1) / sigma) ** 2)
    k /= k.sum()
    for axis in (1, 2):
        pad = [(0, 0)] * 3
        pad[axis] = (radius, radius)
        wide = np.pad(planes, pad, mode="edge")
        planes = sum(w * np.take(wide, np.arange(planes.shape[axis]) + j, axis=axis) for j, w in enumerate(k))
    return planes


def unsharp(planes: np.ndarray, sigma: float, amount: float, adaptive: tuple[float, float] | None = None) -> np.ndarray:
    """planes plus amount times what a blur takes away, held to 0 .. 1. adaptive: a smoothstep of the values between these
    two scales the amount."""
    if adaptive:
        t = np.clip((planes - adaptive[0]) / (adaptive[1] - adaptive[0]), 0.0, 1.0)
        amount = amount * (t * t * (3 - 2 * t))
    return np.clip(planes + amount * (planes - gaussian_blur(planes, sigma)), 0.0, 1.0)


def wavelet_sharpen(planes: np.ndarray, amounts: list[float], base_sigma: float = 1.0, threshold: float = 0.0) -> np.ndarray:
    """A-trous bands of widths base 2^i, each soft-thresholded at threshold 2^(-i/2) and scaled by its amount."""
    rest, out = planes, np.zeros_like(planes)
    for i, amount in enumerate(amounts[:8]):
        smooth = gaussian_blur(rest, base_sigma * 2**i)
        band = rest - smooth
        t = threshold * 2 ** (-i / 2)
        out += amount * np.sign(band) * np.maximum(np.abs(band) - t, 0.0)
        rest = smooth
    return rest + out


def denoise(planes: np.ndarray, percent: float) -> np.ndarray:
    """Six bands put together again without what lies under a threshold, 0.025 at 100 percent; at 0 nothing changes."""
    strength = min(100.0, max(0.0, percent)) / 100.0
    return wavelet_sharpen(planes, [1.0] * 6, 1.0, strength * 0.025) if strength else planes


def richardson_lucy(planes: np.ndarray, sigma: float, rounds: int) -> np.ndarray:
    estimate = planes.copy()
    for _ in range(rounds):
        ratio = planes / np.maximum(gaussian_blur(estimate, sigma), 1e-6)
        estimate = np.clip(estimate * gaussian_blur(ratio, sigma), 0.0, 10.0)
    return estimate


def wiener(planes: np.ndarray, sigma: float, snr: float) -> np.ndarray:
    """K / (K^2 + 1 / SNR) with a Gaussian K, on planes padded to a power of two; 0..1."""
    side = planes.shape[-1]
    n = 1 << (2 * side - 1).bit_length() - 1 if side & (side - 1) else side
    n = max(n, side)
    f = np.fft.fftfreq(n)
    k = np.exp(-2 * np.pi**2 * sigma**2 * (f[:, None] ** 2 + f[None, :] ** 2))
    wide = np.fft.fft2(np.pad(planes, [(0, 0), (0, n - side), (0, n - side)]))
    return np.clip(np.fft.ifft2(wide * k / (k * k + 1.0 / snr)).real[:, :side, :side], 0.0, 1.0)


def bilateral(planes: np.ndarray, radius: int, sigma_space: float, sigma_value: float) -> np.ndarray:
    wide = np.pad(planes, [(0, 0), (radius, radius), (radius, radius)], mode="edge")
    h, w = planes.shape[1:]
    total, weight = np.zeros_like(planes), np.zeros_like(planes)
    for dy in range(2 * radius + 1):
        for dx in range(2 * radius + 1):
            v = wide[:, dy : dy + h, dx : dx + w]
            g = np.exp(-((dy - radius) ** 2 + (dx - radius) ** 2) / (2 * sigma_space**2) - (v - planes) ** 2 / (2 * sigma_value**2))
            total, weight = total + g * v, weight + g
    return total / weight


def guided_filter(planes: np.ndarray, radius: int, eps: float = 8e-4) -> np.ndarray:
    """Self-guided filter: box means of radius, a = var / (var + eps)."""

    def box(p: np.ndarray) -> np.ndarray:
        wide = np.pad(p, [(0, 0), (radius, radius), (radius, radius)], mode="edge")
        return np.lib.stride_tricks.sliding_window_view(wide, (2 * radius + 1, 2 * radius + 1), axis=(1, 2)).mean(axis=(-2, -1))

    mean = box(planes)
    a = np.maximum(box(planes * planes) - mean * mean, 0.0)
    a = a / (a + eps)
    return box(a) * planes + box((1 - a) * mean)
