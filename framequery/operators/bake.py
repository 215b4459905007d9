"""Captures written anew with their corrections baked in: colour measured on a capture's first frame and held for all of
it, then sharpening, tone, crop, size and turns."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framequery.session import shared_path
from framequery.sources import ser

#: Of each of red, green and blue: offset and scale of the white balance, offset and scale of the normalised channels.
IDENTITY = np.tile([0.0, 1.0, 0.0, 1.0], (3, 1))
_EPS = 1e-6
_PART = 32 << 20


@dataclass(frozen=True)
class Bake:
    """What is baked in. `sharpen` maps an (h, w, 3) image to its like, `table` is a tone table over 0..1, `crop` is
    (x, y, w, h); sides are divided by `divisor`, and the image is turned clockwise by the nearest quarter of `degrees`."""

    white_balance: bool = True
    normalise: bool = False
    sharpen: Callable[[np.ndarray], np.ndarray] | None = None
    table: tuple[float, ...] | None = None
    crop: tuple[int, int, int, int] | None = None
    divisor: int = 1
    degrees: int = 0
    depth: int = 16


def image_of(data: bytes, w: int, h: int, depth: int, color: str) -> np.ndarray:
    """RGB (h, w, 3) in 0..1; mosaics are interpolated, a mono frame's channels are equal."""
    image = ser.unpack(data, w, h, depth, color)
    if color.startswith("bayer"):
        return ser.demosaic(image, color)
    return image if image.ndim == 3 else np.repeat(image[:, :, None], 3, axis=2)


def _rank(values: np.ndarray, p: float) -> float:
    k = int((len(values) - 1) * p + 0.5)
    return float(np.partition(values, k)[k])


def measured(image: np.ndarray, job: Bake) -> np.ndarray:
    """Corrections (3 x 4, as IDENTITY) with green as the reference. Grey world: the 5th percentile is taken off, and the
    mean above it brought to green's. Normalised: the 1 and 99 percentiles are brought to green's; flat channels stay."""
    out = IDENTITY.copy()
    channels = [image[:, :, c].ravel() for c in range(3)]
    if job.white_balance:
        out[:, 0] = [_rank(v, 0.05) for v in channels]
        means = [np.maximum(v - o, 0.0).mean() for v, o in zip(channels, out[:, 0], strict=True)]
        out[:, 1] = [means[1] / m if means[1] > _EPS and m > _EPS else 1.0 for m in means]
    if job.normalise:
        ends = [(_rank(v, 0.01), _rank(v, 0.99)) for v in channels]
        low, high = ends[1]
        if high > low + _EPS:
            for c, (a, b) in enumerate(ends):
                scale = (high - low) / (b - a) if b > a + _EPS else 1.0
                out[c, 2:] = a - low / scale, scale
    return out


def scaled(image: np.ndarray, h: int, w: int) -> np.ndarray:
    """Bilinear samples at the centres of h x w pixels; places outside are those of the edge."""
    for axis, size in ((0, h), (1, w)):
        n = image.shape[axis]
        at = np.clip((np.arange(size) + 0.5) * n / size - 0.5, 0, n - 1)
        low = np.floor(at).astype(int)
        part = (at - low).reshape([-1 if k == axis else 1 for k in range(image.ndim)])
        image = np.take(image, low, axis) * (1 - part) + np.take(image, np.minimum(low + 1, n - 1), axis) * part
    return image


def processed(image: np.ndarray, corrections: np.ndarray, job: Bake) -> np.ndarray:
    """The image with all of a job's steps; values may leave 0..1. Sides are 2 at least where the source has as many."""
    off, scale, low, spread = corrections.T
    image = (np.maximum((image - off) * scale, 0.0) - low) * spread
    image = job.sharpen(image) if job.sharpen else image
    if job.table:
        image = np.interp(np.clip(image, 0, 1), np.linspace(0, 1, len(job.table)), job.table)
    if job.crop:
        x, y, w, h = job.crop
        x, y = max(0, min(image.shape[1] - 1, x)), max(0, min(image.shape[0] - 1, y))
        image = image[y : y + max(2, h), x : x + max(2, w)]
    if job.divisor > 1:
        image = scaled(image, *(max(2, s // job.divisor) for s in image.shape[:2]))
    return np.rot90(image, -((job.degrees % 360 + 45) // 90 % 4))


def first_frames(frames: DataFrame) -> DataFrame:
    """Each capture's first frame among these. The source's option firstFrames=1 reads no other where all are wanted."""
    row = F.min_by(F.struct(*frames.columns), "frame_idx")
    return frames.groupBy("path").agg(row.alias("_row")).select("_row.*")


def frozen_corrections(first: DataFrame, job: Bake) -> DataFrame:
    """(path, corrections): what `measured` finds on each capture's first frame, 12 numbers a row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = ("data", "w", "h", "depth", "color")
            rows = zip(*(batch.column(n).to_pylist() for n in names), strict=True)
            found = [measured(image_of(*r), job).ravel() for r in rows]
            yield pa.RecordBatch.from_arrays([batch.column("path"), pa.array(found, pa.list_(pa.float64()))], names=["path", "corrections"])

    return first.mapInArrow(run, "path string, corrections array<double>")


def baked(frames: DataFrame, first: DataFrame, job: Bake) -> DataFrame:
    """Raw frames (ser.FRAME_SCHEMA) as RGB frames with a job's steps; a capture without a row in `first` keeps its colours.

    Corrections are a row a capture. They are written to the shared folder, so Spark knows their size: it broadcasts them
    below its threshold and joins by path beyond it, and a lost task measures nothing again. Frames are one map after that.
    """
    spark, place = frames.sparkSession, shared_path(frames.sparkSession, "corrections")
    frozen = frozen_corrections(first, job)
    frozen.write.parquet(place)
    known = spark.read.schema(frozen.schema).parquet(place)
    full, kind = (65535, "<u2") if job.depth > 8 else (255, np.uint8)
    names = [f.split()[0] for f in ser.FRAME_SCHEMA.split(", ")]
    kinds = {"w": pa.int32(), "h": pa.int32(), "depth": pa.int32(), "color": pa.string(), "data": pa.binary()}

    def batch_of(batch: pa.RecordBatch, rows: list[int], new: dict[str, list]) -> pa.RecordBatch:
        arrays = [pa.array(new[n], kinds[n]) if n in new else batch.column(n).take(pa.array(rows)) for n in names]
        return pa.RecordBatch.from_arrays(arrays, names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[int] = []
            new: dict[str, list] = {n: [] for n in kinds}
            held = 0
            for k in range(batch.num_rows):
                data, w, h, depth, color, found = (batch.column(n)[k].as_py() for n in ("data", "w", "h", "depth", "color", "corrections"))
                corrections = IDENTITY if found is None else np.array(found).reshape(3, 4)
                image = processed(image_of(data, w, h, depth, color), corrections, job)
                out = np.floor(np.clip(image, 0, 1) * full + 0.5).astype(kind).tobytes()
                for n, v in zip(kinds, (image.shape[1], image.shape[0], 16 if job.depth > 8 else 8, "rgb", out), strict=True):
                    new[n].append(v)
                rows.append(k)
                held += len(out)
                if held >= _PART:
                    yield batch_of(batch, rows, new)
                    rows, new, held = [], {n: [] for n in kinds}, 0
            if rows:
                yield batch_of(batch, rows, new)

    return frames.select(*names).join(known, "path", "left").mapInArrow(run, ser.FRAME_SCHEMA)
