"""Captures cut out of others: which frames, which window, and files in which Spark writes them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from framequery.operators import catalog as ct


def picked_frames(frames: DataFrame, first: int, last: int, stride: int = 1, target: int | None = None, by: str = "path", index: str = "frame_idx") -> DataFrame:
    """Frames first to last (held to those there are) at a stride, thinned evenly to `target` a capture, both ends among
    them. Adds `at`, the frame's place in what is written, and `frames`, their number. One window per capture over what
    the stride leaves."""
    capture = Window.partitionBy(by)
    top = F.max(index).over(capture)
    start = F.least(F.lit(max(0, first)), top)
    kept = frames.withColumn("_start", start).where((F.col(index) >= F.col("_start")) & (F.col(index) <= F.greatest(F.lit(last), F.col("_start"))) & ((F.col(index) - F.col("_start")) % max(1, stride) == 0))
    counted = kept.withColumns({"at": F.row_number().over(capture.orderBy(index)) - 1, "frames": F.count(F.lit(1)).over(capture).cast("int")}).drop("_start")
    if not target or target < 1:
        return counted
    thin = F.col("frames") > target
    # Place k of n frames is the k-th pick if k = round(i (n - 1) / (target - 1)) for some i.
    picks = ct.even_pick(F.col("frames"), target)
    chosen = counted.where(~thin | F.array_contains(picks, F.col("at")))
    place = F.when(thin, F.array_position(picks, F.col("at")).cast("int") - 1).otherwise(F.col("at"))
    return chosen.withColumns({"at": place, "frames": F.least("frames", F.lit(target))})


def crop_window(w: Column, h: Column, color: Column, x: int, y: int, cw: int, ch: int) -> Column:
    """The window (x, y, w, h) that a wish for it comes to: on a mosaic its corner and size are even, so that colours stay
    in their places; it stays inside, and is 2 x 2 at least."""
    mosaic = color.startswith("bayer")

    def axis(size: Column, at: int, wide: int) -> tuple[Column, Column]:
        even = lambda v: F.when(mosaic, F.lit(v - v % 2)).otherwise(F.lit(v))
        start = F.greatest(F.lit(0), F.least(size - 1, even(at)))
        return start, F.greatest(F.lit(2), F.least(size - start, even(wide)))

    (x0, cx), (y0, cy) = axis(w, x, cw), axis(h, y, ch)
    return F.struct(x0.cast("int").alias("x"), y0.cast("int").alias("y"), cx.cast("int").alias("w"), cy.cast("int").alias("h"))


def cropped(frames: DataFrame, window: Column) -> DataFrame:
    """Raw frames (rows of ser.FRAME_SCHEMA and any others) cut to a window (x, y, w, h); w and h become the window's.
    One map, rows of pixels are sliced batch by batch."""
    names, schema = frames.columns, frames.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = {n: batch.column(n).to_pylist() for n in ("w", "h", "depth", "color", "_window")}
            out = []
            for k, (w, h, depth, color, win) in enumerate(zip(*at.values(), strict=True)):
                data = np.frombuffer(batch.column("data")[k].as_buffer(), np.uint8).reshape(h, w, depth // 8 * (3 if color in ("rgb", "bgr") else 1))
                out.append(data[win["y"] : win["y"] + win["h"], win["x"] : win["x"] + win["w"]].tobytes())
            new = {"w": pa.array([v["w"] for v in at["_window"]], pa.int32()), "h": pa.array([v["h"] for v in at["_window"]], pa.int32()), "data": pa.array(out, pa.binary())}
            yield pa.RecordBatch.from_arrays([new.get(n, batch.column(n)) for n in names], names=names)

    return frames.withColumn("_window", window).mapInArrow(run, schema)


def write_captures(frames: DataFrame, folder: str, mode: str = "append", fps: int | None = None, frames_per_file: int | None = None, index: str = "at") -> None:
    """Write frames (rows of ser.FRAME_SCHEMA) as SER files, one a path. frames_per_file cuts a long capture into files
    `name-00000.ser`, ... so that many tasks share it; `index` counts a capture's frames from 0. fps gives frames ticks 1/fps apart, from
    ticks_utc on where there is such a column. One shuffle of the frames, sorted as they come; nothing is gathered."""
    if fps:
        base = F.coalesce("ticks_utc", F.lit(0)) if "ticks_utc" in frames.columns else F.lit(0)
        frames = frames.withColumn("ticks", (base + F.col(index) * (10_000_000 // fps)).cast("long"))
    if frames_per_file:
        stem = F.regexp_replace(F.element_at(F.split("path", "/"), -1), r"(?i)\.ser$", "")
        part = F.floor(F.col(index) / frames_per_file)
        frames = frames.withColumn("path", F.concat(stem, F.lit("-"), F.lpad(part.cast("string"), 5, "0"), F.lit(".ser")))
    frames.repartition("path").sortWithinPartitions("path", index).write.format("ser").mode(mode).save(folder)
