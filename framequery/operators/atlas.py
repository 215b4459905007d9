"""Atlases of captures: small pictures of evenly spaced frames, so that any frame's neighbour shows at once."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from framequery.sources.ser import bayer_sites

# Entries at most, bytes at most, the long edge of a picture in pixels.
ENTRIES, BUDGET, LONGEST = 1500, 256 << 20, 192
ATLAS = "path string, entry int, frame_idx int, w int, h int, rgba binary"


def atlas_plan(headers: DataFrame, entries: int = ENTRIES, budget: int = BUDGET, longest: int = LONGEST, least: int = 64) -> DataFrame:
    """(path, frames, stride, entries, w, h) of each capture's atlas. headers: rows of ser.HEADER_SCHEMA.

    Pictures have `longest` pixels (`least` at least) along the long edge, never more than the frames. The stride is the
    least that keeps within the number of entries and the budget of 4 bytes a pixel. Captures without frames have none.
    """
    ratio = F.least(F.lit(1.0), F.lit(float(max(least, longest))) / F.greatest("w", "h"))
    w, h = (F.greatest(F.lit(1), F.round(F.col(c) * ratio)).cast("int") for c in ("w", "h"))
    sized = headers.where("frame_count > 0").select("path", F.col("frame_count").alias("frames"), w.alias("w"), h.alias("h"))
    fits = F.greatest(F.lit(1), F.floor(F.lit(budget) / (F.col("w") * F.col("h") * 4)))
    stride = F.greatest(F.lit(1), F.ceil(F.col("frames") / F.least(F.lit(entries), fits, F.col("frames")))).cast("int")
    return sized.withColumn("stride", stride).select("path", "frames", "stride", F.ceil(F.col("frames") / F.col("stride")).cast("int").alias("entries"), "w", "h")


def picture(data: np.ndarray, w: int, h: int, depth: int, color: str, to_w: int, to_h: int) -> bytes:
    """A raw frame's nearest samples as RGBA, 8 bits; a mosaic's pixel is its 2 x 2 cell, with both greens halved."""
    each = 3 if color in ("rgb", "bgr") else 1
    raw = data.view("<u2") >> 8 if depth > 8 else data
    image = raw.astype(np.uint8).reshape(h, w, each)
    y, x = ((np.arange(n) * (size / n)).astype(int).clip(0, size - 1) for n, size in ((to_h, h), (to_w, w)))
    if color.startswith("bayer"):
        sites, y, x = bayer_sites(color), y - y % 2, x - x % 2
        at = lambda s: image[np.minimum(y + s[0], h - 1)[:, None], np.minimum(x + s[1], w - 1), 0].astype(int)
        planes = [at(sites["R"][0]), (at(sites["G"][0]) + at(sites["G"][1])) >> 1, at(sites["B"][0])]
    else:
        small = image[y[:, None], x]
        planes = [small[:, :, k] for k in {"rgb": (0, 1, 2), "bgr": (2, 1, 0)}.get(color, (0, 0, 0))]
    return np.stack([*planes, np.full((to_h, to_w), 255)], axis=-1).astype(np.uint8).tobytes()


def build_atlas(frames: DataFrame, plan: DataFrame, folder: str) -> None:
    """Write the atlases of captures: `plan`, and `entries` (ATLAS) ordered by path and entry, so that a lookup reads only
    the row groups of its captures. frames: rows of ser.FRAME_SCHEMA; those the plan leaves out are dropped before any
    pixel is touched, and only the small pictures are shuffled, once, by ranges."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols = {n: batch.column(n).to_pylist() for n in ("w", "h", "depth", "color", "to_w", "to_h")}
            made = [picture(np.frombuffer(batch.column("data")[k].as_buffer(), np.uint8), *(cols[n][k] for n in cols)) for k in range(batch.num_rows)]
            arrays = [batch.column("path"), batch.column("entry"), batch.column("frame_idx"), pa.array(cols["to_w"], pa.int32()), pa.array(cols["to_h"], pa.int32()), pa.array(made, pa.binary())]
            yield pa.RecordBatch.from_arrays(arrays, names=["path", "entry", "frame_idx", "w", "h", "rgba"])

    wanted = plan.select("path", "stride", F.col("w").alias("to_w"), F.col("h").alias("to_h"))
    picked = frames.join(wanted, "path").where(F.col("frame_idx") % F.col("stride") == 0).withColumn("entry", F.expr("cast(frame_idx div stride AS int)"))
    entries = picked.select("path", "entry", "frame_idx", "w", "h", "depth", "color", "to_w", "to_h", "data").mapInArrow(run, ATLAS)
    entries.repartitionByRange("path", "entry").sortWithinPartitions("path", "entry").write.parquet(f"{folder}/entries")
    plan.write.parquet(f"{folder}/plan")


def nearest_entry(frame: Column, stride: Column, entries: Column) -> Column:
    return F.greatest(F.lit(0), F.least(entries - 1, F.floor(frame / stride + F.lit(0.5)))).cast("int")


def nearest_pictures(spark: SparkSession, folder: str, wanted: DataFrame) -> DataFrame:
    """wanted (path, frame_idx) beside the entry nearest to each frame: entry, atlas_idx, w, h, rgba. A capture without an
    atlas gives no row. Frames are asked for by entry, so the join's keys prune the atlas's row groups where the wanted
    side is small."""
    plan = spark.read.parquet(f"{folder}/plan").select("path", "stride", "entries")
    entries = spark.read.schema(ATLAS).parquet(f"{folder}/entries").withColumnRenamed("frame_idx", "atlas_idx")
    asked = wanted.join(plan, "path").withColumn("entry", nearest_entry(F.col("frame_idx"), F.col("stride"), F.col("entries")))
    return asked.drop("stride", "entries").join(entries, ["path", "entry"])
