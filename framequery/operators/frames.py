"""Frame planes in long form, sharpness scores and the weighted stack."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SIDE = 8


def frames_from_embeddings(df: DataFrame) -> DataFrame:
    """captures as frames: (capture_id, frame_idx, plane ARRAY<DOUBLE>), an 8x8 row-major plane each."""
    return df.select(
        F.col("label").alias("capture_id"),
        F.col("vec_id").alias("frame_idx"),
        F.col("embedding").cast("array<double>").alias("plane"),
    )


def pixels(frames: DataFrame, side: int = SIDE) -> DataFrame:
    """One row per pixel: (capture_id, frame_idx, px, x, y, v). A narrow map, no shuffle."""
    return frames.select("capture_id", "frame_idx", F.posexplode("plane").alias("px", "v")).select(
        "*", (F.col("px") % side).alias("x"), F.floor(F.col("px") / side).cast("int").alias("y")
    )


def lapd(plane: Column, side: int = SIDE) -> Column:
    """Laplacian with diagonals (cardinal 1, diagonal 0.5, centre -6), zero on the one-pixel border, as an array.

    It stays inside the row: the stencil is a sum of array lookups, so scoring needs no join or shuffle.
    """

    def at(p: Column, d: int) -> Column:
        return F.get(plane, (p + F.lit(d)).cast("int"))

    def one(p: Column) -> Column:
        x, y = p % side, F.floor(p / side)
        inner = (x > 0) & (x < side - 1) & (y > 0) & (y < side - 1)
        cardinal = at(p, -1) + at(p, 1) + at(p, -side) + at(p, side)
        diagonal = at(p, -side - 1) + at(p, -side + 1) + at(p, side - 1) + at(p, side + 1)
        return F.when(inner, cardinal + F.lit(0.5) * diagonal - F.lit(6.0) * at(p, 0)).otherwise(F.lit(0.0))

    return F.transform(F.sequence(F.lit(0), F.size(plane) - 1), one)


def variance(values: Column) -> Column:
    """Population variance of an array, E[x^2] - E[x]^2 held at 0 from below; NULL for an empty array."""
    n = F.size(values).cast("double")
    total = F.aggregate(values, F.lit(0.0), lambda a, v: a + v)
    squares = F.aggregate(values, F.lit(0.0), lambda a, v: a + v * v)
    return F.when(n > 0, F.greatest(F.lit(0.0), squares / n - (total / n) * (total / n)))


def sharpness(frames: DataFrame, side: int = SIDE) -> DataFrame:
    """frames plus `score`: population variance of the LAPD field, border included in the count."""
    return frames.withColumn("score", variance(lapd(F.col("plane"), side)))


def keep_top_percent(scored: DataFrame, percent: int) -> DataFrame:
    """The best n = max(1, count * percent div 100) frames of each capture; ties go to the lower frame_idx."""
    by = Window.partitionBy("capture_id")
    ranked = scored.withColumn(
        "rank", F.row_number().over(by.orderBy(F.col("score").desc(), F.col("frame_idx").asc()))
    ).withColumn("n_frames", F.count(F.lit(1)).over(by))
    keep = F.greatest(F.lit(1), F.expr(f"(n_frames * {int(percent)}) div 100"))
    return ranked.where(F.col("rank") <= keep).drop("n_frames")


def with_quality_weight(kept: DataFrame) -> DataFrame:
    """Weight 0.05 + 1.45 t^2, t the score rescaled over the kept frames of a capture."""
    by = Window.partitionBy("capture_id")
    low, high = F.min("score").over(by), F.max("score").over(by)
    t = (F.col("score") - low) / F.greatest(F.lit(1e-6), high - low)
    return kept.withColumn("weight", F.lit(0.05) + F.lit(1.45) * t * t)


def weighted_plane(weighted: DataFrame) -> DataFrame:
    """Sum(v w) / Sum(w) for each capture and pixel; partial sums are combined before the shuffle."""
    long = weighted.select("capture_id", "weight", F.posexplode("plane").alias("px", "v"))
    return long.groupBy("capture_id", "px").agg(
        (F.sum(F.col("v") * F.col("weight")) / F.sum("weight")).alias("value")
    )


def with_scores(frames: DataFrame, scores: DataFrame) -> DataFrame:
    """frames that have a score, with it: an inner join by capture and index. scores hold one row a frame; they are without
    planes, so Spark broadcasts them where their files are small and shuffles both sides beyond that."""
    return frames.join(scores.select("capture_id", "frame_idx", "score").where("score IS NOT NULL"), ["capture_id", "frame_idx"])


def with_masters(frames: DataFrame, masters: DataFrame) -> DataFrame:
    """frames calibrated in the row by their capture's dark and flat, plus `calibrated`: which of them applied, as text.

    frames: (capture_id, frame_idx, w, h, plane); masters: (capture_id, kind dark or flat, w, h, plane), one row of a kind a
    capture. A master of another width or height than the frame's is left out, as if there were none; without any the plane
    stays as it is. A dark counts as 0 where missing, a flat as 1.
    """
    one = masters.where("kind IN ('dark', 'flat')").groupBy("capture_id", "w", "h").agg(
        F.first(F.when(F.col("kind") == "dark", F.col("plane")), ignorenulls=True).alias("_dark"),
        F.first(F.when(F.col("kind") == "flat", F.col("plane")), ignorenulls=True).alias("_flat"),
    )
    held = frames.join(one, ["capture_id", "w", "h"], "left")
    dark, flat = F.col("_dark"), F.col("_flat")

    def lit(v: Column, k: Column) -> Column:
        less = v - F.coalesce(F.get(dark, k), F.lit(0.0))
        over = F.coalesce(F.get(flat, k), F.lit(1.0))
        return F.greatest(F.lit(0.0), F.when(over > F.lit(1e-4), F.try_divide(less, over)).otherwise(less))

    plane = F.when(dark.isNull() & flat.isNull(), F.col("plane")).otherwise(F.transform("plane", lit))
    applied = F.concat_ws("+", F.when(dark.isNotNull(), F.lit("dark")), F.when(flat.isNotNull(), F.lit("flat")))
    return held.withColumns({"plane": plane, "calibrated": applied}).select(*frames.columns, "calibrated")
