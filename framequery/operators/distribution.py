"""A capture's sharpness distribution from few, evenly spaced frames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from framequery.functions import planes as pn
from framequery.functions import stats
from framequery.operators import catalog as ct
from framequery.operators import frames as fr
from framequery.operators import spectral as sp
from framequery.session import shared_path


def even_frames(frames: DataFrame, most: int = 64) -> DataFrame:
    """frames at `most` even positions of each capture's order, with total_frames; (capture_id, frame_idx) tells frames apart.

    Positions come from one ranking of ids over all captures, so a capture of any length is in no task as a whole; planes
    aren't shuffled: the places taken, `most` a capture at most, are written to the shared folder, so Spark knows their size
    when it chooses the join. Frames without a capture or an index are left out.
    """
    spark = frames.sparkSession
    ids = frames.select("capture_id", "frame_idx").where("capture_id IS NOT NULL AND frame_idx IS NOT NULL")
    placed = ct.ranked(ids, "_at", F.col("capture_id").asc(), F.col("frame_idx").asc(), kind="long")
    ends = placed.groupBy("capture_id").agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("total_frames"))
    positions = ct.even_positions(F.col("total_frames").cast("int"), most)
    taken = ends.select("capture_id", "total_frames", F.explode(F.transform(positions, lambda p: p + F.col("_first"))).alias("_at"))
    path = shared_path(spark, "even-frames")
    placed.join(taken, ["capture_id", "_at"]).drop("_at").write.parquet(path)
    return frames.join(spark.read.parquet(path), ["capture_id", "frame_idx"])


def adjacent_shifts(sampled: DataFrame, side: int) -> DataFrame:
    """(capture_id, frame_idx, dx, dy) of each sampled frame against the one sampled before it, by phase correlation."""
    w = Window.partitionBy("capture_id").orderBy("frame_idx")
    pairs = sampled.select("capture_id", "frame_idx", "plane", F.lag("plane").over(w).alias("_before")).where("_before IS NOT NULL")
    return sp.phase_correlation(pairs, "_before", side).select("capture_id", "frame_idx", "dx", "dy")


def jitter(shifts: DataFrame) -> DataFrame:
    """(capture_id, jitter): root of the mean squared shift."""
    return shifts.groupBy("capture_id").agg(F.sqrt(F.avg(F.col("dx") * F.col("dx") + F.col("dy") * F.col("dy"))).alias("jitter"))


def keep_of(above: Column, sampled: Column, total: Column, shaky: Column) -> Column:
    """Frames to keep of `total`: the sample's share above the knee, x0.7 where shaky, held to 0.20 .. 0.75; then at least
    max(50, min(total, 100)), and total at most."""
    raw = above / sampled * F.when(shaky, F.lit(0.7)).otherwise(F.lit(1.0))
    share = F.least(F.greatest(raw, F.lit(0.20)), F.lit(0.75))
    floor = F.greatest(F.lit(50), F.least(total, F.lit(100)))
    return F.least(F.greatest(F.ceil(total * share - F.lit(1e-9)), floor), total)


def distribution(sampled: DataFrame, side: int, jitters: DataFrame | None = None) -> DataFrame:
    """Of each capture in even_frames(): (capture_id, total_frames, n, least, p10, p50, p90, most, median_hfr, jitter, n_keep,
    fraction).

    Scores and half-flux radii are worked out in the row; a capture's lists hold one value a sampled frame. median_hfr is
    the upper median of the radii above 0, NULL without any; jitter is NULL without a pair, and then tightens nothing.
    """
    scored = fr.sharpness(sampled, side).withColumn("_hfr", pn.half_flux_radius(F.col("plane"), side))
    lists = scored.groupBy("capture_id").agg(
        F.first("total_frames").alias("total_frames"), F.array_sort(F.collect_list("score")).alias("s"), F.array_sort(F.collect_list(F.when(F.col("_hfr") > 0, F.col("_hfr")))).alias("h")
    )
    lists = lists.join(jitters, "capture_id", "left") if jitters is not None else lists.withColumn("jitter", F.lit(None).cast("double"))
    s = F.col("s")
    whole = lists.withColumns({"n": F.size(s), "p90": stats.nearest_rank(s, 0.9)})
    above = F.size(F.filter(s, lambda v: v >= F.lit(0.5) * F.col("p90")))
    keep = keep_of(above, F.col("n"), F.col("total_frames"), F.coalesce(F.col("jitter") > 15, F.lit(False)))
    out = whole.withColumn("n_keep", keep.cast("long"))
    ends = (F.get(s, F.lit(0)).alias("least"), stats.nearest_rank(s, 0.1).alias("p10"), stats.nearest_rank(s, 0.5).alias("p50"), "p90", F.element_at(s, -1).alias("most"))
    return out.select("capture_id", "total_frames", "n", *ends, stats.upper_median(F.col("h")).alias("median_hfr"), "jitter", "n_keep", (F.col("n_keep") / F.col("total_frames")).alias("fraction"))
