"""Percentiles, medians, histograms and moments with the semantics of the scoring code, as expressions and aggregates."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator
from itertools import pairwise
from math import hypot

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def nearest_rank(sorted_values: Column, p: float) -> Column:
    """sorted[round((n - 1) p)], halves away from zero; NULL for an empty array."""
    return F.get(sorted_values, F.floor((F.size(sorted_values) - 1) * F.lit(float(p)) + F.lit(0.5)).cast("int"))


def upper_median(sorted_values: Column) -> Column:
    """sorted[n div 2]."""
    return F.get(sorted_values, F.floor(F.size(sorted_values) / 2).cast("int"))


def nearest_ranks(rows: DataFrame, by: list[str], value: str, ps: dict[str, float]) -> DataFrame:
    """Nearest-rank percentiles per group: values are counted map-side first, so the running counts are over a group's
    distinct values (at most 65,536 for pixels of 16 bits), not over its rows."""
    counted = rows.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count(F.lit(1)).alias("_k"))
    w = Window.partitionBy(*by)
    run = counted.withColumns({"_c": F.sum("_k").over(w.orderBy(value).rowsBetween(Window.unboundedPreceding, 0)), "_n": F.sum("_k").over(w)})
    picks = {name: F.min(F.when(F.col("_c") > F.floor((F.col("_n") - 1) * F.lit(float(p)) + F.lit(0.5)), F.col(value))).alias(name) for name, p in ps.items()}
    return run.groupBy(*by).agg(*picks.values())


def median_and_mad(rows: DataFrame, by: list[str], value: str) -> DataFrame:
    """(by, median, mad): mad is 1.4826 x the median absolute deviation from the true median."""
    medians = rows.groupBy(*by).agg(F.median(value).alias("median"))
    spread = rows.join(medians, by).withColumn("_d", F.abs(F.col(value) - F.col("median")))
    return spread.groupBy(*by).agg(F.first("median").alias("median"), (F.median("_d") * F.lit(1.4826)).alias("mad"))


def histogram(rows: DataFrame, by: list[str], value: Column, bins: int = 256) -> DataFrame:
    """(by, bin, n): values are clamped to 0..1; the last bin holds 1."""
    clamped = F.least(F.greatest(value, F.lit(0.0)), F.lit(1.0))
    bin_of = F.least(F.lit(bins - 1), F.floor(clamped * (bins - 1)).cast("int"))
    return rows.groupBy(*by, bin_of.alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def stretch_bounds(hist: DataFrame, by: list[str], low: float = 0.5, high: float = 0.5, bins: int = 256) -> DataFrame:
    """(by, lo, hi) in 0..1: the first bins at which the running count passes low %, and reaches all but high %."""
    w = Window.partitionBy(*by)
    run = hist.withColumns({"_c": F.sum("n").over(w.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)), "_t": F.sum("n").over(w)})
    lo = F.min(F.when(F.col("_c") >= F.col("_t") * F.lit(low / 100), F.col("bin")))
    hi = F.min(F.when(F.col("_c") >= F.col("_t") * F.lit(1 - high / 100), F.col("bin")))
    return run.groupBy(*by).agg((lo / F.lit(float(bins - 1))).alias("lo"), (hi / F.lit(float(bins - 1))).alias("hi"))


def thumbnail_bounds(counts: DataFrame, by: list[str], value: str, low: int = 100, high: int = 200) -> DataFrame:
    """(by, lo, hi) of counted 8-bit values (n each): the first at which the running count reaches a `low`-th of all, and
    all but a `high`-th."""
    w = Window.partitionBy(*by)
    run = counts.withColumns({"_c": F.sum("n").over(w.orderBy(value).rowsBetween(Window.unboundedPreceding, 0)), "_t": F.sum("n").over(w)})
    lo = F.min(F.when(F.col("_c") >= F.floor(F.col("_t") / low), F.col(value)))
    hi = F.min(F.when(F.col("_c") >= F.col("_t") - F.floor(F.col("_t") / high), F.col(value)))
    return run.groupBy(*by).agg(lo.alias("lo"), hi.alias("hi"))


def centroid(long: DataFrame, by: list[str], weight: Column) -> DataFrame:
    """Weighted centroid of (x, y); NULL where no weight is positive."""
    w = F.greatest(weight, F.lit(0.0))
    held = long.withColumn("_w", w)
    return held.groupBy(*by).agg(F.try_divide(F.sum(F.col("x") * F.col("_w")), F.sum("_w")).alias("cx"), F.try_divide(F.sum(F.col("y") * F.col("_w")), F.sum("_w")).alias("cy"))


def half_flux_radius(long: DataFrame, by: list[str], width: float = 0.5) -> DataFrame:
    """Radius around the flux centroid that holds half the positive flux, linear inside its radial bin."""
    lit = long.where(F.col("v") > 0)
    centre = centroid(lit, by, F.col("v"))
    r = F.sqrt((F.col("x") - F.col("cx")) * (F.col("x") - F.col("cx")) + (F.col("y") - F.col("cy")) * (F.col("y") - F.col("cy")))
    bins = lit.join(centre, by).groupBy(*by, F.floor(r / F.lit(width)).cast("int").alias("bin")).agg(F.sum("v").alias("flux"))
    w = Window.partitionBy(*by)
    run = bins.withColumns({"cum": F.sum("flux").over(w.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)), "half": F.sum("flux").over(w) / F.lit(2.0)})
    crossing = run.where(F.col("cum") >= F.col("half")).groupBy(*by).agg(F.min_by(F.struct("bin", "cum", "flux", "half"), F.col("bin")).alias("c"))
    inside = F.try_divide(F.col("c.half") - (F.col("c.cum") - F.col("c.flux")), F.col("c.flux"))
    return crossing.select(*by, ((F.col("c.bin") + inside) * F.lit(width)).alias("hfr"))


def concentration(long: DataFrame, by: list[str]) -> DataFrame:
    """Peak over the sum of positive values, 1 at most; 0 where nothing is positive."""
    ratio = F.try_divide(F.max("v"), F.sum(F.greatest(F.col("v"), F.lit(0.0))))
    return long.groupBy(*by).agg(F.when(F.max("v") > 0, F.least(F.lit(1.0), ratio)).otherwise(F.lit(0.0)).alias("concentration"))


def keep_recommendation(scores: DataFrame, by: list[str], score: str, jitter: str | None = None) -> DataFrame:
    """(by, n, fraction, n_keep): the share of scores at or above half the 90th percentile, x0.7 where jitter is above
    15, held to 0.20 .. 0.75; then at least max(50, min(n, 100)) frames and n at most."""
    p90 = nearest_ranks(scores, by, score, {"p90": 0.9})
    joined = scores.join(p90, by)
    shaky = F.max(jitter) > 15 if jitter else F.lit(False)
    counted = joined.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col(score) >= F.lit(0.5) * F.col("p90")).alias("above"), shaky.alias("shaky"))
    raw = F.col("above") / F.col("n") * F.when(F.col("shaky"), F.lit(0.7)).otherwise(F.lit(1.0))
    fraction = F.least(F.greatest(raw, F.lit(0.20)), F.lit(0.75))
    floor = F.greatest(F.lit(50), F.least(F.col("n"), F.lit(100)))
    keep = F.least(F.greatest(F.ceil(F.col("n") * F.col("fraction") - F.lit(1e-9)), floor), F.col("n"))
    kept = counted.withColumn("fraction", fraction).withColumn("n_keep", keep)
    return kept.select(*by, "n", (F.col("n_keep") / F.col("n")).alias("fraction"), "n_keep")


def shift_outliers(shifts: DataFrame, by: list[str], k: float = 4.0, floor_px: float = 1.5, most: float = 0.15, least_n: int = 20) -> DataFrame:
    """shifts plus `dropped`: either axis further from its median than max(k MAD, floor); where that would drop over
    `most` of a group, or the group has under `least_n` rows, none is dropped."""
    spread = shifts
    for axis in ("dx", "dy"):
        m = median_and_mad(shifts, by, axis).withColumnsRenamed({"median": f"_m{axis}", "mad": f"_s{axis}"})
        spread = spread.join(m, by)

    def far(axis: str) -> Column:
        return F.abs(F.col(axis) - F.col(f"_m{axis}")) > F.greatest(F.lit(k) * F.col(f"_s{axis}"), F.lit(floor_px))

    w = Window.partitionBy(*by)
    marked = spread.withColumn("_far", far("dx") | far("dy"))
    n, dropped = F.count(F.lit(1)).over(w), F.sum(F.col("_far").cast("int")).over(w)
    trusted = (n >= least_n) & (dropped <= n * F.lit(most))
    return marked.withColumn("dropped", F.col("_far") & trusted).select(*shifts.columns, "dropped")


def drift_fold(shifts: DataFrame, by: str, order: str, is_reference: Column, limit: float = 10.0, history: int = 5) -> DataFrame:
    """Shifts in order, each replaced by its prediction where it is further than `limit` from it; corrected values feed
    the next prediction: the last one plus the mean velocity (per index step) of the last `history`. Reference frames
    are the anchor (0, 0); the very first shift has no prediction. A key's rows are one sorted stream: the fold holds
    the last `history` of them, whatever their number. A missing shift takes its prediction, or stays NULL where nothing came before; steps between
    equal indices have no velocity."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, past = None, deque(maxlen=history)
        for batch in batches:
            xs, ys = [], []
            for k, i, dx, dy, ref in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if not past or k != key:
                    key = k
                    past.clear()
                if ref:
                    dx = dy = 0.0
                elif past:
                    px, py = predicted(past)
                    if dx is None or dy is None or hypot(dx - px, dy - py) > limit:
                        dx, dy = px, py
                if dx is None or dy is None:
                    dx = dy = None
                else:
                    past.append((i, dx, dy))
                xs.append(dx)
                ys.append(dy)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(xs, pa.float64()), pa.array(ys, pa.float64())], names=[by, order, "dx", "dy"])

    def predicted(past: deque) -> tuple[float, float]:
        steps = [(b[0] - a[0], b[1] - a[1], b[2] - a[2]) for a, b in pairwise(past)]
        n = max(len(steps), 1)
        return past[-1][1] + sum(x / i for i, x, _ in steps if i) / n, past[-1][2] + sum(y / i for i, _, y in steps if i) / n

    rows = shifts.select(by, order, F.col("dx").cast("double").alias("dx"), F.col("dy").cast("double").alias("dy"), F.coalesce(is_reference, F.lit(False)).alias("_ref"))
    types = {f.name: f.dataType.simpleString() for f in rows.schema}
    ordered = rows.repartition(by).sortWithinPartitions(by, order, "dx", "dy")
    return ordered.mapInArrow(run, f"`{by}` {types[by]}, `{order}` {types[order]}, dx double, dy double")
