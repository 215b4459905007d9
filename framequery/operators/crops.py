"""Boxes that a stack is cropped to: a border, the area all frames share, what enough frames cover; and the crop."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def border_box(w: Column, h: Column, border: Column) -> Column:
    """The box (x, y, w, h) inside a border, NULL where nothing would be left. A negative border is none."""
    safe = F.greatest(F.lit(0), border)
    left = (w > 2 * safe) & (h > 2 * safe)
    return F.when(left, F.struct(safe.cast("int").alias("x"), safe.cast("int").alias("y"), (w - 2 * safe).cast("int").alias("w"), (h - 2 * safe).cast("int").alias("h")))


def common_boxes(shifts: DataFrame, by: list[str], w: int, h: int) -> DataFrame:
    """(by, box): what is left of a w x h plane when the largest shift along each axis (dx, dy, rounded up, on either side)
    is taken off on both sides; the whole plane where nothing would be left. One aggregate, combined map-side; NULL
    shifts don't count."""
    x, y = (F.coalesce(F.max(F.ceil(F.abs(c))), F.lit(0)) for c in ("dx", "dy"))
    most = shifts.groupBy(*by).agg(x.alias("_x"), y.alias("_y"))
    left = (F.lit(w) > 2 * F.col("_x")) & (F.lit(h) > 2 * F.col("_y"))
    edge = [F.when(left, F.col(c)).otherwise(0).cast("int") for c in ("_x", "_y")]
    return most.select(*by, F.struct(edge[0].alias("x"), edge[1].alias("y"), (F.lit(w) - 2 * edge[0]).alias("w"), (F.lit(h) - 2 * edge[1]).alias("h")).alias("box"))


def coverage_boxes(coverage: DataFrame, by: list[str], w: int, h: int, threshold: float) -> DataFrame:
    """(by, box): the bounding box of the pixels (px) whose coverage is threshold x the largest or more; the whole plane
    where no pixel is covered. coverage: a row a pixel of a stack, so a capture has w x h rows however many frames it has;
    both passes are aggregates that are combined map-side."""
    peak = coverage.groupBy(*by).agg(F.max("coverage").alias("_peak"))
    x, y = (F.col("px") % w).cast("int"), F.floor(F.col("px") / w).cast("int")
    lit = coverage.join(peak, by).withColumn("_lit", (F.col("_peak") > 0) & (F.col("coverage") >= F.lit(threshold) * F.col("_peak")))
    ends = lit.groupBy(*by).agg(*(f(F.when(F.col("_lit"), v)).alias(n) for n, f, v in (("x0", F.min, x), ("x1", F.max, x), ("y0", F.min, y), ("y1", F.max, y))))
    some = F.col("x0").isNotNull()
    whole = {"x": F.lit(0), "y": F.lit(0), "w": F.lit(w), "h": F.lit(h)}
    box = {"x": F.col("x0"), "y": F.col("y0"), "w": F.col("x1") - F.col("x0") + 1, "h": F.col("y1") - F.col("y0") + 1}
    return ends.select(*by, F.struct(*(F.when(some, box[k]).otherwise(whole[k]).alias(k) for k in whole)).alias("box"))


def cropped_pixels(stack: DataFrame, boxes: DataFrame, by: list[str], w: int) -> DataFrame:
    """Pixels (by, px and others) of the stacks inside their box, with x and y from its corner; px counts in the box."""
    x, y = F.col("px") % w - F.col("box.x"), F.floor(F.col("px") / w).cast("int") - F.col("box.y")
    inside = stack.join(boxes, by).withColumns({"x": x.cast("int"), "y": y.cast("int")}).where(F.col("x").between(0, F.col("box.w") - 1) & F.col("y").between(0, F.col("box.h") - 1))
    return inside.withColumn("px", F.col("y") * F.col("box.w") + F.col("x")).drop("box")


def cropped_plane(plane: Column, box: Column, w: int) -> Column:
    """A row-major plane of rows of w pixels cut to a box, in its row."""
    lines = F.transform(F.sequence(F.lit(0), box["h"] - 1), lambda k: F.slice(plane, (box["y"] + k) * w + box["x"] + 1, box["w"]))
    return F.when(box.isNotNull(), F.flatten(lines)).otherwise(plane)
