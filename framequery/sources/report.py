"""Reports of captures and images by their headers: one JSON object a file, keys by name."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from framequery.functions import rules as ru
from framequery.sources import register


def _utc(at: Column) -> Column:
    """ISO 8601 to the second."""
    return F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss'Z'")


def _color(color: Column) -> dict[str, Column]:
    return {"colorID": color, "colorIsBayer": color.startswith("bayer"), "colorIsMono": color == "mono", "colorIsRGB": color.isin("rgb", "bgr")}


def _json(values: dict[str, Column], nulls: bool) -> Column:
    return F.to_json(F.struct(*(values[k].alias(k) for k in sorted(values))), {"ignoreNullFields": str(not nulls).lower()})


def ser_report(headers: DataFrame) -> DataFrame:
    """headers (rows of ser.HEADER_SCHEMA) plus `report`; bytes are those of the frames told by the header. A capture without
    a time has a null date."""
    c = F.col
    values = {
        "filename": F.element_at(F.split("path", "/"), -1), "imageWidth": c("w"), "imageHeight": c("h"), "frameCount": c("frame_count"), "pixelDepth": c("depth"),
        "bytesPerFrame": c("bytes_per_frame"), "totalBytes": c("frame_count") * c("bytes_per_frame"), "captureDateUTC": _utc(ru.ticks_to_timestamp(c("ticks_utc"))),
        **{n: c(n) for n in ("instrument", "observer", "telescope")}, **_color(c("color")),
    }
    return headers.withColumn("report", _json(values, nulls=True))


def fits_report(headers: DataFrame) -> DataFrame:
    """headers (path, w, h, date_obs, file_bytes) plus `report`; an image without a date has no such key."""
    values = {
        "filename": F.element_at(F.split("path", "/"), -1), "format": F.lit("fits"), "imageWidth": F.col("w"), "imageHeight": F.col("h"), "frameCount": F.lit(1), "pixelDepth": F.lit(32),
        "totalBytes": F.col("file_bytes"), "captureDateUTC": _utc(ru.header_date(F.col("date_obs"))), **_color(F.lit("mono")),
    }
    return headers.withColumn("report", _json(values, nulls=False))


def reports(spark: SparkSession, path: str) -> DataFrame:
    """(path, report) of all captures and images of a folder; tasks read headers only."""
    register(spark)
    read = {kind: spark.read.format(kind).option("headersOnly", "true").load(path) for kind in ("ser", "fits")}
    return ser_report(read["ser"]).select("path", "report").union(fits_report(read["fits"]).select("path", "report"))
