"""Captures and images that Spark writes and reads back, with the DuckDB SQL of what they must hold."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framequery.operators import export as ex
from framequery.plans.frame_queries import _frames
from framequery.session import shared_path
from framequery.sources import register


def _raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames as 8-bit captures of a file each; even ones are mosaics."""
    level = lambda v: F.lpad(F.hex(F.floor(F.least(F.greatest(v, F.lit(0.0)), F.lit(1.0)) * 255).cast("long")), 2, "0")
    return _frames(spark, sf_dir).select(
        F.concat(F.lit("capture-"), F.col("capture_id"), F.lit(".ser")).alias("path"), F.col("frame_idx").cast("int").alias("frame_idx"), F.lit(8).alias("w"), F.lit(8).alias("h"), F.lit(8).alias("depth"),
        F.when(F.col("capture_id") % 2 == 0, "bayerRGGB").otherwise("mono").alias("color"), F.lit(None).cast("long").alias("ticks"), F.unhex(F.array_join(F.transform("plane", level), "")).alias("data"),
    )


def sk03_ser_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every second frame from 20 on, 10 a capture, a 5 x 5 window at (3, 1), 25 frames a second, 4 frames a file."""
    register(spark)
    folder = shared_path(spark, "captures")
    picked = ex.picked_frames(_raw(spark, sf_dir), 20, 1 << 30, 2, 10)
    cut = ex.cropped(picked, ex.crop_window(F.col("w"), F.col("h"), F.col("color"), 3, 1, 5, 5))
    ex.write_captures(cut, folder, fps=25, frames_per_file=4)
    name = F.element_at(F.split("path", "/"), -1)
    return spark.read.format("ser").load(folder).select(name.alias("name"), "frame_idx", "w", "h", "color", "ticks", F.hex("data").alias("data"))


def sk02_fits_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each frame as an image whose cards tell its capture and a note with quotes and a slash."""
    register(spark)
    folder = shared_path(spark, "images")
    c, f = F.col("capture_id").cast("string"), F.col("frame_idx")
    cards = F.create_map(F.lit("CAPTURE"), c, F.lit("NOTE"), F.concat(F.lit("O'Neil / "), c), F.lit("GAIN"), F.concat(c, F.lit(".50")))
    rows = _frames(spark, sf_dir).select(
        F.concat(F.lit("frame-"), f).alias("path"), F.lit(8).alias("w"), F.lit(8).alias("h"), F.col("plane").cast("array<float>").alias("plane"), cards.alias("cards"),
        F.concat(F.lit("2024-01-02T03:04:"), F.lpad((f % 60).cast("string"), 2, "0")).alias("date_obs"),
    )
    rows.write.format("fits").mode("append").save(folder)
    back = spark.read.format("fits").load(folder)
    name, total = F.element_at(F.split("path", "/"), -1), F.aggregate("plane", F.lit(0.0), lambda a, v: a + v.cast("double"))
    return back.select(name.alias("name"), "w", "h", "date_obs", *(F.col("cards")[k].alias(k.lower()) for k in ("CAPTURE", "NOTE", "GAIN")), F.round(total, 6).alias("total"), F.round(F.col("plane")[9].cast("double"), 6).alias("tenth"))


QUERIES = {
    "sk03_ser_export": (
        sk03_ser_export,
        """WITH f AS (SELECT label, vec_id, list_transform(embedding, lambda v: floor(least(greatest(v::DOUBLE, 0), 1) * 255)::INT) AS e, least(20, max(vec_id) OVER (PARTITION BY label)) AS start FROM embeddings),
k AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS i, count(*) OVER (PARTITION BY label) AS n FROM f WHERE vec_id >= start AND (vec_id - start) % 2 = 0),
p AS (SELECT *, CASE WHEN n > 10 THEN nullif(list_position([floor(t * (n - 1) / 9 + 0.5)::INT for t in range(10)], i), 0) - 1 ELSE i END AS place FROM k),
c AS (SELECT *, CASE WHEN label % 2 = 0 THEN [2, 0, 4, 4] ELSE [3, 1, 5, 5] END AS win FROM p WHERE place IS NOT NULL)
SELECT 'capture-' || label || '-' || lpad((place // 4)::VARCHAR, 5, '0') || '.ser' AS name, (place % 4)::INT AS frame_idx, win[3] AS w, win[4] AS h,
  CASE WHEN label % 2 = 0 THEN 'bayerRGGB' ELSE 'mono' END AS color, place * 400000 AS ticks,
  array_to_string([format('{:02X}', e[(win[2] + q // win[3]) * 8 + win[1] + q % win[3] + 1]) for q in range(win[3] * win[4])], '') AS data FROM c""",
    ),
    "sk02_fits_images": (
        sk02_fits_images,
        """SELECT 'frame-' || vec_id || '.fits' AS name, 8 AS w, 8 AS h, '2024-01-02T03:04:' || lpad((vec_id % 60)::VARCHAR, 2, '0') AS date_obs, label::VARCHAR AS capture, 'O''Neil / ' || label AS note,
  label || '.50' AS gain, round(list_sum(list_transform(embedding, lambda v: v::DOUBLE)), 6) AS total, round(embedding[10]::DOUBLE, 6) AS tenth FROM embeddings""",
    ),
}
