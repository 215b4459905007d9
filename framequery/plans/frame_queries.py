"""Scoring, selection and stacking queries over `embeddings` read as 8x8 frames."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framequery.operators import frames as fr


def _frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fr.frames_from_embeddings(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


#: Shared SQL: pixels, the LAPD field and the score of each frame.
SQL_PIXELS = """px AS (
  SELECT label AS capture_id, vec_id AS frame_idx, p, p % 8 AS x, p // 8 AS y, embedding[p + 1]::DOUBLE AS v, embedding AS e
  FROM embeddings, range(0, 64) r(p))"""
SQL_SCORES = (
    SQL_PIXELS
    + """, lap AS (
  SELECT capture_id, frame_idx, p, CASE WHEN x BETWEEN 1 AND 6 AND y BETWEEN 1 AND 6 THEN
    e[p]::DOUBLE + e[p + 2]::DOUBLE + e[p - 7]::DOUBLE + e[p + 9]::DOUBLE
    + 0.5::DOUBLE * (e[p - 8]::DOUBLE + e[p - 6]::DOUBLE + e[p + 8]::DOUBLE + e[p + 10]::DOUBLE) - 6.0::DOUBLE * v
    ELSE 0.0::DOUBLE END AS l FROM px),
scores AS (SELECT capture_id, frame_idx, var_pop(l) AS score FROM lap GROUP BY ALL)"""
)
SQL_KEPT = (
    SQL_SCORES
    + """, ranked AS (
  SELECT *, row_number() OVER (PARTITION BY capture_id ORDER BY score DESC, frame_idx) AS rank,
    count(*) OVER (PARTITION BY capture_id) AS n FROM scores),
kept AS (SELECT capture_id, frame_idx, score, rank FROM ranked WHERE rank <= greatest(1, n * 25 // 100)),
weighted AS (
  SELECT *, 0.05::DOUBLE + 1.45::DOUBLE * power((score - min(score) OVER w)
    / greatest(1e-6::DOUBLE, max(score) OVER w - min(score) OVER w), 2) AS weight
  FROM kept WINDOW w AS (PARTITION BY capture_id))"""
)


def ag01_lapd_variance(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = fr.sharpness(_frames(spark, sf_dir))
    return scored.select("capture_id", "frame_idx", F.round("score", 6).alias("score"))


def tk01_top_percent(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = fr.keep_top_percent(fr.sharpness(_frames(spark, sf_dir)), 25)
    return kept.select("capture_id", "frame_idx", "rank")


def ag08_quality_weighted_plane(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = fr.keep_top_percent(fr.sharpness(_frames(spark, sf_dir)), 25)
    plane = fr.weighted_plane(fr.with_quality_weight(kept))
    return plane.select("capture_id", "px", F.round("value", 6).alias("value"))


QUERIES = {
    "ag01_lapd_variance": (
        ag01_lapd_variance,
        f"WITH {SQL_SCORES} SELECT capture_id, frame_idx, round(score, 6) AS score FROM scores",
    ),
    "tk01_top_percent": (
        tk01_top_percent,
        f"WITH {SQL_KEPT} SELECT capture_id, frame_idx, rank::INT AS rank FROM kept",
    ),
    "ag08_quality_weighted_plane": (
        ag08_quality_weighted_plane,
        f"""WITH {SQL_KEPT} SELECT capture_id, p::INT AS px, round(sum(v * weight) / sum(weight), 6) AS value
  FROM px JOIN weighted USING (capture_id, frame_idx) GROUP BY ALL""",
    ),
}
