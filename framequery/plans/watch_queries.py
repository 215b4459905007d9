"""Watched folders, superseded runs, debounced writes, sweep criteria, candidates and shifts, with DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framequery.functions import rules as ru
from framequery.operators import catalog as ct
from framequery.operators import spectral as sp
from framequery.plans.frame_queries import _frames
from framequery.plans.pixel_queries import _referred
from framequery.plans.stream_queries import _stream
from framequery.streaming import stateful as st


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet")


def st02_folder_watch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as files; those of even ids were there at the start, and every fifth has no known target."""
    n = F.col("event_id")
    path = F.concat_ws("/", "user_id", n)
    files = _stream(spark, sf_dir).select(path.alias("path"), n.alias("seq"), F.when(n % 5 != 0, F.col("event_type")).alias("target"))
    backlog = _events(spark, sf_dir).where(n % 2 == 0).select(path.alias("path"))
    return st.run_to_table(st.arrivals(files, backlog), "path string, seq long, target string")


def st06_debounced_writes(spark: SparkSession, sf_dir: str) -> DataFrame:
    requests = _events(spark, sf_dir).select(F.col("user_id").alias("key"), F.col("ts").cast("timestamp").alias("at"))
    return st.debounced(requests, "45 minutes").select("key", "requests", F.unix_micros("at").alias("us"))


def st07_current_callbacks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as callbacks of runs of a user; every seventh comes from the run before."""
    n = F.col("event_id")
    generation = (F.floor(n / 50) - F.when(n % 7 == 0, 1).otherwise(0)).cast("long")
    callbacks = _stream(spark, sf_dir).select(F.col("user_id").cast("string").alias("queue"), generation.alias("generation"), n.alias("seq"))
    return st.run_to_table(st.current_callbacks(callbacks), st.CURRENT_OUT)


def sf12_created_at(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, day = F.col("event_id"), F.date_format("ts", "yyyy-MM-dd")
    text = F.when(n % 4 == 0, F.concat(day, F.lit("T01:02:03.250Z"))).when(n % 4 == 1, F.concat(day, F.lit("T01:02:03+02:00"))).when(n % 4 == 2, day)
    return _events(spark, sf_dir).select("event_id", F.unix_millis(ru.created_at(text)).alias("ms"))


def ag40_sweep_criteria(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users as fixtures; clicks are the base, views the preset, purchases the automatic run; mean value is the score, the
    sum of values the time. Passed: always over the preset, over the base on half of them, 1.3 times its time at most."""
    e = _events(spark, sf_dir)
    kinds = {"click": "base", "view": "preset", "purchase": "auto"}
    each = e.groupBy("user_id").agg(*(f(F.when(F.col("event_type") == k, F.col("value"))).alias(f"{v}_{s}") for k, v in kinds.items() for s, f in (("score", F.avg), ("wall", F.sum))))
    full = each.where("base_score IS NOT NULL AND preset_score IS NOT NULL AND auto_score IS NOT NULL")
    found = full.agg(
        F.count(F.lit(1)).alias("fixtures"),
        F.count_if(F.col("auto_score") > F.col("preset_score")).alias("over_preset"),
        F.count_if(F.col("auto_score") > F.col("base_score")).alias("over_base"),
        F.sum("auto_wall").alias("auto_wall"),
        F.sum("base_wall").alias("base_wall"),
    )
    ratio = F.when(F.col("base_wall") > 0, F.col("auto_wall") / F.col("base_wall")).otherwise(F.lit(1.0))
    passed = (F.col("over_preset") == F.col("fixtures")) & (F.col("over_base") * 2 >= F.col("fixtures")) & (ratio <= 1.3)
    return found.select("fixtures", "over_preset", "over_base", F.round(ratio, 6).alias("wall_ratio"), passed.alias("passed"))


def tk10_best_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as edge candidates of a user."""
    n = F.col("event_id")
    c = _events(spark, sf_dir).select("user_id", "event_id", F.col("value").alias("magnitude"), ((n % 97) / F.lit(97.0)).alias("step_contrast"), (n % 45).cast("double").alias("dir_std"))
    return ct.best_candidates(c, ["user_id"], "event_id", 10).select("user_id", "event_id", F.round("score", 6).alias("score"))


def rg04_region_correlation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each frame against the first of its capture."""
    found = sp.region_correlation(_referred(spark, sf_dir), "reference", 8, (0.0, 0.0, 1.0, 1.0), least=8)
    return found.select("capture_id", "frame_idx", F.round("dx", 6).alias("dx"), F.round("dy", 6).alias("dy"))


def rg07_channel_shifts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each frame as green, with red turned by a row and blue by a column and a row."""
    plane = F.col("plane")

    def turned(k: int):
        return F.concat(F.slice(plane, k + 1, F.size(plane) - k), F.slice(plane, 1, k))

    images = _frames(spark, sf_dir).select("capture_id", "frame_idx", plane.alias("green"), turned(8).alias("red"), turned(9).alias("blue"))
    return sp.channel_shifts(images, 8).select("capture_id", "frame_idx", *(F.round(f"{c}_{a}", 6).alias(f"{c}_{a}") for c in ("red", "blue") for a in ("dx", "dy")))


QUERIES = {
    "st02_folder_watch": (st02_folder_watch, "SELECT user_id || '/' || event_id AS path, event_id AS seq, event_type AS target FROM events WHERE event_id % 2 <> 0 AND event_id % 5 <> 0 AND event_type IS NOT NULL"),
    "st06_debounced_writes": (
        st06_debounced_writes,
        """WITH l AS (SELECT user_id AS key, ts, lag(ts) OVER (PARTITION BY user_id ORDER BY ts) AS p FROM events),
b AS (SELECT *, sum((p IS NULL OR ts > p + INTERVAL 45 MINUTE)::INT) OVER (PARTITION BY key ORDER BY ts) AS burst FROM l)
SELECT key, count(*) AS requests, max(epoch_us(ts)) AS us FROM b GROUP BY key, burst""",
    ),
    "st07_current_callbacks": (
        st07_current_callbacks,
        """WITH c AS (SELECT user_id::VARCHAR AS queue, event_id // 50 - (event_id % 7 = 0)::INT AS generation, event_id AS seq FROM events)
SELECT * FROM c QUALIFY generation >= max(generation) OVER (PARTITION BY queue ORDER BY seq)""",
    ),
    "sf12_created_at": (
        sf12_created_at,
        """SELECT event_id, CASE event_id % 4 WHEN 0 THEN epoch_ms(date_trunc('day', ts)::TIMESTAMP) + 3723250 WHEN 1 THEN epoch_ms(date_trunc('day', ts)::TIMESTAMP) + 3723000 - 7200000 ELSE -62135596800000 END AS ms FROM events""",
    ),
    "ag40_sweep_criteria": (
        ag40_sweep_criteria,
        """WITH e AS (SELECT user_id, avg(value) FILTER (event_type = 'click') AS b, avg(value) FILTER (event_type = 'view') AS p, avg(value) FILTER (event_type = 'purchase') AS a,
  sum(value) FILTER (event_type = 'click') AS bw, sum(value) FILTER (event_type = 'purchase') AS aw FROM events GROUP BY user_id),
t AS (SELECT count(*) AS fixtures, count(*) FILTER (a > p) AS over_preset, count(*) FILTER (a > b) AS over_base, CASE WHEN sum(bw) > 0 THEN sum(aw) / sum(bw) ELSE 1 END AS r FROM e WHERE b IS NOT NULL AND p IS NOT NULL AND a IS NOT NULL)
SELECT fixtures, over_preset, over_base, round(r, 6) AS wall_ratio, over_preset = fixtures AND over_base * 2 >= fixtures AND r <= 1.3 AS passed FROM t""",
    ),
    "tk10_best_candidates": (
        tk10_best_candidates,
        """WITH c AS (SELECT user_id, event_id, value AS m, (event_id % 97) / 97::DOUBLE / (1 + (event_id % 45) / 10::DOUBLE) AS s FROM events),
t AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY m DESC, event_id) <= 10)
SELECT user_id, event_id, round(s, 6) AS score FROM t QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY s DESC, m DESC, event_id) = 1""",
    ),
    "rg04_region_correlation": (rg04_region_correlation, None),
    "rg07_channel_shifts": (rg07_channel_shifts, None),
}
