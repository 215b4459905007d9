"""Streams over `events` in several micro-batches, run to the end of what is there; their SQL is the batch answer."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framequery.streaming import stateful as st


def _stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as a stream of several micro-batches, by id."""
    return st.in_slices(spark.read.parquet(f"{sf_dir}/events.parquet"), "event_id")


def _timed_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as a stream of several micro-batches, by time (at): no batch holds rows that a watermark has passed."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet").withColumn("at", F.col("ts").cast("timestamp"))
    return st.in_slices(events.withColumn("us", F.unix_micros("at")), "us")


def st01_completed_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as size samples of a file per user and quarter of ids: sizes are 0 now and then."""
    n = F.col("event_id")
    size = F.when(n % 13 == 0, 0).otherwise(F.floor(n / 2000) + 1).cast("long")
    samples = _stream(spark, sf_dir).select(F.concat_ws("/", "user_id", n % 4).alias("path"), size.alias("size"), n.alias("seq"))
    return st.run_to_table(st.completed_files(samples), st.COMPLETION_OUT)


def st03_rate_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    calls = _stream(spark, sf_dir).select(F.col("user_id").cast("string").alias("producer"), F.col("event_id").alias("seq"), F.unix_millis(F.col("ts").cast("timestamp")).alias("ms"))
    return st.run_to_table(st.limited_calls(calls, 2), st.LIMIT_OUT).select("seq", "accepted")


def st04_validated_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls are validated before they count; what is accepted gets the server's name, and a time of its own."""
    valid = _stream(spark, sf_dir).where((F.col("value") > 0) & F.col("event_type").isin("click", "view", "purchase") & (F.col("event_id") % 6 > 0))
    calls = valid.select(F.col("event_type").alias("producer"), F.col("event_id").alias("seq"), F.unix_millis(F.col("ts").cast("timestamp")).alias("ms"))
    kept = st.run_to_table(st.limited_calls(calls, 5), st.LIMIT_OUT).where("accepted").withColumn("created_at", F.current_timestamp())
    return kept.select("seq", F.col("producer").alias("event_type"), F.lit("framequery").alias("app"), (F.col("created_at") > F.lit("2020-01-01")).alias("stamped"))


QUERIES = {
    "st01_completed_files": (
        st01_completed_files,
        """WITH e AS (SELECT user_id || '/' || event_id % 4 AS path, event_id AS seq, CASE WHEN event_id % 13 = 0 THEN 0 ELSE event_id // 2000 + 1 END AS size FROM events),
l AS (SELECT *, lag(size) OVER w AS p, sum((size <= 0)::INT) OVER w AS life FROM e WINDOW w AS (PARTITION BY path ORDER BY seq)),
r AS (SELECT *, sum((p IS NULL OR p <> size)::INT) OVER (PARTITION BY path ORDER BY seq) AS run FROM l),
g AS (SELECT *, row_number() OVER (PARTITION BY path, run ORDER BY seq) - 1 AS j FROM r WHERE size > 0)
SELECT path, arg_min(size, seq)::BIGINT AS size, min(seq) AS seq FROM g WHERE j >= 2 GROUP BY path, life""",
    ),
    "st03_rate_limit": (st03_rate_limit, "SELECT event_id AS seq, row_number() OVER (PARTITION BY user_id, date_trunc('hour', ts) ORDER BY epoch_ms(ts), event_id) <= 2 AS accepted FROM events"),
    "st04_validated_calls": (
        st04_validated_calls,
        """SELECT event_id AS seq, event_type, 'framequery' AS app, true AS stamped FROM events WHERE value > 0 AND event_type IN ('click', 'view', 'purchase') AND event_id % 6 > 0
QUALIFY row_number() OVER (PARTITION BY event_type, date_trunc('hour', ts) ORDER BY epoch_ms(ts), event_id) <= 5""",
    ),
}
