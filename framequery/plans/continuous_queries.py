"""Continuous use as streams of several micro-batches over `events` and written captures, with the DuckDB SQL of their results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framequery.operators import export as ex
from framequery.plans.stream_queries import _stream, _timed_stream
from framequery.plans.writer_queries import _raw
from framequery.session import shared_path
from framequery.sources import frame_stream as fs
from framequery.sources import register
from framequery.streaming import stateful as st
from framequery.streaming import watch as wt


def _folder_events(events: DataFrame) -> DataFrame:
    """Each 40 events are 8 rows of a file in each of 5 folders: sizes that settle or don't, and ends of what runs."""
    n = F.col("event_id")
    k, j = F.floor(n / 40), F.floor(n / 5) % 8
    kind = F.when((j == 6) & (k % 2 == 0), "done").when((j == 7) & (k % 3 == 0), "failed").otherwise("size")
    size = F.when((k % 11 == 0) & (j == 3), 0).when((k % 7 == 0) | (j < 2), j + 1).otherwise(7)
    path = F.concat(F.lit("f"), k)
    return events.select(
        F.concat(F.lit("d"), n % 5).alias("folder"), n.alias("seq"), kind.alias("kind"), F.when(kind == "size", path).alias("path"),
        F.when(kind == "size", size).cast("long").alias("size"), F.when(k % 5 != 0, F.concat(F.lit("t"), k % 3)).alias("target"),
    )


def st02_folder_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every ninth file was there at the start."""
    all_events = _folder_events(spark.read.parquet(f"{sf_dir}/events.parquet"))
    backlog = all_events.where("path IS NOT NULL AND cast(substr(path, 2) AS int) % 9 = 0").select("folder", "path").distinct()
    return st.run_to_table(wt.folder_queue(_folder_events(_stream(spark, sf_dir)), backlog), wt.QUEUE_OUT)


def st05_upload_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as polls of a user's file; a file is gone after an hour and a half without one."""
    samples = _timed_stream(spark, sf_dir).select(F.col("user_id").cast("string").alias("path"), F.floor(F.col("event_id") / 900).alias("size"), "at")
    return st.run_to_table(wt.upload_states(samples, 5_400_000), wt.UPLOAD_OUT)


def st06_previews(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as changes of a user's slider: previews 20 minutes apart, the full result after 50 quiet minutes."""
    requests = _timed_stream(spark, sf_dir).select(F.col("user_id").cast("string").alias("key"), "at")
    return st.run_to_table(wt.previews(requests, 1_200_000, 3_000_000), wt.PREVIEW_OUT)


def st06_debounced_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The bursts of st06_debounced_writes as they leave a stream: those whose gap the watermark has passed."""
    requests = _stream(spark, sf_dir).select(F.col("user_id").alias("key"), F.col("ts").cast("timestamp").alias("at")).withWatermark("at", "10 minutes")
    out = st.debounced(requests, "45 minutes").select("key", "requests", F.unix_micros("at").alias("us"))
    return st.run_to_table(out, "key long, requests long, us long")


def st08_frame_pass(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All frames of written captures, passed as a stream: 50 frames a range, 4 ranges a file, 4 files a trigger."""
    register(spark)
    captures, plan = shared_path(spark, "captures"), shared_path(spark, "plan")
    ex.write_captures(_raw(spark, sf_dir), captures, index="frame_idx")
    headers = spark.read.format("ser").option("headersOnly", "true").load(captures)
    fs.add_to_plan(fs.frame_ranges(headers, 50), plan, 4)
    name = F.element_at(F.split("path", "/"), -1)
    frames = fs.frame_stream(spark, plan, 4).select(name.alias("name"), "frame_idx", "color", F.hex("data").alias("data"))
    return st.run_to_table(frames, "name string, frame_idx int, color string, data string")


_POLLS = "e AS (SELECT user_id::VARCHAR AS key, event_id // 900 AS size, epoch_us(ts) // 1000 AS ms, max(epoch_us(ts) // 1000) OVER () AS wm FROM events)"

QUERIES = {
    "st02_folder_queue": (
        st02_folder_queue,
        """WITH RECURSIVE n AS (SELECT 'd' || event_id % 5 AS folder, event_id AS seq, event_id // 40 AS k, event_id // 5 % 8 AS j FROM events),
v AS (SELECT *, CASE WHEN j = 6 AND k % 2 = 0 THEN 'done' WHEN j = 7 AND k % 3 = 0 THEN 'failed' ELSE 'size' END AS kind,
        CASE WHEN k % 11 = 0 AND j = 3 THEN 0 WHEN k % 7 = 0 OR j < 2 THEN j + 1 ELSE 7 END AS size FROM n),
l AS (SELECT *, lag(size) OVER w AS p, sum((size <= 0)::INT) OVER w AS life FROM v WHERE kind = 'size' WINDOW w AS (PARTITION BY folder, k ORDER BY seq)),
r AS (SELECT *, sum((p IS NULL OR p <> size)::INT) OVER (PARTITION BY folder, k ORDER BY seq) AS run FROM l),
g AS (SELECT *, row_number() OVER (PARTITION BY folder, k, run ORDER BY seq) - 1 AS same FROM r WHERE size > 0),
c AS (SELECT folder, k, min(seq) AS c FROM g WHERE same >= 2 AND k % 9 <> 0 GROUP BY folder, k),
q AS (SELECT *, row_number() OVER (PARTITION BY folder ORDER BY c, 'f' || k) AS nth, k % 5 <> 0 AS known FROM c),
x AS (SELECT folder, seq, lead(seq) OVER w AS next_tick, min(CASE WHEN kind <> 'size' THEN seq END) OVER (w ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS ends FROM v WINDOW w AS (PARTITION BY folder ORDER BY seq)),
t AS (SELECT folder, nth, k, known, c AS seq FROM q WHERE nth = 1
  UNION ALL SELECT q.folder, q.nth, q.k, q.known, greatest(q.c, CASE WHEN t.known THEN x.ends ELSE x.next_tick END) AS seq
  FROM t JOIN x ON x.folder = t.folder AND x.seq = t.seq JOIN q ON q.folder = t.folder AND q.nth = t.nth + 1 WHERE CASE WHEN t.known THEN x.ends ELSE x.next_tick END IS NOT NULL),
o AS (SELECT t.*, x.ends FROM t JOIN x USING (folder, seq))
SELECT folder, seq, 'f' || k AS path, CASE WHEN known THEN 't' || k % 3 END AS target, CASE WHEN known THEN 'started' ELSE 'skipped' END AS event FROM o
UNION ALL SELECT o.folder, o.ends AS seq, 'f' || o.k AS path, 't' || o.k % 3 AS target, v.kind AS event FROM o JOIN v ON v.folder = o.folder AND v.seq = o.ends WHERE known""",
    ),
    "st05_upload_states": (
        st05_upload_states,
        f"""WITH {_POLLS}, l AS (SELECT *, lag(ms) OVER w AS before, lag(size) OVER w AS old, lead(ms) OVER w AS after FROM e WINDOW w AS (PARTITION BY key ORDER BY ms, size))
SELECT key AS path, ms, size, CASE WHEN before IS NULL OR ms - before > 5400000 THEN 'new' WHEN size = old THEN 'settled' ELSE 'uploading' END AS state FROM l
UNION ALL SELECT key, ms + 5400000, size, 'gone' FROM l WHERE after - ms > 5400000 OR (after IS NULL AND ms + 5400000 < wm)""",
    ),
    "st06_previews": (
        st06_previews,
        f"""WITH RECURSIVE {_POLLS}, d AS (SELECT DISTINCT key, ms FROM e),
a AS (SELECT *, min(ms) OVER (PARTITION BY key ORDER BY ms RANGE BETWEEN 1200000 FOLLOWING AND UNBOUNDED FOLLOWING) AS later FROM d),
p AS (SELECT key, min(ms) AS ms FROM d GROUP BY key UNION ALL SELECT a.key, a.later FROM p JOIN a ON a.key = p.key AND a.ms = p.ms WHERE a.later IS NOT NULL),
l AS (SELECT *, lead(ms) OVER (PARTITION BY key ORDER BY ms) AS after FROM e)
SELECT key, ms, 'preview' AS kind FROM p UNION ALL SELECT key, ms + 3000000, 'full' FROM l WHERE after - ms >= 3000000 OR (after IS NULL AND ms + 3000000 < wm)""",
    ),
    "st06_debounced_stream": (
        st06_debounced_stream,
        """WITH l AS (SELECT user_id AS key, ts, lag(ts) OVER (PARTITION BY user_id ORDER BY ts) AS p FROM events),
b AS (SELECT *, sum((p IS NULL OR ts > p + INTERVAL 45 MINUTE)::INT) OVER (PARTITION BY key ORDER BY ts) AS burst FROM l)
SELECT key, count(*) AS requests, max(epoch_us(ts)) AS us FROM b GROUP BY key, burst HAVING max(ts) + INTERVAL 45 MINUTE <= (SELECT date_trunc('milliseconds', max(ts)) - INTERVAL 10 MINUTE FROM events)""",
    ),
    "st08_frame_pass": (
        st08_frame_pass,
        """SELECT 'capture-' || label || '.ser' AS name, (row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1)::INT AS frame_idx, CASE WHEN label % 2 = 0 THEN 'bayerRGGB' ELSE 'mono' END AS color,
  array_to_string(list_transform(embedding, lambda v: format('{:02X}', floor(least(greatest(v::DOUBLE, 0), 1) * 255)::INT)), '') AS data FROM embeddings""",
    ),
}
