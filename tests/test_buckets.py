"""Many keys in few calls: a bucket's state is one row of the state store, and results are those of each key by itself."""

import random

import duckdb
import pytest

from framequery.plans import catalog
from framequery.streaming import stateful as st
from framequery.streaming import watch as wt
from framequery.streaming.buckets import BUCKETS


KEYS = 1500


def rows_of(seed):
    """Rows (key, n, k) of three batches, n in order."""
    r = random.Random(seed)
    return [(None if k == 7 else f"k{k}", n, r.randrange(3)) for n, k in enumerate(r.choices(range(KEYS), k=6 * KEYS))]


def run(spark, tmp_path, f):
    """f over the rows in three micro-batches: the rows that come out, by key, and the rows in the state store at most."""
    rows, source, out = rows_of(1), tmp_path / "in", tmp_path / "out"
    for k in range(3):
        spark.createDataFrame(rows[2 * KEYS * k : 2 * KEYS * (k + 1)], "key string, n long, k long").coalesce(1).write.mode("append").parquet(str(source))
    stream = f(spark.readStream.schema("key string, n long, k long").option("maxFilesPerTrigger", 1).parquet(str(source)))
    query = stream.writeStream.format("parquet").option("path", str(out)).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    by_key = {}
    for key, n, k in rows:
        by_key.setdefault(key, []).append((n, k))
    return by_key, spark.read.parquet(str(out)).collect(), max(p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["stateOperators"])


def test_completed_files_of_many_paths(spark, tmp_path):
    by_key, got, held = run(spark, tmp_path, lambda s: st.completed_files(s.selectExpr("key AS path", "k AS size", "n AS seq"), 1))
    want = []
    for key, seen in by_key.items():
        state = None
        for n, k in seen:
            state, done = st.observe(state, k, 1)
            want += [(key, k, n)] * done
    assert len(want) > 500 and sorted(map(str, want)) == sorted(str(tuple(r)) for r in got) and 0 < held <= BUCKETS


def test_limited_calls_of_many_producers(spark, tmp_path):
    by_key, got, held = run(spark, tmp_path, lambda s: st.limited_calls(s.selectExpr("key AS producer", "n AS seq", "k * 3600000 AS ms"), 2))
    want = [(key, n, k, sum(j == k for _, j in seen[:i]) < 2) for key, seen in by_key.items() for i, (n, k) in enumerate(seen)]
    # Within a batch calls count by time, here the order of n in an hour.
    assert sorted(map(str, want)) == sorted(str(tuple(r)) for r in got) and 0 < held <= BUCKETS


def test_producers_are_forgotten(spark, tmp_path):
    source, schema = str(tmp_path / "in"), "producer string, seq long, ms long"
    add = lambda *rows: spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
    add(("p", 1, 0), ("p", 2, 1), ("q", 3, 2))
    calls = st.limited_calls(spark.readStream.schema(schema).parquet(source), 1, forget_after=500)
    query = calls.writeStream.format("memory").queryName("forgotten").option("checkpointLocation", str(tmp_path / "cp")).trigger(processingTime="300 milliseconds").start()
    try:
        for _ in range(300):
            done = query.recentProgress
            if any(p["numInputRows"] for p in done) and done[-1]["stateOperators"][0]["numRowsTotal"] == 0:
                break
            query.awaitTermination(0.2)
        add(("p", 4, 3))
        for _ in range(300):
            if spark.table("forgotten").count() == 4:
                break
            query.awaitTermination(0.2)
    finally:
        query.stop()
    assert {r.seq: r.accepted for r in spark.table("forgotten").collect()} == {1: True, 2: False, 3: True, 4: True}


def test_current_callbacks_of_many_queues(spark, tmp_path):
    by_key, got, held = run(spark, tmp_path, lambda s: st.current_callbacks(s.selectExpr("key AS queue", "k AS generation", "n AS seq")))
    want = [(key, k, n) for key, seen in by_key.items() for i, (n, k) in enumerate(seen) if k >= max(j for _, j in seen[: i + 1])]
    assert sorted(map(str, want)) == sorted(str(tuple(r)) for r in got) and 0 < held <= BUCKETS


def test_uploads_of_many_paths(spark, tmp_path):
    by_key, got, held = run(spark, tmp_path, lambda s: wt.upload_states(s.selectExpr("key AS path", "k AS size", "timestamp_millis(1000 + n) AS at"), 1000))
    want, end = [], 6 * KEYS - 1
    for key, seen in by_key.items():
        for i, (n, k) in enumerate(seen):
            first = i == 0 or n - seen[i - 1][0] > 1000
            want.append((key, n, k, "new" if first else "settled" if seen[i - 1][1] == k else "uploading"))
            after = seen[i + 1][0] if i + 1 < len(seen) else None
            if (after is None and n + 1000 < end) or (after is not None and after - n > 1000):
                want.append((key, n + 1000, k, "gone"))
    assert sorted(map(str, want)) == sorted(str((r[0], r[1] - 1000, *r[2:])) for r in got) and 0 < held <= BUCKETS


@pytest.mark.parametrize("name", ["st05_upload_states", "st06_previews"])
def test_timed_queries_take_rows_in_any_order_of_ids(spark, tmp_path, name):
    path = str(tmp_path / "events.parquet")
    # Later ids have earlier times, as in copies of a table with shifted ids.
    spark.range(4000).selectExpr("id AS event_id", "timestamp_ntz'2024-01-01 00:00:00' + make_interval(0, 0, 0, 0, 0, 40 * ((3999 - id) % 2000), id % 50) AS ts", "id % 37 AS user_id").write.parquet(path)
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{path}/*.parquet'")
    want = con.execute(catalog.oracle_sql()[name]).fetchall()
    got = catalog.queries()[name](spark, str(tmp_path)).collect()
    assert len(want) > 4000 and sorted(map(str, want)) == sorted(str(tuple(r)) for r in got)


def test_previews_of_many_keys(spark, tmp_path):
    by_key, got, held = run(spark, tmp_path, lambda s: wt.previews(s.selectExpr("key", "timestamp_millis(1000 + n) AS at"), 700, 900))
    want, end = [], 6 * KEYS - 1
    for key, seen in by_key.items():
        shown = None
        for i, (n, _) in enumerate(seen):
            if shown is None or n - shown >= 700:
                want.append((key, n, "preview"))
                shown = n
            after = seen[i + 1][0] if i + 1 < len(seen) else None
            if (after is None and n + 900 < end) or (after is not None and after - n >= 900):
                want.append((key, n + 900, "full"))
    assert sorted(map(str, want)) == sorted(str((r[0], r[1] - 1000, *r[2:])) for r in got) and 0 < held <= BUCKETS


def test_a_folder_with_many_files_is_watched_by_buckets(spark, tmp_path):
    schema, source, out = "folder string, seq long, kind string, path string, size long, target string", str(tmp_path / "in"), str(tmp_path / "out")
    rows = [("d", 4 * i + j, *(("size", f"f{i}", 5, "sun") if j < 3 else ("done", None, None, None))) for i in range(1200) for j in range(4)]
    for k in range(3):
        spark.createDataFrame(rows[1600 * k : 1600 * (k + 1)], schema).coalesce(1).write.mode("append").parquet(source)
    stream = wt.folder_queue(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source), spark.createDataFrame([("d", "f3")], "folder string, path string"))
    query = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    want = [("d", 4 * i + k, f"f{i}", "sun", event) for i in range(1200) if i != 3 for k, event in ((2, "started"), (3, "done"))]
    assert sorted(want) == sorted(map(tuple, spark.read.parquet(out).collect()))
    assert 0 < max(sum(s["numRowsTotal"] for s in p["stateOperators"]) for p in query.recentProgress) <= BUCKETS + 2
