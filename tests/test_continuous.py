"""Streams over several micro-batches: the folder queue, uploads, previews, and captures passed frame by frame."""

import pytest

from framequery.sources import frame_stream as fs
from framequery.sources import register, ser
from framequery.streaming import stateful as st
from framequery.streaming import watch as wt

EVENTS = "folder string, seq long, kind string, path string, size long, target string"


def run(spark, tmp_path, batches, schema, f):
    """f over batches of rows, one micro-batch each."""
    source, out = tmp_path / "in", tmp_path / "out"
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(source))
    stream = f(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(source)))
    query = stream.writeStream.format("parquet").option("path", str(out)).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    # A last batch without rows lets timers fire.
    assert len(batches) <= len([p for p in query.recentProgress if p["batchId"] >= 0]) <= len(batches) + 1
    return sorted(map(tuple, spark.read.parquet(str(out)).collect()), key=lambda r: (r[0], r[1], str(r)))


def sizes(folder, seq, **paths):
    return [(folder, seq, "size", p, s, None if p.startswith("u") else "sun") for p, s in paths.items()]


def test_queue_runs_one_at_a_time_in_order(spark, tmp_path):
    batches = [
        [*sizes("d", 1, a=5, b=5, old=9), *sizes("e", 1, z=1)],
        [*sizes("d", 2, a=5, b=5, old=9), *sizes("e", 2, z=1)],
        [*sizes("d", 3, a=5, b=5, old=9, c=3), *sizes("e", 3, z=1)],  # a and b are complete; a starts
        [*sizes("d", 4, a=5, c=3, u1=2), ("d", 5, "failed", None, None, None)],  # b starts at once
        [*sizes("d", 6, c=3, u1=2), *sizes("d", 7, u1=2), ("d", 8, "done", None, None, None), ("d", 9, "done", None, None, None)],
        [*sizes("d", 10, a=6, y=1), *sizes("d", 11, a=6, y=1), *sizes("d", 12, a=6, y=1), ("d", 13, "size", "y", 1, "sun")],
    ]
    backlog = spark.createDataFrame([("d", "old")], "folder string, path string")
    got = run(spark, tmp_path, batches, EVENTS, lambda s: wt.folder_queue(s, backlog))
    assert got == [
        ("d", 3, "a", "sun", "started"), ("d", 5, "a", "sun", "failed"), ("d", 5, "b", "sun", "started"), ("d", 8, "b", "sun", "done"), ("d", 8, "c", "sun", "started"), ("d", 9, "c", "sun", "done"),
        ("d", 9, "u1", None, "skipped"), ("d", 12, "y", "sun", "started"), ("e", 3, "z", "sun", "started"),
    ]


def test_uploads_don_t_depend_on_batches(spark, tmp_path):
    rows = [("a", 1, 0), ("b", 1, 0), ("a", 2, 10), ("a", 2, 20), ("b", 1, 200), ("c", 1, 210), ("c", 1, 290), ("c", 1, 400)]
    rows = [(p, s, ms / 1000) for p, s, ms in rows]
    want = [
        ("a", 0, 1, "new"), ("a", 10, 2, "uploading"), ("a", 20, 2, "settled"), ("a", 120, 2, "gone"), ("b", 0, 1, "new"), ("b", 100, 1, "gone"), ("b", 200, 1, "new"), ("b", 300, 1, "gone"),
        ("c", 210, 1, "new"), ("c", 290, 1, "settled"), ("c", 390, 1, "gone"), ("c", 400, 1, "new"),
    ]
    for k, cuts in enumerate([[0, 8], [0, 3, 8], [0, 1, 2, 5, 7, 8]]):
        batches = [rows[a:b] for a, b in zip(cuts, cuts[1:])]
        f = lambda s: wt.upload_states(s.selectExpr("path", "size", "timestamp_millis(1000 + cast(round(s * 1000) as long)) AS at"), 100)
        (tmp_path / str(k)).mkdir()
        assert run(spark, tmp_path / str(k), batches, "path string, size long, s double", f) == [(p, 1000 + ms, size, state) for p, ms, size, state in want]


def test_previews_are_thinned_and_settle(spark, tmp_path):
    at = [0, 10, 32, 33, 40, 70, 269, 270, 280, 600]
    batches = [[("k", ms) for ms in at[:4]], [("k", ms) for ms in at[4:7]], [("k", ms) for ms in at[7:]]]
    got = run(spark, tmp_path, batches, "key string, t long", lambda s: wt.previews(s.selectExpr("key", "timestamp_millis(1000 + t) AS at")))
    assert got == [("k", 1000 + t, kind) for t, kind in [(0, "preview"), (33, "preview"), (70, "preview"), (269, "preview"), (480, "full"), (600, "preview")]]
    with pytest.raises(ValueError):
        wt.previews(spark.createDataFrame([], "key string, at timestamp"), 200, 33)


def test_limits_are_kept_over_batches_and_hours(spark, tmp_path):
    hour = st.HOUR_MS
    batches = [[("p", 1, 5), ("p", 2, hour + 1), ("q", 3, 7)], [("p", 4, 6), ("p", 5, 7), ("p", 6, hour + 2)], [("p", 7, 8), ("p", 8, hour + 3), ("p", 9, 2 * hour)]]
    got = run(spark, tmp_path, batches, "producer string, seq long, ms long", lambda s: st.limited_calls(s, 2))
    assert {r[1]: (r[2], r[3]) for r in got} == {1: (0, True), 2: (1, True), 3: (0, True), 4: (0, True), 5: (0, False), 6: (1, True), 7: (0, False), 8: (1, False), 9: (2, True)}


def test_frames_pass_in_bounded_steps_and_go_on_after_a_stop(spark, tmp_path):
    register(spark)
    captures, plan, out = tmp_path / "captures", str(tmp_path / "plan"), str(tmp_path / "out")
    captures.mkdir()
    (captures / "a.ser").write_bytes(ser.synthetic(w=8, h=6, n=50, ticks=list(range(50))))
    (captures / "empty.ser").write_bytes(ser.synthetic(w=8, h=6, n=0))
    heads = lambda: spark.read.format("ser").option("headersOnly", "true").load(str(captures))
    fs.add_to_plan(fs.frame_ranges(heads(), 4), plan)

    def start():
        frames = fs.frame_stream(spark, plan, 3).select("path", "frame_idx", "ticks", "data")
        return frames.writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "cp"))

    first = start().trigger(processingTime="200 milliseconds").start()
    while not first.recentProgress or first.lastProgress["batchId"] < 1:
        first.awaitTermination(0.1)
    first.stop()
    (captures / "b.ser").write_bytes(ser.synthetic(w=4, h=4, n=6))
    fs.add_to_plan(fs.frame_ranges(heads(), 4), plan)  # captures that are planned aren't again
    second = start().trigger(availableNow=True).start()
    second.awaitTermination(120)
    assert all(p["numInputRows"] <= 3 for q in (first, second) for p in q.recentProgress)
    rows = spark.read.parquet(out).collect()
    want = [("a.ser", k, str(k), 0x10 + k) for k in range(50)] + [("b.ser", k, "None", 0x10 + k) for k in range(6)]
    assert sorted((r.path[-5:], r.frame_idx, str(r.ticks), r.data[0]) for r in rows) == sorted(want)


def test_slices_come_in_order(spark, tmp_path):
    table = spark.createDataFrame([(k, k % 3) for k in range(100)] + [(None, 9)], "id long, v long")
    seen = []
    query = st.in_slices(table, "id", 4, 2).writeStream.foreachBatch(lambda df, k: seen.append(sorted((r.id or 0) for r in df.collect()))).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert [len(s) for s in seen] == [26, 25, 25, 25] and [s[-1] for s in seen] == [24, 49, 74, 99]
