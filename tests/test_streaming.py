import pandas as pd

from framequery.streaming.stateful import completed_files, limited_calls, observe


def run(sizes, needed=2):
    state, fired = None, []
    for k, size in enumerate(sizes):
        state, done = observe(state, size, needed)
        if done:
            fired.append(k)
    return fired


def test_fires_once_after_two_repeats():
    assert run([5, 5, 5, 5, 5]) == [2]
    assert run([5, 6, 6, 7, 7, 7]) == [5]


def test_empty_sample_starts_over():
    assert run([5, 5, 5, 0, 5, 5, 5]) == [2, 6]
    assert run([0, 0, 0]) == []


def stream(spark, tmp_path, batches, schema, f, out):
    source = tmp_path / "in"
    source.mkdir()
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(source))
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(source))
    query = f(reader).writeStream.format("memory").queryName(out).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    return spark.table(out).toPandas()


def test_completion_stream(spark, tmp_path):
    batches = [[("a", 5, 0), ("b", 1, 0)], [("a", 5, 1), ("b", 2, 1)], [("a", 5, 2), ("b", 2, 2)], [("a", 5, 3), ("b", 2, 3)]]
    got = stream(spark, tmp_path, batches, "path string, size long, seq long", completed_files, "done")
    assert sorted(map(tuple, got.values.tolist())) == [("a", 5, 2), ("b", 2, 3)]


def test_rate_limit_stream(spark, tmp_path):
    hour = 3_600_000
    batches = [[("p", 1, 10), ("p", 2, 20), ("q", 3, 5)], [("p", 4, 30), ("p", 5, hour + 1)]]
    got = stream(spark, tmp_path, batches, "producer string, seq long, ms long", lambda d: limited_calls(d, 2), "calls")
    assert dict(zip(got.seq, got.accepted)) == {1: True, 2: True, 3: True, 4: False, 5: True}
    assert isinstance(got, pd.DataFrame)
