"""Captures and images written by Spark and read back, and what a failed write leaves."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from framequery.operators import export as ex
from framequery.sources import fits, register, ser

FRAMES = "path string, frame_idx int, w int, h int, depth int, color string, ticks long, data binary"


def files(folder):
    return sorted(f for f in os.listdir(folder) if not f.startswith("."))


def test_captures_come_back_equal(tmp_path, spark):
    register(spark)
    source, out = tmp_path / "in", tmp_path / "out"
    source.mkdir()
    (source / "a.ser").write_bytes(ser.synthetic(w=8, h=6, n=11, ticks=list(range(11))))
    (source / "b.ser").write_bytes(ser.synthetic(w=4, h=4, n=3, depth=16, color_id=9))
    (source / "c.SER").write_bytes(ser.synthetic(w=3, h=5, n=2, color_id=17))
    frames = spark.read.format("ser").option("bytesPerPartition", "100").load(str(source))
    ex.write_captures(frames, str(out), index="frame_idx")
    assert files(out) == ["a.ser", "b.ser", "c.SER"]
    for name in files(out):
        assert (out / name).read_bytes() == (source / name).read_bytes()


def test_header_columns_ticks_and_parts(tmp_path, spark):
    register(spark)
    rows = [("x", k, 2, 2, 8, "mono", None, bytes([k] * 4), "Ann", 638000000000000000) for k in range(10)]
    frames = spark.createDataFrame(rows, FRAMES + ", observer string, ticks_utc long").repartition(3)
    ex.write_captures(frames, str(tmp_path / "o"), fps=50, frames_per_file=4, index="frame_idx")
    assert files(tmp_path / "o") == ["x-00000.ser", "x-00001.ser", "x-00002.ser"]
    heads = spark.read.format("ser").option("headersOnly", "true").load(str(tmp_path / "o")).collect()
    assert {(h.observer, h.ticks_utc) for h in heads} == {("Ann", 638000000000000000)} and sum(h.frame_count for h in heads) == 10
    back = spark.read.format("ser").load(str(tmp_path / "o")).orderBy("path", "frame_idx").collect()
    assert [(r.data[0], r.ticks) for r in back] == [(k, 638000000000000000 + k * 200_000) for k in range(10)]


def test_modes_and_refusals(tmp_path, spark):
    register(spark)
    folder = str(tmp_path / "o")
    one = lambda name, data=b"abcd", w=2: spark.createDataFrame([(name, 0, w, 2, 8, "mono", None, data)], FRAMES)
    one("x").write.format("ser").mode("append").save(folder)
    one("y").write.format("ser").mode("append").save(folder)
    with pytest.raises(Exception, match="already"):
        one("x", b"zzzz").write.format("ser").mode("append").save(folder)
    for bad in (one("z", b"abc"), one("z", None), one("z", b"", 0)):
        with pytest.raises(Exception):
            bad.write.format("ser").mode("append").save(folder)
    # What failed has left nothing behind, not even aside.
    assert files(folder) == ["x.ser", "y.ser"] and (tmp_path / "o" / "x.ser").read_bytes()[-4:] == b"abcd"
    one("z").write.format("ser").mode("overwrite").save(folder)
    assert files(folder) == ["z.ser"]
    with pytest.raises(Exception, match="no "):
        spark.range(1).write.format("ser").mode("append").save(folder)
    spark.createDataFrame([], FRAMES).write.format("ser").mode("append").save(str(tmp_path / "empty"))
    assert files(tmp_path / "empty") == []


def test_a_task_that_fails_leaves_no_file(tmp_path, spark):
    """One partition is written whole before another fails: neither shows."""
    register(spark)
    rows = [(f"f{k}", 0, 1, 1, 8, "mono", None, bytes([k])) for k in range(8)]
    frames = spark.createDataFrame(rows, FRAMES).repartition(4).withColumn("data", F.when(F.col("path") == "f7", F.lit(b"xx")).otherwise(F.col("data")))
    with pytest.raises(Exception, match="has not 1 bytes"):
        frames.write.format("ser").mode("append").save(str(tmp_path / "o"))
    assert not (tmp_path / "o").exists() or files(tmp_path / "o") == []


def picks_by_hand(idx, first, last, stride, target):
    n = max(idx) + 1
    start = max(0, min(first, n - 1))
    kept = list(range(start, max(start, min(last, n - 1)) + 1, stride))
    if not target or target >= len(kept):
        return kept
    return [kept[0]] if target == 1 else [kept[int(i * (len(kept) - 1) / (target - 1) + 0.5)] for i in range(target)]


@pytest.mark.parametrize("first, last, stride, target", [(0, 99, 1, None), (3, 50, 5, None), (3, 50, 5, 4), (0, 99, 1, 1), (40, 20, 1, None), (500, 600, 2, 3), (-5, 10, 3, 2)])
def test_picked_frames(spark, first, last, stride, target):
    frames = spark.createDataFrame([(p, k) for p, n in (("a", 60), ("b", 7)) for k in range(n)], "path string, frame_idx int")
    got = ex.picked_frames(frames, first, last, stride, target).orderBy("path", "at").collect()
    for p, n in (("a", 60), ("b", 7)):
        mine = [r for r in got if r.path == p]
        assert [r.frame_idx for r in mine] == picks_by_hand(range(n), first, last, stride, target)
        assert [r.at for r in mine] == list(range(len(mine))) and {r.frames for r in mine} == {len(mine)}


@pytest.mark.parametrize("color, wish, want", [
    ("mono", (3, 1, 5, 5), (3, 1, 5, 5)), ("bayerGRBG", (3, 1, 5, 5), (2, 0, 4, 4)), ("rgb", (-4, 2, 100, 1), (0, 2, 10, 2)), ("bayerRGGB", (8, 6, 9, 9), (8, 6, 2, 2)),
])
def test_crop(spark, color, wish, want):
    each = 3 if color in ("rgb", "bgr") else 1
    image = np.arange(10 * 8 * each, dtype=np.uint8)
    frames = spark.createDataFrame([("p", 0, 10, 8, 8, color, None, image.tobytes())], FRAMES)
    row = ex.cropped(frames, ex.crop_window(F.col("w"), F.col("h"), F.col("color"), *wish)).first()
    x, y, w, h = want
    assert (row.w, row.h) == (w, h)
    assert bytes(row.data) == image.reshape(8, 10, each)[y : y + h, x : x + w].tobytes()


def test_images_come_back_equal(tmp_path, spark):
    register(spark)
    rows = [(f"/far/{k}.fits", 3, 2, "2024-01-02T03:04:05", {"NOTE": "O'Neil / x", "GAIN": "1.50", "FLAG": "T", "WORD": "inf", "NAXIS1": "99"}, [float(k + j) for j in range(6)]) for k in range(5)]
    images = spark.createDataFrame(rows, fits.SCHEMA).repartition(2)
    images.write.format("fits").mode("append").save(str(tmp_path / "o"))
    back = {r.path.rsplit("/", 1)[-1]: r for r in spark.read.format("fits").load(str(tmp_path / "o")).collect()}
    assert sorted(back) == [f"{k}.fits" for k in range(5)]
    for k in range(5):
        r = back[f"{k}.fits"]
        assert (r.w, r.h, r.date_obs, list(r.plane)) == (3, 2, "2024-01-02T03:04:05", rows[k][5])
        assert {c: r.cards[c] for c in ("NOTE", "GAIN", "FLAG", "WORD", "NAXIS1")} == {"NOTE": "O'Neil / x", "GAIN": "1.50", "FLAG": "T", "WORD": "inf", "NAXIS1": "3"}
    with pytest.raises(Exception, match="pixels"):
        images.withColumn("w", F.lit(4)).write.format("fits").mode("overwrite").save(str(tmp_path / "o"))
    assert len(files(tmp_path / "o")) == 5
