"""Scans of mixed folders, frames of any format, baselines of JSON files, and corrections baked in."""

import json
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from framequery.functions import planes as pn
from framequery.operators import bake as bk
from framequery.operators import catalog as ct
from framequery.operators import export as ex
from framequery.operators import spectral as sp
from framequery.sources import fits, register, scan, ser


def png(w, h):
    return b"\x89PNG\r\n\x1a\n" + struct.pack(">I", 13) + b"IHDR" + struct.pack(">2I", w, h) + b"\x08\x02\0\0\0"


def jpeg(w, h):
    return b"\xff\xd8\xff\xe0" + struct.pack(">H", 16) + b"JFIF".ljust(14, b"\0") + b"\xff\xc4" + struct.pack(">H", 4) + b"ab" + b"\xff\xc2" + struct.pack(">HBHH", 11, 8, h, w) + b"\x01\x01\x11\0"


def tiff(w, h, order):
    entries = struct.pack(order + "HHII", 256, 4, 1, w) + struct.pack(order + "HHIHH", 257, 3, 1, h, 0)
    return (b"II*\0" if order == "<" else b"MM\0*") + struct.pack(order + "I", 12) + b"pad!" + struct.pack(order + "H", 2) + entries


def avi(w, h):
    return b"RIFF\0\0\0\0AVI LIST\0\0\0\0hdrlavih" + struct.pack("<I", 56) + struct.pack("<14I", *([0] * 8), w, h, 0, 0, 0, 0)


@pytest.fixture
def session(tmp_path):
    root = tmp_path / "a session"
    (root / "jupiter" / "deep").mkdir(parents=True)
    (root / ".hidden").mkdir()
    plane = np.arange(12, dtype=np.float32).reshape(3, 4) / 12
    files = {
        "m10.ser": ser.synthetic(w=6, h=4, n=3), "m9.SER": ser.synthetic(w=8, h=2, n=2), "i.fit": fits.encode(plane), "p.png": png(70000, 3), "q.jpg": jpeg(640, 480), "t.tif": tiff(5, 7, "<"),
        "u.tiff": tiff(9, 11, ">"), "v.avi": avi(320, 200), "broken.png": b"\x89PN", "empty.ser": b"", "short.jpeg": b"\xff\xd8\xff", "notes.txt": b"x", ".m11.ser": ser.synthetic(),
        "jupiter/a.ser": ser.synthetic(w=2, h=2, n=5), "jupiter/deep/sun.ser": ser.synthetic(w=4, h=4, n=7), ".hidden/b.ser": ser.synthetic(),
    }
    for name, data in files.items():
        (root / name).write_bytes(data)
    return root


def test_scan_sizes_and_order(spark, session):
    found = scan.scan(spark, str(session)).orderBy("sort_key").collect()
    sizes = {r.name: (r.w, r.h) for r in found}
    assert sizes == {
        "m10.ser": (6, 4), "m9.SER": (8, 2), "i.fit": (4, 3), "p.png": (70000, 3), "q.jpg": (640, 480), "t.tif": (5, 7), "u.tiff": (9, 11), "v.avi": (320, 200),
        "broken.png": (None, None), "empty.ser": (None, None), "short.jpeg": (None, None),
    }
    names = [r.name for r in found]
    assert names.index("m9.SER") < names.index("m10.ser")
    assert all(r.size == (session / r.name).stat().st_size and r.modified is not None for r in found)


def test_scan_goes_down_and_finds_targets(spark, session, tmp_path):
    deep = {r.name: r.target for r in scan.scan(spark, str(session), recursive=True).collect()}
    assert len(deep) == 13 and deep["a.ser"] == "Jupiter" and deep["sun.ser"] == "Sun" and deep["m10.ser"] is None
    by_uri = scan.scan(spark, session.as_uri().replace("%20", " "), recursive=True)
    assert by_uri.count() == 13 and by_uri.where("w IS NOT NULL").count() == 10
    (tmp_path / "empty").mkdir()
    assert scan.scan(spark, str(tmp_path / "empty")).count() == 0 == scan.scan(spark, str(tmp_path / "gone"), recursive=True).count()


def test_frames_of_any_format(spark, tmp_path):
    plane = np.arange(12, dtype=np.float32).reshape(3, 4) / 12
    (tmp_path / "a.ser").write_bytes(ser.synthetic(w=6, h=4, n=3))
    (tmp_path / "i.fits").write_bytes(fits.encode(plane))
    both = {(r.path.rsplit("/", 1)[-1], r.frame_idx): r for r in scan.open_frames(spark, str(tmp_path)).collect()}
    assert sorted(both) == [("a.ser", 0), ("a.ser", 1), ("a.ser", 2), ("i.fits", 0)]
    assert both["i.fits", 0].plane == pytest.approx(plane.ravel().tolist()) and both["a.ser", 1].plane[0] == pytest.approx(0x11 / 255)
    assert scan.open_frames(spark, str(tmp_path / "a.ser")).count() == 3
    for name in ("x.mov", "x.txt", "x"):
        (tmp_path / name).write_bytes(b"")
        with pytest.raises(ValueError):
            scan.open_frames(spark, str(tmp_path / name))


def test_baselines_against_a_walk(spark, session, tmp_path):
    (tmp_path / "base" / "old").mkdir(parents=True)
    one = {"frameCount": 5, "imageWidth": 2, "imageHeight": 2, "pixelDepth": 8, "bytesPerFrame": 4, "app": "x"}
    (tmp_path / "base" / "jupiter__a.ser.json").write_text(json.dumps(one, indent=2))
    (tmp_path / "base" / "old" / "deep__sun.ser.json").write_text(json.dumps(one | {"frameCount": 8, "imageWidth": 4, "imageHeight": 4, "bytesPerFrame": 16, "extra": 1}))
    (tmp_path / "base" / "none.json").write_text("not json")
    base = scan.baselines(spark, str(tmp_path / "base"))
    assert {(r.value, r.text) for r in base.where("key = 'app'").collect()} == {(None, "x")}
    heads = scan.headers(scan.listed(spark, str(session), recursive=True).where(F.col("path").contains("jupiter")))
    diff = ct.metric_diff(scan.capture_metrics(heads), base.where("value IS NOT NULL").drop("text"), {"frameCount": 0.1})
    assert sorted(map(tuple, diff.collect())) == [("deep__sun.ser", "extra", "MISSING"), ("deep__sun.ser", "frameCount", "DIFFERENT")]
    every = scan.headers(scan.listed(spark, str(session), recursive=True))
    assert every.count() == 4  # the empty one has no header


def by_hand(image, first, turn):
    """Grey world of the first image, the means of 2 x 2 pixels, quarters of a turn; one channel and pixel at a time."""
    h, w, _ = image.shape
    off = [sorted(first[:, :, c].ravel())[int((h * w - 1) * 0.05 + 0.5)] for c in range(3)]
    mean = [sum(max(0.0, v - off[c]) for v in first[:, :, c].ravel()) / (h * w) for c in range(3)]
    out = np.zeros((h // 2, w // 2, 3))
    for y in range(h // 2):
        for x in range(w // 2):
            for c in range(3):
                cell = [max(0.0, (image[2 * y + j, 2 * x + i, c] - off[c]) * mean[1] / mean[c]) for j in (0, 1) for i in (0, 1)]
                out[y, x, c] = min(1.0, sum(cell) / 4)
    turned = np.zeros((w // 2, h // 2, 3) if turn % 2 else out.shape)
    for y in range(h // 2):
        for x in range(w // 2):
            ty, tx = {0: (y, x), 1: (x, h // 2 - 1 - y), 2: (h // 2 - 1 - y, w // 2 - 1 - x), 3: (w // 2 - 1 - x, y)}[turn]
            turned[ty, tx] = out[y, x]
    return turned


@pytest.mark.parametrize(("degrees", "turn"), [(0, 0), (90, 1), (-180, 2), (275, 3)])
def test_bake_freezes_the_first_frame(spark, tmp_path, degrees, turn):
    register(spark)
    rng = np.random.default_rng(degrees % 7)
    source, out = tmp_path / "in", tmp_path / "out"
    source.mkdir()
    raw = {n: rng.integers(20, 255, (4, 6, 8, 3)).astype(np.uint8) for n in ("a", "b")}
    for n, frames in raw.items():
        ser.write_ser(str(source / f"{n}.ser"), [f.tobytes() for f in frames], w=8, h=6, color_id=16)
    read = spark.read.format("ser")
    first = read.option("firstFrames", "1").load(str(source))
    assert first.count() == 2
    frames = spark.read.format("ser").load(str(source))
    job = bk.Bake(divisor=2, degrees=degrees)
    ex.write_captures(bk.baked(frames, first, job), str(out), index="frame_idx")
    rows = spark.read.format("ser").load(str(out)).collect()
    assert len(rows) == 8
    for r in rows:
        want = by_hand(raw[r.path[-5]][r.frame_idx] / 255, raw[r.path[-5]][0] / 255, turn)
        got = np.frombuffer(r.data, "<u2").reshape(r.h, r.w, 3) / 65535
        assert (r.depth, r.color) == (16, "rgb") and np.abs(got - want).max() < 1e-5
    again = {(r.path, r.frame_idx): r.data for r in bk.baked(frames, bk.first_frames(frames), job).collect()}
    assert sorted(d for d in again.values()) == sorted(r.data for r in rows)


def test_bake_of_other_kinds(spark):
    rows = [("m", 0, 4, 4, 8, "mono", None, bytes(range(16))), ("flat", 0, 4, 4, 16, "bayerRGGB", 7, b"\x00\x80" * 16), ("none", 3, 4, 4, 8, "mono", None, bytes(range(0, 160, 10)))]
    frames = spark.createDataFrame(rows, ser.FRAME_SCHEMA)
    job = bk.Bake(normalise=True, sharpen=lambda image: image * 2, crop=(1, 1, 2, 3), depth=8)
    got = {r.path: r for r in bk.baked(frames, frames.where("path <> 'none'"), job).collect()}
    assert (got["m"].w, got["m"].h, got["m"].depth, got["m"].ticks, got["flat"].ticks) == (2, 3, 8, None, 7)
    # A flat mosaic is all background; a capture without a first frame keeps its colours.
    assert set(got["flat"].data) == {0}
    plane = np.arange(0, 160, 10).reshape(4, 4)[1:4, 1:3]
    assert np.frombuffer(got["none"].data, np.uint8).reshape(3, 2, 3).tolist() == np.repeat(np.minimum(plane * 2, 255)[:, :, None], 3, 2).tolist()
    assert bk.baked(frames.limit(0), frames.limit(0), job).count() == 0


def test_sizes_and_moves_of_planes(spark):
    plane = np.random.default_rng(4).random((5, 7))
    row = spark.createDataFrame([(plane.ravel().tolist(),)], "p array<double>")
    for w, h in ((7, 5), (3, 2), (14, 10), (1, 1)):
        got = row.select(pn.resampled(F.col("p"), 7, 5, w, h)).first()[0]
        assert np.abs(np.reshape(got, (h, w)) - bk.scaled(plane, h, w)).max() < 1e-12
    same, aside = row.select(pn.moved(F.col("p"), 7, 5, 0.0, 0.0), pn.moved(F.col("p"), 7, 5, 1.0, -2.0)).first()
    assert same == pytest.approx(plane.ravel().tolist())
    assert np.reshape(aside, (5, 7)).tolist() == pytest.approx(np.take(np.take(plane, [2, 3, 4, 4, 4], 0), [0, 0, 1, 2, 3, 4, 5], 1))
    noisy = np.random.default_rng(5).random((1, 16, 16)) * 0.01 + 0.5
    assert np.array_equal(sp.denoise(noisy, 0), noisy) and sp.denoise(noisy, 100).std() < 0.5 * noisy.std()
