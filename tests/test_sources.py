import json

import numpy as np
import pytest

from framequery.sources import fits, register, report, ser


def test_header_round_trip(tmp_path):
    data = ser.synthetic(w=8, h=6, n=3, strings=("Ann", "cam gain=12", "scope"), ticks=[10, 20, 30], utc=638000000000000000)
    h = ser.parse_header(data[:178], len(data))
    assert (h["w"], h["h"], h["frame_count"], h["readable_frames"], h["color"]) == (8, 6, 3, 3, "mono")
    assert (h["observer"], h["instrument"], h["ticks_utc"]) == ("Ann", "cam gain=12", 638000000000000000)


@pytest.mark.parametrize("color, expected", [(108, 8), (117, 17), (16, 16)])
def test_color_dialect(color, expected):
    assert ser.resolve_color(color, 10, 10, 8, 0, 0) == expected


def test_color_from_size_and_error():
    assert ser.resolve_color(55, 100, 100, 8, 10 * 30_000, 10) == 16
    assert ser.resolve_color(55, 100, 100, 16, 10 * 20_000 + 100, 10) == 0
    with pytest.raises(ValueError):
        ser.resolve_color(55, 100, 100, 8, 5, 10)


def test_rejects_short_files_and_odd_depths():
    with pytest.raises(ValueError):
        ser.parse_header(b"x" * 100, 100)
    with pytest.raises(ValueError):
        ser.parse_header(ser.synthetic(depth=12)[:178], 1000)


def test_truncated_file_reads_whole_frames_only(tmp_path, spark):
    register(spark)
    whole = ser.synthetic(w=8, h=6, n=5)
    (tmp_path / "a.ser").write_bytes(whole[:-10])
    (tmp_path / "b.ser").write_bytes(ser.synthetic(w=4, h=4, n=3, depth=16, ticks=[7, 8, 9]))
    (tmp_path / ".hidden.ser").write_bytes(whole)
    heads = spark.read.format("ser").option("headersOnly", "true").load(str(tmp_path)).orderBy("path").collect()
    assert [h.readable_frames for h in heads] == [4, 3]
    frames = spark.read.format("ser").option("bytesPerPartition", "150").load(str(tmp_path)).orderBy("path", "frame_idx").collect()
    assert [(f.frame_idx, f.data[0], f.ticks) for f in frames[:4]] == [(i, 0x10 + i, None) for i in range(4)]
    assert [f.ticks for f in frames[4:]] == [7, 8, 9]
    planes = spark.read.format("ser").load(str(tmp_path)).mapInArrow(ser.planes, "path string, frame_idx int, w int, h int, plane array<double>")
    assert planes.where("size(plane) = w * h").count() == 7


def test_bayer_sites_and_channels():
    mosaic = np.arange(16.0).reshape(4, 4)
    assert ser.bayer_sites("bayerRGGB") == {"R": [(0, 0)], "G": [(0, 1), (1, 0)], "B": [(1, 1)]}
    assert ser.bayer_channel(mosaic, "bayerRGGB", "G").tolist() == [[2.5, 4.5], [10.5, 12.5]]
    assert ser.combine_channels(*[np.ones((2, 2))] * 3).shape == (4, 4, 3)


def test_bgr_is_swapped():
    assert ser.unpack(bytes([1, 2, 3]), 1, 1, 8, "bgr")[0, 0].tolist() == [3 / 255, 2 / 255, 1 / 255]


def test_fits_round_trip(tmp_path, spark):
    plane = np.linspace(-1, 1, 15, dtype=np.float32).reshape(3, 5)
    data = fits.encode(plane, {"DATE-OBS": "2024-01-02T03:04:05", "OBJECT": "O'Neil / star"})
    assert len(data) % 2880 == 0
    cards, back = fits.decode(data)
    assert (back == plane).all() and cards["OBJECT"] == "O'Neil / star"
    (tmp_path / "x.fits").write_bytes(data)
    register(spark)
    row = spark.read.format("fits").load(str(tmp_path)).first()
    assert (row.w, row.h, row.date_obs) == (5, 3, "2024-01-02T03:04:05") and np.allclose(row.plane, plane.ravel())


def test_fits_rejects_other_kinds():
    with pytest.raises(ValueError):
        fits.decode(fits.encode(np.zeros((2, 2))).replace(b"-32", b"-64"))


def test_fits_cards():
    assert fits.parse_card("EXPTIME =                  1.5 / seconds") == ("EXPTIME", "1.5")
    assert fits.parse_card("HISTORY made") is None


def test_reports_of_a_folder(tmp_path, spark):
    (tmp_path / "a.ser").write_bytes(ser.synthetic(w=8, h=6, n=5, color_id=8, strings=("Ann", "cam", ""), utc=638000000000000000))
    (tmp_path / "b.ser").write_bytes(ser.synthetic(w=8, h=6, n=2, depth=16))
    plane = np.zeros((3, 5), np.float32)
    (tmp_path / "c.fits").write_bytes(fits.encode(plane, {"DATE-OBS": "2024-01-02T03:04:05"}))
    (tmp_path / "d.fit").write_bytes(fits.encode(plane))
    got = {r.path.rsplit("/", 1)[-1]: json.loads(r.report) for r in report.reports(spark, str(tmp_path)).collect()}
    assert sorted(got) == ["a.ser", "b.ser", "c.fits", "d.fit"] and all(list(r) == sorted(r) for r in got.values())
    a, b, c, d = (got[k] for k in sorted(got))
    assert (a["filename"], a["frameCount"], a["bytesPerFrame"], a["totalBytes"], a["colorID"], a["colorIsBayer"]) == ("a.ser", 5, 48, 240, "bayerRGGB", True)
    assert a["captureDateUTC"].startswith("2022-") and b["captureDateUTC"] is None and b["pixelDepth"] == 16 and b["colorIsMono"]
    assert c["captureDateUTC"] == "2024-01-02T03:04:05Z" and "captureDateUTC" not in d and d["totalBytes"] == (tmp_path / "d.fit").stat().st_size
    heads = spark.read.format("fits").option("headersOnly", "true").load(str(tmp_path))
    assert "plane" not in heads.columns and heads.count() == 2


def test_shares_hold_each_frame_once(tmp_path, spark):
    register(spark)
    (tmp_path / "a.ser").write_bytes(ser.synthetic(w=8, h=6, n=11, ticks=list(range(11))))
    (tmp_path / "empty.ser").write_bytes(ser.synthetic(w=8, h=6, n=0))
    for size in ("1", "100", "1000000"):
        got = spark.read.format("ser").option("bytesPerPartition", size).load(str(tmp_path)).collect()
        assert sorted((r.frame_idx, r.data[0], r.ticks) for r in got) == [(i, 0x10 + i, i) for i in range(11)]
