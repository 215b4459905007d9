"""Presets, marks, sort keys, sampled distributions and masters against plain Python."""

import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from framequery.functions import planes as pn
from framequery.functions import rules as ru
from framequery.operators import catalog as ct
from framequery.operators import distribution as ds
from framequery.operators import frames as fr
from framequery.operators import presets as ps


def preset(**keys):
    return json.dumps({"id": "a", "name": "n", "target": "Moon", "luckyKeepPercent": 25} | keys)


def test_presets_from_json(spark):
    texts = [preset(), preset(id="b", luckyMultiAPGrid=3, luckyDetails={"autoPSF": True}), preset(id="c", target="Comet"), preset(id="d")[:20], "", None, "[1]", '{"id": "e"}', preset(id="f", unknown=1)]
    got = {r.id: r for r in ps.parsed(spark.createDataFrame([(t,) for t in texts], "t string"), "t").collect()}
    assert set(got) == {"a", "b", "f"}
    assert got["a"].luckyMultiAPPatchHalf == 8 and got["a"].luckyDetails is None and got["a"].isBuiltIn is False
    assert got["b"].luckyMultiAPGrid == 3 and got["b"].luckyDetails.autoPSF is True and got["b"].luckyDetails.drizzleScale == 1
    assert ps.parsed(spark.createDataFrame([], "t string"), "t").count() == 0


def test_presets_saved_and_deleted(spark):
    schema = "id string, name string, isBuiltIn boolean, modifiedAt timestamp"
    user = spark.createDataFrame([("a", "old", True, None), ("b", "kept", True, None), ("c", "gone", False, None)], schema)
    rows = [("a", "one", 1, 10, False), ("a", "two", 2, 20, False), ("c", "x", 1, 10, True), ("d", "new", 1, 5, False), ("d", None, 2, 6, True), ("d", "again", 3, 7, False), ("z", None, 1, 1, True)]
    changes = spark.createDataFrame(rows, "id string, name string, seq long, at long, gone boolean").select("id", "name", F.lit(True).alias("isBuiltIn"), F.lit(None).cast("timestamp").alias("modifiedAt"), "seq", F.timestamp_seconds("at").alias("at"), "gone")
    got = {r.id: r for r in ps.replayed(user, changes, "seq", "at", F.col("gone")).collect()}
    assert {k: r.name for k, r in got.items()} == {"a": "two", "b": "kept", "d": "again"}
    assert not got["a"].isBuiltIn and got["b"].isBuiltIn and got["a"].modifiedAt is not None and got["b"].modifiedAt is None
    none = changes.where("false")
    assert ps.replayed(user, none, "seq", "at", F.col("gone")).count() == 3
    assert {r.id for r in ps.replayed(user.where("false"), changes, "seq", "at", F.col("gone")).collect()} == {"a", "d"}


def test_marks(spark):
    files = spark.createDataFrame([(k,) for k in (1, 2, 2, 3, None)], "id long")
    marks, chosen = (spark.createDataFrame([(k,) for k in ids], "id long") for ids in ((2, 9, None), (3, 3)))
    want = {"all": {1, 2, 3}, "none": set(), "invert": {1, 3}, "selection": {2, 3, 9}}
    for action, ids in want.items():
        rows = [r.id for r in ct.marked(files, "id", marks, action, chosen).collect()]
        assert len(rows) == len(set(rows)) and set(rows) == ids
    with pytest.raises(ValueError, match="no such action"):
        ct.marked(files, "id", marks, "most")


def test_sorted_places(spark):
    rng = np.random.default_rng(6)
    rows = [(k, f"n{rng.integers(9)}.{'SER' if k % 2 else 'tif'}", None if k % 5 == 0 else float(rng.integers(4)), int(rng.integers(5)), None if k % 7 == 0 else 10, int(rng.integers(3))) for k in range(300)]
    files = spark.createDataFrame(rows, "id long, name string, sharpness double, bytes long, width long, height long").withColumn("created", F.lit(None).cast("timestamp")).repartition(5)
    got = {(r.key, r.id): r.place for r in ct.sorted_places(files, "id", ("sharpness",)).collect()}
    keys = {
        "name": lambda r: (r[1], r[0]), "type": lambda r: (r[1][-3:].lower(), r[0]), "sharpness": lambda r: (math.inf if r[2] is None else -r[2], r[0]), "created": lambda r: r[0],
        "size": lambda r: (r[3], r[0]), "area": lambda r: ((r[4] or 0) * r[5], r[0]),
    }
    assert len(got) == 6 * len(rows)
    for key, by in keys.items():
        assert [got[key, r[0]] for r in sorted(rows, key=by)] == list(range(1, len(rows) + 1)), key
    assert ct.sorted_places(files.where("false"), "id").count() == 0


def radius(plane):
    """Half-flux radius by plain loops over 0.5-pixel bins."""
    side = len(plane)
    lit = [(x, y, plane[y, x]) for y in range(side) for x in range(side) if plane[y, x] > 0]
    if not lit:
        return None
    total = sum(v for *_, v in lit)
    cx, cy = (sum(p[a] * p[2] for p in lit) / total for a in (0, 1))
    bins = {}
    for x, y, v in lit:
        b = math.floor(math.hypot(x - cx, y - cy) / 0.5)
        bins[b] = bins.get(b, 0) + v
    run = 0
    for b in sorted(bins):
        if run + bins[b] >= total / 2:
            return (b + (total / 2 - run) / bins[b]) * 0.5
        run += bins[b]


def test_half_flux_radius_in_the_row(spark):
    rng = np.random.default_rng(7)
    planes = [rng.normal(0.2, 1, (12, 12)) for _ in range(20)] + [np.zeros((12, 12)), -np.ones((12, 12)), np.eye(1, 144, 70).reshape(12, 12)]
    df = spark.createDataFrame([(k, p.ravel().tolist()) for k, p in enumerate(planes)], "k int, plane array<double>")
    got = {r.k: r.h for r in df.select("k", pn.half_flux_radius(F.col("plane"), 12).alias("h")).collect()}
    for k, p in enumerate(planes):
        want = radius(p)
        assert (got[k] is None) if want is None else got[k] == pytest.approx(want, abs=1e-9), k


def test_distribution_of_even_frames(spark):
    """A capture that rolls a known step between frames, one of a single frame, and one shorter than the sample."""
    rng = np.random.default_rng(8)
    base = rng.random((16, 16))
    rows = [("long", 10 * k, np.roll(base, 2 * k, axis=1).ravel().tolist()) for k in range(40)]
    rows += [("one", 5, base.ravel().tolist())] + [("short", k, np.roll(base, (k, 0), axis=(0, 1)).ravel().tolist()) for k in range(3)]
    frames = spark.createDataFrame(rows, "capture_id string, frame_idx long, plane array<double>").repartition(4)
    sampled = ds.even_frames(frames, 8)
    taken = {c: sorted(r.frame_idx for r in sampled.where(F.col("capture_id") == c).collect()) for c in ("long", "one", "short")}
    assert taken == {"long": [10 * min(39, int((i + 0.5) / 8 * 40)) for i in range(8)], "one": [5], "short": [0, 1, 2]}
    shifts = ds.adjacent_shifts(sampled, 16)
    got = {r.capture_id: r for r in ds.distribution(sampled, 16, ds.jitter(shifts)).collect()}
    # Five frames apart a roll of 10 is one of -6 around the edge.
    assert got["long"].jitter == pytest.approx(6, abs=0.05) and got["short"].jitter == pytest.approx(1, abs=0.05) and got["one"].jitter is None
    assert (got["long"].total_frames, got["long"].n, got["one"].n, got["short"].n) == (40, 8, 1, 3)
    assert got["long"].n_keep == 40 and got["long"].fraction == 1
    for r in got.values():
        assert r.least <= r.p10 <= r.p50 <= r.p90 <= r.most and r.median_hfr > 0


def test_frames_to_keep(spark):
    cases = [(64, 64, 1000, False, 750), (64, 64, 1000, True, 700), (1, 64, 1000, False, 200), (32, 64, 120, False, 100), (64, 64, 30, False, 30), (20, 64, 10_000, False, 3125)]
    df = spark.createDataFrame(cases, "a int, n int, t long, shaky boolean, want long")
    for r in df.withColumn("got", ds.keep_of(F.col("a"), F.col("n"), F.col("t"), F.col("shaky"))).collect():
        assert r.got == r.want, r


def test_masters_of_another_size_are_left_out(spark):
    frames = spark.createDataFrame([(1, 0, 2, 2, [5.0, 6.0, 7.0, 8.0]), (2, 0, 4, 1, [5.0, 6.0, 7.0, 8.0]), (3, 0, 2, 2, [-1.0, 1.0, 1.0, 1.0])], "capture_id int, frame_idx int, w int, h int, plane array<double>")
    masters = spark.createDataFrame([(1, "dark", 2, 2, [1.0] * 4), (1, "flat", 2, 2, [2.0, 1.0, 0.0, 0.5]), (2, "dark", 2, 2, [1.0] * 4), (2, "flat", 4, 1, [2.0] * 4), (3, "flat", 1, 4, [2.0] * 4)], "capture_id int, kind string, w int, h int, plane array<double>")
    got = {r.capture_id: (r.calibrated, r.plane) for r in fr.with_masters(frames, masters).collect()}
    assert got == {1: ("dark+flat", [2.0, 5.0, 6.0, 14.0]), 2: ("flat", [2.5, 3.0, 3.5, 4.0]), 3: ("", [-1.0, 1.0, 1.0, 1.0])}


def test_widths_in_order(spark):
    df = spark.createDataFrame([(1.0, 2.0, 3.0), (None, 2.0, 3.0), (None, None, 3.0), (None, 0.0, 9.0), (None, None, None)], "limb double, edge double, seeing double")
    got = [(r.sigma and round(r.sigma, 6), r.origin) for r in df.select(ru.psf_sigma(F.col("limb"), F.col("edge"), F.col("seeing")).alias("f")).select("f.*").collect()]
    assert got == [(1.0, "limb"), (2.0, "edge"), (2.7, "synthetic"), (1.5, "synthetic"), (None, "none")]
