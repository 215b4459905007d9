"""Stack reducers and the drift fold against plain numpy and Python."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from framequery.functions import stats
from framequery.operators import reduce as rd


def frames(spark, planes):
    rows = [(c, i, p) for c, stack in planes.items() for i, p in enumerate(stack)]
    return spark.createDataFrame(rows, "capture_id long, frame_idx long, plane array<double>")


@pytest.mark.parametrize("rounds", [1, 3])
def test_clipping_rounds_match_numpy(spark, rounds):
    rng = np.random.default_rng(4)
    planes = {1: rng.normal(5, 1, (30, 64)), None: rng.normal(2, 1, (9, 64))}
    planes[1][3, 7], planes[1][4, 7] = 90.0, 30.0
    got = {(r.capture_id, r.px): (r.value, r.n_kept) for r in rd.sigma_clipped_plane(frames(spark, {c: p.tolist() for c, p in planes.items()}), 1.5, rounds).collect()}
    assert len(got) == 128
    for (capture, px), (value, n) in got.items():
        v = planes[capture][:, px]
        for _ in range(rounds):
            v = v[np.abs(v - v.mean()) <= 1.5 * v.std() + 1e-12]
        assert abs(value - v.mean()) < 1e-9 and n == len(v)


def test_clipping_keeps_the_mean_where_nothing_is_left_and_skips_missing_pixels(spark):
    low, high = [0.0, None] + [1.0] * 62, [2.0, None] + [1.0] * 62
    got = {r.px: (r.value, r.n_kept) for r in rd.sigma_clipped_plane(frames(spark, {0: [low, high]}), 0.5, 2).collect()}
    assert got[0] == (1.0, 0) and got[1] == (None, 0) and got[2] == (1.0, 2)
    assert rd.sigma_clipped_plane(frames(spark, {0: [low]}).limit(0), 2.0).count() == 0


def test_tile_weighted_mean_matches_the_weights_of_each_pixel(spark):
    rng = np.random.default_rng(9)
    planes = {0: rng.random((6, 64)).tolist()}
    weights = [(0, f, ty, tx, float(rng.random())) for f in range(4) for ty in range(4) for tx in range(4) if (f + ty + tx) % 3]
    w = spark.createDataFrame(weights, "capture_id long, frame_idx long, ty int, tx int, w double")
    for cosine in (False, True):
        got = {r.px: r.value for r in rd.tile_weighted_mean(frames(spark, planes), w, 2, cosine=cosine).collect()}
        blend = rd.tile_of_pixel(rd.exploded(frames(spark, {0: planes[0][:1]})).select("px", "x", "y"), 2, cosine=cosine).collect()
        own = {(f, ty, tx): v for _, f, ty, tx, v in weights}
        for px in range(64):
            parts = [(planes[0][f][px], b.w * own.get((f, b.ty, b.tx), 0.0)) for b in blend if b.px == px for f in range(6)]
            assert abs(got[px] - sum(v * x for v, x in parts) / sum(x for _, x in parts)) < 1e-9


def test_drift_fold_carries_its_history_over_batches(spark):
    rows = [(k, i, float(i), 0.0 if i % 7 else 100.0) for k in ("a", "b") for i in range(30)]
    rows += [("c", 0, None, None), ("c", 1, 1.0, 1.0), ("c", 2, None, 1.0), (None, 0, 3.0, 4.0)]
    shifts = spark.createDataFrame(rows, "k string, i long, dx double, dy double")

    def fold():
        return sorted(((r.k or "", r.i, r.dx, r.dy) for r in stats.drift_fold(shifts, "k", "i", F.col("i") == 5).collect()), key=lambda r: r[:2])

    whole, size = fold(), spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        assert fold() == whole
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
    got = {r[:2]: r[2:] for r in whole}
    assert len(whole) == len(rows) and got["c", 0] == (None, None) and got["c", 2] == (1.0, 1.0) and got["", 0] == (3.0, 4.0)
    assert got["a", 5] == (0.0, 0.0) and got["a", 0] == (0.0, 100.0)
