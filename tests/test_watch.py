import numpy as np

from framequery.operators import spectral as sp
from framequery.streaming.stateful import arrivals, current_callbacks, debounced
from tests.test_streaming import stream


def test_superseded_runs_are_dropped_over_batches(spark, tmp_path):
    batches = [[("q", 1, 0), ("q", 2, 1), ("q", 1, 2)], [("q", 1, 3), ("q", 2, 4), ("r", 1, 5)], [("q", 3, 6), ("q", 2, 7)]]
    got = stream(spark, tmp_path, batches, "queue string, generation long, seq long", current_callbacks, "current")
    assert sorted(got.seq) == [0, 1, 4, 5, 6]


def test_watch_passes_over_backlog_and_unknown_targets(spark, tmp_path):
    old = spark.createDataFrame([("a",)], "path string")
    batches = [[("a", "Moon"), ("b", "Sun")], [("c", None), ("d", "Mars")]]
    got = stream(spark, tmp_path, batches, "path string, target string", lambda f: arrivals(f, old), "arrived")
    assert sorted(got.path) == ["b", "d"]


def test_bursts_make_one_write(spark):
    rows = spark.createDataFrame([("k", 0.0), ("k", 0.3), ("k", 0.7), ("k", 2.0), ("m", 0.1)], "key string, s double")
    got = debounced(rows.selectExpr("key", "timestamp_millis(cast(s * 1000 AS long)) AS at"), "500 milliseconds")
    assert sorted((r.key, r.requests) for r in got.collect()) == [("k", 1), ("k", 3), ("m", 1)]


def _scene(side):
    y, x = np.mgrid[:side, :side]
    rng = np.random.default_rng(1)
    return sum(np.exp(-((x - a) ** 2 + (y - b) ** 2) / 8.0) for a, b in rng.integers(side // 4, 3 * side // 4, (12, 2)))


def test_region_and_channel_shifts_are_found(spark):
    plane = _scene(64)
    moved = np.roll(plane, (2, -3), axis=(0, 1))
    frames = spark.createDataFrame([(0, moved.ravel().tolist())], "id int, plane array<double>")
    r = sp.region_correlation(frames, plane, 64, (0.0, 0.0, 1.0, 1.0)).first()
    assert abs(r.dx - 3) < 0.6 and abs(r.dy + 2) < 0.6
    assert sp.region_correlation(frames, plane, 64, (0.1, 0.1, 0.5, 0.5)).first().dx is None
    other = _scene(64)[::-1].copy()  # each frame beside a reference of its own
    rows = [(0, moved.ravel().tolist(), plane.ravel().tolist()), (1, np.roll(other, (1, 4), axis=(0, 1)).ravel().tolist(), other.ravel().tolist())]
    own = sp.region_correlation(spark.createDataFrame(rows, "id int, plane array<double>, reference array<double>"), "reference", 64, (0.0, 0.0, 1.0, 1.0)).orderBy("id").collect()
    assert all(abs(q.dx - dx) < 0.6 and abs(q.dy - dy) < 0.6 for q, (dx, dy) in zip(own, [(3, -2), (-4, -1)], strict=True))
    far = np.roll(plane, 9, axis=1)
    images = spark.createDataFrame([(0, moved.ravel().tolist(), plane.ravel().tolist(), far.ravel().tolist())], "id int, red array<double>, green array<double>, blue array<double>")
    c = sp.channel_shifts(images, 64).first()
    assert abs(c.red_dx - 3) < 0.6 and abs(c.red_dy + 2) < 0.6
    assert (c.blue_dx, c.blue_dy) == (0.0, 0.0)


def test_cascade_finds_shifts_and_ignores_a_far_basin(spark):
    plane = _scene(128)
    wanted = [(3, -2), (-17, 9), (0, 0)]
    rows = [(k, np.roll(plane, (-dy, -dx), axis=(0, 1)).ravel().tolist(), plane.ravel().tolist()) for k, (dx, dy) in enumerate(wanted)]
    frames = spark.createDataFrame(rows, "id int, plane array<double>, reference array<double>")
    for coarse, side_least in ((64, 64), (64, 256)):
        got = {r.id: (r.dx, r.dy) for r in sp.cascade_correlation(frames, "reference", 128, coarse=coarse, least=side_least).collect()}
        assert all(abs(got[k][0] - dx) < 1.5 and abs(got[k][1] - dy) < 1.5 for k, (dx, dy) in enumerate(wanted)), got
    # The peak at (20, 0) is higher, but only those near (2, 126) count.
    surface = np.zeros((1, 128, 128))
    surface[0, 0, 20], surface[0, 127, 2] = 2.0, 1.0
    cross = np.fft.fft2(surface)
    dx, dy = sp._peak_shift(cross, 128, (np.array([2]), np.array([-2])), 8)
    assert abs(dx[0] - 2) <= 0.5 and abs(dy[0] + 1) <= 0.5


def test_phase_correlation_takes_a_reference_per_row(spark):
    plane = _scene(32)
    rows = [(0, np.roll(plane, 2, axis=1).ravel().tolist(), plane.ravel().tolist()), (1, plane.ravel().tolist(), np.roll(plane, 3, axis=0).ravel().tolist())]
    got = sp.phase_correlation(spark.createDataFrame(rows, "id int, plane array<double>, reference array<double>"), "reference", 32)
    assert got.columns == ["id", "dx", "dy"]
    found = {r.id: (round(r.dx), round(r.dy)) for r in got.collect()}
    assert found == {0: (-2, 0), 1: (0, 3)}
