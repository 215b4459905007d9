import math

import numpy as np
from pyspark.sql import functions as F

from framequery.functions import pixels, rules, stats
from framequery.operators import catalog, frames, reduce, spectral


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_targets(spark):
    assert one(spark, rules.detect_target(F.lit("/Sun/2026/cap.ser"))) == "Sun"
    assert one(spark, rules.detect_target(F.lit("JUP_001"), F.lit(None).cast("string"))) == "Jupiter"
    assert one(spark, rules.detect_target(F.lit("x"), F.lit("y"))) is None


def test_metadata_first_wins(spark):
    assert one(spark, rules.metadata_map(F.lit("Gain=3 exp=1.5ms"), F.lit("gain=9 t=-4"))) == {"gain": 3.0, "exp": 1.5, "t": -4.0}
    assert one(spark, rules.metadata_map(F.lit(""))) == {}


def test_keep_percents(spark):
    assert one(spark, rules.keep_percents(F.lit("20, 40%;60  20 0 100 x"))) == [20, 40, 60]


def test_semver(spark):
    assert one(spark, rules.semver_newer(F.lit("1.10"), F.lit("1.9.9"))) is True
    assert one(spark, rules.semver_newer(F.lit("v1.2.0"), F.lit("1.2"))) is False


def test_lapd_of_flat_and_impulse(spark):
    rows = [(0, 0, [0.5] * 64), (0, 1, [float(p == 27) for p in range(64)])]
    got = {r.frame_idx: r.score for r in frames.sharpness(spark.createDataFrame(rows, "capture_id int, frame_idx int, plane array<double>")).collect()}
    assert abs(got[0]) < 1e-12 and got[1] > 0


def test_clipped_mean(spark):
    values = F.array(*map(F.lit, [1.0, 1.1, 0.9, 1.0, 1.05, 0.95, 50.0]))
    assert abs(one(spark, reduce.clipped_mean(values, 2.0, 3)) - 1.0) < 0.03
    assert one(spark, reduce.clipped_mean(F.expr("cast(array() as array<double>)"))) is None


def test_nearest_rank(spark):
    assert one(spark, stats.nearest_rank(F.array(*map(F.lit, range(1, 7))), 0.5)) == 4


def test_weights_of_tiles_sum_to_one(spark):
    px = spark.range(64).select(F.col("id").cast("int").alias("px"), (F.col("id") % 8).cast("int").alias("x"), F.floor(F.col("id") / 8).cast("int").alias("y"))
    for cosine in (False, True):
        sums = reduce.tile_of_pixel(px, 2, cosine=cosine).groupBy("px").agg(F.sum("w").alias("s")).collect()
        assert len(sums) == 64 and all(abs(r.s - 1) < 1e-9 for r in sums)


def test_half_flux_radius_of_a_disc(spark):
    n, r = 41, 15.0
    rows = [(0, x, y, 1.0 if math.hypot(x - 20, y - 20) <= r else 0.0) for x in range(n) for y in range(n)]
    got = stats.half_flux_radius(spark.createDataFrame(rows, "k int, x int, y int, v double"), ["k"]).first().hfr
    assert abs(got - r / math.sqrt(2)) < 0.5


def test_phase_correlation_finds_a_roll(spark):
    base = np.random.default_rng(1).random((16, 16))
    rows = [(0, i, np.roll(base, (dy, dx), (0, 1)).ravel().tolist()) for i, (dx, dy) in enumerate([(0, 0), (3, -2), (-5, 4)])]
    got = spectral.phase_correlation(spark.createDataFrame(rows, "c int, i int, plane array<double>"), base, 16).orderBy("i").collect()
    assert [(round(r.dx), round(r.dy)) for r in got] == [(0, 0), (-3, 2), (5, -4)]


def test_deconvolution_sharpens():
    sharp = np.zeros((1, 32, 32))
    sharp[0, 12:20, 12:20] = 1.0
    blurred = spectral.gaussian_blur(sharp, 1.5)
    for restored in (spectral.richardson_lucy(blurred, 1.5, 20), spectral.wiener(blurred, 1.5, 1e4)):
        assert np.abs(restored - sharp).mean() < np.abs(blurred - sharp).mean()


def test_tone_table_is_monotone():
    table = pixels.catmull_rom_table([(0.0, 0.0), (0.5, 0.4), (1.0, 1.0)], 64)
    assert table[0] == 0 and table[-1] == 1 and all(a <= b + 1e-12 for a, b in zip(table, table[1:]))


def test_nearest_takes_the_lower_of_two(spark):
    asked, cached = spark.createDataFrame([(1, 4), (1, 5), (1, 99)], "k int, want int"), spark.createDataFrame([(1, 2), (1, 6)], "k int, have int")
    got = {r.want: r.have for r in catalog.nearest(asked, cached, ["k"], "want", "have").collect()}
    assert got == {4: 2, 5: 6, 99: 6}
