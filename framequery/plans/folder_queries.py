"""Folders of captures: scans, frames of any format, baselines, corrections baked in; sizes and channel shifts of planes.
With DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framequery.functions import pixels as px
from framequery.functions import planes as pn
from framequery.operators import bake as bk
from framequery.operators import catalog as ct
from framequery.operators import export as ex
from framequery.plans.frame_queries import _frames
from framequery.plans.geometry_queries import _TAPS, _TONE
from framequery.plans.pixel_queries import _SQL_RGB, _rgb
from framequery.plans.writer_queries import _raw
from framequery.session import shared_path
from framequery.sources import register, scan

_OWN = ("capture_id", "frame_idx")
_FOLDERS = ("jupiter", "mars")
_TABLE = tuple(px.dual_zone_table(256))
_JOB = bk.Bake(white_balance=True, normalise=True, table=_TABLE, crop=(1, 1, 6, 6), divisor=2, degrees=90)


def _name() -> F.Column:
    return F.element_at(F.split("path", "/"), -1).alias("name")


def _level(v: F.Column) -> F.Column:
    return F.lpad(F.hex(F.floor(px.unit(v) * 255).cast("long")), 2, "0")


def _session(spark: SparkSession, sf_dir: str) -> str:
    """A folder of two folders, captures of even and of odd numbers; beside each capture its first frame as an image."""
    register(spark)
    root = shared_path(spark, "session")
    raw = _raw(spark, sf_dir).withColumn("color", F.lit("mono"))
    firsts = _frames(spark, sf_dir).groupBy("capture_id").agg(F.min_by("plane", "frame_idx").alias("plane"))
    images = firsts.select(F.concat(F.lit("first-"), "capture_id").alias("path"), F.lit(8).alias("w"), F.lit(8).alias("h"), F.col("plane").cast("array<float>").alias("plane"), "capture_id")
    for k, folder in enumerate(_FOLDERS):
        ex.write_captures(raw.where(F.regexp_extract("path", r"(\d+)", 1).cast("int") % 2 == k), f"{root}/{folder}", index="frame_idx")
        images.where(F.col("capture_id") % 2 == k).drop("capture_id").write.format("fits").mode("append").save(f"{root}/{folder}")
    return root


def sc16_folder_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan.scan(spark, _session(spark, sf_dir), recursive=True)
    return found.select("name", "extension", "size", "target", "sort_key", "w", "h")


def sc14_any_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames of captures and images alike: luma summed over each plane, and its tenth value."""
    root = _session(spark, sf_dir)
    frames = scan.open_frames(spark, f"{root}/{_FOLDERS[0]}").union(scan.open_frames(spark, f"{root}/{_FOLDERS[1]}"))
    total = F.aggregate("plane", F.lit(0.0), lambda a, v: a + v)
    return frames.select(_name(), "frame_idx", "w", "h", F.round(total, 5).alias("total"), F.round(F.get("plane", 9), 6).alias("tenth"))


def sc21_baseline_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Headers of all captures below a folder against JSON baselines below another: capture 7 has none, capture 5 one key
    more, frame counts of every third are off by a fifth, pixel depths are in none."""
    root, places = _session(spark, sf_dir), shared_path(spark, "baselines")
    n, c = _frames(spark, sf_dir).groupBy("capture_id").agg(F.count(F.lit(1)).alias("n")), F.col("capture_id")
    key = F.concat(F.when(c % 2 == 0, _FOLDERS[0]).otherwise(_FOLDERS[1]), F.lit("__capture-"), c, F.lit(".ser"))
    known = n.where("capture_id <> 7").select(
        key.alias("baseline"), (F.col("n") * F.when(c % 3 == 0, 1.2).otherwise(1.0)).alias("frameCount"), F.when(c == 4, 9).otherwise(8).alias("imageWidth"), F.lit(8).alias("imageHeight"),
        F.lit(64).alias("bytesPerFrame"), F.when(c == 5, 0.5).alias("sharpness"),
    )
    known.repartition("baseline").write.partitionBy("baseline").json(places)
    base = scan.baselines(spark, places, F.regexp_extract("file", "baseline=([^/]+)/", 1))
    produced = scan.capture_metrics(scan.headers(scan.listed(spark, root, recursive=True)))
    return ct.metric_diff(produced, base.select("path", "key", "value"), {"frameCount": 0.05})


def sk08_bake(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Colour captures with white balance and normalised channels of their first frames, the two-zone table, a window of
    6 x 6 at half size, turned by 90 degrees; written with 16 bits and read back."""
    register(spark)
    source, target = shared_path(spark, "colour"), shared_path(spark, "baked")
    rgb = F.zip_with("plane", F.reverse("plane"), lambda a, b: F.concat(_level(a * 0.25 + F.lit(0.5)), _level(b * 0.5 + F.lit(0.5)), _level(a * 0.125 + F.lit(0.25))))
    raw = _raw(spark, sf_dir).drop("data").withColumn("color", F.lit("rgb"))
    planes = _frames(spark, sf_dir).select("frame_idx", F.unhex(F.array_join(rgb, "")).alias("data"))
    ex.write_captures(raw.join(planes, "frame_idx"), source, index="frame_idx")
    read = spark.read.format("ser")
    ex.write_captures(bk.baked(read.load(source), read.option("firstFrames", "1").load(source), _JOB), target, index="frame_idx")
    back = spark.read.format("ser").load(target)
    pixels = back.select(_name(), "frame_idx", "w", "h", "depth", "color", F.hex("data").alias("x"), F.explode(F.sequence(F.lit(0), F.col("w") * F.col("h") - 1)).alias("px"))
    word = lambda k: F.concat(F.substr("x", F.col("px") * 12 + 4 * k + 3, F.lit(2)), F.substr("x", F.col("px") * 12 + 4 * k + 1, F.lit(2)))
    return pixels.select("name", "frame_idx", "w", "h", "depth", "color", "px", *(F.conv(word(k), 16, 10).cast("int").alias(c) for k, c in enumerate("rgb")))


def pr03_any_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _frames(spark, sf_dir).select(*_OWN, F.posexplode(pn.resampled(F.col("plane"), 8, 8, 5, 3)).alias("px", "v")).withColumn("v", F.round("v", 6))


def pr09_channel_shift(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A plane as red and as blue, moved by parts of a pixel that follow the frame."""
    f, n = _frames(spark, sf_dir), F.col("frame_idx")
    red, blue = (pn.moved(F.col("plane"), 8, 8, x, y) for x, y in (((n % 5 - 2) * F.lit(0.5), (n % 3 - 1) * F.lit(0.25)), ((n % 4) * F.lit(-0.75), (n % 7) * F.lit(0.5))))
    both = f.select(*_OWN, F.posexplode(F.arrays_zip(red.alias("red"), blue.alias("blue"))).alias("px", "z"))
    return both.select(*_OWN, "px", F.round("z.red", 6).alias("red"), F.round("z.blue", 6).alias("blue"))


def fi15_purple_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    user = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "user_id")
    return _rgb(spark, sf_dir).join(user, "event_id").groupBy("user_id").agg(px.purple_gate(F.col("r"), F.col("g"), F.col("b"), 0.05).alias("engage"))


_FOLDER = "CASE WHEN label % 2 = 0 THEN 'jupiter' ELSE 'mars' END"
_LEVELS = "list_transform(embedding, lambda v: floor(least(greatest(v::DOUBLE, 0), 1) * 255))"
_RED_BLUE = "floor(least(greatest({}, 0), 1) * 255) / 255"


def _at(x: str, y: str) -> str:
    return f"greatest(0, least(7, {x})) AS sx, greatest(0, least(7, {y})) AS sy"


QUERIES = {
    "sc16_folder_scan": (
        sc16_folder_scan,
        """WITH n AS (SELECT label, count(*) AS n FROM embeddings GROUP BY ALL), f AS (SELECT label, 'capture-' AS stem, 'ser' AS extension, 178 + 64 * n AS size FROM n UNION ALL SELECT label, 'first-', 'fits', 5760 FROM n)
SELECT stem || label || '.' || extension AS name, extension, size, CASE WHEN label % 2 = 0 THEN 'Jupiter' ELSE 'Mars' END AS target, stem || lpad(label::VARCHAR, 20, '0') || '.' || extension AS sort_key, 8 AS w, 8 AS h FROM f""",
    ),
    "sc14_any_format": (
        sc14_any_format,
        f"""WITH f AS (SELECT label, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS i, embedding, {_LEVELS} AS e FROM embeddings)
SELECT 'capture-' || label || '.ser' AS name, i::INT AS frame_idx, 8 AS w, 8 AS h, round(list_sum(e) / 255, 5) AS total, round(e[10] / 255, 6) AS tenth FROM f UNION ALL
SELECT 'first-' || label || '.fits', 0, 8, 8, round(list_sum(list_transform(embedding, lambda v: v::DOUBLE)), 5), round(embedding[10]::DOUBLE, 6) FROM f WHERE i = 0""",
    ),
    "sc21_baseline_diff": (
        sc21_baseline_diff,
        f"""WITH n AS (SELECT DISTINCT label, {_FOLDER} || '__capture-' || label || '.ser' AS path FROM embeddings)
SELECT path, unnest(['frameCount', 'imageWidth', 'imageHeight', 'pixelDepth', 'bytesPerFrame']) AS key, 'UNEXPECTED' AS verdict FROM n WHERE label = 7 UNION ALL
SELECT path, 'pixelDepth', 'UNEXPECTED' FROM n WHERE label <> 7 UNION ALL SELECT path, 'sharpness', 'MISSING' FROM n WHERE label = 5 UNION ALL
SELECT path, 'imageWidth', 'DIFFERENT' FROM n WHERE label = 4 UNION ALL SELECT path, 'frameCount', 'DIFFERENT' FROM n WHERE label % 3 = 0""",
    ),
    "sk08_bake": (
        sk08_bake,
        f"""WITH f AS (SELECT label, (row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1)::INT AS i, embedding AS e FROM embeddings),
p AS (SELECT label, i, q % 8 AS x, q // 8 AS y, ch, CASE ch WHEN 0 THEN {_RED_BLUE.format("e[q + 1]::DOUBLE * 0.25 + 0.5")} WHEN 1 THEN {_RED_BLUE.format("e[64 - q]::DOUBLE * 0.5 + 0.5")} ELSE {_RED_BLUE.format("e[q + 1]::DOUBLE * 0.125 + 0.25")} END AS v FROM f, range(64) a(q), range(3) b(ch)),
s AS (SELECT label, ch, list_sort(list(v)) AS s FROM p WHERE i = 0 GROUP BY ALL),
m AS (SELECT label, ch, s[4] AS off, s[2] AS lo, s[63] AS hi, list_avg(list_transform(s, lambda v: greatest(v - s[4], 0))) AS mean FROM s),
g AS (SELECT label, mean AS gm, lo AS glo, hi AS ghi FROM m WHERE ch = 1),
k AS (SELECT label, ch, off, CASE WHEN gm > 1e-6 AND mean > 1e-6 THEN gm / mean ELSE 1 END AS scale, CASE WHEN ghi <= glo + 1e-6 THEN 0 ELSE lo - glo / (CASE WHEN hi > lo + 1e-6 THEN (ghi - glo) / (hi - lo) ELSE 1 END) END AS low,
  CASE WHEN ghi > glo + 1e-6 AND hi > lo + 1e-6 THEN (ghi - glo) / (hi - lo) ELSE 1 END AS spread FROM m JOIN g USING (label)),
c AS (SELECT label, i, x, y, ch, least(greatest((greatest((v - off) * scale, 0) - low) * spread, 0), 1) * 255 AS at_, floor(least(greatest((greatest((v - off) * scale, 0) - low) * spread, 0), 1) * 255) AS k FROM p JOIN k USING (label, ch) WHERE x BETWEEN 1 AND 6 AND y BETWEEN 1 AND 6),
t AS (SELECT label, i, x, y, ch, {_TONE.format(k="k")} + ({_TONE.format(k="least(k + 1, 255)")} - {_TONE.format(k="k")}) * (at_ - k) AS v FROM c),
o AS (SELECT label, i, ((x - 1) // 2 * 3 + 2 - (y - 1) // 2)::INT AS px, ch, floor(avg(v) * 65535 + 0.5)::INT AS v FROM t GROUP BY ALL)
SELECT 'capture-' || label || '.ser' AS name, i AS frame_idx, 3 AS w, 3 AS h, 16 AS depth, 'rgb' AS color, px, max(v) FILTER (ch = 0) AS r, max(v) FILTER (ch = 1) AS g, max(v) FILTER (ch = 2) AS b FROM o GROUP BY ALL""",
    ),
    "pr03_any_size": (
        pr03_any_size,
        f"WITH c AS (SELECT label, vec_id, k, embedding AS e, {_at('(k % 5 + 0.5::DOUBLE) * 8 / 5 - 0.5', '(k // 5 + 0.5::DOUBLE) * 8 / 3 - 0.5')} FROM embeddings, range(15) r(k)) SELECT label AS capture_id, vec_id AS frame_idx, k::INT AS px, round({_TAPS}, 6) AS v FROM c",
    ),
    "pr09_channel_shift": (
        pr09_channel_shift,
        f"""WITH k AS (SELECT label, vec_id, k, embedding AS e FROM embeddings, range(64) r(k)), u AS (SELECT *, {_at('k % 8 - (vec_id % 5 - 2) * 0.5::DOUBLE', 'k // 8 - (vec_id % 3 - 1) * 0.25::DOUBLE')} FROM k), v AS (SELECT *, {_at('k % 8 + (vec_id % 4) * 0.75::DOUBLE', 'k // 8 - (vec_id % 7) * 0.5::DOUBLE')} FROM k),
a AS (SELECT label, vec_id, k, round({_TAPS}, 6) AS red FROM u), b AS (SELECT vec_id, k, round({_TAPS}, 6) AS blue FROM v)
SELECT label AS capture_id, vec_id AS frame_idx, k::INT AS px, red, blue FROM a JOIN b USING (vec_id, k)""",
    ),
    "fi15_purple_gate": (
        fi15_purple_gate,
        f"""WITH {_SQL_RGB}, s AS (SELECT *, greatest(r, g, b) AS top, greatest(r, g, b) - least(r, g, b) AS span FROM c),
h AS (SELECT event_id, top, span, CASE WHEN span > 0 THEN 60::DOUBLE * (CASE WHEN top = r THEN (g - b) / span WHEN top = g THEN (b - r) / span + 2 ELSE (r - g) / span + 4 END) END AS hue FROM s),
d AS (SELECT event_id, top, span, abs((CASE WHEN hue < 0 THEN hue + 360 ELSE hue END) - 290) AS off FROM h)
SELECT user_id, avg(CASE WHEN top > 0 AND span / top >= 0.05 AND least(off, 360 - off) <= 30 THEN 1.0::DOUBLE ELSE 0 END) >= 0.05 AS engage FROM d JOIN events USING (event_id) GROUP BY user_id""",
    ),
}
