"""Presets, marks, sort keys, sampled distributions, and frames joined to scores and masters, with DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from framequery.functions import rules as ru
from framequery.operators import catalog as ct
from framequery.operators import distribution as ds
from framequery.operators import frames as fr
from framequery.operators import presets as ps
from framequery.plans.frame_queries import SQL_PIXELS, SQL_SCORES, _frames

_OWN = ["capture_id", "frame_idx"]


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def _target(n: Column) -> Column:
    return F.get(F.array(*map(F.lit, ps.TARGETS)), (n % len(ps.TARGETS)).cast("int"))


#: Parts as stored presets: every 11th has a target nobody knows, every 13th is cut short, some lack the later keys.
def _presets(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    details = F.when(k % 4 == 0, F.struct(F.when(k % 8 == 0, F.lit(False)).alias("autoNuke"), (F.col("p_size") + F.lit(0.5)).alias("autoPSFSNR")))
    text = F.to_json(
        F.struct(
            F.concat(F.lit("p"), k).alias("id"), F.col("p_name").alias("name"), F.when(k % 11 == 0, F.lit("Comet")).otherwise(_target(k)).alias("target"), F.when(k % 3 == 0, F.col("p_type")).alias("notes"),
            (k % 5 == 0).alias("isBuiltIn"), F.col("p_size").alias("luckyKeepPercent"), F.when(k % 2 == 0, (k % 7).cast("int")).alias("luckyMultiAPGrid"), details.alias("luckyDetails"),
        )
    )
    stored = F.when(k % 13 == 0, F.substring(text, 1, 12)).otherwise(text)
    return ps.parsed(_read(spark, sf_dir, "part").select(stored.alias("json")), "json")


def sc19_presets(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = "luckyDetails"
    return _presets(spark, sf_dir).select("id", "name", "target", "notes", "isBuiltIn", "luckyKeepPercent", "luckyMultiAPGrid", "luckyMultiAPPatchHalf", *(F.col(f"{d}.{c}").alias(c) for c in ps.DETAILS))


def sk15_preset_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as changes: purchases delete, all others save under the user's id with the event's value as share to keep."""
    user = _presets(spark, sf_dir).where("NOT isBuiltIn").select("id", "name", "target", "isBuiltIn", "modifiedAt", "luckyKeepPercent")
    e = _read(spark, sf_dir, "events")
    changes = e.select(
        F.concat(F.lit("p"), F.col("user_id") * 3).alias("id"), F.col("event_type").alias("name"), _target(F.col("event_id")).alias("target"), F.lit(True).alias("isBuiltIn"), "event_id", "ts",
        (F.col("event_id") % 100).cast("int").alias("luckyKeepPercent"), F.lit(None).cast("timestamp").alias("modifiedAt"), (F.col("event_type") == "purchase").alias("gone"),
    )
    return ps.replayed(user, changes, "event_id", "ts", F.col("gone"))


def fi18_presets_by_target(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The presets of a target, and those of two ids."""
    p = _presets(spark, sf_dir)
    found = ps.matching_target(p, "Jupiter").select(F.lit("target").alias("by"), "id", "name")
    return found.unionByName(ps.with_ids(p, "p7", "p13").select(F.lit("id").alias("by"), "id", "name"))


def fi04_marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The marked events after each action; marks are those above 100, the selection every tenth."""
    e = _read(spark, sf_dir, "events").select("event_id", "value")
    marks, chosen = e.where("value > 100"), e.where("event_id % 10 = 0")
    after = [ct.marked(e, "event_id", marks, a, chosen).withColumn("action", F.lit(a)) for a in ("all", "none", "invert", "selection")]
    return after[0].union(after[1]).union(after[2]).union(after[3])


def tk06_sort_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as files: places by each of the six keys, sharpness and size falling."""
    i = F.col("event_id")
    files = _read(spark, sf_dir, "events").select(
        i, F.concat("event_type", F.lit("-"), F.col("user_id"), F.when(i % 3 == 0, F.lit(".SER")).when(i % 3 == 1, F.lit(".avi")).otherwise(F.lit(""))).alias("name"), F.when(i % 3 != 0, F.col("value")).alias("sharpness"),
        F.when(i % 4 != 0, F.col("ts")).alias("created"), (i % 97 * 1000).alias("bytes"), F.when(i % 5 != 0, i % 31 * 10).alias("width"), (i % 17 * 10).alias("height"),
    )
    return ct.sorted_places(files, "event_id", ("sharpness", "size"))


def ag23_even_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of 16 even frames a capture: percentiles, median half-flux radius and the frames to keep."""
    d = ds.distribution(ds.even_frames(_frames(spark, sf_dir), 16), 8).drop("jitter")
    return d.select("capture_id", "total_frames", "n", *(F.round(c, 5).alias(c) for c in ("least", "p10", "p50", "p90", "most", "median_hfr")), "n_keep", F.round("fraction", 6).alias("fraction"))


def ag23_sampled_jitter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole distribution of 64 even frames, with the jitter between adjacent ones."""
    sampled = ds.even_frames(_frames(spark, sf_dir))
    return ds.distribution(sampled, 8, ds.jitter(ds.adjacent_shifts(sampled, 8)))


def jo02_scored_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weighted mean plane of the frames that have a score in another table."""
    e = _read(spark, sf_dir, "events").where("event_id % 3 <> 1")
    f = _frames(spark, sf_dir)
    scores = e.select(F.col("event_id").alias("frame_idx"), F.col("value").alias("score")).join(f.select(*_OWN), "frame_idx")
    plane = fr.weighted_plane(fr.with_quality_weight(fr.with_scores(f, scores)))
    return plane.select("capture_id", "px", F.round("value", 6).alias("value"))


def jo04_masters_by_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each capture's first frame as an 8 x 8 dark and its last as a 16 x 4 flat; frames are 8 x 8, 16 x 4 or 32 x 2 by capture."""
    c = F.col("capture_id")
    f = _frames(spark, sf_dir).withColumns({"w": F.element_at(F.array(*map(F.lit, (8, 16, 32))), (c % 3 + 1).cast("int"))}).withColumn("h", (F.lit(64) / F.col("w")).cast("int"))
    ends = f.groupBy("capture_id").agg(F.min_by("plane", "frame_idx").alias("dark"), F.max_by("plane", "frame_idx").alias("flat"))
    kinds = F.array(F.struct(F.lit("dark").alias("kind"), F.lit(8).alias("w"), F.lit(8).alias("h"), F.col("dark").alias("plane")), F.struct(F.lit("flat").alias("kind"), F.lit(16).alias("w"), F.lit(4).alias("h"), F.transform("flat", lambda v: F.abs(v) + F.lit(0.5)).alias("plane")))
    masters = ends.select("capture_id", F.explode(kinds).alias("m")).select("capture_id", "m.*")
    lit = fr.with_masters(f, masters)
    return lit.select(*_OWN, "calibrated", F.posexplode("plane").alias("px", "v")).select(*_OWN, "calibrated", "px", F.round("v", 5).alias("v"))


def ru11_psf_sigma(spark: SparkSession, sf_dir: str) -> DataFrame:
    i, v = F.col("event_id"), F.col("value")
    limb, edge = F.when(i % 3 == 0, v / 100), F.when(i % 2 == 0, v / 90)
    found = ru.psf_sigma(limb, edge, F.when(i % 7 != 0, v / 50)).alias("f")
    short = ru.psf_sigma(limb, edge, v / 50, with_edge=False, synthetic=False).alias("s")
    return _read(spark, sf_dir, "events").select("event_id", found, short).select("event_id", F.round("f.sigma", 6).alias("sigma"), F.col("f.origin").alias("origin"), F.round("s.sigma", 6).alias("limb_only"))


_TARGETS = "['Sun', 'Moon', 'Jupiter', 'Saturn', 'Mars', 'Other']"
_SQL_PRESETS = f"""ps AS (SELECT 'p' || p_partkey AS id, p_name AS name, {_TARGETS}[p_partkey % 6 + 1] AS target, CASE WHEN p_partkey % 3 = 0 THEN p_type ELSE '' END AS notes, p_partkey % 5 = 0 AS built_in, p_size AS keep,
  CASE WHEN p_partkey % 2 = 0 THEN p_partkey % 7 ELSE 0 END::INT AS grid, p_partkey AS k, p_size FROM part WHERE p_partkey % 11 <> 0 AND p_partkey % 13 <> 0 AND p_name IS NOT NULL AND p_size IS NOT NULL)"""

QUERIES = {
    "sc19_presets": (
        sc19_presets,
        f"""WITH {_SQL_PRESETS} SELECT id, name, target, notes, built_in AS "isBuiltIn", keep AS "luckyKeepPercent", grid AS "luckyMultiAPGrid", 8 AS "luckyMultiAPPatchHalf", CASE WHEN k % 8 = 0 THEN false WHEN k % 4 = 0 THEN true END AS "autoNuke",
CASE WHEN k % 4 = 0 THEN false END AS "autoPSF", CASE WHEN k % 4 = 0 THEN p_size + 0.5::DOUBLE END AS "autoPSFSNR", CASE WHEN k % 4 = 0 THEN 2.5::DOUBLE END AS "sigmaClipThreshold", CASE WHEN k % 4 = 0 THEN 1 END AS "drizzleScale" FROM ps""",
    ),
    "sk15_preset_changes": (
        sk15_preset_changes,
        f"""WITH {_SQL_PRESETS}, last AS (SELECT 'p' || user_id * 3 AS id, event_type AS name, {_TARGETS}[event_id % 6 + 1] AS target, ts AS m, (event_id % 100)::INT AS keep FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) = 1)
SELECT id, name, target, false AS "isBuiltIn", NULL::TIMESTAMP AS "modifiedAt", keep AS "luckyKeepPercent" FROM ps WHERE NOT built_in AND id NOT IN (SELECT id FROM last)
UNION ALL SELECT id, name, target, false, m, keep FROM last WHERE name <> 'purchase'""",
    ),
    "fi18_presets_by_target": (fi18_presets_by_target, f"WITH {_SQL_PRESETS} SELECT 'target' AS by, id, name FROM ps WHERE target = 'Jupiter' UNION ALL SELECT 'id', id, name FROM ps WHERE id IN ('p7', 'p13')"),
    "fi04_marks": (
        fi04_marks,
        "SELECT event_id, 'all' AS action FROM events UNION ALL SELECT event_id, 'invert' FROM events WHERE value IS NULL OR value <= 100 UNION ALL SELECT event_id, 'selection' FROM events WHERE value > 100 OR event_id % 10 = 0",
    ),
    "tk06_sort_keys": (
        tk06_sort_keys,
        """WITH f AS (SELECT event_id, event_type || '-' || user_id || CASE event_id % 3 WHEN 0 THEN '.SER' WHEN 1 THEN '.avi' ELSE '' END AS name, CASE event_id % 3 WHEN 0 THEN 'ser' WHEN 1 THEN 'avi' ELSE '' END AS type, CASE WHEN event_id % 3 <> 0 THEN value END AS s,
  CASE WHEN event_id % 4 <> 0 THEN ts END AS c, event_id % 97 AS b, CASE WHEN event_id % 5 <> 0 THEN event_id % 31 * (event_id % 17) ELSE 0 END AS a FROM events)
SELECT event_id, 'name' AS key, row_number() OVER (ORDER BY name, event_id) AS place FROM f UNION ALL SELECT event_id, 'type', row_number() OVER (ORDER BY type, event_id) FROM f
UNION ALL SELECT event_id, 'sharpness', row_number() OVER (ORDER BY s DESC NULLS LAST, event_id) FROM f UNION ALL SELECT event_id, 'created', row_number() OVER (ORDER BY c NULLS LAST, event_id) FROM f
UNION ALL SELECT event_id, 'size', row_number() OVER (ORDER BY b DESC, event_id) FROM f UNION ALL SELECT event_id, 'area', row_number() OVER (ORDER BY a, event_id) FROM f""",
    ),
    "ag23_even_distribution": (
        ag23_even_distribution,
        f"""WITH {SQL_SCORES}, places AS (SELECT *, row_number() OVER w - 1 AS place, count(*) OVER (PARTITION BY capture_id) AS total FROM scores WINDOW w AS (PARTITION BY capture_id ORDER BY frame_idx)),
picked AS (SELECT DISTINCT capture_id, frame_idx, score, total FROM places, range(16) r(i) WHERE i < total AND place = least(total - 1, floor((i + 0.5::DOUBLE) / least(16, total) * total))),
c AS (SELECT capture_id, frame_idx, sum(x * v) / sum(v) AS cx, sum(y * v) / sum(v) AS cy FROM px SEMI JOIN picked USING (capture_id, frame_idx) WHERE v > 0 GROUP BY ALL),
b AS (SELECT capture_id, frame_idx, floor(sqrt((x - cx) * (x - cx) + (y - cy) * (y - cy)) / 0.5)::INT AS bin, sum(v) AS flux FROM px JOIN c USING (capture_id, frame_idx) WHERE v > 0 GROUP BY ALL),
r AS (SELECT *, sum(flux) OVER (PARTITION BY capture_id, frame_idx ORDER BY bin) AS cum, sum(flux) OVER (PARTITION BY capture_id, frame_idx) / 2 AS half FROM b),
h AS (SELECT capture_id, frame_idx, min_by((bin + (half - (cum - flux)) / flux) * 0.5::DOUBLE, bin) AS hfr FROM r WHERE cum >= half GROUP BY ALL),
hm AS (SELECT capture_id, list_sort(list(hfr) FILTER (hfr > 0)) AS h FROM h GROUP BY ALL),
l AS (SELECT capture_id, any_value(total) AS total, list_sort(list(score)) AS s FROM picked GROUP BY ALL),
p AS (SELECT *, len(s) AS n, s[(floor((len(s) - 1) * 0.9::DOUBLE + 0.5) + 1)::INT] AS p90 FROM l),
k AS (SELECT *, least(0.75::DOUBLE, greatest(0.2::DOUBLE, len(list_filter(s, lambda v: v >= 0.5 * p90)) / n::DOUBLE)) AS share FROM p),
q AS (SELECT *, least(total, greatest(ceil(total * share - 1e-9), 50, least(total, 100)))::BIGINT AS n_keep FROM k)
SELECT capture_id, total AS total_frames, n::INT AS n, round(s[1], 5) AS least, round(s[(floor((n - 1) * 0.1::DOUBLE + 0.5) + 1)::INT], 5) AS p10, round(s[(floor((n - 1) * 0.5::DOUBLE + 0.5) + 1)::INT], 5) AS p50, round(p90, 5) AS p90, round(s[n], 5) AS most,
  round(h[(len(h) // 2 + 1)::INT], 5) AS median_hfr, n_keep, round(n_keep / total::DOUBLE, 6) AS fraction FROM q LEFT JOIN hm USING (capture_id)""",
    ),
    "ag23_sampled_jitter": (ag23_sampled_jitter, None),
    "jo02_scored_frames": (
        jo02_scored_frames,
        f"""WITH {SQL_PIXELS}, k AS (SELECT label AS capture_id, vec_id AS frame_idx, value AS score FROM embeddings JOIN events ON event_id = vec_id WHERE event_id % 3 <> 1 AND value IS NOT NULL),
w AS (SELECT *, 0.05::DOUBLE + 1.45::DOUBLE * power((score - min(score) OVER c) / greatest(1e-6::DOUBLE, max(score) OVER c - min(score) OVER c), 2) AS weight FROM k WINDOW c AS (PARTITION BY capture_id))
SELECT capture_id, p::INT AS px, round(sum(v * weight) / sum(weight), 6) AS value FROM px JOIN w USING (capture_id, frame_idx) GROUP BY ALL""",
    ),
    "jo04_masters_by_size": (
        jo04_masters_by_size,
        f"""WITH {SQL_PIXELS}, e AS (SELECT capture_id, p, min_by(v, frame_idx) AS dark, abs(max_by(v, frame_idx)) + 0.5::DOUBLE AS flat FROM px GROUP BY ALL)
SELECT capture_id, frame_idx, CASE capture_id % 3 WHEN 0 THEN 'dark' WHEN 1 THEN 'flat' ELSE '' END AS calibrated, p::INT AS px,
  round(CASE capture_id % 3 WHEN 0 THEN greatest(0, v - dark) WHEN 1 THEN greatest(0, v / flat) ELSE v END, 5) AS v FROM px JOIN e USING (capture_id, p)""",
    ),
    "ru11_psf_sigma": (
        ru11_psf_sigma,
        """WITH f AS (SELECT event_id, CASE WHEN event_id % 3 = 0 AND value > 0 THEN value / 100 END AS limb, CASE WHEN event_id % 2 = 0 AND value > 0 THEN value / 90 END AS edge, CASE WHEN event_id % 7 <> 0 THEN 4.5::DOUBLE - 0.6::DOUBLE * least(5, greatest(1, value / 50)) END AS made FROM events)
SELECT event_id, round(coalesce(limb, edge, made), 6) AS sigma, CASE WHEN limb IS NOT NULL THEN 'limb' WHEN edge IS NOT NULL THEN 'edge' WHEN made IS NOT NULL THEN 'synthetic' ELSE 'none' END AS origin, round(limb, 6) AS limb_only FROM f""",
    ),
}
