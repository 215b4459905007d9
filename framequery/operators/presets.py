"""Presets: named settings for a target, read from JSON, saved and deleted by id, looked up by target or by id."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The targets a preset can have, and what keys of later versions are taken to be where older JSON lacks them.
TARGETS = ("Sun", "Moon", "Jupiter", "Saturn", "Mars", "Other")
LATER_KEYS = {"luckyMultiAPGrid": 0, "luckyMultiAPPatchHalf": 8}
DETAILS = {"autoNuke": True, "autoPSF": False, "autoPSFSNR": 50.0, "sigmaClipThreshold": 2.5, "drizzleScale": 1}
DETAIL_TYPES = "autoNuke boolean, autoPSF boolean, autoPSFSNR double, sigmaClipThreshold double, drizzleScale int"
SCHEMA = f"id string, name string, target string, notes string, isBuiltIn boolean, modifiedAt timestamp, luckyMode string, luckyKeepPercent int, luckyMultiAPGrid int, luckyMultiAPPatchHalf int, luckyDetails struct<{DETAIL_TYPES}>"
REQUIRED = ("id", "name", "target", "luckyKeepPercent")


def parsed(rows: DataFrame, text: str) -> DataFrame:
    """One preset a row of JSON text. Keys that later versions added are their defaults where missing; a preset without
    any details keeps none (NULL), one with some has the rest by default. Text that is no JSON object, lacks a required
    key or names no target is left out: one bad entry costs no other. A map with no shuffle."""
    p = rows.select(F.from_json(text, SCHEMA, {"mode": "PERMISSIVE"}).alias("p")).select("p.*")
    whole = F.lit(True)
    for key in REQUIRED:
        whole = whole & F.col(key).isNotNull()
    known = p.where(whole & F.col("target").isin(*TARGETS))
    inner = F.struct(*(F.coalesce(F.col(f"luckyDetails.{k}"), F.lit(v)).alias(k) for k, v in DETAILS.items()))
    filled = {k: F.coalesce(k, F.lit(v)) for k, v in LATER_KEYS.items()}
    return known.withColumns(filled | {"notes": F.coalesce("notes", F.lit("")), "isBuiltIn": F.coalesce("isBuiltIn", F.lit(False)), "luckyDetails": F.when(F.col("luckyDetails").isNotNull(), inner)})


def replayed(user: DataFrame, changes: DataFrame, order: str, at: str, deleted: Column) -> DataFrame:
    """The user's presets after all changes, each a save or a deletion by id; of each id the last one in `order` decides.

    changes: the columns of `user`, `order` (no two changes of an id share one), `at` and what `deleted` reads. What is
    saved is no built-in and is stamped with the time of its change. Deleting an unknown id does nothing. One shuffle by
    id with partial aggregation: each id's last change is a maximum, so no id's history is in one task.
    """
    columns = [c for c in user.columns if c != "id"]
    fresh = [F.lit(False).alias(c) if c == "isBuiltIn" else F.col(at).cast("timestamp").alias(c) if c == "modifiedAt" else F.col(c) for c in columns]
    held = user.select("id", F.struct(F.lit(None).cast("long").alias("_at"), F.lit(False).alias("_gone"), F.struct(*columns).alias("p")).alias("_s"))
    new = changes.select("id", F.struct(F.col(order).cast("long").alias("_at"), deleted.alias("_gone"), F.struct(*fresh).alias("p")).alias("_s"))
    # NULL is the least order: what was stored gives way to any change.
    last = held.unionByName(new).groupBy("id").agg(F.max_by("_s", F.coalesce(F.col("_s._at"), F.lit(-(1 << 63)))).alias("_s"))
    return last.where(~F.col("_s._gone")).select("id", "_s.p.*").select(*user.columns)


def matching_target(presets: DataFrame, target: str | Column) -> DataFrame:
    """All presets of a target."""
    return presets.where(F.col("target") == target)


def with_ids(presets: DataFrame, *ids: str) -> DataFrame:
    """The presets of these ids; unknown ids give no row."""
    return presets.where(F.col("id").isin(*ids))
