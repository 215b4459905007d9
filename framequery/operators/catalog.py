"""File catalogue, feed, rate limits, diffs and selections as relational operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from framequery.session import shared_path


def ranked(rows: DataFrame, place: str, *order: Column, kind: str = "int") -> DataFrame:
    """rows with their place (of type `kind`, from 1) in one order over all of them; `order` must tell all rows apart.

    Rows are dealt by ranges of the order and ranked within each; the counts of the ranges before, one row a range, are
    added. The ranges are written to the shared folder, as ranges of a second sample could differ from the first's.
    """
    spark = rows.sparkSession
    path = shared_path(spark, "ranges")
    ranges = rows.repartitionByRange(*order).withColumn("_range", F.spark_partition_id())
    ranges.write.parquet(path)
    dealt = spark.read.schema(ranges.schema).parquet(path)
    before = F.sum("_n").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1))
    starts = dealt.groupBy("_range").agg(F.count(F.lit(1)).alias("_n")).select("_range", F.coalesce(before, F.lit(0)).alias("_before"))
    own = F.row_number().over(Window.partitionBy("_range").orderBy(*order))
    numbered = dealt.withColumn(place, own).join(F.broadcast(starts), "_range")
    return numbered.withColumn(place, (F.col(place) + F.col("_before")).cast(kind)).drop("_range", "_before")


def search(files: DataFrame, column: str, query: str, negate: bool = False) -> DataFrame:
    """Rows whose column has the query in it, whatever the case; an empty query passes all."""
    if not query:
        return files
    hit = F.lower(column).contains(query.lower())
    return files.where(~hit if negate else hit)


def capped_feed(rows: DataFrame, producer: str, newest: Column, tie: str, fetch: int = 250, cap: int = 6, limit: int = 50) -> DataFrame:
    """The newest `fetch` rows, at most `cap` a producer, then the first `limit`: small from the first step on."""
    head = rows.orderBy(newest.desc(), tie).limit(fetch)
    by = Window.partitionBy(producer).orderBy(newest.desc(), tie)
    return head.withColumn("_n", F.row_number().over(by)).where(F.col("_n") <= cap).drop("_n").orderBy(newest.desc(), tie).limit(limit)


def rate_limited(calls: DataFrame, producer: str, at: str, tie: str, per_hour: int) -> DataFrame:
    """calls plus `accepted`: the first per_hour calls of a producer in each clock hour."""
    by = Window.partitionBy(producer, F.date_trunc("hour", F.col(at))).orderBy(at, tie)
    return calls.withColumn("accepted", F.row_number().over(by) <= per_hour)


def stable_runs(samples: DataFrame, key: str, order: str, size: str, needed: int = 2) -> DataFrame:
    """Batch form of the completion detector: (key, order) of each sample at which a file is complete: `needed` repeats
    of one size after its first sighting, once until an empty sample starts it over."""
    by = Window.partitionBy(key).orderBy(order)
    lagged = samples.withColumn("_p", F.lag(size).over(by))
    lives = lagged.withColumn("_life", F.sum((F.col(size) <= 0).cast("int")).over(by))
    fresh = F.col("_p").isNull() | (F.col("_p") != F.col(size))
    runs = lives.withColumn("_run", F.sum(fresh.cast("int")).over(by))
    long = runs.where(F.col(size) > 0).withColumn("_k", F.row_number().over(Window.partitionBy(key, "_run").orderBy(order)) - 1)
    ready = long.where(F.col("_k") >= needed)
    return ready.groupBy(key, "_life").agg(F.min(order).alias(order)).select(key, order)


def nearest(requests: DataFrame, cached: DataFrame, by: list[str], want: str, have: str) -> DataFrame:
    """requests plus the nearest cached index on either side (the lower of two as near), by two as-of windows over the
    union of both sides: one sort, no cross join."""
    both = requests.select(*by, F.col(want).alias("_at"), F.lit(True).alias("_ask")).unionByName(cached.select(*by, F.col(have).alias("_at"), F.lit(False).alias("_ask")))
    w = Window.partitionBy(*by).orderBy("_at", "_ask")
    entry = F.when(~F.col("_ask"), F.col("_at"))
    before = F.last(entry, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    after = F.first(entry, ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing))
    found = both.withColumns({"_b": before, "_a": after}).where("_ask")
    pick = F.when(F.col("_a").isNull() | (F.col("_at") - F.col("_b") <= F.col("_a") - F.col("_at")), F.coalesce("_b", "_a")).otherwise(F.col("_a"))
    return found.select(*by, F.col("_at").alias(want), pick.alias(have)).distinct()


def even_positions(n: Column, k: int) -> Column:
    """Positions of at most k samples spread evenly over n: min(n - 1, floor((i + 0.5) n / k))."""
    m = F.least(F.lit(k), n)
    return F.transform(F.sequence(F.lit(0), m - 1), lambda i: F.least(n - 1, F.floor((i + F.lit(0.5)) / m * n).cast("int")))


def even_pick(n: Column, target: int) -> Column:
    """`target` positions of n, both ends among them: round(t (n - 1) / (target - 1))."""
    m = F.least(F.lit(target), n)
    return F.transform(F.sequence(F.lit(0), m - 1), lambda i: F.when(m > 1, F.floor(i * (n - 1) / F.greatest(m - 1, F.lit(1)) + F.lit(0.5)).cast("int")).otherwise(F.lit(0)))


def latest_wins(old: DataFrame, new: DataFrame, keys: list[str], stamp: str) -> DataFrame:
    """Upsert: of each key the row with the latest stamp; of equal stamps the new one."""
    both = old.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    by = Window.partitionBy(*keys).orderBy(F.col(stamp).desc(), F.col("_new").desc())
    return both.withColumn("_n", F.row_number().over(by)).where("_n = 1").drop("_n", "_new")


def metric_diff(produced: DataFrame, baseline: DataFrame, tolerance: dict[str, float]) -> DataFrame:
    """(path, key, verdict) of differing (path, key, value) rows: MISSING, UNEXPECTED, or DIFFERENT beyond the key's
    relative tolerance (exact where it has none; never equal where the baseline isn't positive)."""
    p, b = produced.withColumnRenamed("value", "p"), baseline.withColumnRenamed("value", "b")
    tol = F.lit(None).cast("double")
    for key, t in tolerance.items():
        tol = F.when(F.col("key") == key, F.lit(t)).otherwise(tol)
    same = F.when(tol.isNotNull(), (F.col("b") > 0) & (F.try_divide(F.abs(F.col("p") - F.col("b")), F.col("b")) <= tol)).otherwise(F.col("p") == F.col("b"))
    verdict = F.when(F.col("p").isNull(), "MISSING").when(F.col("b").isNull(), "UNEXPECTED").when(~F.coalesce(same, F.lit(False)), "DIFFERENT")
    return p.join(b, ["path", "key"], "full_outer").select("path", "key", verdict.alias("verdict")).where(F.col("verdict").isNotNull())


def mark_rank(cells: DataFrame, by: list[str], score: str, tie: list[str]) -> DataFrame:
    """Blend mask of cells by rank: 0.40 + 0.60 sqrt(rank / (n - 1)), rank from 0 by rising score."""
    w = Window.partitionBy(*by)
    rank = F.row_number().over(w.orderBy(score, *tie)) - 1
    n = F.count(F.lit(1)).over(w)
    return cells.withColumn("mask", F.lit(0.4) + F.lit(0.6) * F.sqrt(rank / F.greatest(F.lit(1), n - 1)))


def best_candidates(candidates: DataFrame, keys: list[str], tie: str, most: int = 50) -> DataFrame:
    """Of the `most` candidates of greatest magnitude of each key, the one of best step_contrast / (1 + dir_std / 10)."""
    strongest = Window.partitionBy(*keys).orderBy(F.col("magnitude").desc(), tie)
    best = Window.partitionBy(*keys).orderBy(F.col("score").desc(), F.col("magnitude").desc(), tie)
    top = candidates.withColumn("_rank", F.row_number().over(strongest)).where(F.col("_rank") <= most)
    scored = top.withColumn("score", F.col("step_contrast") / (F.lit(1.0) + F.col("dir_std") / F.lit(10.0)))
    return scored.withColumn("_rank", F.row_number().over(best)).where(F.col("_rank") == 1).drop("_rank")


def marked(files: DataFrame, id_col: str, marks: DataFrame, action: str, selection: DataFrame | None = None) -> DataFrame:
    """The ids marked after an action: "all" files, "none", "invert" (the files not marked), or "selection" (marks and
    selected ids together). Ids come once each, NULL never; marks of files that aren't there stay until inverted or replaced."""
    ids = files.select(id_col).where(F.col(id_col).isNotNull())
    held = marks.select(id_col).where(F.col(id_col).isNotNull())
    if action == "all":
        return ids.distinct()
    if action == "none":
        return ids.where(F.lit(False))
    if action == "invert":
        return ids.join(held, id_col, "left_anti").distinct()
    if action == "selection" and selection is not None:
        return held.union(selection.select(id_col).where(F.col(id_col).isNotNull())).distinct()
    raise ValueError(f"no such action: {action}")


#: The columns a listing can be sorted by, each as a number and a text of which one decides. A missing sharpness is below all
#: others and a missing date above them; sizes of pictures sort by their area, 0 where unknown.
def sort_keys() -> dict[str, tuple[Column, Column]]:
    text, number = F.lit(""), F.lit(0.0)
    typed = F.lower(F.regexp_extract("name", r"\.([^./]+)$", 1))
    return {
        "name": (number, F.coalesce("name", text)),
        "type": (number, F.coalesce(typed, text)),
        "sharpness": (F.coalesce(F.col("sharpness").cast("double"), F.lit(float("-inf"))), text),
        "created": (F.coalesce(F.unix_micros(F.col("created").cast("timestamp")).cast("double"), F.lit(float("inf"))), text),
        "size": (F.coalesce(F.col("bytes").cast("double"), number), text),
        "area": (F.coalesce(F.col("width").cast("double") * F.col("height"), number), text),
    }


def sorted_places(files: DataFrame, id_col: str, descending: tuple[str, ...] = ()) -> DataFrame:
    """(id, key, place): each file's place, from 1, in the order of each of sort_keys(); equal values by id.

    All orders are worked out by one ranking over (key, value, id): one range shuffle and one written copy, whatever the
    number of keys. `descending` turns keys round, ids among equals still rising. Ids tell files apart.
    """
    columns = []
    for key, (number, text) in sort_keys().items():
        way = F.lit(-1.0 if key in descending else 1.0)
        columns.append(F.struct(F.lit(key).alias("key"), (number * way).alias("_number"), text.alias("_text")))
    turned = [k for k in descending if k in ("name", "type")]
    if turned:
        raise ValueError(f"text keys are sorted in rising order only: {turned}")
    long = files.select(F.col(id_col), F.explode(F.array(*columns)).alias("k")).select(id_col, "k.*")
    placed = ranked(long, "_at", F.col("key").asc(), F.col("_number").asc(), F.col("_text").asc(), F.col(id_col).asc(), kind="long")
    # One row a key.
    first = placed.groupBy("key").agg(F.min("_at").alias("_first"))
    return placed.join(F.broadcast(first), "key").select(id_col, "key", (F.col("_at") - F.col("_first") + 1).alias("place"))
