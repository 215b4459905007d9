"""Stateful operators over streams, keyed by file path or producer, with arbitrary state in Spark's state store."""

from __future__ import annotations

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from framequery.session import shared_path
from framequery.streaming.buckets import by_buckets, forgotten, table

HOUR_MS = 3_600_000
COMPLETION_OUT = "path string, size long, seq long"
LIMIT_OUT = "producer string, seq long, hour long, accepted boolean"
CURRENT_OUT = "queue string, generation long, seq long"


def observe(state: tuple[int, int, bool] | None, size: int, needed: int = 2) -> tuple[tuple[int, int, bool], bool]:
    """(last size, repeats, fired) after a sample, and whether the file has just become complete. An empty file starts
    over; the first sighting sets the baseline; each repeat counts; it fires once."""
    if size <= 0 or state is None:
        return (size, 0, False), False
    last, repeats, fired = state
    repeats = repeats + 1 if last == size else 0
    done = not fired and repeats >= max(1, needed)
    return (size, repeats, fired or done), done


def completed_files(samples: DataFrame, needed: int = 2, forget_after: int | None = None) -> DataFrame:
    """Rows of (path, size, seq) samples at which a file is complete. forget_after: state of paths not seen for so long
    (processing time, in ms) is dropped."""
    held = pa.schema({"path": pa.string(), "last": pa.int64(), "repeats": pa.int64(), "fired": pa.bool_(), "seen": pa.int64()})

    def update(rows: pd.DataFrame, before: pd.DataFrame, state: GroupState) -> tuple[pd.DataFrame, pd.DataFrame, int | None]:
        now = state.getCurrentProcessingTimeMs() if forget_after else 0
        files = {path: (file, seen) for path, *file, seen in before.itertuples(index=False, name=None)}
        rows = rows.sort_values("seq")
        out = []
        for path, size, seq in zip(rows["path"].tolist(), rows["size"].tolist(), rows["seq"].tolist(), strict=True):
            file, done = observe(files[path][0] if path in files else None, int(size), needed)
            files[path] = (file, now)
            if done:
                out.append((path, int(size), int(seq)))
        after, due = forgotten(table(held, [(path, *file, seen) for path, (file, seen) in files.items()]), forget_after, state)
        return pd.DataFrame(out, columns=["path", "size", "seq"]), after, due

    return by_buckets(samples.select("path", "size", "seq"), ["path"], update, COMPLETION_OUT, held, _timeout(forget_after))


def limited_calls(calls: DataFrame, per_hour: int, forget_after: int | None = None) -> DataFrame:
    """calls (producer, seq, ms) with `accepted`: per_hour a fixed clock hour of the producer; rejected ones don't count.

    The state is the calls accepted in each hour of each producer, so a late call is judged in the hour it belongs to.
    forget_after: a producer not seen for so long (processing time, in ms) is dropped, as a service that never ends
    should ask for.
    """
    held, key = pa.schema({"producer": pa.string(), "hour": pa.int64(), "used": pa.int64(), "seen": pa.int64()}), ["producer", "hour"]

    def update(rows: pd.DataFrame, before: pd.DataFrame, state: GroupState) -> tuple[pd.DataFrame, pd.DataFrame, int | None]:
        now = state.getCurrentProcessingTimeMs() if forget_after else 0
        rows = rows.sort_values(["ms", "seq"], ignore_index=True)
        rows["hour"] = rows["ms"] // HOUR_MS
        every = pd.concat([before, rows.assign(used=1, seen=now)[held.names]], ignore_index=True)
        # Calls of an hour stand behind its state, in order: what was used before a call is the sum up to it.
        groups = every.groupby(key, dropna=False, sort=False)
        turn = (groups["used"].cumsum() - every["used"]).to_numpy()[len(before) :]
        after = groups.agg({"used": "sum", "seen": "max"}).reset_index()
        after["used"] = after["used"].clip(upper=per_hour)
        if forget_after:
            after["seen"] = after.groupby("producer", dropna=False)["seen"].transform("max")
        found = pd.DataFrame({"producer": rows["producer"], "seq": rows["seq"], "hour": rows["hour"], "accepted": turn < per_hour})
        return found, *forgotten(after, forget_after, state)

    return by_buckets(calls.select("producer", "seq", "ms"), ["producer"], update, LIMIT_OUT, held, _timeout(forget_after))


def current_callbacks(callbacks: DataFrame) -> DataFrame:
    """callbacks (queue, generation, seq) without late ones: those of a run that a newer run of the queue had superseded."""
    held = pa.schema({"queue": pa.string(), "generation": pa.int64()})

    def update(rows: pd.DataFrame, before: pd.DataFrame, state: GroupState) -> tuple[pd.DataFrame, pd.DataFrame, int | None]:
        rows = rows.sort_values("seq")
        every = pd.concat([before, rows[held.names]], ignore_index=True)
        groups = every.groupby("queue", dropna=False, sort=False)["generation"]
        newest = groups.cummax().to_numpy()[len(before) :]
        return rows[rows["generation"].to_numpy() >= newest][["queue", "generation", "seq"]], groups.max().reset_index(), None

    return by_buckets(callbacks.select("queue", "generation", "seq"), ["queue"], update, CURRENT_OUT, held)


def _timeout(forget_after: int | None) -> str:
    return GroupStateTimeout.ProcessingTimeTimeout if forget_after else GroupStateTimeout.NoTimeout


def arrivals(files: DataFrame, backlog: DataFrame) -> DataFrame:
    """The files (path, target) of a watched folder that have come since its first listing. A file of unknown target is
    passed over. backlog: the paths of that listing, as a table."""
    return files.join(backlog.select("path"), "path", "left_anti").where(F.col("target").isNotNull())


def debounced(requests: DataFrame, gap: str) -> DataFrame:
    """One write for each burst of requests (key, at): those that follow within the gap join in. (key, requests, at of the
    last). As a stream it needs a watermark on at; a burst comes out once the watermark has passed its gap."""
    burst = F.session_window("at", gap)
    return requests.groupBy("key", burst).agg(F.count(F.lit(1)).alias("requests"), F.max("at").alias("at")).drop("session_window")


def run_to_table(stream: DataFrame, schema: str) -> DataFrame:
    """Run a stream over what its source has now, to its end, and give its output as a table in the shared folder.
    A stream whose state times out by processing time has no end."""
    spark = stream.sparkSession
    path = shared_path(spark, "stream")
    query = stream.writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(schema).parquet(f"{path}/out")


def in_slices(table: DataFrame, order: str, slices: int = 4, files: int = 4) -> DataFrame:
    """A table as a stream of several micro-batches: rows by ranges of the number `order`, each range written to the
    shared folder after the one before, `files` files to a batch. Files are taken by the time they were written."""
    spark = table.sparkSession
    path = shared_path(spark, "slices")
    low, high = table.agg(F.min(order), F.max(order)).first()
    step = max(1, -(-((high or 0) - (low or 0) + 1) // slices))
    for k in range(slices):
        here = F.floor((F.col(order) - (low or 0)) / step) == k
        table.where(here if k else here | F.col(order).isNull()).repartition(files).write.mode("append").parquet(path)
    return spark.readStream.schema(table.schema).option("maxFilesPerTrigger", files).parquet(path)
