"""Continuous use of a folder: a queue of completed captures, uploads in progress, previews while a value is dragged."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from framequery.streaming.buckets import by_buckets, table
from framequery.streaming.stateful import observe

QUEUE_OUT = "folder string, seq long, path string, target string, event string"
UPLOAD_OUT = "path string, ms long, size long, state string"
PREVIEW_OUT = "key string, ms long, kind string"
STATE_STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class FolderQueue(StatefulProcessor):
    """A folder's complete captures wait their turn and run one at a time.

    State: the queue by number, and what runs. Captures that come and go within a batch never enter it.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.waiting = handle.getMapState("waiting", "n long", "path string, target string")
        self.place = handle.getValueState("place", "head long, tail long, path string, target string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        head, tail, running, target = self.place.get() if self.place.exists() else (0, 0, None, None)
        batch = pd.concat(list(rows), ignore_index=True).sort_values(["seq", "path"], kind="stable")
        ticks, at = np.unique(batch["seq"].to_numpy(), return_inverse=True)
        complete, ends = batch["complete"].to_numpy(dtype=bool), batch["kind"].to_numpy() != "size"
        new = list(zip(at[complete].tolist(), batch["path"][complete].tolist(), batch["target"][complete].tolist(), strict=True))
        ended = list(zip(at[ends].tolist(), batch["kind"][ends].tolist(), strict=True))
        seqs, out = ticks.tolist(), []
        n, e, since = 0, 0, 0  # captures and ends that are dealt with, and the first tick that is still to come
        while True:
            if running is not None:
                while e < len(ended) and ended[e][0] < since:
                    e += 1
                if e == len(ended):
                    break
                since, kind = ended[e]
                out.append((key[0], seqs[since], running, target, kind))
                running = None
            if head < tail:
                start, (path, aim) = since, self.waiting.getValue((head,)) if since < len(seqs) else (None, None)
            elif n < len(new):
                start, path, aim = max(since, new[n][0]), new[n][1], new[n][2]
            else:
                break
            if start >= len(seqs):
                break
            if head < tail:
                self.waiting.removeKey((head,))
                head += 1
            else:
                n += 1
            aim = aim if isinstance(aim, str) else None
            out.append((key[0], seqs[start], path, aim, "skipped" if aim is None else "started"))
            if aim is not None:
                running, target = path, aim
            since = start + 1
        for _, path, aim in new[n:]:
            self.waiting.updateValue((tail,), (path, aim if isinstance(aim, str) else None))
            tail += 1
        self.place.update((head, tail, running, target if running is not None else None))
        yield pd.DataFrame(out, columns=["folder", "seq", "path", "target", "event"])

    def close(self) -> None:
        pass


def _completed(events: DataFrame, needed: int) -> DataFrame:
    """Events with `complete`: whether a file's row completes it. Rows keep their path and target only if so, or if they
    tell an end. Files are dealt out by buckets, so a folder's files are watched by many tasks."""
    held = pa.schema({"folder": pa.string(), "path": pa.string(), "last": pa.int64(), "repeats": pa.int64(), "seen": pa.bool_()})

    def update(rows: pd.DataFrame, before: pd.DataFrame, state: GroupState) -> tuple[pd.DataFrame, pd.DataFrame, None]:
        files = {(folder, path): tuple(file) for folder, path, *file in before.itertuples(index=False, name=None)}
        rows = rows.sort_values("seq", ignore_index=True)
        complete = [False] * len(rows)
        for k, (folder, kind, path, size, old) in enumerate(zip(*(rows[c].tolist() for c in ("folder", "kind", "path", "size", "old")), strict=True)):
            file = files.get((folder, path))
            if kind == "size" and not old and not (file and file[2]):
                files[folder, path], complete[k] = observe(file, int(size), needed)
        rows["complete"] = complete
        named = rows["complete"] | (rows["kind"] != "size")
        found = rows[["folder", "seq", "kind"]].assign(path=rows["path"].where(named, None), target=rows["target"].where(named, None), complete=rows["complete"])
        return found, table(held, [(*key, *file) for key, file in files.items()]), None

    spread = F.when(F.col("kind") == "size", F.xxhash64("folder", "path")).otherwise(F.xxhash64("folder", "seq"))
    return by_buckets(events, spread, update, "folder string, seq long, kind string, path string, target string, complete boolean", held)


def folder_queue(events: DataFrame, backlog: DataFrame | None = None, needed: int = 2) -> DataFrame:
    """(folder, seq, path, target, event) of watched folders: which capture starts, is skipped, is done or has failed, when.

    events: (folder, seq, kind, path, size, target). Rows of kind `size` tell a file's size at a tick (seq); `done` and
    `failed` say that what runs in the folder has ended. A file is complete once its size has repeated `needed` times; it
    is seen then and queues, first come first (ties by path). After the rows of a tick the next one starts if nothing
    runs: one at a time. A capture without a target is passed over, and the next has its turn at the next tick; a
    failure ends a capture like any other end. backlog (folder, path): files that were there at the start, never run.

    Files are watched by buckets of (folder, path), as in by_buckets; then a folder is a key, whose queue is one stream.
    A tick's rows must come in one batch, and ticks in order. Needs the RocksDB state store, which keeps the queue on
    disk; a folder's ticks of one batch are sorted in memory, so bound what a trigger takes.
    """
    events.sparkSession.conf.set(STATE_STORE, ROCKSDB)
    events = events.select("folder", "seq", "kind", "path", "size", "target")
    if backlog is None:
        events = events.withColumn("old", F.lit(False))
    else:
        there = backlog.select(F.col("folder").alias("_folder"), F.col("path").alias("_path"), F.lit(True).alias("_old")).distinct()
        same = F.col("folder").eqNullSafe(F.col("_folder")) & F.col("path").eqNullSafe(F.col("_path"))
        events = events.join(there, same, "left").select(*events.columns, F.coalesce("_old", F.lit(False)).alias("old"))
    return _completed(events, needed).groupBy("folder").transformWithStateInPandas(FolderQueue(), QUEUE_OUT, "Append", "None")


def _timed(rows: DataFrame, key: str, delay: str, *columns: str) -> DataFrame:
    return rows.withWatermark("at", delay).select(key, "at", *columns, F.unix_millis("at").alias("ms"))


def upload_states(samples: DataFrame, prune_after: int, delay: str = "0 seconds") -> DataFrame:
    """(path, ms, size, state) for samples (path, size, at): `new` at first sight, `uploading` where the size isn't the
    last one, else `settled`; and `gone`, prune_after ms after the last sample, for a path that was not seen for longer.

    A path's state is dropped as it goes, by an event-time timer once the watermark (delay behind the latest `at`) has
    passed, or before its next sample; so results don't depend on how rows fall into batches.
    """
    held = pa.schema({"path": pa.string(), "last": pa.int64(), "size": pa.int64()})

    def update(rows: pd.DataFrame, before: pd.DataFrame, state: GroupState) -> tuple[pd.DataFrame, pd.DataFrame, int | None]:
        files = {path: (last, size) for path, last, size in before.itertuples(index=False, name=None)}
        rows = rows.sort_values(["ms", "size"])
        out = []
        for path, ms, now in zip(rows["path"].tolist(), rows["ms"].tolist(), rows["size"].tolist(), strict=True):
            last, size = files.get(path, (None, None))
            if last is not None and ms - last > prune_after:
                out.append((path, last + prune_after, size, "gone"))
                last = None
            out.append((path, ms, now, "new" if last is None else "settled" if now == size else "uploading"))
            files[path] = (ms, now)
        over = state.getCurrentWatermarkMs() - prune_after
        out += [(path, last + prune_after, size, "gone") for path, (last, size) in files.items() if last < over]
        left = [(path, last, size) for path, (last, size) in files.items() if last >= over]
        return pd.DataFrame(out, columns=["path", "ms", "size", "state"]), table(held, left), min((last for _, last, _ in left), default=0) + prune_after

    return by_buckets(_timed(samples, "path", delay, "size"), ["path"], update, UPLOAD_OUT, held, GroupStateTimeout.EventTimeTimeout)


def previews(requests: DataFrame, throttle: int = 33, settle: int = 200, delay: str = "0 seconds") -> DataFrame:
    """(key, ms, kind) for requests (key, at): a `preview` at a request that comes throttle ms or more after the last
    preview, and the `full` result once no request has come for settle ms. Keys without a request for so long leave no
    state (settle must not be shorter than throttle). Times are event times; see upload_states."""
    if settle < throttle:
        raise ValueError("settle is shorter than throttle")
    held = pa.schema({"key": pa.string(), "asked": pa.int64(), "shown": pa.int64()})

    def update(rows: pd.DataFrame, before: pd.DataFrame, state: GroupState) -> tuple[pd.DataFrame, pd.DataFrame, int | None]:
        keys = {key: (asked, shown) for key, asked, shown in before.itertuples(index=False, name=None)}
        rows = rows.sort_values("ms")
        out = []
        for key, ms in zip(rows["key"].tolist(), rows["ms"].tolist(), strict=True):
            asked, shown = keys.get(key, (None, None))
            if asked is not None and ms - asked >= settle:
                out.append((key, asked + settle, "full"))
            if shown is None or ms - shown >= throttle:
                out.append((key, ms, "preview"))
                shown = ms
            keys[key] = (ms, shown)
        over = state.getCurrentWatermarkMs() - settle
        out += [(key, asked + settle, "full") for key, (asked, _) in keys.items() if asked < over]
        left = [(key, asked, shown) for key, (asked, shown) in keys.items() if asked >= over]
        return pd.DataFrame(out, columns=["key", "ms", "kind"]), table(held, left), min((asked for _, asked, _ in left), default=0) + settle

    return by_buckets(_timed(requests, "key", delay), ["key"], update, PREVIEW_OUT, held, GroupStateTimeout.EventTimeTimeout)
