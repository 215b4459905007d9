"""State of many keys by buckets of keys: one call of Python has all rows of a bucket, and its keys' state as one table.

A call for each key costs about a millisecond however few rows it has, so a table with many keys would be all calls. A
bucket's table is read and written whole when a trigger has rows of it, so ask for more buckets where keys far outnumber
a trigger's rows. It lies in the state store as a compressed Arrow stream.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

BUCKETS = 512
#: (rows, state of the keys, group state) -> (rows out, state of the keys from now on, time of the next call at the latest)
Update = Callable[[pd.DataFrame, pd.DataFrame, GroupState], tuple[pd.DataFrame, pd.DataFrame, int | None]]


def packed(table: pd.DataFrame, schema: pa.Schema) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as writer:
        writer.write_table(pa.Table.from_pandas(table, schema, preserve_index=False))
    return sink.getvalue().to_pybytes()


def unpacked(data: bytes) -> pd.DataFrame:
    return pa.ipc.open_stream(pa.py_buffer(bytes(data))).read_pandas()


def by_buckets(rows: DataFrame, bucket: list[str] | Column, update: Update, out: str, held: pa.Schema, timeout: str = GroupStateTimeout.NoTimeout, buckets: int = BUCKETS) -> DataFrame:
    """Rows of `out` that update gives for each bucket of a trigger. bucket: the columns of a key, or a number whose
    remainder is the bucket. A bucket whose time has come is called without rows, so keys that are due must be looked for
    in every call. A bucket without keys leaves no state."""

    def call(_: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        parts = list(frames)
        batch = pd.concat(parts, ignore_index=True) if parts else pd.DataFrame(columns=rows_columns)
        before = unpacked(state.get[0]) if state.exists else held.empty_table().to_pandas()
        found, after, due = update(batch, before, state)
        if len(after):
            state.update((packed(after, held),))
            if timeout == GroupStateTimeout.EventTimeTimeout:
                state.setTimeoutTimestamp(max(due, state.getCurrentWatermarkMs() + 1))
            elif timeout == GroupStateTimeout.ProcessingTimeTimeout:
                state.setTimeoutDuration(max(1, due - state.getCurrentProcessingTimeMs()))
        elif state.exists:
            state.remove()
        if len(found):
            yield found

    number = bucket if isinstance(bucket, Column) else F.xxhash64(*bucket)
    rows_columns = rows.columns
    return rows.withColumn("_bucket", F.pmod(number, F.lit(buckets))).groupBy("_bucket").applyInPandasWithState(call, out, "held binary", "append", timeout)


def table(schema: pa.Schema, entries: list[tuple]) -> pd.DataFrame:
    """Entries as a table of these columns."""
    return pd.DataFrame({name: list(column) for name, column in zip(schema.names, zip(*entries, strict=True), strict=True)} if entries else {name: [] for name in schema.names})


def forgotten(held: pd.DataFrame, after: int | None, state: GroupState) -> tuple[pd.DataFrame, int | None]:
    """State without the keys last `seen` so long ago (processing time, in ms), and when the next one is due."""
    if not after:
        return held, None
    held = held[held["seen"] + after >= state.getCurrentProcessingTimeMs()]
    return held, int(held["seen"].min()) + after if len(held) else None
