"""Arrow and numpy helpers shared by the text operators: words, unique words, gathering of ragged rows."""

from __future__ import annotations

import ctypes
import functools
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Words are runs of characters other than these ASCII white spaces.
WORD_PATTERN = r"[^\x20\x09-\x0D]+"
A64 = np.uint64(6364136223846793005)
M1, M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)


def as_array(column: pa.Array | pa.ChunkedArray) -> pa.Array:
    return column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column


def split_words(texts: pa.Array, lower: bool = False) -> tuple[pa.Array, np.ndarray]:
    """All words of all texts, flat, and the offsets of each text (n + 1). NULL counts as an empty text."""
    texts = pc.fill_null(as_array(texts).cast(pa.large_string()), "")
    if lower:
        texts = pc.ascii_lower(texts)
    lists = pc.ascii_split_whitespace(pc.ascii_trim_whitespace(texts))
    flat, offsets = lists.flatten(), lists.offsets.to_numpy().astype(np.int64)
    offsets = offsets - offsets[0]
    full = pc.greater(pc.binary_length(flat), 0)
    if pc.all(full).as_py() is False:  # an empty text yields one empty word
        kept = np.concatenate([[0], np.cumsum(full.to_numpy(zero_copy_only=False))])
        flat, offsets = flat.filter(full), kept[offsets]
    return flat, offsets


def unique_words(flat: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Distinct words and, for each word, its index among them."""
    if len(flat) == 0:
        return flat, np.zeros(0, np.int64)
    coded = flat.dictionary_encode()
    return coded.dictionary, coded.indices.to_numpy().astype(np.int64)


def gather(values: np.ndarray, offsets: np.ndarray, index: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Concatenate the ragged rows `index` of (values, offsets); returns the values and their offsets."""
    starts = offsets[:-1][index]
    lengths = offsets[1:][index] - starts
    out = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int64)
    where = np.arange(out[-1], dtype=np.int64) + np.repeat(starts - out[:-1], lengths)
    return values[where], out


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser over uint64."""
    h = (h ^ (h >> np.uint64(30))) * M2
    h = (h ^ (h >> np.uint64(27))) * M1
    return h ^ (h >> np.uint64(31))


def hash_strings(strings: pa.Array) -> np.ndarray:
    """A 64-bit hash of each string, computed over whole Arrow buffers eight bytes at a time."""
    binary = as_array(strings).cast(pa.large_binary())
    n = len(binary)
    if n == 0:
        return np.zeros(0, np.uint64)
    offsets = np.frombuffer(binary.buffers()[1], np.int64)[binary.offset : binary.offset + n + 1]
    data = np.frombuffer(binary.buffers()[2] or b"", np.uint8)[: offsets[-1]]
    data = np.concatenate([data, np.zeros(8, np.uint8)])
    lanes = np.ndarray((len(data) - 7,), np.uint64, data, strides=(1,))  # unaligned eight-byte reads
    starts, lengths = offsets[:-1], np.diff(offsets)
    h = mix(lengths.astype(np.uint64) * A64 + M1)
    todo, at = np.arange(n), 0
    while len(todo):
        todo = todo[lengths[todo] > at]
        if not len(todo):
            break
        left = np.minimum(lengths[todo] - at, 8).astype(np.uint64)
        lane = lanes[starts[todo] + at] & (np.uint64(0xFFFFFFFFFFFFFFFF) >> (np.uint64(64) - left * np.uint64(8)))
        h[todo] = mix(h[todo] * A64 + lane * M2 + M1)
        at += 8
    return h


def release() -> None:
    """Give memory that is free but still held, by Arrow and by the C library, back to the system."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
    if trim is not None:
        trim(0)


def freed(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """run for mapInArrow; what it held goes back once its last batch is out, as the worker lives on for other stages."""

    @functools.wraps(run)
    def call(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        release()

    return call


def freed_group(run: Callable[[pa.Table, pa.Table], pa.Table]) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """The same for a function of two groups, after each call."""

    @functools.wraps(run)
    def call(left: pa.Table, right: pa.Table) -> pa.Table:
        out = run(left, right)
        release()
        return out

    return call


def rebatched(batches: Iterable[pa.RecordBatch], max_bytes: int = 16 << 20) -> Iterator[pa.Table]:
    """Arrow batches gathered, or cut by rows, to tables of about max_bytes: per-table dictionaries pay off, and what
    is derived from a table stays bounded. A table always has a row, however long."""
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        rows, total = batch.num_rows, batch.nbytes
        step = max(1, rows * max_bytes // max(1, total)) if total > max_bytes else rows
        for k in range(0, rows, max(1, step)):
            part = batch.slice(k, step)
            if held and size + part.nbytes > max_bytes:
                yield pa.Table.from_batches(held)
                held, size = [], 0
                release()
            held.append(part)
            size += part.nbytes
    if held:
        yield pa.Table.from_batches(held)
        held.clear()
        release()


def to_batches(table: pa.Table, rows: int = 10_000) -> Iterator[pa.RecordBatch]:
    yield from table.to_batches(max_chunksize=rows)


def join_rows(strings: pa.Array, offsets: np.ndarray, separator: str = " ") -> pa.Array:
    """The strings of each row (offsets: n + 1) joined by the separator."""
    rows = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), strings.cast(pa.large_string()))
    return pc.binary_join(rows, pa.scalar(separator, pa.large_string()))
