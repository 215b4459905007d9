"""Removal of repeated byte strings by prefix-free parsing.

A rolling hash over the bytes chooses triggers by content: in each 100-byte window the 32-byte gram of least hash. A
phrase is a trigger with the bytes around it that the windows choosing it cover, so phrases overlap by the overhang
that keeps each window whole in one phrase. The distinct phrases are the dictionary. The suffixes of the dictionary at
the windows' starts are sorted to a depth of 100 bytes (a suffix array to that depth); suffixes whose common prefix with
a neighbour reaches it are equal windows. The parse, as each phrase's occurrences by document and place, turns the
dictionary's order into that of the corpus: of equal windows the one of least place stays. As a window never leaves its
phrase, the parse's suffixes needn't be compared beyond their first phrase. See repeats.py for the steps.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framequery.llm import repeats
from framequery.llm.steps import Steps
from framequery.llm.words import M1, as_array, freed_group, mix

WIDTH = 100
TRIGGER = 32
#: A pseudo-random 64-bit value for each byte.
BYTE_UNITS = mix(np.arange(1, 257, dtype=np.uint64) * M1)


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts one after another, and their offsets."""
    binary = as_array(texts).cast(pa.large_binary())
    offsets = np.frombuffer(binary.buffers()[1], np.int64)[binary.offset : binary.offset + len(binary) + 1] if len(binary) else np.zeros(1, np.int64)
    data = np.frombuffer(binary.buffers()[2] or b"", np.uint8) if len(binary) else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def byte_units(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    data, offsets = text_bytes(texts)
    return BYTE_UNITS[data], offsets


def byte_grams(units: np.ndarray) -> np.ndarray:
    """A rolling hash of the 32 bytes from each place (fewer at the end), kept to 60 bits."""
    h, inverse = repeats.prefix_hashes(units)
    n = max(0, len(units) - TRIGGER)
    whole = mix((h[TRIGGER:] - h[: n + 1]) * inverse[: n + 1] + np.full(1, TRIGGER, np.uint64) * M1)[:n] if n else np.zeros(0, np.uint64)
    at = np.arange(n, len(units))
    return np.concatenate([whole, repeats.range_hash((h, inverse), at, np.full(len(at), len(units)))]) >> np.uint64(4)


SPEC = repeats.Spec(WIDTH, TRIGGER, 1, byte_units, byte_grams, lambda texts: text_bytes(texts)[0], True)


def remove_repeated_bytes(docs: DataFrame, digests: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, n_removed, n_spans, kept): UTF-8 bytes without those covered by a 100-byte string that starts earlier.

    Earlier: in a row of smaller id (NULL least), or further ahead in the row. Rows that share an id are ordered by a hash
    of their texts, then as they are read; ids may be of any type that Spark can order. n_spans counts maximal removed
    runs. kept (BINARY: cuts may fall inside a character) holds the bytes left; with digests it is kept_sha256, lowercase
    hex. NULL and empty texts have no bytes; an empty table gives no rows. Other columns are not read. Phrases are told
    apart by 64-bit hashes; windows of different phrases are compared byte by byte.
    """
    steps = Steps(docs.sparkSession)
    rows, whole = repeats.sharded(docs, id_col, text_col)
    last = "kept_sha256" if digests else "kept"

    @freed_group
    def run(texts: pa.Table, spans: pa.Table) -> pa.Table:
        table = texts.sort_by("doc")
        data, offsets = text_bytes(table["text"].combine_chunks())
        gone = repeats.covered(table["doc"].to_numpy(), offsets, spans)
        left = data[~gone]
        ends = np.concatenate([[0], np.cumsum(~gone)])[offsets]
        # A run begins at a removed byte whose forerunner in the same row stays or doesn't exist.
        begins = gone.copy()
        begins[1:] &= ~gone[:-1]
        heads = offsets[:-1][np.diff(offsets) > 0]
        begins[heads] = gone[heads]
        runs = np.concatenate([[0], np.cumsum(begins)])[offsets]
        parts = [left[a:b].tobytes() for a, b in zip(ends[:-1], ends[1:], strict=True)]
        kept = pa.array([hashlib.sha256(p).hexdigest() for p in parts], pa.string()) if digests else pa.array(parts, pa.binary())
        n = np.diff(offsets)
        return pa.table([table["_id"], pa.array(n), pa.array(n - np.diff(ends)), pa.array(np.diff(runs)), kept], names=[id_col, "n_bytes", "n_removed", "n_spans", last])

    found, phrases, late = repeats.repeated_phrases(rows, SPEC, steps)
    # A shard's first place of a phrase goes where another shard has an earlier one; AQE can split a frequent phrase's rows.
    firsts = phrases.where(F.col("places") > 1).select("gram", "phrase", F.col("doc").alias("first_doc"))
    other = found.where(F.col("kind") == repeats.OPEN).join(firsts, ["gram", "phrase"]).where(F.col("doc") != F.col("first_doc"))
    spans = [x.select("shard", "doc", "a", (F.col("n") + WIDTH - 1).alias("n")) for x in (other, late)]
    sure = found.where(F.col("kind") == repeats.REMOVED).select("shard", "doc", "a", "n")
    gone = steps.write(sure.unionByName(spans[0]).unionByName(spans[1]), "spans", "shard int, doc long, a int, n int")
    steps.drop("found", "phrases", "late")
    key, kind = docs.schema[id_col].dataType.simpleString(), "string" if digests else "binary"
    return whole.groupBy("shard").cogroup(gone.groupBy("shard")).applyInArrow(run, f"`{id_col}` {key}, n_bytes long, n_removed long, n_spans long, {last} {kind}")
