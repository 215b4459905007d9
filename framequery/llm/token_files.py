"""Token ids in binary files of shuffled planes, and their readers.

Format: a folder with two Parquet tables, so that writes are committed by Spark and survive lost executors.

* `chunks`: one row for a run of whole documents in key order, at least `chunk_ids` ids long: shard, chunk, keys,
  lengths, block_ids, and `planes`: for each block of `block_ids` ids (the last may be shorter) its byte or bit planes,
  each compressed with zstandard. Ids are unsigned 32-bit little-endian numbers.
* `index`: one row for each chunk: shard, chunk, n_docs, n_ids, and start, the ids of all chunks before it.
"""

from __future__ import annotations

import functools
import json
import os
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from framequery.llm.bpe import byte_letters
from framequery.llm.words import gather, join_rows, rebatched, split_words, to_batches, unique_words

#: Distinct pieces and runs beyond which a worker keeps only those that its current batch uses.
CACHED = 1_000_000
RUNS_A_CALL = 4_000
PIECES_A_TEXT = 100
#: Runs of these characters are cut into pieces here as the tokenizers library does (tested for each character).
PLAIN_RUN = "^[!-~\u00a1-\u012f\u0131-\u024f]+$"
PIECE = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: The normaliser and splitter for which that holds.
LOWER = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]
SPLIT = {"type": "Split", "pattern": {"Regex": PIECE}, "behavior": "Removed", "invert": True}
PIECE_OR_LINE = regex.compile(rf"\n|{PIECE}")


class LibraryRuns:
    """Ids of distinct white-space-free runs from the tokenizers library.

    The vocabularies here split at white space before anything else, so a text's ids are those of its runs. Runs are
    handed over many at a time, parted by a special token, whose id parts the ids again. Plain runs are first cut into
    pieces, of which there are fewer distinct ones; pieces are parted by blanks, which the library takes for less, and
    the ids by the tokens that end a word.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.t = Tokenizer.from_file(path)
        self.t.no_truncation()
        self.t.no_padding()
        specials = {i: t.content for i, t in self.t.get_added_tokens_decoder().items() if t.special}
        self.part_id, self.part = max(specials.items())
        self.mark = os.path.commonprefix([*specials.values()])
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab = self.t.get_vocab()
        end = spec["model"].get("end_of_word_suffix")
        splitters = (spec.get("pre_tokenizer") or {}).get("pretokenizers", [])
        self.by_pieces = (
            bool(end) and bool(self.mark) and (spec["normalizer"] or {}).get("normalizers") == LOWER and len(splitters) == 2 and splitters[0] == SPLIT
            and splitters[1]["type"] == "ByteLevel" and not splitters[1]["add_prefix_space"] and all(c + end in vocab for c in byte_letters())
        )
        self.ends = np.zeros(max(vocab.values()) + 1, bool)
        self.ends[[i for token, i in vocab.items() if end and token.endswith(end)]] = True
        #: What was encoded before, with the flat ids and their offsets.
        self.known, self.ids, self.offsets = pa.array([], pa.large_string()), np.zeros(0, "<i4"), np.zeros(1, np.int64)
        probe = ["Half", "a", "word's", "2nd", "end."]
        if self.t.encode(" \t".join(probe) + "\n", add_special_tokens=False).ids != self.encode(pa.array(probe, pa.large_string()))[0].tolist():
            raise ValueError(f"{path} doesn't split at white space: runs of it can't be encoded one by one")

    def _runs(self, runs: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of any runs, parted by the special token; runs that could hold one go by themselves."""
        own = {k: self.t.encode(r, add_special_tokens=False).ids for k, r in enumerate(runs) if self.mark in r}
        rest = [r for k, r in enumerate(runs) if k not in own]
        texts = [self.part.join(rest[k : k + RUNS_A_CALL]) for k in range(0, len(rest), RUNS_A_CALL)]
        ids = np.array([i for e in self.t.encode_batch_fast(texts, add_special_tokens=False) for i in (*e.ids, self.part_id)], "<i4")
        part = ids == self.part_id
        ends = np.flatnonzero(part)
        lengths = np.diff(ends, prepend=-1) - 1
        ids = ids[~part]
        if own:
            at = np.array(list(own)) - np.arange(len(own))
            before = np.concatenate([[0], np.cumsum(lengths)])[at]
            ids = np.insert(ids, np.repeat(before, [len(x) for x in own.values()]), [i for x in own.values() for i in x])
            lengths = np.insert(lengths, at, [len(x) for x in own.values()])
        return ids, np.concatenate([[0], np.cumsum(lengths)])

    def _pieces(self, pieces: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of pieces, parted by blanks. Each has one token that ends a word, the last; were there more, some piece
        would be several to the library, and they go as runs."""
        texts = join_rows(pieces, np.append(np.arange(0, len(pieces), PIECES_A_TEXT), len(pieces))).to_pylist()
        ids = np.concatenate([np.zeros(0, "<i4"), *(np.array(e.ids, "<i4") for e in self.t.encode_batch_fast(texts, add_special_tokens=False))])
        ends = np.flatnonzero(self.ends[ids]) + 1
        if len(ends) != len(pieces):
            return self._runs(pieces.to_pylist())
        return ids, np.concatenate([[0], ends])

    def _known(self, strings: pa.Array, n_pieces: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids of strings, the first n_pieces of which are pieces; only those not met before are encoded."""
        at = pc.index_in(strings, value_set=self.known).fill_null(-1).to_numpy().astype(np.int64)
        new = at < 0
        fresh = [strings[:n_pieces].filter(pa.array(new[:n_pieces])), strings[n_pieces:].filter(pa.array(new[n_pieces:]))]
        at[new] = len(self.known) + np.arange(new.sum())
        for some, (ids, offsets) in zip(fresh, (self._pieces(fresh[0]), self._runs(fresh[1].to_pylist())), strict=True):
            self.known, self.ids = pa.concat_arrays([self.known, some]), np.concatenate([self.ids, ids])
            self.offsets = np.concatenate([self.offsets, self.offsets[-1] + offsets[1:]])
        ids, offsets = gather(self.ids, self.offsets, at)
        if len(self.known) > CACHED:
            self.known, self.ids, self.offsets = strings, ids, offsets
        return ids, offsets

    def encode(self, runs: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids of distinct runs and their offsets."""
        plain = np.zeros(len(runs), bool)
        if self.by_pieces:
            plain = pc.and_not(pc.match_substring_regex(runs, PLAIN_RUN), pc.match_substring(runs, self.mark)).to_numpy(zero_copy_only=False)
        lines, odd = runs.filter(pa.array(plain)), runs.filter(pa.array(~plain))
        text = join_rows(lines, np.array([0, len(lines)]), "\n")[0].as_py().lower() + "\n" if len(lines) else ""
        # The first of the strings is the end of a line, which has no ids.
        strings, index = unique_words(pa.array(PIECE_OR_LINE.findall("\n" + text), pa.large_string()))
        n_pieces = len(strings) - 1
        ids, offsets = self._known(pa.concat_arrays([strings[1:], odd]), n_pieces)
        values, at = gather(ids, np.concatenate([[0], offsets[: n_pieces + 1]]), index)
        run_offsets = at[np.flatnonzero(index == 0)]
        if not len(odd):
            return values, run_offsets
        place = np.empty(len(runs), np.int64)
        place[np.concatenate([np.flatnonzero(plain), np.flatnonzero(~plain)])] = np.arange(len(runs))
        values = np.concatenate([values, ids[offsets[n_pieces] :]])
        return gather(values, np.concatenate([run_offsets, run_offsets[-1] + offsets[n_pieces + 1 :] - offsets[n_pieces]]), place)


@functools.lru_cache(maxsize=2)
def library_runs(path: str) -> LibraryRuns:
    return LibraryRuns(path)


def split_planes(ids: np.ndarray, bits: bool) -> list[bytes]:
    """The byte planes (4) or bit planes (32) of uint32 ids, lowest first."""
    raw = ids.astype("<u4").view(np.uint8).reshape(-1, 4)
    if not bits:
        return [raw[:, k].tobytes() for k in range(4)]
    ones = np.unpackbits(raw, axis=1, bitorder="little")
    return [np.packbits(ones[:, k]).tobytes() for k in range(32)]


def join_planes(planes: list[bytes], n: int) -> np.ndarray:
    if len(planes) == 4:
        return np.stack([np.frombuffer(p, np.uint8) for p in planes], axis=1).reshape(-1).view("<u4") if n else np.zeros(0, np.uint32)
    ones = np.stack([np.unpackbits(np.frombuffer(p, np.uint8), count=n) for p in planes], axis=1)
    return np.packbits(ones, axis=1, bitorder="little").reshape(-1).view("<u4")


def write_token_files(
    docs: DataFrame, path: str, tokenizer_path: str, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text",
    block_ids: int = 1 << 16, chunk_ids: int = 1 << 20, bits: bool = False, level: int = 1,
) -> None:
    """Encode every whole text with the tokenizers library, append end_id, and write the format above to `path`.

    Documents are ordered by id (NULL ids first; equal ids by a hash of the text, then as read) with one range shuffle,
    which parts the rows of a frequent id too. Ids keep their type, any that Spark can order. NULL and empty texts give
    end_id alone; an empty table gives empty tables; other columns aren't read. A task holds one batch of text and one
    open chunk.
    """
    key = docs.schema[id_col].dataType
    schema = f"shard int, chunk int, keys array<{key.simpleString()}>, lengths array<long>, block_ids int, planes array<array<binary>>"
    key_type = to_arrow_type(key)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, shard = library_runs(tokenizer_path), TaskContext.get().partitionId()
        zstd = zstandard.ZstdCompressor(level=level)
        held: list[np.ndarray] = []
        keys: list = []
        lengths: list[np.ndarray] = []
        chunk = size = 0

        def row_of(values: pa.ChunkedArray) -> pa.Array:
            return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values.combine_chunks())

        def row() -> pa.RecordBatch:
            ids = np.concatenate(held)
            planes = [[zstd.compress(p) for p in split_planes(ids[k : k + block_ids], bits)] for k in range(0, len(ids), block_ids)]
            arrays = [
                pa.array([shard], pa.int32()), pa.array([chunk], pa.int32()), row_of(pa.chunked_array([c for x in keys for c in x.chunks], key_type)),
                pa.array([np.concatenate(lengths)], pa.list_(pa.int64())), pa.array([block_ids], pa.int32()), pa.array([planes], pa.list_(pa.list_(pa.binary()))),
            ]
            return pa.RecordBatch.from_arrays(arrays, names=["shard", "chunk", "keys", "lengths", "block_ids", "planes"])

        for table in rebatched(batches):
            flat, spans = split_words(table.column(1).combine_chunks())
            distinct, index = unique_words(flat)
            ids, offsets = encoder.encode(distinct)
            values, run_offsets = gather(ids, offsets, index)
            ends = run_offsets[spans]
            # Put end_id after each document's ids.
            values = np.insert(values, ends[1:], end_id)
            ends = ends + np.arange(len(ends))
            a = 0
            while a < len(ends) - 1:  # whole documents until the chunk is full
                b = int(min(max(np.searchsorted(ends, ends[a] + chunk_ids - size), a + 1), len(ends) - 1))
                held.append(values[ends[a] : ends[b]])
                keys.append(table.column(0).slice(a, b - a))
                lengths.append(np.diff(ends[a : b + 1]))
                size += int(ends[b] - ends[a])
                a = b
                if size >= chunk_ids:
                    yield row()
                    held, keys, lengths, size, chunk = [], [], [], 0, chunk + 1
        if held:
            yield row()

    spark = docs.sparkSession
    order = [F.col("_id").asc_nulls_first(), F.col("_text").asc(), F.col("_read").asc()]
    keyed = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("_text"), F.monotonically_increasing_id().alias("_read"))
    keyed.repartitionByRange(*order).sortWithinPartitions(*order).select("_id", "text").mapInArrow(run, schema).write.mode("errorifexists").option("compression", "none").parquet(f"{path}/chunks")
    # Two levels of running sums: over shards (a row each), then within each shard.
    chunks = spark.read.schema(schema).parquet(f"{path}/chunks").select(
        "shard", "chunk", F.size("keys").alias("n_docs"), F.aggregate("lengths", F.lit(0).cast("long"), lambda a, x: a + x).alias("n_ids")
    )
    shards = chunks.groupBy("shard").agg(F.sum("n_ids").alias("ids")).withColumn("before", F.sum("ids").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)))
    within = F.sum("n_ids").over(Window.partitionBy("shard").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1))
    start = F.coalesce(within, F.lit(0)) + F.coalesce("before", F.lit(0))
    chunks.join(shards, "shard").withColumn("start", start).select("shard", "chunk", "n_docs", "n_ids", "start").write.parquet(f"{path}/index")


def read_token_files(spark: SparkSession, path: str, digests: bool = False, id_col: str = "doc_id") -> DataFrame:
    """Rows (id, start, n_tokens, ids) in the files, or ids_crc32 (of little-endian uint32 ids) for ids.

    Each chunk is decoded by itself; only the small per-document rows meet the index.
    """
    chunks = spark.read.parquet(f"{path}/chunks")
    index = spark.read.parquet(f"{path}/index").select("shard", "chunk", F.col("start").alias("chunk_start"))
    key = chunks.schema["keys"].dataType.elementType
    last = "ids_crc32 long" if digests else "ids array<int>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        zstd = zstandard.ZstdDecompressor()
        for batch in batches:
            for k in range(batch.num_rows):
                shard, chunk, keys, lengths, block, blocks = (batch.column(c)[k] for c in range(6))
                ends = np.concatenate([[0], np.cumsum(lengths.values.to_numpy())]).astype(np.int64)
                parts = []
                for j, planes in enumerate(blocks.as_py()):
                    n = min(block.as_py(), int(ends[-1]) - j * block.as_py())
                    parts.append(join_planes([zstd.decompress(p) for p in planes], n))
                ids = np.concatenate(parts).astype("<u4")
                if digests:
                    raw = memoryview(ids).cast("B")
                    tail = pa.array([zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(ends[:-1], ends[1:], strict=True)], pa.int64())
                else:
                    tail = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(ids.astype(np.int32)))
                n = len(keys)
                yield from to_batches(pa.table(
                    [pa.array([shard.as_py()] * n, pa.int32()), pa.array([chunk.as_py()] * n, pa.int32()), keys.values, pa.array(ends[:-1]), pa.array(np.diff(ends)), tail],
                    names=["shard", "chunk", "doc_id", "at", "n_tokens", "last"],
                ))

    columns = ["shard", "chunk", "keys", "lengths", "block_ids", "planes"]
    rows = chunks.select(columns).mapInArrow(run, f"shard int, chunk int, doc_id {key.simpleString()}, at long, n_tokens long, last {last.split()[1]}")
    return rows.join(index, ["shard", "chunk"]).select(
        F.col("doc_id").alias(id_col), (F.col("chunk_start") + F.col("at")).alias("start"), "n_tokens", F.col("last").alias(last.split()[0])
    )


def shared_root(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or one of our own where that is unset."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    return "/tmp/framequery-checkpoints"


def shared_folder(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder."""
    return f"{shared_root(spark)}/framequery/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str, schema: str | None = None) -> DataFrame:
    """df through a Parquet table in the shared folder: the next step starts from files, not from a lineage."""
    spark = df.sparkSession
    path = shared_folder(spark, name)
    df.write.parquet(path)
    return spark.read.schema(schema or df.schema).parquet(path)
