"""SimHash near-duplicates by anchor-point covering.

Two 64-bit fingerprints that differ in at most 3 bits differ in at most 1 bit in one of their halves. On 31 bits of
each half the anchors are the code words of the perfect Hamming [31, 26] code, whose covering radius is 1: every
fingerprint has a home anchor within 1 bit. It is replicated to every anchor within radius + threshold = 2 bits (16 at
most), so a near fingerprint always meets it at its home. Homes are compared with replicas anchor by anchor.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framequery.llm.components import connected_components
from framequery.llm.token_files import shared_folder
from framequery.llm.words import freed, rebatched, split_words, to_batches

SEED = 42
#: Shingles whose 64 bits are counted at once; numpy makes 8 bytes of each bit for the sums by text.
COUNT_ROWS = 40_000
#: Text, or a part of a longer text's shingles, that is hashed at once.
TEXT_BYTES = 2 << 20
HASHED_AT_ONCE = 100_000
PAIRS_AT_ONCE = 2_000_000
#: Rows of whole anchors that are compared at once.
ROWS_AT_ONCE = 100_000


def hash_shingles(flat: pa.Array, offsets: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """XXH64 of every n-word shingle of each text (the whole of a shorter text), and the texts' offsets."""
    from xxhash import xxh64_intdigest

    lengths = np.diff(offsets)
    counts = np.where(lengths >= n, lengths - n + 1, np.minimum(lengths, 1))
    out = np.concatenate([[0], np.cumsum(counts)]).astype(np.int64)
    starts = np.arange(out[-1]) + np.repeat(offsets[:-1] - out[:-1], counts)
    short = np.repeat(lengths < n, counts)
    hashes = np.zeros(len(starts), np.uint64)
    whole = np.flatnonzero(~short)
    for c in range(0, len(whole), HASHED_AT_ONCE):
        some = whole[c : c + HASHED_AT_ONCE]
        parts = [flat.take(pa.array(starts[some] + k)) for k in range(n)]
        joined = pc.binary_join_element_wise(*parts, pa.scalar(" ", parts[0].type)).cast(pa.large_binary())
        hashes[some] = np.fromiter((xxh64_intdigest(b, SEED) for b in joined.to_pylist()), np.uint64, len(some))
    for k in np.flatnonzero(short):
        d = int(np.searchsorted(out, k, side="right") - 1)
        text = " ".join(flat.slice(int(offsets[d]), int(lengths[d])).to_pylist())
        hashes[k] = xxh64_intdigest(text.encode("utf-8"), SEED)
    return hashes, out


def majority_bits(hashes: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """For each text the bits that are 1 in over half of its hashes; 0 for a text without any."""
    n = len(offsets) - 1
    out = np.zeros(n, np.uint64)
    a = 0
    while a < n:
        b = int(max(a + 1, np.searchsorted(offsets, offsets[a] + COUNT_ROWS, side="right") - 1))
        full = a + np.flatnonzero(np.diff(offsets[a : b + 1]) > 0)
        if len(full):
            lo, hi = offsets[a], offsets[b]
            total = np.zeros((len(full), 64), np.int64)
            for c in range(lo, hi, COUNT_ROWS):  # a single long text goes in pieces
                d = min(hi, c + COUNT_ROWS)
                bits = np.unpackbits(hashes[c:d].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
                if len(full) == 1:
                    total[0] += bits.sum(axis=0, dtype=np.int64)
                else:
                    total += np.add.reduceat(bits, offsets[full] - lo, axis=0, dtype=np.int64)
            sizes = (offsets[full + 1] - offsets[full])[:, None]
            out[full] = np.packbits(2 * total > sizes, axis=1, bitorder="little").reshape(-1, 8).view(np.uint64).ravel()
        a = b
    return out


def fingerprints(docs: DataFrame, words: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp long): SimHash of each whole text; A-Z lower-cased, shingles counted with repeats. NULL text: 0."""

    @freed
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in rebatched(batches, TEXT_BYTES):
            flat, offsets = split_words(table.column(1), lower=True)
            fp = majority_bits(*hash_shingles(flat, offsets, words))
            yield from to_batches(pa.table([table.column(0), pa.array(fp.view(np.int64))], names=[id_col, "fp"]))

    return docs.select(F.col(id_col).cast("long"), text_col).mapInArrow(run, f"{id_col} long, fp long")


def anchors_of(fp: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, anchor, home) of each fingerprint: all code words within 2 bits of each half; the half is in bit 31."""
    rows, anchors, homes = [], [], []
    bit = np.concatenate([[0], np.int64(1) << np.arange(31)])
    for half in range(2):
        v = (fp >> np.uint64(32 * half)).astype(np.int64) & 0x7FFFFFFF
        syndrome = np.zeros(len(v), np.int64)
        for k in range(1, 32):
            syndrome ^= np.where(v & bit[k], k, 0)
        # Flipping position s gives the word within 1 bit; flipping a and a ^ s those within 2.
        rows.append(np.arange(len(v)))
        anchors.append(v ^ bit[syndrome] | half << 31)
        homes.append(np.ones(len(v), bool))
        for a in range(1, 32):
            b = a ^ syndrome
            ok = (syndrome > 0) & (b > a) & (a != syndrome) & (b != syndrome)
            rows.append(np.flatnonzero(ok))
            anchors.append(v[ok] ^ bit[a] ^ bit[b[ok]] | half << 31)
            homes.append(np.zeros(int(ok.sum()), bool))
    return np.concatenate(rows), np.concatenate(anchors), np.concatenate(homes)


def forest_of_links(group: np.ndarray, home: np.ndarray, node: np.ndarray, fp: np.ndarray, most: int) -> tuple[list[int], list[int]]:
    """Links (within `most` bits) that join homes and replicas of the sorted groups, thinned to a spanning forest."""
    first = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
    size = np.diff(np.concatenate([first, [len(group)]]))
    start, length = np.repeat(first, size), np.repeat(size, size)
    rows = np.flatnonzero(home & (length > 1))
    names, member = np.unique(node, return_inverse=True)
    root = np.arange(len(names))

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    a_out, b_out = [], []
    ends = np.cumsum(length[rows])
    at = 0
    while at < len(rows):
        stop = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + PAIRS_AT_ONCE, side="right")))
        own, n = rows[at:stop], length[rows[at:stop]]
        left = np.repeat(own, n)
        right = np.arange(n.sum()) + np.repeat(start[own] - np.concatenate([[0], np.cumsum(n)[:-1]]), n)
        near = (np.bitwise_count(fp[left] ^ fp[right]) <= most) & (member[left] != member[right])
        x, y = member[left[near]], member[right[near]]
        while True:  # compress paths of all members
            up = root[root]
            if (up == root).all():
                break
            root[:] = up
        apart = root[x] != root[y]
        x, y = x[apart], y[apart]
        keep = np.unique(np.minimum(root[x], root[y]) * np.int64(len(names)) + np.maximum(root[x], root[y]), return_index=True)[1]
        for i, j in zip(x[keep].tolist(), y[keep].tolist(), strict=True):
            p, q = find(i), find(j)
            if p != q:
                root[max(p, q)] = min(p, q)
                a_out.append(int(names[i]))
                b_out.append(int(names[j]))
        at = stop
    return a_out, b_out


def links(distinct: DataFrame, most: int = 3, hot_rows: int = 50_000) -> DataFrame:
    """(a, b) edges between nodes of distinct fingerprints (node long, fp long) that connect all within `most` bits.

    most is 3 at the most (the halves' guarantee). Rows go to their anchor's partition, which takes them anchor by anchor.
    An anchor with over `hot_rows` rows is split on both sides: its homes and its other rows are dealt over slices, and
    each pair of slices is a group of its own, so no group holds more than about twice `hot_rows`, and no pair is lost.
    Each group gives a spanning forest of its links, never all pairs.
    """
    if most > 3:
        raise ValueError("two halves cover at most 3 differing bits")

    @freed
    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            node, fp = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            row, anchor, home = anchors_of(fp.view(np.uint64))
            yield from to_batches(pa.table([pa.array(anchor), pa.array(home), pa.array(node[row]), pa.array(fp[row])], names=["anchor", "home", "node", "fp"]), 50_000)

    rows = distinct.select("node", "fp").mapInArrow(spread, "anchor long, home boolean, node long, fp long")
    hot = rows.groupBy("anchor").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > hot_rows).select("anchor", F.ceil(F.col("n") / hot_rows).cast("int").alias("slices"))
    sliced = rows.join(hot, "anchor", "left").withColumn("slices", F.coalesce("slices", F.lit(1)))
    own = F.pmod(F.xxhash64("node"), F.col("slices")).cast("int")
    every = F.sequence(F.lit(0), F.col("slices") - 1)

    def cell(home: bool, slice_of: F.Column) -> F.Column:
        return F.struct(F.lit(home).alias("home"), slice_of.alias("slice"))

    # Cell (h, r) of a split anchor has the homes of slice h, and as others all rows of slice r.
    as_home = F.transform(every, lambda r: cell(True, own * F.col("slices") + r))
    as_other = F.transform(every, lambda h: cell(False, h * F.col("slices") + own))
    cells = F.when(~F.col("home"), as_other).when(F.col("slices") > 1, F.concat(as_home, as_other)).otherwise(as_home)
    dealt = sliced.select("anchor", "node", "fp", F.explode(cells).alias("c")).select("anchor", "c.slice", "c.home", "node", "fp")

    def joined(table: pa.Table) -> Iterator[pa.RecordBatch]:
        anchor, part, home, node, fp = (table.column(k).to_numpy() for k in range(5))
        group = np.cumsum(np.concatenate([[0], (anchor[1:] != anchor[:-1]) | (part[1:] != part[:-1])]))
        a, b = forest_of_links(group, home.astype(bool), node, fp.view(np.uint64), most)
        yield from to_batches(pa.table([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"]))

    @freed
    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        size = 0
        for batch in batches:
            held.append(pa.Table.from_batches([batch]))
            size += batch.num_rows
            if size > ROWS_AT_ONCE:
                table = pa.concat_tables(held)
                anchor, part = table.column(0).to_numpy(), table.column(1).to_numpy()
                other = np.flatnonzero((anchor != anchor[-1]) | (part != part[-1]))
                cut = int(other[-1]) + 1 if len(other) else 0  # the last group may go on
                if cut:
                    yield from joined(table.slice(0, cut))
                held, size = [table.slice(cut)], size - cut
        if size:
            yield from joined(pa.concat_tables(held))

    return dealt.repartition("anchor", "slice").sortWithinPartitions("anchor", "slice").mapInArrow(compare, "a long, b long")


def near_duplicates(docs: DataFrame, most: int = 3, words: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp, component_id): fp as a long; component_id is the least id that a row reaches over links.

    Equal fingerprints are one class from the start, so copies are never paired. Rows with a NULL id link like any other
    and get their component (NULL where no row of it has an id). Fingerprints are written once to the shared folder. Ids are whole
    numbers; repeated rows come out as often as they are there, and an empty table gives none. Other columns aren't
    read. Memory is bounded by a batch of text, a document's shingles, and a group of `links`.
    """
    if docs.schema[id_col].dataType.simpleString() not in ("bigint", "int", "smallint", "tinyint"):
        raise ValueError(f"{id_col} must be a whole number: components are named by their least id")
    spark = docs.sparkSession
    path = shared_folder(spark, "fingerprints")
    fingerprints(docs, words, id_col, text_col).write.parquet(path)
    fps = spark.read.schema(f"{id_col} long, fp long").parquet(path)
    # Fingerprints are linked, whatever ids their rows have; a component takes the least id of its rows afterwards.
    classes = fps.groupBy("fp").agg(F.min(id_col).alias("least"))
    found = connected_components(links(classes.select(F.col("fp").alias("node"), "fp"), most))
    placed = classes.join(found.select(F.col("node").alias("fp"), "component"), "fp", "left").select("fp", "least", F.coalesce("component", "fp").alias("component"))
    least = placed.groupBy("component").agg(F.min("least").alias("component_id"))
    named = placed.select("fp", "component").join(least, "component").select("fp", "component_id")
    return fps.join(named, "fp").select(id_col, "fp", "component_id")
