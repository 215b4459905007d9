"""Spelling variants: words that differ by one code point, each led to the form that is ten times as frequent."""

from __future__ import annotations

import functools
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framequery.llm.steps import Steps
from framequery.llm.words import mix, rebatched, unique_words

#: Texts are read by about so many bytes at a time, cut between runs.
PIECE = 4 << 20
#: Candidates that are hashed at a time.
AT_ONCE = 1 << 20
#: Filter bits: per word of the vocabulary, in a segment, and in all at most (128 MB).
WORD_BITS, SEGMENT_BITS, MOST_BITS = 16, 1 << 16, 1 << 30
PROBES = 4
BASE = np.uint64(0x9E3779B97F4A7C15)

_B = np.arange(256, dtype=np.uint8)
#: Bytes of A-Z and a-z, and their lower case; byte 0xC3 starts U+00C0 to U+00FF and nothing else.
LETTER = ((_B | 32) >= 97) & ((_B | 32) <= 122)
LOWER = np.where((_B >= 65) & (_B <= 90), _B + 32, _B).astype(np.uint8)
#: Lengths in bytes up to which checksums are combined by table.
TABLED = 64


@functools.cache
def zero_tables() -> np.ndarray:
    """[length, byte of the checksum, its value] -> the checksum after so many zero bytes, to be xor-ed over the four."""
    crc = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        crc = np.where(crc & 1, (crc >> 1) ^ np.uint32(0xEDB88320), crc >> 1)
    tables = np.empty((TABLED + 1, 4, 256), np.uint32)
    tables[0] = [np.arange(256, dtype=np.uint32) << np.uint32(8 * k) for k in range(4)]
    for n in range(1, TABLED + 1):
        v = tables[n - 1]
        tables[n] = (v >> np.uint32(8)) ^ crc[v & np.uint32(255)]
    return tables


def pieces(raw: np.ndarray, size: int = PIECE) -> Iterator[np.ndarray]:
    """raw cut into parts of about `size` bytes, never within a run."""
    at = 0
    while at < len(raw):
        end = min(at + size, len(raw))
        while end < len(raw):
            window = raw[end - 1 : end + size]
            inner = LETTER[window] | (window == 0xC3)
            inner[1:] |= window[:-1] == 0xC3
            gap = np.flatnonzero(~inner[1:])
            end = end + int(gap[0]) if len(gap) else min(end + size, len(raw))
            if len(gap):
                break
        yield raw[at:end]
        at = end


def run_counts(prefixes: list[bytes], raw: np.ndarray, offsets: np.ndarray, noise: int, min_length: int) -> Counter:
    """Words of texts laid end to end (offsets: n + 1) and how often each occurs."""
    high = raw == 0xC3
    inside = LETTER[raw] | high
    inside[1:] |= high[:-1]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    borders = offsets[1:-1]
    borders = borders[borders < len(raw)]
    first[borders] = inside[borders]
    starts = np.flatnonzero(first)
    if not len(starts):
        return Counter()
    compact = LOWER[raw[inside]]
    at = np.concatenate([[0], np.cumsum(inside)])[np.append(starts, len(raw))].astype(np.int64)
    runs = pa.Array.from_buffers(pa.large_string(), len(starts), [None, pa.py_buffer(at), pa.py_buffer(compact)])
    distinct, code = unique_words(runs)
    words = distinct.to_pylist()
    # The checksum of a prefix and a run together, from the checksums of both.
    sizes = np.diff(at)
    heads = np.array([zlib.crc32(p) for p in prefixes], np.uint32)
    tails = np.array([zlib.crc32(w.encode()) for w in words], np.uint32)
    doc = np.searchsorted(offsets, starts, side="right") - 1
    head, table, short = heads[doc], zero_tables(), np.minimum(sizes, TABLED)
    h = tails[code]
    for k in range(4):
        h = h ^ table[short, k, (head >> np.uint32(8 * k)) & np.uint32(255)]
    for k in np.flatnonzero(sizes > TABLED):
        h[k] = zlib.crc32(words[code[k]].encode(), int(head[k]))
    h = h.astype(np.int64)
    hit = h % noise == 0
    length = pc.utf8_length(distinct).to_numpy()
    counts = np.bincount(code[~hit], minlength=len(words))
    found = Counter({words[k]: int(counts[k]) for k in np.flatnonzero((counts > 0) & (length >= min_length))})
    hit &= length[code] > min_length  # a shorter one is no word after the deletion
    gone = h[hit] % length[code[hit]]
    pairs, times = np.unique(np.stack([code[hit], gone]), axis=1, return_counts=True)
    for (k, p), n in zip(pairs.T.tolist(), times.tolist(), strict=True):
        found[words[k][:p] + words[k][p + 1 :]] += n
    return found


def word_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", noise: int = 31, min_length: int = 7, min_count: int = 2) -> DataFrame:
    """(word, n) over whole texts: runs of A-Z, a-z and U+00C0 to U+00FF, of which A-Z are lower-cased. Where `noise`
    divides the crc32 of `<id>:<run>`, the run loses its code point crc32 % length first. Only words of min_length code
    points and min_count occurrences.

    Counts are summed per batch of text, then before and after one shuffle, so frequent words aren't hot. NULL texts
    have no words, a NULL id counts as the empty string; repeated rows count again.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in rebatched(batches, PIECE):
            ids = [f"{k or ''}:".encode() for k in table.column(0).to_pylist()]
            texts = pc.fill_null(table.column(1).combine_chunks().cast(pa.large_binary()), b"")
            offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
            raw = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
            if len(ids) > 1:
                parts = [(ids, raw, offsets - offsets[0])]
            else:
                parts = ((ids, p, np.array([0, len(p)])) for p in pieces(raw))
            for keys, part, bounds in parts:
                found = run_counts(keys, part, bounds, noise, min_length)
                yield pa.RecordBatch.from_arrays([pa.array(list(found.keys()), pa.string()), pa.array(list(found.values()), pa.int64())], names=["word", "n"])

    rows = docs.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= min_count)


def matrices(words: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Words by length: their indices, and their code points as rows."""
    lengths = np.array([len(w) for w in words])
    for n in np.unique(lengths).tolist():
        rows = np.flatnonzero(lengths == n)
        points = np.frombuffer("".join(words[k] for k in rows).encode("utf-32-le"), np.uint32).reshape(len(rows), n)
        yield rows, points.astype(np.uint64)


def prefix_hashes(points: np.ndarray) -> np.ndarray:
    """[word, i] -> polynomial hash of its first i code points, for all i."""
    out = np.zeros((len(points), points.shape[1] + 1), np.uint64)
    for i in range(points.shape[1]):
        out[:, i + 1] = out[:, i] * BASE + points[:, i]
    return out


def suffix_hashes(points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """[word, i] -> what the code points from i on add to a hash, and [i] -> the power by which what lies before counts."""
    m, n = points.shape
    out, powers = np.zeros((m, n + 1), np.uint64), np.ones(n + 1, np.uint64)
    for i in range(n - 1, -1, -1):
        out[:, i] = out[:, i + 1] + points[:, i] * powers[i + 1]
        powers[i : i + 1] = powers[i + 1 : i + 2] * BASE
    return out, powers


def segment_of(h: np.ndarray, segments: int) -> np.ndarray:
    """The segment (of a power of two of them) that holds a mixed hash's bits."""
    return (h >> np.uint64(64 - 14)) & np.uint64(segments - 1)


def probe(h: np.ndarray, k: int) -> np.ndarray:
    """Bit k of a mixed hash in its segment."""
    step = (h >> np.uint64(16)) & np.uint64(SEGMENT_BITS - 1) | np.uint64(1)
    return (h + np.uint64(k) * step) & np.uint64(SEGMENT_BITS - 1)


def vocabulary_filter(words: DataFrame, n_words: int) -> np.ndarray:
    """A Bloom filter of all words, its segments set in Spark. Its size is bounded by MOST_BITS: beyond 64 million words
    it lets more candidates through to the join, which decides."""
    segments = 1
    while segments * SEGMENT_BITS < min(n_words * WORD_BITS, MOST_BITS):
        segments *= 2

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, points in matrices(batch.column(0).to_pylist()):
                h = mix(prefix_hashes(points)[:, -1])
                yield pa.RecordBatch.from_arrays([pa.array(segment_of(h, segments).astype(np.int32)), pa.array(h.view(np.int64))], names=["segment", "h"])

    def one_segment(table: pa.Table) -> pa.Table:
        bits = np.zeros(SEGMENT_BITS, np.uint8)
        h = table.column("h").to_numpy().view(np.uint64)
        for k in range(PROBES):
            bits[probe(h, k)] = 1
        return pa.table({"segment": table.column("segment")[:1], "bits": pa.array([np.packbits(bits, bitorder="little").tobytes()], pa.binary())})

    parts = words.select("word").mapInArrow(hashed, "segment int, h long").groupBy("segment").applyInArrow(one_segment, "segment int, bits binary")
    out = np.zeros((segments, SEGMENT_BITS // 8), np.uint8)
    for row in parts.toLocalIterator():
        out[row.segment] = np.frombuffer(row.bits, np.uint8)
    return out


def passing(h: np.ndarray, kept: np.ndarray, bits: np.ndarray) -> np.ndarray:
    """Indices of the hashes that `kept` marks and the filter may hold."""
    at = np.flatnonzero(kept)
    h, flat = mix(h.reshape(-1)[at]), bits.reshape(-1)
    for k in range(PROBES):
        place = segment_of(h, len(bits)) * np.uint64(SEGMENT_BITS) + probe(h, k)
        alive = (flat[place >> np.uint64(3)] >> (place & np.uint64(7)).astype(np.uint8)) & 1 == 1
        at, h = at[alive], h[alive]
    return at


def neighbourhood(words: list[str], alphabet: np.ndarray, bits: np.ndarray) -> Iterator[tuple[int, str]]:
    """(index of a word, candidate): all distinct deletions, replacements and insertions over the alphabet that the
    filter may hold. Each is made once: of a run of one code point the first is deleted, an insertion comes after the
    run of its code point, and no replacement leaves the word as it is. Hashes of all come first, from those of what
    lies before and after the change; only those that pass are spelt out."""
    letters = [chr(c) for c in alphabet.tolist()]
    a = len(letters)
    for all_rows, all_points in matrices(words):
        n = all_points.shape[1]
        step = max(1, AT_ONCE // ((n + 1) * a))
        for k in range(0, len(all_rows), step):
            rows, points = all_rows[k : k + step], all_points[k : k + step]
            before = prefix_hashes(points)
            after, powers = suffix_hashes(points)
            kept = np.ones(points.shape, bool)
            kept[:, 1:] = points[:, 1:] != points[:, :-1]
            for at in passing(before[:, :-1] * powers[1:] + after[:, 1:], kept, bits).tolist():
                w, i = divmod(at, n)
                word = words[rows[w]]
                yield rows[w], word[:i] + word[i + 1 :]
            grown = before[:, :, None] * BASE + alphabet
            kept = points[:, :, None] != alphabet
            for at in passing(grown[:, :-1] * powers[1:, None] + after[:, 1:, None], kept, bits).tolist():
                w, rest = divmod(at, n * a)
                i, x = divmod(rest, a)
                word = words[rows[w]]
                yield rows[w], word[:i] + letters[x] + word[i + 1 :]
            kept = np.concatenate([kept, np.ones((len(rows), 1, a), bool)], axis=1)
            for at in passing(grown * powers[:, None] + after[:, :, None], kept, bits).tolist():
                w, rest = divmod(at, (n + 1) * a)
                i, x = divmod(rest, a)
                word = words[rows[w]]
                yield rows[w], word[:i] + letters[x] + word[i:]


def near_words(words: DataFrame) -> DataFrame:
    """words (word, n; each word once) -> (word, n, near, near_n): itself, and every word that differs by exactly one
    inserted, deleted or replaced code point.

    Each word's whole neighbourhood over the code points in use is hash-joined to the words on the candidate's text, so
    no distance is verified. A filter of the words lets go of candidates that can't be any before they are shuffled. The
    alphabet is collected: letters of the runs are at most 90 code points.
    An empty table gives no rows.
    """
    spark = words.sparkSession
    n_words = words.count()
    letters = words.select(F.explode(F.split("word", "")).alias("c")).where(F.col("c") != "").distinct()
    alphabet = np.sort(np.array([ord(r.c) for r in letters.collect()], np.uint64))
    bits = spark.sparkContext.broadcast(vocabulary_filter(words, n_words))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, counts = batch.column(0).to_pylist(), batch.column(1).to_numpy()
            found = list(neighbourhood(names, alphabet, bits.value))
            index = np.array([k for k, _ in found], np.int64)
            near = [*names, *(c for _, c in found)]
            index = np.concatenate([np.arange(len(names)), index])
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(index)), pa.array(counts[index]), pa.array(near, pa.string())], names=["word", "n", "near"])

    candidates = words.select("word", "n").mapInArrow(run, "word string, n long, near string")
    return candidates.join(words.select(F.col("word").alias("near"), F.col("n").alias("near_n")), "near").select("word", "n", "near", "near_n")


def spelling_variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", noise: int = 31, min_length: int = 7, min_count: int = 2, ratio: int = 10) -> DataFrame:
    """word, form, root, n, n_near, form_n of every word (see word_counts).

    n_near counts the words at one change. form is the near word of largest n (ties: the smallest in code-point order)
    if that n is at least ratio times the word's, form_n its n; else both are NULL. root follows forms to the last, or
    is the word. As n grows ratio-fold (ratio >= 2) with each form, chains are short and pointers settle after a few
    doublings. No texts, or none with words, give no rows; other columns aren't read.
    """
    steps = Steps(docs.sparkSession)
    words = steps.write(word_counts(docs, id_col, text_col, noise, min_length, min_count), "variant-words")
    other = F.when(F.col("near") != F.col("word"), F.struct((-F.col("near_n")).alias("less"), "near"))
    best = near_words(words).groupBy("word", "n").agg(F.count(other).alias("n_near"), F.min(other).alias("best"))
    enough = -F.col("best.less") >= ratio * F.col("n")
    formed = best.select("word", "n", "n_near", F.when(enough, F.col("best.near")).alias("form"), F.when(enough, -F.col("best.less")).alias("form_n"))
    formed = steps.write(formed, "variant-forms")
    steps.drop("variant-words")
    return formed.join(roots(steps, formed), "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def roots(steps: Steps, formed: DataFrame) -> DataFrame:
    """(word, root) of the words with a form: each round, a word's root becomes its root's root."""
    now = steps.write(formed.where(F.col("form").isNotNull()).select("word", F.col("form").alias("root"), F.lit(True).alias("moved")), "variant-roots-0")
    k = 0
    while now.where("moved").limit(1).count():
        next_root = F.col("b.root")
        moved = now.alias("a").join(now.select("word", "root").alias("b"), F.col("a.root") == F.col("b.word"), "left")
        now = steps.write(moved.select("a.word", F.coalesce(next_root, F.col("a.root")).alias("root"), next_root.isNotNull().alias("moved")), f"variant-roots-{k + 1}")
        steps.drop(f"variant-roots-{k}")
        k += 1
    return now.select("word", "root")

