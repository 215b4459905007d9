"""Benchmark decontamination: a BM25 index of test items, queried by every training passage with block-max WAND.

The index holds the test items (the documents of BM25) in blocks; each passage of the corpus is a query. A passage and
an item meet when the item's score is at least `threshold` of the score it has with itself. Posting lists are sparse.
Each block has essential terms; what its items can score with the others together is bounded by the block's spare. A
passage's essential terms are traversed with the blocks' maximal impacts, and a block is a pivot where these and the
spare reach the threshold; all other blocks are skipped unread. Pivots are scored exactly, posting by posting. Meetings
are then verified: the shares of the question's and of the answer's 5-word shingles that the passage has must both reach
`overlap`, or that of the whole item's, as an answer of few shingles is lost by one altered word. Marks around a word
don't count.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framequery.llm.words import freed, rebatched, split_words, to_batches, unique_words

SHINGLE = 5
#: Words of an item of which the last part is taken as the answer where the table has none of its own.
ANSWER_SHARE = 0.25
MARKS_AROUND = r"^[^\p{L}\p{N}\p{M}]+|[^\p{L}\p{N}\p{M}]+$"
#: Items of a block, and the part of the threshold that terms which aren't essential may reach.
BLOCK = 4
SPARE = 0.5
#: Postings that are traversed at once, and sums that are held in a dense array.
POSTINGS_AT_ONCE = 1_000_000
DENSE_SUMS = 4_000_000


def bare(words: pa.Array) -> pa.Array:
    """Words without the marks before and after their letters and digits; words of marks alone stay."""
    inner = pc.replace_substring_regex(words, MARKS_AROUND, "")
    return pc.if_else(pc.equal(pc.binary_length(inner), 0), words, inner)


def item_words(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Lower-case words of items, flat, their offsets, and where each item's answer begins: the last quarter of its
    words, one at least, answers; an item of one word is all question."""
    flat, offsets = split_words(texts, lower=True)
    n = np.diff(offsets)
    cut = np.where(n > 1, n - np.maximum(1, (n * ANSWER_SHARE).astype(np.int64)), n)
    return bare(flat) if len(flat) else flat, offsets, cut


def shingles(words: list) -> set[tuple]:
    """5-word shingles; shorter sequences are one shingle; no words, none."""
    if not words:
        return set()
    n = min(SHINGLE, len(words))
    return {tuple(words[k : k + n]) for k in range(len(words) - n + 1)}


@dataclass(frozen=True)
class ItemIndex:
    """An inverted index in arrays. Items are numbered in the order of their texts, BLOCK to a block.

    words[word_starts[i]:word_starts[i + 1]] are item i's terms in order, its answer from cuts[i] on. The postings of a
    term in a block are (items, impacts)[starts[k]:starts[k + 1]], keys[k] = block x terms + term being sorted; impacts
    are BM25 shares of an item's score with itself. Term t is essential in blocks[essential[t]:essential[t + 1]], with
    those `maxima`; spare[b] bounds what all other terms give an item of block b.
    """

    terms: pa.Array
    ids: pa.Array
    words: np.ndarray
    word_starts: np.ndarray
    cuts: np.ndarray
    keys: np.ndarray
    starts: np.ndarray
    items: np.ndarray
    impacts: np.ndarray
    essential: np.ndarray
    blocks: np.ndarray
    maxima: np.ndarray
    spare: np.ndarray
    longest: int
    threshold: float


@dataclass(frozen=True)
class Statistics:
    """What BM25 takes from all items: their number, mean length, and (terms, df) of at least the terms at hand."""

    n: int
    mean: float
    terms: pa.Array
    df: np.ndarray


def _heads(key: np.ndarray) -> np.ndarray:
    """Where runs of equal values begin."""
    return np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])[: len(key)])


def build_index(ids: pa.Array, texts: pa.Array, threshold: float = 0.5, k1: float = 1.2, b: float = 0.75, statistics: Statistics | None = None) -> ItemIndex:
    """Items without words are left out: nothing can match them. statistics: of all items, where these are but a part."""
    order = pc.sort_indices(pa.table([pc.fill_null(texts, ""), pc.cast(ids, pa.string())], names=["t", "i"]), sort_keys=[("t", "ascending"), ("i", "ascending")])
    ids, texts = ids.take(order), texts.take(order)
    flat, offsets, cuts = item_words(texts)
    full = np.flatnonzero(np.diff(offsets))
    ids, cuts, lengths = ids.take(pa.array(full)), cuts[full], np.diff(offsets)[full]
    starts = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int64)
    terms, word = unique_words(flat)
    n, size = len(full), max(1, len(terms))
    pair, tf = np.unique(np.repeat(np.arange(n), lengths) * size + word, return_counts=True)
    item, term = pair // size, pair % size
    if statistics is None:
        total, mean, df = n, lengths.mean() if n else 1.0, np.bincount(term, minlength=len(terms))
    else:
        total, mean = statistics.n, statistics.mean
        df = statistics.df[pc.index_in(terms, statistics.terms).to_numpy(zero_copy_only=False).astype(np.int64)] if len(terms) else np.zeros(0)
    idf = np.log1p((total - df + 0.5) / (df + 0.5))
    impact = idf[term] * tf * (k1 + 1) / (tf + k1 * (1 - b + b * lengths[item] / mean))
    impact /= np.bincount(item, impact, n)[item]
    # The least telling terms of each item may be spared while they stay under a part of the threshold.
    by = np.lexsort((impact, item))
    running = np.cumsum(impact[by])
    before = np.concatenate([[0.0], running])[np.searchsorted(item, np.arange(n))]
    telling = np.zeros(len(pair), bool)
    telling[by] = running - before[item[by]] >= SPARE * threshold - 1e-9
    block, blocks = item // BLOCK, -(-n // BLOCK)
    by = np.lexsort((item, block * size + term))
    item, term, impact, telling, key = item[by], term[by], impact[by], telling[by], (block * size + term)[by]
    heads = _heads(key)
    run = np.repeat(np.arange(len(heads)), np.diff(np.concatenate([heads, [len(key)]])))
    needed = np.bincount(run, telling, len(heads)) > 0
    most = np.maximum.reduceat(impact, heads) if len(heads) else np.zeros(0)
    rest = np.bincount(item, np.where(needed[run], 0.0, impact), n)
    spare = np.zeros(blocks)
    np.maximum.at(spare, np.arange(n) // BLOCK, rest)
    keys = key[heads]
    chosen = np.flatnonzero(needed)
    chosen = chosen[np.argsort(keys[chosen] % size, kind="stable")]
    return ItemIndex(
        terms, ids, word.astype(np.int32), starts, cuts, keys, np.concatenate([heads, [len(key)]]), item.astype(np.int32), impact,
        np.searchsorted(keys[chosen] % size, np.arange(len(terms) + 1)), keys[chosen] // size, most[chosen] * (1 + 1e-9), spare, int(lengths.max()) if n else 0, threshold,
    )


def _spread(starts: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places starts[i], starts[i] + 1 ... (counts[i] of them) of all i, and i for each."""
    owner = np.repeat(np.arange(len(counts)), counts)
    return np.arange(len(owner)) + np.repeat(starts - np.concatenate([[0], np.cumsum(counts)[:-1]]), counts), owner


def query_passages(index: ItemIndex, term_of: np.ndarray, passage_of: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All (passage, item, score) at or above the threshold. (term_of, passage_of): distinct, sorted by passage."""
    least, blocks, size = index.threshold - 1e-9, len(index.spare), max(1, len(index.terms))
    at, owner = _spread(index.essential[term_of], index.essential[term_of + 1] - index.essential[term_of])
    key, bound = passage_of[owner] * np.int64(blocks) + index.blocks[at], index.maxima[at]
    if n * blocks <= DENSE_SUMS:
        sums = np.bincount(key, bound, n * blocks)
        pivots = np.flatnonzero((sums > 0) & (sums.reshape(n, blocks) + index.spare >= least).ravel())
    else:
        key, back = np.unique(key, return_inverse=True)
        pivots = key[np.bincount(back, bound, len(key)) + index.spare[key % blocks] >= least]
    # Pivots are scored exactly by the passage's postings in their blocks.
    first = np.searchsorted(passage_of, np.arange(n + 1))
    found: list[tuple[np.ndarray, ...]] = []
    terms_in = np.diff(first)
    a, ends = 0, np.cumsum(terms_in[pivots // blocks])
    while a < len(pivots):
        b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + POSTINGS_AT_ONCE, side="right")))
        passage, block = pivots[a:b] // blocks, pivots[a:b] % blocks
        at, owner = _spread(first[passage], terms_in[passage])
        wanted = block[owner] * np.int64(size) + term_of[at]
        place = np.minimum(np.searchsorted(index.keys, wanted), len(index.keys) - 1)
        hit = index.keys[place] == wanted
        place, owner = place[hit], owner[hit]
        at, one = _spread(index.starts[place], index.starts[place + 1] - index.starts[place])
        slot = owner[one] * BLOCK + index.items[at] % BLOCK
        score = np.bincount(slot, index.impacts[at], (b - a) * BLOCK)
        good = np.flatnonzero(score >= least)
        found.append((passage[good // BLOCK], block[good // BLOCK] * BLOCK + good % BLOCK, score[good]))
        a = b
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def verify(index: ItemIndex, item: int, words: list[int]) -> tuple[float, float, float]:
    """Shares of the question's, the answer's and the whole item's shingles among the passage's terms (-1: a word that
    no item has); 1 for a part without words."""

    def share(part: list[int]) -> float:
        wanted = shingles(part)
        if not wanted:
            return 1.0
        n = len(next(iter(wanted)))
        have = {tuple(words[k : k + n]) for k in range(len(words) - n + 1)}
        return len(wanted & have) / len(wanted)

    whole, cut = index.words[index.word_starts[item] : index.word_starts[item + 1]].tolist(), int(index.cuts[item])
    return share(whole[:cut]), share(whole[cut:]), share(whole)


def item_statistics(items: DataFrame, item_text: str, terms: DataFrame) -> Statistics:
    """BM25's statistics of all items, with document frequencies of `terms` (term) only."""

    @freed
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in rebatched(batches, 4 << 20):
            flat, offsets, _ = item_words(table.column(0))
            words, index = unique_words(flat)
            row = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
            df = np.bincount(np.unique(row * max(1, len(words)) + index) % max(1, len(words)), minlength=len(words))
            full = int((np.diff(offsets) > 0).sum())
            # The row without a term counts the items and their words.
            names = pa.concat_arrays([words.cast(pa.string()), pa.array([None], pa.string())])
            yield from to_batches(pa.table([names, pa.array([*df.tolist(), full]), pa.array([0] * len(df) + [len(flat)])], names=["term", "df", "n"]), 100_000)

    counts = items.select(item_text).mapInArrow(run, "term string, df long, n long").groupBy("term").agg(F.sum("df").alias("df"), F.sum("n").alias("n"))
    whole = counts.where(F.col("term").isNull()).first()
    known = counts.join(terms, "term").select("term", "df").toArrow()
    n = whole.df if whole else 0
    return Statistics(n, whole.n / n if n else 1.0, known["term"].combine_chunks().cast(pa.large_string()), known["df"].to_numpy())


def contaminated(
    docs: DataFrame, items: DataFrame, threshold: float = 0.5, overlap: float = 0.8, id_col: str = "doc_id", text_col: str = "text",
    item_id: str = "item_id", item_text: str = "text", shard_bytes: int = 32 << 20,
) -> DataFrame:
    """(doc_id, item_id, score, question_overlap, answer_overlap): one row for each row of docs and of items that meet.

    Passages are windows of twice the longest item's words, moved by its length, so every occurrence is whole in one.
    score and overlaps are those of the passage with the highest overlaps, then score. NULL and empty texts and items
    meet none; NULL ids come out as NULL; repeated documents and items give repeated rows. Other columns aren't read.

    An index goes to the executors with the task, so the text of its items is held to `shard_bytes` (some 200,000 items).
    A larger test set is split into that many indexes with the statistics of all items, so that scores don't depend on
    the split, and the corpus is read once for each.
    """
    size = items.agg(F.coalesce(F.sum(F.octet_length(item_text)), F.lit(0))).first()[0]
    shards = max(1, -(-size // shard_bytes))
    numbered = items.select(F.col(item_id).alias("item"), F.col(item_text).alias("text"), F.pmod(F.xxhash64(item_id, item_text), F.lit(shards)).alias("shard"))
    longest = _longest(items, item_text) if shards > 1 else None
    out = None
    for k in range(shards):
        some = numbered.where(F.col("shard") == k)
        rows = some.select("item", "text").toArrow()
        ids, texts = rows["item"].combine_chunks(), rows["text"].combine_chunks()
        statistics = None
        if shards > 1:
            terms = unique_words(item_words(texts)[0])[0].cast(pa.string())
            statistics = item_statistics(items, item_text, docs.sparkSession.createDataFrame(pa.table([terms], names=["term"])))
        part = _search(docs.select(id_col, text_col), build_index(ids, texts, threshold, statistics=statistics), overlap, f"`{item_id}` {items.schema[item_id].dataType.simpleString()}", item_id, longest)
        out = part if out is None else out.unionByName(part)
    return out


def _longest(items: DataFrame, item_text: str) -> int:
    """Words of the longest item: passages are the same whatever shard is searched."""
    words = F.size(F.filter(F.split(F.coalesce(item_text, F.lit("")), r"[\x20\x09-\x0D]+"), lambda w: w != ""))
    return items.agg(F.max(words)).first()[0] or 0


def _search(docs: DataFrame, index: ItemIndex, overlap: float, item_field: str, item_id: str, longest: int | None) -> DataFrame:
    id_col = docs.columns[0]
    schema = f"`{id_col}` {docs.schema[0].dataType.simpleString()}, {item_field}, score double, question_overlap double, answer_overlap double"
    stride = max(1, index.longest if longest is None else longest)
    size = len(index.terms)

    def met(passage_of: np.ndarray, term_of: np.ndarray) -> Iterator[tuple[int, int, float]]:
        """Meetings of sorted (passage, term) rows, whole passages of about POSTINGS_AT_ONCE postings at a time."""
        ends = np.cumsum(index.essential[term_of + 1] - index.essential[term_of] + 1)
        a = 0
        while a < len(passage_of):
            b = int(np.searchsorted(ends, (ends[a - 1] if a else 0) + POSTINGS_AT_ONCE, side="right"))
            if b < len(passage_of):
                b = max(int(np.searchsorted(passage_of, passage_of[b], side="left")), int(np.searchsorted(passage_of, passage_of[a], side="right")))
            base = passage_of[a]
            passage, item, score = query_passages(index, term_of[a:b], passage_of[a:b] - base, int(passage_of[b - 1] - base) + 1)
            yield from zip((passage + base).tolist(), item.tolist(), score.tolist(), strict=True)
            a = b

    @freed
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in rebatched(batches, 4 << 20):
            found: dict[tuple[int, int], tuple[float, float, float]] = {}
            if size:
                flat, offsets = split_words(table.column(1), lower=True)
                distinct, which = unique_words(flat)
                known = pc.index_in(bare(distinct), index.terms).fill_null(-1).to_numpy().astype(np.int64) if len(distinct) else np.zeros(0, np.int64)
                term = known[which]
                at = np.flatnonzero(term >= 0)
                doc = np.searchsorted(offsets, at, side="right") - 1
                inner = (at - offsets[doc]) // stride
                steps = np.maximum(1, -(-np.diff(offsets) // stride))
                first = np.concatenate([[0], np.cumsum(steps)])
                # Each word stands in the window that begins in its stride and in the one before.
                window = np.concatenate([first[doc] + inner, (first[doc] + inner - 1)[inner > 0]])
                key = np.unique(window * np.int64(size) + np.concatenate([term[at], term[at][inner > 0]]))
                for p, i, s in met(key // size, key % size):
                    d = int(np.searchsorted(first, p, side="right") - 1)
                    a = int(offsets[d] + (p - first[d]) * stride)
                    q, r, whole = verify(index, i, term[a : min(a + 2 * stride, int(offsets[d + 1]))].tolist())
                    if q >= overlap and r >= overlap or whole >= overlap:
                        found[d, i] = max(found.get((d, i), (0.0, 0.0, 0.0)), (q, r, s))
            rows = pa.array([d for d, _ in found], pa.int64())
            best = [[v[k] for v in found.values()] for k in (2, 0, 1)]
            ids, items = table.column(0).combine_chunks().take(rows), index.ids.take(pa.array([i for _, i in found], pa.int64()))
            yield from to_batches(pa.table([ids, items, *(pa.array(x, pa.float64()) for x in best)], names=[id_col, item_id, "score", "question_overlap", "answer_overlap"]))

    return docs.mapInArrow(run, schema)
