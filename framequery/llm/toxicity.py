"""Toxicity by classifier chains.

Categories are predicted in a fixed sequence by linear (logistic) models over words and word beginnings; each later
model also sees the earlier categories' probabilities. Those are out-of-fold predictions in training, so that later
models learn how far earlier ones can be trusted.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framequery.llm.words import freed, hash_strings, mix, rebatched, split_words, to_batches, unique_words

#: Beginnings of words, in letters, that count as features beside the whole words.
PREFIXES = (3, 4, 5, 6)
BUCKETS = 1 << 20


@dataclass(frozen=True)
class ChainModel:
    """buckets: the sorted features; for each category: weights over them, a bias, and weights of earlier categories."""

    categories: tuple[str, ...]
    buckets: np.ndarray
    weights: np.ndarray
    bias: np.ndarray
    chained: np.ndarray


def word_features(words: pa.Array) -> np.ndarray:
    """Feature buckets of each distinct word: one row a word, -1 where a beginning is the whole word."""
    bare = pc.utf8_trim(pc.utf8_lower(words.cast(pa.large_string())), ".,;:!?\"'()[]{}|*#%$&<>")
    length = pc.utf8_length(bare).to_numpy()
    columns = [hash_strings(bare)]
    for k in PREFIXES:
        h = hash_strings(pc.utf8_slice_codeunits(bare, 0, k)) * np.uint64(2 * k + 1)
        columns.append(h)
    # What is left of a word without letters and digits, and whether it is all capitals: marks of junk.
    marks = pc.replace_substring_regex(words.cast(pa.large_string()), r"[\p{L}\p{N}]+", "")
    capitals = pc.and_(pc.utf8_is_upper(words), pc.greater(pc.utf8_length(words), 2)).to_numpy(zero_copy_only=False)
    columns += [hash_strings(marks) * np.uint64(3), np.full(len(words), 12345, np.uint64)]
    out = np.stack([(h % np.uint64(BUCKETS)).astype(np.int64) for h in columns], axis=1)
    for j, k in enumerate(PREFIXES, 1):
        out[length <= k, j] = -1
    out[length == 0, : 1 + len(PREFIXES)] = -1
    out[pc.equal(pc.binary_length(marks), 0).to_numpy(zero_copy_only=False), -2] = -1
    out[~capitals, -1] = -1
    return out


def doc_features(texts: pa.Array, buckets: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (row, feature) pairs of texts, sorted; only those in `buckets` (then as places in it) where given."""
    flat, offsets = split_words(texts)
    distinct, index = unique_words(flat)
    features = word_features(distinct) if len(distinct) else np.zeros((0, 3 + len(PREFIXES)), np.int64)
    if buckets is not None:
        at = np.searchsorted(buckets, features)
        at = np.minimum(at, max(0, len(buckets) - 1))
        features = np.where((buckets[at] == features) & (features >= 0), at, -1) if len(buckets) else np.full_like(features, -1)
    useful = (features >= 0).any(axis=1)
    rows = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    hit = useful[index]
    pairs = np.unique(rows[hit] * np.int64(max(1, len(distinct))) + index[hit])
    row, word = pairs // max(1, len(distinct)), pairs % max(1, len(distinct))
    key = (row[:, None] * np.int64(BUCKETS) + features[word])[features[word] >= 0]
    key = np.unique(key)
    return key // BUCKETS, key % BUCKETS


def _fit(rows: np.ndarray, columns: np.ndarray, n: int, width: int, dense: np.ndarray, y: np.ndarray, use: np.ndarray, l2: float, rounds: int) -> tuple[np.ndarray, float, np.ndarray]:
    """Logistic regression by Adam over all rows in `use`: weights, bias, weights of the dense columns."""
    keep = use[rows]
    rows, columns = rows[keep], columns[keep]
    m = max(1, int(use.sum()))
    rate = y[use].mean() if use.any() else 0.0
    theta = np.zeros(width + dense.shape[1] + 1)
    theta[-1] = np.log((rate * m + 0.5) / ((1 - rate) * m + 0.5))
    mean, square, target = np.zeros_like(theta), np.zeros_like(theta), y.astype(np.float64)
    for t in range(1, rounds + 1):
        z = np.bincount(rows, theta[columns], n) + dense @ theta[width:-1] + theta[-1]
        error = np.where(use, 1 / (1 + np.exp(-np.clip(z, -30, 30))) - target, 0.0)
        grad = np.concatenate([np.bincount(columns, error[rows], width), dense.T @ error, [error.sum()]]) / m
        grad[:-1] += l2 * theta[:-1]
        mean, square = 0.9 * mean + 0.1 * grad, 0.99 * square + 0.01 * grad * grad
        rate_t = 0.1 * (1 - t / (rounds + 1)) + 1e-3
        theta = theta - rate_t * (mean / (1 - 0.9**t)) / (np.sqrt(square / (1 - 0.99**t)) + 1e-8)
    return theta[:width], float(theta[-1]), theta[width:-1]


def select_features(rows: np.ndarray, features: np.ndarray, labels: np.ndarray, most: int, min_docs: int = 3, least: float = 4.0) -> np.ndarray:
    """The features whose documents differ most in their labels from all others (chi-square root, over `least`), sorted.

    Of a hundred thousand features that say nothing some thousands lie beyond 2 by chance, and a fit on them is worse on
    texts it hasn't seen; beyond 4 there are a handful.
    """
    n = len(labels)
    df = np.bincount(features, minlength=BUCKETS)
    chosen = np.zeros(BUCKETS)
    for c in range(labels.shape[1]):
        hits = np.bincount(features, labels[rows, c].astype(np.float64), BUCKETS)
        rate = labels[:, c].mean()
        spread = np.sqrt(np.maximum(df * rate * (1 - rate) * (1 - df / max(1, n)), 1e-9))
        chosen = np.maximum(chosen, np.where(df >= min_docs, np.abs(hits - df * rate) / spread, 0.0))
    best = np.argsort(-chosen, kind="stable")[:most]
    return np.sort(best[chosen[best] > least])


def train_chain(
    docs: DataFrame, labels: DataFrame, categories: dict[str, F.Column], max_labelled: int = 6000, max_features: int = 3000,
    folds: int = 4, rounds: int = 150, l2: float = 1e-4, id_col: str = "doc_id", text_col: str = "text",
) -> ChainModel:
    """Fit the chain on at most `max_labelled` rows of labelled documents, those with the least hashes of id and text.

    categories: name -> expression over `labels` that is true, false or NULL (row left out), in the chain's order.
    Documents with clashing labels count as true; rows without an id have no label. The bound on rows is a parameter, so
    what reaches the driver is bounded; with no labelled document every probability is 0. Folds go by a hash of the
    text, so copies of a text never part: no out-of-fold prediction has seen its own text.
    """
    names = tuple(categories)
    marked = labels.select(F.col(id_col), *(c.cast("boolean").alias(f"_c{k}") for k, c in enumerate(categories.values()))).dropna()
    grouped = marked.groupBy(id_col).agg(*(F.max(f"_c{k}").alias(f"_c{k}") for k in range(len(names))))
    # Bounded by the parameter, so it may be broadcast.
    sample = F.broadcast(grouped.orderBy(F.xxhash64(id_col), id_col).limit(max_labelled))
    labelled = docs.select(id_col, text_col).join(sample, id_col)
    known = labelled.select(
        text_col, F.xxhash64(id_col).alias("_key"), F.xxhash64(F.coalesce(text_col, F.lit(""))).alias("_hash"), *(f"_c{k}" for k in range(len(names)))
    )

    @freed
    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in rebatched(batches, 4 << 20):
            row, feature = doc_features(table.column(0).combine_chunks(), None)
            ends = np.searchsorted(row, np.arange(table.num_rows + 1))
            lists = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(feature.astype(np.int32)))
            yield from to_batches(pa.table([lists, *table.columns[1:]], names=["features", "key", "hash", *(f"c{k}" for k in range(len(names)))]))

    rows = known.mapInArrow(features, ", ".join(["features array<int>, key long, hash long", *(f"c{k} boolean" for k in range(len(names)))]))
    # An id may have many rows: repeated ones count once, and the bound holds again for rows.
    found = rows.dropDuplicates(["key", "hash"]).orderBy("key", "hash").limit(max_labelled).toArrow()
    # Rows come in no fixed order; sorting them makes the fit the same in every run.
    lists = found.column("features").combine_chunks() if found.num_rows else pa.array([], pa.list_(pa.int32()))
    y = np.stack([found.column(f"c{k}").to_numpy().astype(bool) for k in range(len(names))], axis=1) if found.num_rows else np.zeros((0, len(names)), bool)
    if not found.num_rows:
        zero = np.zeros((len(names), 0))
        return ChainModel(names, np.zeros(0, np.int64), zero, np.full(len(names), -30.0), np.zeros((len(names), len(names))))
    columns, offsets = lists.flatten().to_numpy().astype(np.int64), lists.offsets.to_numpy().astype(np.int64)
    counts, text = np.diff(offsets), found.column("hash").to_numpy()
    order = np.lexsort((*y.T, text))
    back = np.empty(len(order), np.int64)
    back[order] = np.arange(len(order))
    rows = back[np.repeat(np.arange(len(counts)), counts)]
    y, text = y[order], text[order]
    buckets = select_features(rows, columns, y, max_features)
    at = np.minimum(np.searchsorted(buckets, columns), max(0, len(buckets) - 1))
    hit = buckets[at] == columns if len(buckets) else np.zeros(len(columns), bool)
    rows, columns, n, width = rows[hit], at[hit], len(y), len(buckets)
    fold = (mix(text.view(np.uint64)) % np.uint64(folds)).astype(np.int64)
    everyone = np.ones(n, bool)
    earlier = np.zeros((n, 0))
    weights, bias, chained = [], [], np.zeros((len(names), len(names)))
    for c in range(len(names)):
        w, b, v = _fit(rows, columns, n, width, earlier, y[:, c], everyone, l2, rounds)
        weights.append(w)
        bias.append(b)
        chained[c, :c] = v
        if c + 1 < len(names):
            out = np.zeros(n)
            for k in range(folds):
                w, b, v = _fit(rows, columns, n, width, earlier, y[:, c], fold != k, l2, rounds)
                z = np.bincount(rows, w[columns], n) + earlier @ v + b
                out = np.where(fold == k, 1 / (1 + np.exp(-np.clip(z, -30, 30))), out)
            earlier = np.concatenate([earlier, out[:, None]], axis=1)
    return ChainModel(names, buckets, np.stack(weights), np.array(bias), chained)


def score_chain(docs: DataFrame, model: ChainModel, text_col: str = "text") -> DataFrame:
    """docs plus p_<category> (double) for each category; whole texts, in one pass, with no shuffle.

    NULL and empty texts have no features: they get the biases' probabilities, chained like any other. Columns of docs
    with the name of a probability are replaced.
    """
    names = [f"p_{c}" for c in model.categories]
    docs = docs.drop(*names)
    columns = docs.columns
    place = columns.index(text_col)

    @freed
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in rebatched(batches, 2 << 20):
            n = table.num_rows
            row, feature = doc_features(table.column(place).combine_chunks(), model.buckets)
            found = np.zeros((n, len(names)))
            for c in range(len(names)):
                z = np.bincount(row, model.weights[c][feature], n) + found[:, :c] @ model.chained[c, :c] + model.bias[c]
                found[:, c] = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
            yield from to_batches(pa.table([*table.columns, *(pa.array(found[:, c]) for c in range(len(names)))], names=[*columns, *names]))

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema), *(f"`{c}` double" for c in names)])
    return docs.mapInArrow(run, schema)


#: The chain over the labels table: junk first, since no junk is labelled toxic, then toxicity.
def label_categories() -> dict[str, F.Column]:
    return {"low_quality": F.col("quality") == 0, "toxic": F.col("toxic") == 1}


def toxic_verdicts(docs: DataFrame, labels: DataFrame, threshold: float = 0.35) -> DataFrame:
    """docs plus p_low_quality, p_toxic and toxic (p_toxic >= threshold).

    The threshold lies below one half since few documents are toxic, so that the fit leans to the clean side, and since a
    toxic document that stays costs more than a clean one that goes. Any rows and ids will do, repeated or NULL: each row
    is judged by its whole text; equal texts get equal verdicts.
    """
    model = train_chain(docs, labels, label_categories())
    return score_chain(docs, model).withColumn("toxic", F.col("p_toxic") >= threshold)
