"""Hidden Markov language model.

Latent states emit word classes: each of the most frequent words is a class of its own, every other word falls in a
class by its ending. A class emits its words by their training counts. Baum-Welch learns starts, transitions and the
states' classes: every round runs forward and backward over all training documents in their partitions, and Spark sums
the expected counts. A text's likelihood is exact: the scaled forward recursion over its whole length.

Counts of all training words are kept in a table and joined to the words that a shard of documents uses, so neither
the vocabulary nor the corpus passes through the driver. What the driver holds is bounded by the parameters: the
frequent words, and states x classes expected counts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framequery.llm.steps import finished_steps_leave_no_shuffle
from framequery.llm.token_files import written
from framequery.llm.words import hash_strings, rebatched, split_words, to_batches, unique_words

#: Tokens on which forward and backward run at once. A longer document is run by pieces, whose values carry over.
TOKENS_AT_ONCE = 400_000
PIECE = 100_000
#: Text of a shard, which one task scores.
SHARD_BYTES = 3 << 20
ENDING = 3


@dataclass(frozen=True)
class Lexicon:
    """frequent: words by falling count, with their counts; the first `own` are classes. ending_counts/_words: training
    tokens and distinct words of each ending class. The last class is the end of a text."""

    frequent: pa.Array
    counts: np.ndarray
    own: int
    ending_counts: np.ndarray
    ending_words: np.ndarray
    n_docs: int
    n_tokens: int
    n_distinct: int

    @property
    def classes(self) -> int:
        return self.own + len(self.ending_counts) + 1


@dataclass(frozen=True)
class Model:
    start: np.ndarray
    move: np.ndarray
    emit: np.ndarray  # classes x states


def ending_class(words: pa.Array, endings: int) -> np.ndarray:
    return (hash_strings(pc.utf8_slice_codeunits(words.cast(pa.large_string()), -ENDING)) % np.uint64(endings)).astype(np.int64)


def word_classes(words: pa.Array, frequent: pa.Array, own: int, endings: int) -> np.ndarray:
    """Class of each distinct word."""
    if not len(words):
        return np.zeros(0, np.int64)
    place = pc.index_in(words, frequent.slice(0, own)).fill_null(-1).to_numpy().astype(np.int64)
    return np.where(place >= 0, place, own + ending_class(words, endings))


def count_words(train: DataFrame, text_col: str) -> DataFrame:
    """(word, c) over all training texts, counted per batch first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in rebatched(batches):
            words, index = unique_words(split_words(table.column(0), lower=True)[0])
            yield from to_batches(pa.table([words.cast(pa.string()), pa.array(np.bincount(index, minlength=len(words)))], names=["word", "c"]), 100_000)

    return train.select(text_col).mapInArrow(run, "word string, c long").groupBy("word").agg(F.sum("c").alias("c"))


def build_lexicon(counts: DataFrame, n_docs: int, own: int, endings: int, frequent: int) -> Lexicon:
    top = counts.orderBy(F.col("c").desc(), "word").limit(frequent).toArrow()
    words, c = top.column("word").combine_chunks().cast(pa.large_string()), top.column("c").to_numpy()
    own = min(own, len(words))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, distinct = np.zeros(own + endings), np.zeros(own + endings)
        for batch in batches:
            of = word_classes(batch.column(0).cast(pa.large_string()), words, own, endings)
            tokens += np.bincount(of, batch.column(1).to_numpy(), own + endings)
            distinct += np.bincount(of, minlength=own + endings)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(own + endings)), pa.array(tokens.astype(np.int64)), pa.array(distinct.astype(np.int64))], names=["k", "tokens", "words"])

    sums = counts.mapInArrow(run, "k long, tokens long, words long").groupBy("k").agg(F.sum("tokens").alias("tokens"), F.sum("words").alias("words")).toArrow().sort_by("k")
    tokens, distinct = (np.zeros(own + endings, np.int64) for _ in range(2))
    if sums.num_rows:
        tokens[sums["k"].to_numpy()], distinct[sums["k"].to_numpy()] = sums["tokens"].to_numpy(), sums["words"].to_numpy()
    total, kinds = int(tokens.sum()) + n_docs, int(distinct.sum()) + (n_docs > 0)
    return Lexicon(words, c, own, tokens[own:], distinct[own:], n_docs, total, kinds)


class Timed:
    """Sequences (classes, offsets) laid out by time: at each step the sequences still running come first."""

    def __init__(self, offsets: np.ndarray):
        length = np.diff(offsets)
        self.order = np.argsort(-length, kind="stable")
        rank = np.empty(len(length), np.int64)
        rank[self.order] = np.arange(len(length))
        longest = int(length.max()) if len(length) else 0
        self.running = len(length) - np.searchsorted(np.sort(length), np.arange(longest), side="right")
        self.at = np.concatenate([[0], np.cumsum(self.running)])
        owner = np.repeat(np.arange(len(length)), length)
        when = np.arange(offsets[-1]) - offsets[:-1][owner]
        self.place = self.at[when] + rank[owner]
        self.owner = owner


def forward(model: Model, seen: np.ndarray, timed: Timed) -> tuple[np.ndarray, np.ndarray]:
    """Scaled forward probabilities and scales, by time. seen: emission probabilities (tokens x states) by time."""
    alpha, scale = np.empty_like(seen), np.empty(len(seen), seen.dtype)
    ones, before = np.ones(seen.shape[1], seen.dtype), 0
    for a, n in zip(timed.at.tolist(), timed.running.tolist(), strict=False):
        now = alpha[a : a + n]
        if a:
            np.matmul(alpha[before : before + n], model.move, out=now)
            now *= seen[a : a + n]
        else:
            np.multiply(seen[:n], model.start, out=now)
        total = np.matmul(now, ones, out=scale[a : a + n])
        now /= total[:, None]
        before = a
    return alpha, scale


def expected_counts(model: Model, classes: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """Expected starts, transitions and emissions (classes x states) of whole sequences, and their log-likelihood.

    Steps are taken in the precision of the model's arrays; what is summed over steps is double.
    """
    timed = Timed(offsets)
    by_time = np.empty(len(classes), np.int64)
    by_time[timed.place] = classes
    seen = model.emit[by_time]
    alpha, scale = forward(model, seen, timed)
    states = len(model.start)
    # seen becomes what each token says about the step before it: emission x beta / scale.
    seen /= scale[:, None]
    moves, back, m = np.zeros((states, states)), np.ascontiguousarray(model.move.T), 0
    ahead = seen[:0]
    for a, n in zip(timed.at[-2::-1].tolist(), timed.running[::-1].tolist(), strict=True):
        now = seen[a : a + n]
        if m:
            moves += alpha[a : a + m].T @ ahead
            beta = ahead @ back
            alpha[a : a + m] *= beta
            now[:m] *= beta
        ahead, m = now, n
    starts = alpha[: timed.running[0]].sum(axis=0, dtype=np.float64) if len(timed.running) else np.zeros(states)
    emits = np.stack([np.bincount(by_time, alpha[:, k], len(model.emit)) for k in range(states)], axis=1)
    return starts, moves * model.move, emits, float(np.log(scale).sum(dtype=np.float64))


def long_counts(model: Model, classes: np.ndarray, piece: int = PIECE) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """expected_counts of one sequence of any length. Forward values are kept at the borders of pieces only; a piece is
    run forward again when the backward values reach it, so nothing is cut and memory is that of a piece."""
    states, dtype = len(model.start), model.emit.dtype

    def run(part: np.ndarray, before: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
        alpha, scale = model.emit[part], np.empty(len(part), dtype)
        for t in range(len(part)):
            alpha[t] *= model.start if before is None else before @ model.move
            scale[t] = alpha[t].sum()
            alpha[t] /= scale[t]
            before = alpha[t]
        return alpha, scale

    cuts, borders = list(range(0, len(classes), piece)), [None]
    for a in cuts[:-1]:
        borders.append(run(classes[a : a + piece], borders[-1])[0][-1].copy())
    moves, emits, total, ahead = np.zeros((states, states)), np.zeros((len(model.emit), states)), 0.0, None
    starts = np.zeros(states)
    for a, before in zip(cuts[::-1], borders[::-1], strict=True):
        part = classes[a : a + piece]
        alpha, scale = run(part, before)
        seen = model.emit[part] / scale[:, None]
        for t in range(len(part) - 1, -1, -1):
            if ahead is not None:
                moves += np.outer(alpha[t], ahead)
                beta = model.move @ ahead
                alpha[t] *= beta
                seen[t] *= beta
            ahead = seen[t]
        emits += np.stack([np.bincount(part, alpha[:, k], len(emits)) for k in range(states)], axis=1)
        total += float(np.log(scale).sum(dtype=np.float64))
        starts = alpha[0].astype(np.float64)
    return starts, moves * model.move, emits, total


def first_model(lexicon: Lexicon, states: int, seed: int) -> Model:
    """Sticky states that share the classes' counts, each tilted at random."""
    rng = np.random.default_rng(seed)
    base = np.concatenate([lexicon.counts[: lexicon.own], lexicon.ending_counts, [lexicon.n_docs]]) + 1.0
    emit = base[:, None] * np.exp(1.0 * rng.standard_normal((len(base), states)))
    emit[-1] = base[-1]
    move = np.full((states, states), 0.1 / max(1, states - 1))
    np.fill_diagonal(move, 0.9 if states > 1 else 1.0)
    return Model(np.full(states, 1.0 / states), move / move.sum(axis=1, keepdims=True), emit / emit.sum(axis=0))


def by_length(texts: list[np.ndarray]) -> Iterator[list[np.ndarray]]:
    """Sequences in groups of at most TOKENS_AT_ONCE tokens (a longer one alone) and of like length: a group takes as many
    steps as its longest sequence has tokens, so long ones had better share theirs."""
    held: list[np.ndarray] = []
    size = 0
    for x in sorted(texts, key=len, reverse=True):
        if held and size + len(x) > TOKENS_AT_ONCE:
            yield held
            held, size = [], 0
        held.append(x)
        size += len(x)
    if held:
        yield held


def train(codes: DataFrame, lexicon: Lexicon, states: int, rounds: int, seed: int) -> tuple[Model, list[float]]:
    """Baum-Welch over (codes BINARY: uint16 classes of a text, the end included); the log-likelihoods of the rounds."""
    model, history = first_model(lexicon, states, seed), []
    size = lexicon.classes
    for _ in range(rounds):

        # Single precision is enough for one round's steps: they are scaled at each token.
        single = Model(*(x.astype(np.float32) for x in (model.start, model.move, model.emit)))

        def run(batches: Iterator[pa.RecordBatch], model: Model = single) -> Iterator[pa.RecordBatch]:
            starts, moves, emits, total = np.zeros(states), np.zeros((states, states)), np.zeros((size, states)), 0.0
            for table in rebatched(batches):
                texts = [np.frombuffer(x.as_buffer(), "<u2") for x in table.column(0)]
                for some in by_length(texts):
                    offsets = np.concatenate([[0], np.cumsum([len(x) for x in some])]).astype(np.int64)
                    flat = np.concatenate(some).astype(np.int64)
                    a, b, c, d = expected_counts(model, flat, offsets) if len(flat) <= TOKENS_AT_ONCE else long_counts(model, flat)
                    starts, moves, emits, total = starts + a, moves + b, emits + c, total + d
            flat = np.concatenate([[total], starts, moves.ravel(), emits.ravel()])
            some = np.flatnonzero(flat)
            yield from to_batches(pa.table([pa.array(some), pa.array(flat[some])], names=["k", "v"]), 100_000)

        sums = codes.mapInArrow(run, "k long, v double").groupBy("k").agg(F.sum("v").alias("v")).toArrow()
        flat = np.zeros(1 + states + states * states + size * states)
        flat[sums["k"].to_numpy()] = sums["v"].to_numpy()
        history.append(float(flat[0]))
        starts, rest = flat[1 : 1 + states] + 0.1, flat[1 + states :]
        moves, emits = rest[: states * states].reshape(states, states) + 0.1, rest[states * states :].reshape(size, states) + 0.01
        model = Model(starts / starts.sum(), moves / moves.sum(axis=1, keepdims=True), emits / emits.sum(axis=0))
    return model, history


def score_texts(
    docs: DataFrame, own: int = 4096, endings: int = 1024, frequent: int = 50_000, states: int = 8, rounds: int = 6, seed: int = 11,
    id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """(id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every whole text, learnt from the texts that
    are not held out: those whose crc32(id as text) mod 7 is not 2 (a NULL id counts as an empty one).

    Words lower-case A-Z; each text ends with one end token. NULL text counts as empty: its end alone is scored.
    base_score is the add-one unigram's log10 probability, score the model's. A word of count 0 is its ending class's
    unknown word. Rows that share an id are scored one by one; ids may be of any type that has a text; with no training
    text all scores are those of the starting model, and an empty table gives no rows. Other columns aren't read. Texts
    of any length are learnt from and scored whole.
    """
    held = F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit(""))) % 7 == 2
    docs = docs.select(F.col(id_col), F.col(text_col))
    learn = docs.where(~held)
    total = docs.agg(F.coalesce(F.sum(F.octet_length(text_col)), F.lit(0))).first()[0]
    # Rows are dealt over shards by a number that is written once, not by content: equal rows don't share a shard.
    shard = F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(max(1, -(-total // SHARD_BYTES)))).cast("int")
    numbered = docs.select(shard.alias("shard"), F.col(id_col).alias("_id"), F.coalesce(text_col, F.lit("")).alias("text"), held.alias("held"))
    rows = written(numbered, "numbered")
    with finished_steps_leave_no_shuffle(docs.sparkSession):
        counts = written(count_words(learn, text_col), "counts")
        lexicon = build_lexicon(counts, learn.count(), own, endings, frequent)

        def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for table in rebatched(batches):
                flat, offsets = split_words(table.column(0), lower=True)
                words, index = unique_words(flat)
                of = np.append(word_classes(words, lexicon.frequent, lexicon.own, endings), lexicon.classes - 1)
                codes = of[np.insert(index, offsets[1:], len(words))].astype("<u2")
                ends = (offsets + np.arange(len(offsets))) * 2
                rows = pa.Array.from_buffers(pa.binary(), len(ends) - 1, [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(codes)])
                yield from to_batches(pa.table([rows], names=["codes"]), 5_000)

        codes = written(learn.select(text_col).mapInArrow(encode, "codes binary"), "codes")
        model, _ = train(codes, lexicon, states, rounds, seed)

        def rare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            """The words beyond the frequent ones that each shard's documents in a batch use."""
            for table in rebatched(batches, 4 << 20):
                flat, offsets = split_words(table["text"], lower=True)
                words, index = unique_words(flat)
                unknown = pc.is_in(words, lexicon.frequent).to_numpy(zero_copy_only=False) == 0 if len(words) else np.zeros(0, bool)
                shard = np.repeat(table["shard"].to_numpy().astype(np.int64), np.diff(offsets))
                key = np.unique((shard * max(1, len(words)) + index)[unknown[index]])
                yield from to_batches(pa.table([pa.array((key // max(1, len(words))).astype(np.int32)), words.take(pa.array(key % max(1, len(words)))).cast(pa.string())], names=["shard", "word"]), 100_000)

        wanted = rows.select("shard", "text").mapInArrow(rare, "shard int, word string")
        known = written(wanted.join(counts, "word").select("shard", "word", "c"), "shard-counts")
    key = docs.schema[id_col].dataType.simpleString()
    schema = f"`{id_col}` {key}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"

    def score(texts: pa.Table, counted: pa.Table) -> pa.Table:
        flat, offsets = split_words(texts["text"], lower=True)
        words, index = unique_words(flat)
        c = np.zeros(len(words) + 1, np.int64)
        if len(words):
            place = pc.index_in(words, lexicon.frequent).fill_null(-1).to_numpy().astype(np.int64)
            c[:-1] = np.where(place >= 0, lexicon.counts[place] if len(lexicon.counts) else 0, 0)
            if counted.num_rows:
                names = counted["word"].combine_chunks().cast(pa.large_string())
                rare_place = pc.index_in(words, names).fill_null(-1).to_numpy().astype(np.int64)
                c[:-1] += np.where((rare_place >= 0) & (place < 0), counted["c"].to_numpy()[rare_place], 0)
        c[-1] = lexicon.n_docs
        of = np.append(word_classes(words, lexicon.frequent, lexicon.own, endings), lexicon.classes - 1)
        # log10 of a word's share of its class; classes of one word have none to share.
        inside = np.zeros(len(c))
        by_ending = (of >= lexicon.own) & (of < lexicon.classes - 1)
        e = of[by_ending] - lexicon.own
        inside[by_ending] = np.log10((c[by_ending] + 1) / (lexicon.ending_counts[e] + lexicon.ending_words[e] + 1))
        base = np.log10((c + 1) / (lexicon.n_tokens + lexicon.n_distinct + 1))
        tokens = np.insert(index, offsets[1:], len(words))
        ends = offsets + np.arange(len(offsets))
        total = {}
        rows_of = np.repeat(np.arange(len(ends) - 1), np.diff(ends))
        for name, value in (("base", base[tokens]), ("inside", inside[tokens]), ("known", (c > 0)[tokens].astype(np.float64))):
            total[name] = np.bincount(rows_of, value, len(ends) - 1)
        path = np.zeros(len(ends) - 1)
        a = 0
        while a < len(ends) - 1:
            b = int(max(a + 1, np.searchsorted(ends, ends[a] + TOKENS_AT_ONCE, side="right") - 1))
            path[a:b] = log_likelihoods(model, of[tokens[ends[a] : ends[b]]], ends[a : b + 1] - ends[a])
            a = b
        n = np.diff(ends)
        return pa.table(
            [texts["_id"], texts["held"], pa.array(n), pa.array(total["known"].astype(np.int64)), pa.array(np.full(len(n), lexicon.n_tokens)), pa.array(total["base"]), pa.array(total["inside"] + path)],
            names=[id_col, "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
        )

    return rows.groupBy("shard").cogroup(known.groupBy("shard")).applyInArrow(score, schema)


def log_likelihoods(model: Model, classes: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Exact log10 likelihood of each class sequence by the scaled forward recursion, step by step for all at once;
    only the last step's probabilities are held, so a text's length is not bounded."""
    timed = Timed(offsets)
    by_time = np.empty(len(classes), np.int64)
    by_time[timed.place] = classes
    out = np.zeros(len(offsets) - 1)
    alpha, ones = np.zeros((0, len(model.start))), np.ones(len(model.start))
    for t, n in enumerate(timed.running.tolist()):
        now = model.emit[by_time[timed.at[t] : timed.at[t] + n]]
        now *= alpha[:n] @ model.move if t else model.start
        total = now @ ones
        out[:n] += np.log10(total)
        now /= total[:, None]
        alpha = now
    result = np.empty_like(out)
    result[timed.order] = out
    return result
