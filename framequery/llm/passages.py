"""Removal of passages that repeat word for word, by automata of the repeated passages.

Recurring passages are confirmed first (see repeats.py): phrases of the parse that occur twice, and runs of 20-word
windows that different phrases have in common. Each shard of documents gets an Aho-Corasick automaton of the confirmed
passages that its documents have, compiled with pyahocorasick over the codes of its words, and all its documents are
streamed through it. The automaton locates every occurrence; all but a passage's first place in the corpus are removed.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framequery.llm import repeats
from framequery.llm.steps import Steps
from framequery.llm.words import freed_group, hash_strings, join_rows, split_words, unique_words

WIDTH = 20
GRAM = 6
#: Bits of a word's code in a gram; a gram of codes fits in 60 bits. Words may share a code: windows are compared in full.
CODE_BITS = 10


def word_units(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    flat, offsets = split_words(texts)
    distinct, index = unique_words(flat)
    return hash_strings(distinct)[index], offsets


def word_grams(units: np.ndarray) -> np.ndarray:
    """The gram of codes that starts at each word (padded with zeros at the end)."""
    codes = np.concatenate([units >> np.uint64(64 - CODE_BITS), np.zeros(GRAM - 1, np.uint64)])
    out = np.zeros(len(units), np.uint64)
    for k in range(GRAM):
        out |= codes[k : k + len(units)] << np.uint64(CODE_BITS * k)
    return out


SPEC = repeats.Spec(WIDTH, GRAM, 8, word_units, word_grams, lambda texts: word_units(texts)[0].view(np.uint8), False)


def confirmed(found: DataFrame, phrases: DataFrame, late: DataFrame) -> DataFrame:
    """(shard, doc, a, n, first_doc, first_a, parts): the recurring phrases that each shard has, with a place there and
    the first of all. parts: the runs (k, n, first_doc, first_a) of windows that another phrase has earlier; a phrase has
    few windows, so few parts. Where the only occurrence in the shard is the first of all, only parts are to be found."""
    parts = late.groupBy("gram", "phrase").agg(F.collect_list(F.struct("k", "n", "first_doc", "first_a")).alias("parts"))
    firsts = phrases.select("gram", "phrase", F.col("doc").alias("first_doc"), F.col("a").alias("first_a"), F.col("copies").alias("all"))
    recurring = firsts.join(parts, ["gram", "phrase"], "left").where((F.col("all") > 1) | F.col("parts").isNotNull()).drop("all")
    # AQE can split a frequent phrase's rows, one a shard at most.
    places = found.where(F.col("kind") == repeats.OPEN).select("shard", "gram", "phrase", "doc", "a", "n", "copies")
    alone = (F.col("copies") == 1) & (F.col("doc") == F.col("first_doc")) & F.col("parts").isNull()
    return places.join(recurring, ["gram", "phrase"]).where(~alone).select("shard", "doc", "a", "n", "first_doc", "first_a", "parts")


def patterns_of(passages: pa.Table) -> tuple[np.ndarray, ...]:
    """(doc, a, n, first_doc, first_a) of runs of windows whose first places in the corpus are known and neighbours: the
    parts of each phrase, and what lies between them."""
    doc, a, n, first_doc, first_a = (passages[c].to_numpy().astype(np.int64) for c in ("doc", "a", "n", "first_doc", "first_a"))
    parts = passages["parts"].combine_chunks()
    split = parts.is_valid().to_numpy(zero_copy_only=False)
    rows = [np.stack([x[~split] for x in (doc, a, n, first_doc, first_a)], axis=1)]
    more: list[tuple[int, ...]] = []
    for k in np.flatnonzero(split).tolist():
        at = 0
        for part in [*sorted(parts[k].as_py(), key=lambda p: p["k"]), {"k": int(n[k]), "n": 0}]:
            if part["k"] > at:
                more.append((doc[k], a[k] + at, part["k"] - at, first_doc[k], first_a[k] + at))
            if part["n"]:
                more.append((doc[k], a[k] + part["k"], part["n"], part["first_doc"], part["first_a"]))
            at = part["k"] + part["n"]
    return tuple(np.concatenate([*rows, np.array(more, np.int64).reshape(-1, 5)]).T)


def located(index: np.ndarray, offsets: np.ndarray, doc: np.ndarray, passages: pa.Table) -> np.ndarray:
    """Mask over the words (codes `index`, texts by `offsets`, ids `doc` rising) in occurrences of the passages (rows as
    confirmed() gives them), their first places of all apart."""
    import ahocorasick

    gone = np.zeros(len(index) + 1, np.int64)
    if not passages.num_rows or not len(index):
        return gone[:-1] > 0
    # A code of no word parts the texts, so that no passage runs across them.
    text = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    stream = np.insert(index, offsets[1:-1], index.max() + 1).tolist()
    here, a, n, first_doc, first_a = patterns_of(passages)
    n = n + WIDTH - 1
    begin = np.searchsorted(doc, here)
    begin = (offsets[begin] + begin + a).tolist()
    automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS, ahocorasick.KEY_SEQUENCE)
    for k, (a, size) in enumerate(zip(begin, n.tolist(), strict=True)):
        automaton.add_word(tuple(stream[a : a + size]), k)
    automaton.make_automaton()
    hits = np.array(list(automaton.iter(tuple(stream))), np.int64).reshape(-1, 2)
    end, which = hits[:, 0], hits[:, 1]
    # Places in the stream become words and texts again; ends of passages are never parting codes.
    word = np.insert(np.arange(len(index)), offsets[1:-1], -1)[end]
    start = word - n[which] + 1
    row = text[word]
    own = (doc[row] == first_doc[which]) & (start - offsets[row] == first_a[which])
    np.add.at(gone, start[~own], 1)
    np.add.at(gone, word[~own] + 1, -1)
    return np.cumsum(gone)[:-1] > 0


def remove_passages(
    docs: DataFrame, digests: bool = False, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = ()
) -> DataFrame:
    """(id, n_words, n_removed, kept, carried columns): each text without the words covered by a 20-word window that starts earlier.

    Earlier: in a row of smaller id (NULL least), or further ahead in the row. Rows that share an id are ordered by a hash
    of their texts, then as they are read; ids may be of any type that Spark can order. kept joins the words left by one
    space; with digests it is kept_sha256, lowercase hex. NULL and empty texts have no words; an empty table gives no
    rows. A carried column with the name of a result is left out. Passages are told apart by 64-bit hashes, and found by
    their words.
    """
    steps = Steps(docs.sparkSession)
    last = "kept_sha256" if digests else "kept"
    carry = tuple(c for c in dict.fromkeys(carry) if c not in (id_col, "n_words", "n_removed", last))
    rows, whole = repeats.sharded(docs, id_col, text_col, carry)
    extra = "".join(f", `{c}` {docs.schema[c].dataType.simpleString()}" for c in carry)

    @freed_group
    def run(texts: pa.Table, passages: pa.Table) -> pa.Table:
        table = texts.sort_by("doc")
        flat, offsets = split_words(table["text"].combine_chunks())
        gone = located(unique_words(flat)[1], offsets, table["doc"].to_numpy(), passages)
        ends = np.concatenate([[0], np.cumsum(~gone)])[offsets]
        kept = join_rows(flat.filter(pa.array(~gone)), ends)
        n = np.diff(offsets)
        if digests:
            kept = pa.array([hashlib.sha256(memoryview(s.as_buffer())).hexdigest() for s in kept], pa.string())
        carried = [table[f"_{k}"] for k in range(len(carry))]
        return pa.table([table["_id"], pa.array(n), pa.array(n - np.diff(ends)), kept.cast(pa.string()), *carried], names=[id_col, "n_words", "n_removed", last, *carry])

    found, phrases, late = repeats.repeated_phrases(rows, SPEC, steps)
    passages = steps.write(confirmed(found, phrases, late), "passages")
    steps.drop("found", "phrases", "late")
    key = docs.schema[id_col].dataType.simpleString()
    schema = f"`{id_col}` {key}, n_words long, n_removed long, {last} string{extra}"
    return whole.groupBy("shard").cogroup(passages.groupBy("shard")).applyInArrow(run, schema)
