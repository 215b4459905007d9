"""What the exact removal of repeated windows shares: shards, the parse into phrases, and the dictionary's suffixes.

A window is `width` consecutive units (words or bytes) of one document. A rolling hash of grams chooses triggers by
content: each window selects the inner gram of least hash, so equal windows select equal grams at equal places. A
phrase is a trigger with all the windows that select it: phrases overlap by what windows need, so each window lies
whole in one phrase of the parse. Phrases whose trigger occurs once can't hold a repeated window and are let go.

The distinct phrases are the dictionary, each with its first place in the parse. All later occurrences of a phrase are
repeats. Windows of different phrases are compared by sorting the dictionary's suffixes (those at the windows' starts)
by their first `width` units; suffixes that agree with a neighbour that far are equal windows. The first place of each
in the order of the corpus is the least place that the parse gives any of its phrases.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from framequery.llm.steps import Steps
from framequery.llm.words import A64, M1, freed, freed_group, mix, rebatched, to_batches
from framequery.operators.catalog import ranked

#: Text of a shard; a shard's documents are read by one task.
SHARD_BYTES = 2 << 20
#: Places that fit beside the upper bits of a gram's order; always the same, so that equal windows select alike.
PLACES = 1 << 28
#: Distinct phrases of one trigger beyond which its windows are parts of their own, compared by aggregates and a join.
HOT_PHRASES = 20_000
#: Content of the dictionary that is sorted at once; a group is a trigger with at most HOT_PHRASES phrases.
SORTED_BYTES = 2 << 20
A64_INVERSE = np.uint64(pow(int(A64), -1, 1 << 64))
#: A shard's first place of a phrase and its occurrences there, or (kind REMOVED) a span to remove.
FOUND = "shard int, kind int, gram long, phrase long, doc long, a int, n int, copies int"
REMOVED, OPEN = 0, 1
#: A part of the dictionary: the windows of a phrase (k 0), or the k-th window of a hot trigger's phrase (hot 1).
CONTENTS = "gram long, hot int, phrase long, k int, shard int, doc long, a int, n int, content binary"
#: The n windows from the k-th of a phrase, first at (doc, a), equal those from (first_doc, first_a) on.
LATE = "gram long, phrase long, k int, shard int, doc long, a int, n int, first_doc long, first_a int"


def numbered(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """docs plus _doc (long): the row's place in the order of the corpus.

    That is the id where ids are whole numbers, none NULL and none repeated. Else rows are numbered by id (NULL first),
    then by a hash of the text, then as read; any type of id that Spark can order will do.
    """
    if docs.schema[id_col].dataType.simpleString() in ("bigint", "int", "smallint", "tinyint"):
        odd = docs.groupBy(id_col).agg(F.count(F.lit(1)).alias("n")).where((F.col("n") > 1) | F.col(id_col).isNull())
        if not odd.limit(1).count():
            return docs.withColumn("_doc", F.col(id_col).cast("long"))
    keyed = docs.withColumn("_text", F.xxhash64(text_col)).withColumn("_read", F.monotonically_increasing_id())
    return ranked(keyed, "_doc", F.col(id_col).asc_nulls_first(), F.col("_text").asc(), F.col("_read").asc(), kind="long").drop("_text", "_read")


def sharded(docs: DataFrame, id_col: str, text_col: str, carry: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """(shard int, doc long, text) rows, and the same with the id as _id and the columns to carry along as _0, _1 ...;
    NULL texts as empty. doc tells all rows apart. The number of shards follows the bytes of text."""
    total = docs.agg(F.coalesce(F.sum(F.octet_length(text_col)), F.lit(0))).first()[0]
    rows = numbered(docs.select(*dict.fromkeys([id_col, text_col, *carry])), id_col, text_col)
    shard = F.pmod(F.xxhash64("_doc"), F.lit(max(1, -(-total // SHARD_BYTES)))).cast("int")
    columns = [shard.alias("shard"), F.col("_doc").alias("doc"), F.coalesce(text_col, F.lit("")).alias("text")]
    return rows.select(columns), rows.select(*columns, F.col(id_col).alias("_id"), *(F.col(c).alias(f"_{k}") for k, c in enumerate(carry)))


def recurring(grams: DataFrame) -> DataFrame:
    """(shard, gram) of grams that occur at least twice; grams has (gram, shard, n), any number of rows a pair.

    Counts are combined map-side, and the join lets AQE split the rows of a frequent gram.
    """
    twice = grams.groupBy("gram").agg(F.sum("n").alias("n")).where(F.col("n") > 1).select("gram")
    return grams.select("shard", "gram").join(twice, "gram").select("shard", "gram")


def window_grams(order: np.ndarray, n_units: np.ndarray, offsets: np.ndarray, width: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts of all windows, and for each the place of the gram it selects: the first of least `order`.

    order: a pseudo-random value for the gram that starts at each unit, all documents one after another.
    """
    span = width - gram + 1
    counts = np.maximum(n_units - width + 1, 0)
    total = int(counts.sum())
    if not total:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    starts = np.arange(total) + np.repeat(offsets[:-1] - np.concatenate([[0], np.cumsum(counts)[:-1]]), counts)
    place = np.empty(len(order), np.int64)
    for k in range(0, len(order), PLACES // 2):
        place[k : k + PLACES // 2] = k + _least_places(order[k : k + PLACES // 2 + span - 1], span)[: PLACES // 2]
    return starts, place[starts]


def _least_places(order: np.ndarray, span: int) -> np.ndarray:
    """The place of the least of `span` neighbours from each place (fewer at the end): a value's upper bits and its
    place make one number, so that places break ties, and doubled blocks need one minimum each."""
    key = order & ~np.uint64(PLACES - 1) | np.arange(len(order), dtype=np.uint64)
    size = 1
    while size < span:
        step = min(size, span - size)
        np.minimum(key[:-step], key[step:], out=key[:-step])
        size += step
    return (key & np.uint64(PLACES - 1)).astype(np.int64)


def prefix_hashes(units: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Running polynomial hashes H (n + 1) of 64-bit units, and the inverse powers of the base."""
    n = len(units)
    power, inverse = np.ones(n + 1, np.uint64), np.ones(n + 1, np.uint64)
    if n:
        np.multiply.accumulate(np.full(n, A64, np.uint64), out=power[1:])
        np.multiply.accumulate(np.full(n, A64_INVERSE, np.uint64), out=inverse[1:])
    return np.concatenate([np.zeros(1, np.uint64), np.cumsum(units * power[:-1], dtype=np.uint64)]), inverse


def range_hash(hashes: tuple[np.ndarray, np.ndarray], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A hash of the units in each range [a, b), the same wherever the range stands."""
    h, inverse = hashes
    return mix((h[b] - h[a]) * inverse[a] + (b - a).astype(np.uint64) * M1)


def distinct_places(places: np.ndarray, n: int) -> np.ndarray:
    """The distinct places below n, sorted."""
    marked = np.zeros(n, bool)
    marked[places] = True
    return np.flatnonzero(marked)


def phrases_of(starts: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of consecutive windows that select one place: first start, number of windows, place."""
    first = np.flatnonzero(np.concatenate([[True], (places[1:] != places[:-1]) | (starts[1:] != starts[:-1] + 1)])) if len(starts) else np.zeros(0, np.int64)
    n = np.diff(np.concatenate([first, [len(starts)]]))
    return starts[first], n, places[first]


@dataclass(frozen=True)
class Spec:
    """How an operator sees texts: `units` gives (uint64 units, offsets) of texts in order; `grams` the gram that starts
    at each unit; `contents` the units as stored in the dictionary, `stored` bytes each. spans: whether repeats within a
    shard are given as spans at once."""

    width: int
    gram: int
    stored: int
    units: Callable[[pa.Array], tuple[np.ndarray, np.ndarray]]
    grams: Callable[[np.ndarray], np.ndarray]
    contents: Callable[[pa.Array], np.ndarray]
    spans: bool


def selected(spec: Spec, units: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(grams, window starts, selected places)."""
    grams = spec.grams(units)
    order = mix(grams + M1)
    starts, places = window_grams(order, np.diff(offsets), offsets, spec.width, spec.gram)
    return grams, starts, places


def count_grams(rows: DataFrame, spec: Spec) -> DataFrame:
    """(gram, shard, n) of the grams that windows select; a row for each gram, shard and batch."""

    @freed
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in rebatched(batches, 2 << 20):
            units, offsets = spec.units(table["text"].combine_chunks())
            grams, _, places = selected(spec, units, offsets)
            places = distinct_places(places, len(units))
            row = np.searchsorted(offsets, places, side="right") - 1
            gram, shard = grams[places], table["shard"].to_numpy()[row]
            order = np.lexsort((shard, gram))
            gram, shard = gram[order], shard[order]
            first = np.flatnonzero(np.concatenate([[True], (gram[1:] != gram[:-1]) | (shard[1:] != shard[:-1])])[: len(gram)])
            n = np.diff(np.concatenate([first, [len(gram)]]))
            yield from to_batches(pa.table([pa.array(gram[first].view(np.int64)), pa.array(shard[first]), pa.array(n.astype(np.int32))], names=["gram", "shard", "n"]), 100_000)

    return rows.mapInArrow(run, "gram long, shard int, n int")


FOUND_NAMES = ["shard", "kind", "gram", "phrase", "doc", "a", "n", "copies"]
FOUND_TYPES = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32()]
CONTENT_NAMES = ["gram", "hot", "phrase", "k", "shard", "doc", "a", "n", "content"]
CONTENT_TYPES = [pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.binary()]
LATE_NAMES = ["gram", "phrase", "k", "shard", "doc", "a", "n", "first_doc", "first_a"]
LATE_TYPES = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int32()]


def _rows(types: list[pa.DataType], names: list[str], *columns: np.ndarray | pa.Array | int) -> pa.Table:
    """A table of the given columns; numbers stand for columns of one value."""
    size = next((len(c) for c in columns if not isinstance(c, int)), 0)
    full = [pa.repeat(pa.scalar(c, t), size) if isinstance(c, int) else pa.array(c).cast(t) for c, t in zip(columns, types, strict=True)]
    return pa.table(full, names=names)


def find_phrases(rows: DataFrame, wanted: DataFrame, spec: Spec) -> DataFrame:
    """FOUND rows: each shard's distinct phrases of recurring triggers, with the first place and the count there."""

    @freed_group
    def run(docs: pa.Table, grams: pa.Table) -> pa.Table:
        if not docs.num_rows or not grams.num_rows:
            return _rows(FOUND_TYPES, FOUND_NAMES, *([[]] * len(FOUND_NAMES)))
        shard = docs["shard"][0].as_py()
        docs = docs.sort_by("doc")
        units, offsets = spec.units(docs["text"].combine_chunks())
        keys, starts, places = selected(spec, units, offsets)
        kept = np.unique(grams["gram"].to_numpy()).view(np.uint64)
        chosen = distinct_places(places, len(units))
        known = np.zeros(len(units), bool)
        known[chosen] = kept[np.minimum(np.searchsorted(kept, keys[chosen]), len(kept) - 1)] == keys[chosen]
        hit = known[places]
        lo, n, place = phrases_of(starts[hit], places[hit])
        name = range_hash(prefix_hashes(units), lo, lo + n + spec.width - 1) ^ mix((place - lo).astype(np.uint64))
        row = np.searchsorted(offsets, lo, side="right") - 1
        gram, doc, a = keys[place], docs["doc"].to_numpy()[row], lo - offsets[row]
        # lo rises in the order of the corpus, so a stable sort puts each phrase's first place first.
        order = np.argsort(mix(gram * M1 + mix(name)), kind="stable")
        key = mix(gram * M1 + mix(name))[order]
        fresh = np.concatenate([[True], key[1:] != key[:-1]])[: len(key)]
        first = order[fresh]
        copies = np.diff(np.concatenate([np.flatnonzero(fresh), [len(key)]]))
        out = _rows(FOUND_TYPES, FOUND_NAMES, shard, OPEN, gram[first].view(np.int64), name[first].view(np.int64), doc[first], a[first], n[first], copies)
        if not spec.spans:
            return out
        late = np.sort(order[~fresh])
        who, start, size = merge_spans(doc[late], a[late], n[late] + spec.width - 1)
        return pa.concat_tables([out, _rows(FOUND_TYPES, FOUND_NAMES, shard, REMOVED, 0, 0, who, start, size, 0)])

    return rows.groupBy("shard").cogroup(wanted.groupBy("shard")).applyInArrow(run, FOUND)


def dictionary(opened: DataFrame) -> DataFrame:
    """(gram, phrase, shard, doc, a, n, copies, places) of each distinct phrase: its first place in the parse, all its
    occurrences, and in how many shards it is. Minima and sums are combined map-side."""
    least = F.min(F.struct("doc", "a", "shard", "n")).alias("f")
    found = opened.groupBy("gram", "phrase").agg(least, F.sum("copies").alias("copies"), F.count(F.lit(1)).alias("places"))
    return found.select("gram", "phrase", "f.shard", "f.doc", "f.a", "f.n", "copies", "places")


def various(phrases: DataFrame) -> DataFrame:
    """The phrases whose trigger has others as well, and whether it is hot: has over HOT_PHRASES of them. The join lets
    AQE split a frequent trigger's phrases."""
    kinds = phrases.groupBy("gram").agg(F.count(F.lit(1)).alias("kinds")).where(F.col("kinds") > 1)
    return phrases.join(kinds, "gram").select("shard", "gram", "phrase", "doc", "a", "n", (F.col("kinds") > HOT_PHRASES).alias("hot"))


def phrase_contents(rows: DataFrame, opened: DataFrame, spec: Spec) -> DataFrame:
    """CONTENTS of the opened phrases, read from their first places."""

    @freed_group
    def run(docs: pa.Table, opened: pa.Table) -> pa.Table:
        if not docs.num_rows or not opened.num_rows:
            return _rows(CONTENT_TYPES, CONTENT_NAMES, *([[]] * len(CONTENT_NAMES)))
        shard = docs["shard"][0].as_py()
        docs = docs.filter(pc.is_in(docs["doc"], opened["doc"].combine_chunks())).sort_by("doc")
        texts = docs["text"].combine_chunks()
        _, offsets = spec.units(texts)
        data = spec.contents(texts)
        gram, phrase, which, a, n = (opened[c].to_numpy() for c in ("gram", "phrase", "doc", "a", "n"))
        hot = opened["hot"].to_numpy()
        start = offsets[np.searchsorted(docs["doc"].to_numpy(), which)] + a
        # The windows of hot triggers are parts of their own.
        at = np.arange(n[hot].sum()) + np.repeat(start[hot] - np.concatenate([[0], np.cumsum(n[hot])])[:-1], n[hot])
        begin = np.concatenate([start[~hot], at])
        key, name, doc, place = (np.concatenate([x[~hot], np.repeat(x[hot], n[hot])]) for x in (gram, phrase, which, a))
        none = np.zeros(int((~hot).sum()), np.int64)
        k = np.concatenate([none, at - np.repeat(start[hot], n[hot])])
        count = np.concatenate([n[~hot], np.ones(len(at), n.dtype)])
        size = (count + spec.width - 1).astype(np.int64) * spec.stored
        ends = np.concatenate([[0], np.cumsum(size)])
        raw = data[np.arange(ends[-1]) + np.repeat(begin * spec.stored - ends[:-1], size)]
        content = pa.Array.from_buffers(pa.binary(), len(size), [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(raw)])
        part = np.concatenate([none, np.ones(len(at), np.int64)])
        return _rows(CONTENT_TYPES, CONTENT_NAMES, key, part, name, k, shard, doc, place + k, count, content)

    return rows.groupBy("shard").cogroup(opened.groupBy("shard")).applyInArrow(run, CONTENTS)


def equal_suffixes(data: np.ndarray, starts: np.ndarray, group: np.ndarray, width: int, stored: int) -> tuple[np.ndarray, np.ndarray]:
    """The suffixes of `data` (bytes) at `starts` in sorted order, as far as they agree with a neighbour of their group
    in their first width * stored bytes: (which, class), classes counted in sorted order.

    A suffix array to that depth, built by eight bytes at a time; a suffix that has parted from all others is let go.
    """
    lanes = np.ndarray((max(0, len(data) - 7),), ">u8", data, strides=(1,))
    size = width * stored
    active, cls = np.arange(len(starts)), group
    for lane in [*range(0, size - 7, 8), *([size - 8] if size % 8 else [])]:
        key = lanes[starts[active] + lane].astype(np.uint64)
        order = np.lexsort((key, cls))
        key, cls, active = key[order], cls[order], active[order]
        fresh = np.concatenate([[True], (cls[1:] != cls[:-1]) | (key[1:] != key[:-1])])[: len(cls)]
        lone = fresh & np.concatenate([fresh[1:], [True]])[: len(fresh)]
        cls, active = np.cumsum(fresh)[~lone], active[~lone]
        if not len(active):
            break
    return active, cls


def late_windows(contents: DataFrame, spec: Spec) -> DataFrame:
    """LATE rows of CONTENTS: windows of the dictionary that equal one of a phrase with an earlier place. However many
    phrases share a window, no task holds them together."""
    return late_in_groups(contents.where("hot = 0"), spec).unionByName(late_of_hot(contents.where("hot = 1")))


def late_of_hot(windows: DataFrame) -> DataFrame:
    """LATE rows of windows (n 1) by their content: a window's first place is a minimum that is combined map-side, and is
    joined back, where AQE splits a window that many phrases share. Neighbours in a phrase whose first places are
    neighbours too make one row."""
    place = F.min(F.struct("doc", "a")).alias("first")
    first = windows.groupBy("gram", "content").agg(place, F.count(F.lit(1)).alias("times")).where("times > 1").drop("times")
    late = windows.join(first, ["gram", "content"]).where(F.struct("doc", "a") != F.col("first"))
    phrase = Window.partitionBy("gram", "phrase").orderBy("k")
    goes_on = (F.col("k") == F.lag("k").over(phrase) + 1) & (F.col("first.doc") == F.lag("first.doc").over(phrase)) & (F.col("first.a") == F.lag("first.a").over(phrase) + 1)
    placed = late.select("gram", "phrase", "k", "shard", "doc", "a", F.col("first.doc").alias("first_doc"), F.col("first.a").alias("first_a"), F.coalesce(goes_on, F.lit(False)).alias("on"))
    runs = placed.withColumn("run", F.sum(F.when(F.col("on"), 0).otherwise(1)).over(phrase))
    heads = {"k": F.min("k"), "shard": F.min("shard"), "doc": F.min("doc"), "a": F.min("a"), "n": F.count(F.lit(1)).cast("int"), "first_doc": F.min("first_doc"), "first_a": F.min("first_a")}
    return runs.groupBy("gram", "phrase", "run").agg(*(v.alias(n) for n, v in heads.items())).select(*LATE_NAMES)


def late_in_groups(parts: DataFrame, spec: Spec) -> DataFrame:
    """LATE rows of phrases of triggers that aren't hot. Parts of one trigger meet in one partition, sorted, and are taken
    by whole groups of about SORTED_BYTES."""

    def settle(table: pa.Table) -> pa.Table:
        content = table["content"].combine_chunks().cast(pa.large_binary())
        offsets = np.frombuffer(content.buffers()[1], np.int64)[content.offset : content.offset + len(content) + 1]
        data = np.frombuffer(content.buffers()[2], np.uint8)
        n = table["n"].to_numpy().astype(np.int64)
        gram = table["gram"].to_numpy()
        group = np.cumsum(np.concatenate([[0], gram[1:] != gram[:-1]]))
        owner = np.repeat(np.arange(len(n)), n)
        step = np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n)
        which, cls = equal_suffixes(data, offsets[owner] + step * spec.stored, group[owner], spec.width, spec.stored)
        doc, at = table["doc"].to_numpy()[owner[which]], (table["a"].to_numpy()[owner] + step)[which]
        order = np.lexsort((at, doc, cls))
        which, cls, doc, at = which[order], cls[order], doc[order], at[order]
        head = np.flatnonzero(np.concatenate([[True], cls[1:] != cls[:-1]])[: len(cls)])
        size = np.diff(np.concatenate([head, [len(cls)]]))
        first_doc, first_at = np.repeat(doc[head], size), np.repeat(at[head], size)
        late = np.ones(len(cls), bool)
        late[head] = False
        order = np.argsort(which[late])
        which, doc, at, first_doc, first_at = (x[late][order] for x in (which, doc, at, first_doc, first_at))
        # Neighbouring windows of one phrase whose first places are neighbours too make one row.
        near = (which[1:] == which[:-1] + 1) & (owner[which[1:]] == owner[which[:-1]]) & (first_doc[1:] == first_doc[:-1]) & (first_at[1:] == first_at[:-1] + 1)
        head = np.flatnonzero(np.concatenate([[True], ~near])[: len(which)])
        size = np.diff(np.concatenate([head, [len(which)]]))
        part = owner[which[head]]
        name, shard = table["phrase"].to_numpy()[part], table["shard"].to_numpy()[part]
        k = table["k"].to_numpy()[part] + step[which[head]]
        return _rows(LATE_TYPES, LATE_NAMES, gram[part], name, k, shard, doc[head], at[head], size, first_doc[head], first_at[head])

    @freed
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        size = 0
        for batch in batches:
            held.append(pa.Table.from_batches([batch]))
            size += batch.nbytes
            if size > SORTED_BYTES:
                table = pa.concat_tables(held)
                gram = table["gram"].to_numpy()
                other = np.flatnonzero(gram != gram[-1])
                cut = int(other[-1]) + 1 if len(other) else 0  # the last group may go on
                if cut:
                    yield from to_batches(settle(table.slice(0, cut)), 50_000)
                held, size = [table.slice(cut)], (table.num_rows - cut) * table.nbytes // table.num_rows
        if held and (table := pa.concat_tables(held)).num_rows:
            yield from to_batches(settle(table), 50_000)

    return parts.repartition("gram").sortWithinPartitions("gram").mapInArrow(run, LATE)


def repeated_phrases(rows: DataFrame, spec: Spec, steps: Steps) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(found, phrases, late): FOUND rows, the dictionary, and LATE rows of its windows. Each step is written and read
    again; steps that no later one reads are deleted."""
    grams = steps.write(count_grams(rows, spec), "grams")
    wanted = steps.write(recurring(grams), "recurring")
    steps.drop("grams")
    found = steps.write(find_phrases(rows, wanted, spec), "found", FOUND)
    steps.drop("recurring")
    phrases = steps.write(dictionary(found.where(F.col("kind") == OPEN)), "phrases")
    opened = steps.write(various(phrases), "opened")
    contents = steps.write(phrase_contents(rows, opened, spec), "contents", CONTENTS)
    steps.drop("opened")
    late = steps.write(late_windows(contents, spec), "late", LATE)
    steps.drop("contents")
    return found, phrases, late


def covered(doc: np.ndarray, offsets: np.ndarray, spans: pa.Table) -> np.ndarray:
    """Mask over the flat units of rows (by rising doc) that the spans (doc, a, n) cover."""
    size = int(offsets[-1])
    if not spans.num_rows or not size:
        return np.zeros(size, bool)
    start = offsets[np.searchsorted(doc, spans["doc"].to_numpy())] + spans["a"].to_numpy()
    edge = np.bincount(start, minlength=size + 1).astype(np.int64) - np.bincount(start + spans["n"].to_numpy(), minlength=size + 1)
    return np.cumsum(edge)[:size] > 0


def merge_spans(doc: np.ndarray, a: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Union of spans per document: maximal runs, sorted. Spans that touch become one."""
    if not len(doc):
        return doc, a, n
    order = np.lexsort((a, doc))
    doc, a, end = doc[order], a[order], (a + n)[order]
    # Running furthest end within a document: ends are offset by a stride per document so that one scan does.
    number = np.cumsum(np.concatenate([[0], doc[1:] != doc[:-1]]))
    stride = np.int64(end.max() + 1)
    far = np.maximum.accumulate(end + number * stride) - number * stride
    fresh = np.concatenate([[True], (doc[1:] != doc[:-1]) | (a[1:] > far[:-1])])
    first = np.flatnonzero(fresh)
    last = np.concatenate([first[1:], [len(doc)]]) - 1
    return doc[first], a[first], far[last] - a[first]
