"""Fill-in-the-middle: texts cut in three at units of their own, reordered between marks, and put together again."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framequery.llm.words import rebatched

SCHEMA = "n long, form string, prefix_units long, middle_units long, prefix_chars long, middle_chars long, output string"
BLANKS = b"\t\n\v\f\r "


def _class(members: Callable[[int], bool]) -> bytes:
    """A translation of bytes to 1 where they belong to a class, else to 0."""
    return bytes(1 if members(b) else 0 for b in range(256))


#: Bytes that start a code point in UTF-8; bytes of words; ends of lines.
LEADS, INK, BREAKS = _class(lambda b: b & 0xC0 != 0x80), _class(lambda b: b not in BLANKS), _class(lambda b: b == 10)


def class_mask(raw: bytes, table: bytes) -> int:
    """A big integer with bit 8 i set where byte i is of the class."""
    return int.from_bytes(raw.translate(table), "little")


def code_point_starts(raw: bytes) -> int:
    return class_mask(raw, LEADS)


def word_starts(raw: bytes) -> int:
    """A unit is a word with the blanks after it; blanks before the first word belong to it."""
    ink = class_mask(raw, INK)
    starts = ink & ~(ink << 8)
    return starts ^ (starts & -starts) | 1 if raw else 0  # the first start moves to the text's start


def line_starts(raw: bytes) -> int:
    """A unit is a line with its end."""
    return (class_mask(raw, BREAKS) << 8 | 1) & ((1 << 8 * len(raw)) - 1)


UNITS = {"code_points": code_point_starts, "words": word_starts, "lines": line_starts}


def place(starts: int, size: int, k: int) -> int:
    """The byte at which unit k (from 0) starts, or size if there are only k units: halves are counted and the one
    that holds the bit is halved again, so all steps together read the mask twice."""
    if k >= starts.bit_count():
        return size
    at = 0
    while size > 1:
        half = size >> 1
        low = starts & ((1 << 8 * half) - 1)
        before = low.bit_count()
        if k < before:
            starts, size = low, half
        else:
            k, starts, at, size = k - before, starts >> 8 * half, at + half, size - half
    return at


@dataclass(frozen=True)
class Marks:
    """What goes before prefix, suffix and middle. None may be empty, or overlap another or itself: texts that hold a
    mark stay plain, so every mark in another text's output is one that was put there."""

    prefix: str = "<P>"
    suffix: str = "<S>"
    middle: str = "<M>"

    def __post_init__(self) -> None:
        every = (self.prefix, self.suffix, self.middle)
        for i, a in enumerate(every):
            for j, b in enumerate(every):
                if not a or (i != j and a in b) or any(a.endswith(b[:k]) for k in range(1, len(b))):
                    raise ValueError(f"marks {a!r} and {b!r} can overlap")


def fill_in_middle(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", unit: str = "code_points", seed: int = 1, rate: int = 90, suffix_first: int = 20, marks: Marks = Marks()
) -> DataFrame:
    """Each text cut after two random numbers of units and written as prefix, suffix, middle (psm) or suffix, prefix,
    middle (spm), one map without a shuffle.

    h1 to h4 are the first four 8-digit groups of the hex sha256 of `<seed>:<id>`. The cuts come after h1 % (n + 1) and
    h2 % (n + 1) of the n units, the smaller first. h3 % 100 >= rate leaves a text plain, as do an empty text and one
    with a mark in it; h4 % 100 < suffix_first makes it spm. unit: code_points, words (a word with the blanks after it)
    or lines.

    Returns id_col, n, form, prefix_units, middle_units, prefix_chars and middle_chars (code points; the four NULL if
    plain) and output, one row for each row; other columns aren't read, so none can clash. A NULL text is empty, a NULL
    id the empty string; equal ids cut alike. Texts are held one at a time, with masks of their size.
    """
    starts_of, seen = UNITS[unit], re.compile("|".join(map(re.escape, (marks.prefix, marks.suffix, marks.middle))).encode())
    p, s, m = marks.prefix.encode(), marks.suffix.encode(), marks.middle.encode()
    out_type = pa.schema([("k", pa.string()), ("n", pa.int64()), ("form", pa.string()), *((c, pa.int64()) for c in ("prefix_units", "middle_units", "prefix_chars", "middle_chars")), ("output", pa.string())])

    def one(key: str | None, raw: bytes) -> tuple:
        starts = starts_of(raw)
        n = starts.bit_count()
        digest = hashlib.sha256(f"{seed}:{key or ''}".encode()).digest()
        h1, h2, h3, h4 = (int.from_bytes(digest[k : k + 4]) for k in (0, 4, 8, 12))
        if not raw or h3 % 100 >= rate or seen.search(raw):
            return n, "plain", None, None, None, None, raw
        first, last = sorted((h1 % (n + 1), h2 % (n + 1)))
        a, b = place(starts, len(raw), first), place(starts, len(raw), last)
        prefix, middle, suffix = raw[:a], raw[a:b], raw[b:]
        form = "spm" if h4 % 100 < suffix_first else "psm"
        output = b"".join((s, suffix, p, prefix, m, middle) if form == "spm" else (p, prefix, s, suffix, m, middle))
        chars = (first, last - first) if unit == "code_points" else tuple(code_point_starts(x).bit_count() for x in (prefix, middle))
        return n, form, first, last - first, *chars, output

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in rebatched(batches, 8 << 20):
            texts = table.column(1).cast(pa.binary())
            rows = [one(k.as_py(), t.as_py() or b"") for k, t in zip(table.column(0), texts, strict=True)]
            columns = list(zip(*rows, strict=True))
            arrays = [pa.array(c, f.type) for c, f in zip(columns[:-1], list(out_type)[1:-1], strict=True)]
            output = pa.array(columns[-1], pa.binary()).cast(pa.string())
            yield pa.RecordBatch.from_arrays([table.column(2).combine_chunks(), *arrays, output], names=["id", *out_type.names[1:]])

    id_type = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).cast("string").alias("k"), F.col(text_col).alias("text"), F.col(id_col).alias("id"))
    return rows.mapInArrow(run, f"id {id_type}, {SCHEMA}").withColumnRenamed("id", id_col)


def restored(output: Column, form: Column, marks: Marks = Marks()) -> Column:
    """The text that was cut: the three parts between the marks, in their first order."""
    parts = F.split(output, "|".join(rf"\Q{m}\E" for m in (marks.prefix, marks.suffix, marks.middle)), -1)
    psm, spm = F.concat(parts[1], parts[3], parts[2]), F.concat(parts[2], parts[3], parts[1])
    return F.when(form == "plain", output).when(form == "psm", psm).otherwise(spm)
