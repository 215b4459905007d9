"""Fill-in-the-middle against plain Python over code points."""

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from framequery.llm import fim

SCHEMA = "doc_id long, text string, n string, form string, output string, k string"


def brute(i, text, marks=("<P>", "<S>", "<M>"), rate=90, suffix_first=20, seed=1):
    text = text or ""
    d = hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(d[k : k + 8], 16) for k in (0, 8, 16, 24))
    n = len(text)
    if not text or any(m in text for m in marks) or h3 % 100 >= rate:
        return n, "plain", None, None, text
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = text[:a], text[a:b], text[b:]
    P, S, M = marks
    if h4 % 100 < suffix_first:
        return n, "spm", a, b - a, S + s + P + p + M + m
    return n, "psm", a, b - a, P + p + S + s + M + m


@pytest.fixture(scope="module")
def rows():
    rnd = random.Random(3)
    texts = [None, "", "a", "é", "🙂", "a<P>b", "<S>", "x<M>", "<<P", "<S", "P>", "\x00\x00b", "long é " * 50_000, "\n\n", " "]
    texts += ["".join(rnd.choice("abé日🙂\n <PSM>") for _ in range(rnd.randint(1, 300))) for _ in range(300)]
    return list(enumerate(texts)) + [(5, texts[30]), (5, texts[30]), (None, "no id é"), (None, "no id é")]


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "clash", "clash", "clash", "clash") for i, t in rows], SCHEMA).repartition(3)


def test_equals_brute_force_and_restores(spark, rows):
    cut = fim.fill_in_middle(frame(spark, rows))
    got = sorted(map(repr, (tuple(r) for r in cut.select("doc_id", "n", "form", "prefix_chars", "middle_chars", "output").collect())))
    assert got == sorted(repr((i, *brute(i, t))) for i, t in rows)
    forms = {brute(i, t)[1] for i, t in rows}
    assert forms == {"plain", "psm", "spm"}
    back = cut.select("doc_id", fim.restored(F.col("output"), F.col("form")).alias("text")).collect()
    assert sorted(map(repr, ((r.doc_id, r.text) for r in back))) == sorted(repr((i, t or "")) for i, t in rows)


def test_other_parameters(spark, rows):
    marks = fim.Marks("[PRE]", "[SUF]", "[MID]")
    cut = fim.fill_in_middle(frame(spark, rows), rate=100, suffix_first=100, seed=9, marks=marks)
    got = {repr((r.doc_id, r.output)) for r in cut.collect()}
    assert got == {repr((i, brute(i, t, ("[PRE]", "[SUF]", "[MID]"), 100, 100, 9)[-1])) for i, t in rows}
    back = {repr((r.doc_id, r.text)) for r in cut.select("doc_id", fim.restored(F.col("output"), F.col("form"), marks).alias("text")).collect()}
    assert back == {repr((i, t or "")) for i, t in rows}
    for bad in (("", "a", "b"), ("<a", "a", "b"), ("ab", "ba", "c"), ("aa", "b", "c"), ("x", "x", "y")):
        with pytest.raises(ValueError):
            fim.Marks(*bad)


@pytest.mark.parametrize("unit, pattern", [("words", r"^[\t-\r ]+[^\t-\r ]*[\t-\r ]*|[^\t-\r ]+[\t-\r ]*"), ("lines", r"[^\n]*\n|[^\n]+$")])
def test_words_and_lines(spark, rows, unit, pattern):
    for r in fim.fill_in_middle(frame(spark, rows), unit=unit, rate=100).collect():
        if r.form == "plain":
            continue
        text = fim_text(r)
        units = re.findall(pattern, text)
        assert "".join(units) == text and r.n == len(units)
        prefix, middle = "".join(units[: r.prefix_units]), "".join(units[r.prefix_units : r.prefix_units + r.middle_units])
        assert (r.prefix_chars, r.middle_chars) == (len(prefix), len(middle))
        assert r.output.endswith(f"<M>{middle}") and f"<P>{prefix}<" in r.output


def fim_text(r):
    parts = re.split("<[PSM]>", r.output)
    return parts[1] + parts[3] + parts[2] if r.form == "psm" else parts[2] + parts[3] + parts[1]


def test_places_by_halving():
    rnd = random.Random(1)
    for size in (1, 2, 3, 17, 64, 257):
        bits = [rnd.random() < 0.3 for _ in range(size)]
        mask = sum(1 << 8 * k for k, b in enumerate(bits) if b)
        at = [k for k, b in enumerate(bits) if b]
        assert [fim.place(mask, size, k) for k in range(len(at) + 1)] == [*at, size]


def test_nothing_to_cut(spark):
    assert fim.fill_in_middle(frame(spark, [])).count() == 0
    (row,) = fim.fill_in_middle(frame(spark, [(None, None)])).collect()
    assert (row.n, row.form, row.output) == (0, "plain", "")
