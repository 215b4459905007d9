"""Rows without ids that link others, and equal rows in great number."""

import random

import numpy as np
from pyspark.sql import functions as F

from framequery.llm import byte_repeats, hmm, repeats, simhash


def test_op5_rows_without_ids_link_others(spark, monkeypatch):
    """1 and 2 differ by six bits; a row without an id lies between them. Another component has no id at all."""
    prints = [(1, 0b000000), (None, 0b000111), (2, 0b111111), (None, 0xFF << 40), (None, (0xFF << 40) | 1), (9, 1 << 62 | 0xFFFF0000), (9, 1 << 62 | 0xFFFF0000)]
    rows = spark.createDataFrame([(i, str(fp)) for i, fp in prints], "doc_id long, text string")
    monkeypatch.setattr(simhash, "fingerprints", lambda docs, words, id_col, text_col: docs.select(id_col, F.col(text_col).cast("long").alias("fp")))
    got = sorted(((r.doc_id, r.fp, r.component_id) for r in simhash.near_duplicates(rows).collect()), key=str)

    def near(a, b):
        return bin(a ^ b).count("1") <= 3

    fps = sorted({fp for _, fp in prints})
    reach = {fp: {fp} for fp in fps}
    for _ in fps:
        reach = {fp: set().union(*({g} | reach[g] for g in fps if any(near(g, h) for h in seen))) for fp, seen in reach.items()}
    want = [(i, fp, min((j for j, other in prints if j is not None and other in reach[fp]), default=None)) for i, fp in prints]
    assert got == sorted(want, key=str)
    assert {r[2] for r in got if r[0] in (1, 2)} == {1}


def test_op1_equal_rows_are_dealt_over_shards(spark, monkeypatch):
    monkeypatch.setattr(hmm, "SHARD_BYTES", 2000)
    text = "one text that is there again and again"
    docs = spark.createDataFrame([(None, text)] * 1500 + [(k, f"text number {k} of its own") for k in range(50)], "doc_id long, text string").repartition(4)
    seen = {}
    real = hmm.written

    def spy(df, name, *rest):
        out = real(df, name, *rest)
        seen[name] = out
        return out

    monkeypatch.setattr(hmm, "written", spy)
    got = hmm.score_texts(docs, states=2, rounds=1).where(F.col("doc_id").isNull()).agg(F.count(F.lit(1)), F.countDistinct("score"), F.countDistinct("n_known")).first()
    assert tuple(got) == (1500, 1, 1)
    sizes = np.array([r["count"] for r in seen["numbered"].groupBy("shard").count().collect()])
    assert len(sizes) > 20 and sizes.max() < 4 * sizes.mean()


def test_a_window_that_many_phrases_share_is_in_no_group(spark, monkeypatch):
    """3,000 documents with one passage between texts of their own: its windows are aggregated, never sorted together."""
    monkeypatch.setattr(repeats, "HOT_PHRASES", 200)
    rnd = random.Random(4)
    passage = "".join(rnd.choice("abcdefgh ") for _ in range(120))
    own = [["".join(rnd.choice("klmnopqr ") for _ in range(60)) for _ in range(2)] for _ in range(3000)]
    docs = spark.createDataFrame([(k, f"{a}{passage}{b}") for k, (a, b) in enumerate(own)], "doc_id long, text string").repartition(4)
    seen = {}
    real = repeats.late_windows

    def spy(contents, spec):
        seen["hot"] = contents.where("hot = 1").count()
        seen["group"] = contents.where("hot = 0").groupBy("gram").count().agg({"count": "max"}).first()[0] or 0
        return real(contents, spec)

    monkeypatch.setattr(repeats, "late_windows", spy)
    got = {r.doc_id: bytes(r.kept) for r in byte_repeats.remove_repeated_bytes(docs).collect()}
    known, want = set(), {}
    for k, (a, b) in enumerate(own):
        data = f"{a}{passage}{b}".encode()
        gone = bytearray(len(data))
        for at in range(len(data) - 99):
            if data[at : at + 100] in known:
                gone[at : at + 100] = b"\1" * 100
            known.add(data[at : at + 100])
        want[k] = bytes(x for x, g in zip(data, gone) if not g)
    assert got == want and len(want[0]) == 240 and max(len(want[k]) for k in range(1, 3000)) <= 120
    assert seen["hot"] > 3000 and seen["group"] <= 200
