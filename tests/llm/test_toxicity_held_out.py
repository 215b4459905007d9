"""The classifier chain on rows it hasn't seen, on very long texts and on ties."""

import numpy as np
from pyspark.sql import functions as F

from framequery.llm import toxicity

SF = "/root/testdata/sf0.1"


def test_held_out_precision_and_recall(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    unseen = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(3)) == 0
    got = toxicity.toxic_verdicts(docs, labels.where(~unseen)).join(labels.where(unseen).select("doc_id", F.col("toxic").alias("truth")), "doc_id")
    rows = got.groupBy("truth", "toxic").count().collect()
    n = {(r.truth, r.toxic): r["count"] for r in rows}
    found, missed, wrong = n.get((1, True), 0), n.get((1, False), 0), n.get((0, True), 0)
    print(f"found {found}, missed {missed}, wrong {wrong}")
    assert found + missed > 50
    assert found / (found + wrong) >= 0.92 and found / (found + missed) >= 0.92


def test_long_texts_and_ties(spark):
    rng = np.random.default_rng(8)
    word = lambda k: f"w{k}"
    rows = [(k, " ".join(map(word, rng.integers(0, 50, 20))) + (" vile" if k % 4 == 0 else "")) for k in range(200)]
    long = " ".join(map(word, rng.integers(0, 50, 300_000)))
    rows += [(1000, long), (1001, long), (1002, long + " vile"), (1003, rows[4][1]), (1004, rows[4][1])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    labels = spark.createDataFrame([(k, 1, int(k % 4 == 0)) for k in range(200)], "doc_id long, quality int, toxic int")
    model = toxicity.train_chain(docs, labels, toxicity.label_categories())
    got = {r.doc_id: r.p_toxic for r in toxicity.score_chain(docs, model).collect()}
    assert len(got) == len(rows) and all(0 < p < 1 for p in got.values())
    # Equal texts tie; a long text has the same value whatever rows it shares a batch with.
    assert got[1000] == got[1001] and got[1003] == got[1004] == got[4]
    alone = toxicity.score_chain(docs.where("doc_id = 1002").coalesce(1), model).first()
    assert alone.p_toxic == got[1002] >= got[1000]
    assert np.mean([(got[k] >= 0.35) == (k % 4 == 0) for k in range(200)]) > 0.95
