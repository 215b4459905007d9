"""A corpus pipeline of the text operators: each stage's documents are written as Parquet and read by the next."""

from __future__ import annotations

import functools
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framequery.llm import bpe, decontaminate, passages, simhash, token_files, toxicity

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def columns_apart(stage: Stage) -> Stage:
    """stage with columns beside doc_id, text and n_chars under names of their own, so that they can't clash with its results."""

    @functools.wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        names = {c: f"_carried{k}" for k, c in enumerate(docs.columns) if c not in ("doc_id", "text", "n_chars")}
        out = stage(spark, docs.withColumnsRenamed(names), sf_dir)
        return out.withColumnsRenamed({own: c for c, own in names.items()})

    return run


@columns_apart
def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier chain rejects go."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return toxicity.toxic_verdicts(docs, labels).where(~F.col("toxic")).select(docs.columns)


def keyed(docs: DataFrame) -> DataFrame:
    """docs with a key of each id and text, as ids can be missing or repeated. Never NULL."""
    return docs.withColumn("_row", F.xxhash64("doc_id", "text"))


@columns_apart
def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the row of least id stays, once; one without an id only where none has one."""
    rows = keyed(docs)
    groups = simhash.near_duplicates(rows, id_col="_row").select("_row", "component_id").distinct()
    ids = rows.select("_row", "doc_id").distinct()
    least = F.min(F.struct(F.col("doc_id").isNull().alias("missing"), "doc_id", "_row"))
    keepers = groups.join(ids, "_row").groupBy("component_id").agg(least.alias("k")).select("k._row")
    return rows.join(keepers, "_row", "left_semi").dropDuplicates(["_row"]).select(docs.columns)


@columns_apart
def remove_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words in 20-word windows that an earlier document has are cut from the texts."""
    carry = tuple(c for c in docs.columns if c not in ("doc_id", "text", "n_chars"))
    cut = passages.remove_passages(docs, carry=carry).withColumnRenamed("kept", "text")
    return cut.withColumn("n_chars", F.length("text").cast("long")).select(docs.columns)


@columns_apart
def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a verified passage of the benchmark go."""
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    rows = keyed(docs)
    found = token_files.written(decontaminate.contaminated(rows, items, id_col="_row").select("_row").distinct(), "contaminated")
    return rows.join(found, "_row", "left_anti").select(docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The ids of each kept document and the text they decode to."""
    return bpe.encode_decode(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash_near_dedup", drop_near_duplicates),
    ("substring_dedup", remove_passages),
    ("decontamination", drop_contaminated),
    ("bpe", encode),
]
#: The stages hold iterative and learnt steps that SQL can't express; tests compare them with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        if k == len(STAGES) - 1:
            return out
        docs = token_files.written(out, f"pipeline-{k}-{name}")
    return docs
