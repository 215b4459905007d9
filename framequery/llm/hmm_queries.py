"""Query of the hidden Markov language model (1). SQL can't train it; tests compare with direct sums over paths."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from framequery.llm.hmm import score_texts


def op1_hmm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_texts(spark.read.parquet(f"{sf_dir}/documents.parquet"))


QUERIES = {"op1_hmm_score": op1_hmm_score}
SQL: dict[str, str] = {}
