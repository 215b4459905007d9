"""Query of the toxicity chain (8). SQL can't fit it; tests measure it on held-out labels."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framequery.llm.toxicity import toxic_verdicts


def op8_toxicity_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return toxic_verdicts(docs, labels).select("doc_id", F.round("p_low_quality", 6).alias("p_low_quality"), F.round("p_toxic", 6).alias("p_toxic"), "toxic")


QUERIES = {"op8_toxicity_chain": op8_toxicity_chain}
SQL: dict[str, str] = {}
