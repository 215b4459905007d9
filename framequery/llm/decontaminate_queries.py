"""Query of the decontamination (3). Tests compare it with brute force over all pairs of a fixture."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framequery.llm.decontaminate import contaminated


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return contaminated(docs, items).withColumn("score", F.round("score", 6))


QUERIES = {"op3_decontamination": op3_decontamination}
SQL: dict[str, str] = {}
