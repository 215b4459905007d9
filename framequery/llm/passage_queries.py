"""Queries of the repeated windows of bytes (2) and words (10). Tests compare both with brute force."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from framequery.llm.byte_repeats import remove_repeated_bytes
from framequery.llm.passages import remove_passages


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_passages(spark.read.parquet(f"{sf_dir}/documents.parquet"), digests=True)


def op2_byte_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeated_bytes(spark.read.parquet(f"{sf_dir}/documents.parquet"), digests=True)


QUERIES = {"op2_byte_dedup": op2_byte_dedup, "op10_substring_dedup": op10_substring_dedup}
SQL: dict[str, str] = {}
