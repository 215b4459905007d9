"""Query of the spelling variants (11). DuckDB has no crc32, so there is no oracle; tests compare it with brute force."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from framequery.llm.variants import spelling_variants


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants(spark.read.parquet(f"{sf_dir}/documents.parquet"))


QUERIES = {"op11_spelling_variants": op11_spelling_variants}
SQL: dict[str, str] = {}
