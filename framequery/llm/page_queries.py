"""Query of the page extraction (9). SQL can't parse pages; tests compare with pages of known text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framequery.llm.pages import extract_main_text


def op9_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return extract_main_text(pages).select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


QUERIES = {"op9_main_text": op9_main_text}
SQL: dict[str, str] = {}
