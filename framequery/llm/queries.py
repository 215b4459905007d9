"""All queries of the text operators, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from framequery.llm import chat_queries, decontaminate_queries, fim_queries, hmm_queries, page_queries, passage_queries, quality_queries, simhash_queries, tokenizer_queries, toxicity_queries, variant_queries

_MODULES = (hmm_queries, decontaminate_queries, tokenizer_queries, simhash_queries, quality_queries, toxicity_queries, page_queries, passage_queries, variant_queries, fim_queries, chat_queries)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: run for m in _MODULES for name, run in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in _MODULES for name, sql in m.SQL.items()}
