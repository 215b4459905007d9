"""Query catalogue of the frame operators: name -> (callable, DuckDB SQL or None)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from framequery.plans import continuous_queries, folder_queries, frame_queries, geometry_queries, mosaic_queries, pixel_queries, planning_queries, rule_queries, stack_queries, stat_queries, store_queries, stream_queries, watch_queries, writer_queries

_MODULES = (frame_queries, stack_queries, stat_queries, rule_queries, pixel_queries, planning_queries, mosaic_queries, stream_queries, watch_queries, writer_queries, continuous_queries, geometry_queries, folder_queries, store_queries)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: run for module in _MODULES for name, (run, _) in module.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for module in _MODULES for name, (_, sql) in module.QUERIES.items() if sql}
