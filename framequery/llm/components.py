"""Connected components of a graph that may be far larger than any machine, by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framequery.llm.token_files import shared_root


def checkpointed(df: DataFrame) -> DataFrame:
    """df cut from its lineage by a checkpoint in the folder that all executors share."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_root(df.sparkSession))
    return df.checkpoint()


def _stars(edges: DataFrame, large: bool) -> DataFrame:
    """One contraction. Rows (a, b) with a > b; only minima per node are aggregated, so hubs are combined map-side.

    large: every neighbour above a node moves to the least of the node and its neighbours.
    small: a node and its lesser neighbours move to the least of them.
    """
    if large:
        both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
    else:
        both = edges.select(F.col("a").alias("u"), F.col("b").alias("v"))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    joined = both.join(least, "u")
    if large:
        moved = joined.where(F.col("v") > F.col("u")).select(F.col("v").alias("a"), F.col("m").alias("b"))
    else:
        moved = joined.select(F.col("v").alias("a"), F.col("m").alias("b")).unionByName(least.select(F.col("u").alias("a"), F.col("m").alias("b")))
    return moved.where(F.col("a") != F.col("b")).distinct()


def connected_components(edges: DataFrame, max_rounds: int = 50) -> DataFrame:
    """edges (a long, b long) -> (node, component): the least node that each node of an edge reaches.

    Rounds end when a round of both contractions leaves the edges as they were; edges are then stars around the
    components' least nodes. Self-links and repeated links do no harm; an empty graph gives no rows.
    """
    ordered = edges.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    now = checkpointed(ordered)
    sign = F.struct(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)")))
    before = now.agg(sign).first()[0]
    for _ in range(max_rounds):
        now = checkpointed(_stars(_stars(now, True), False))
        after = now.agg(sign).first()[0]
        if after == before:
            break
        before = after
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    stars = now.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return stars.unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())


def empty_edges(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], "a long, b long")
