"""Steps of an operator: tables in the shared folder that later steps read, deleted as soon as none needs them."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

from framequery.llm.token_files import shared_folder

CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def finished_steps_leave_no_shuffle(spark: SparkSession) -> Iterator[None]:
    """Within, Spark deletes an execution's shuffle files when it has ended: each step writes what later ones read."""
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(CLEANUP)
        else:
            spark.conf.set(CLEANUP, before)


class Steps:
    """Writes steps as Parquet in the shared folder, so that a lost executor costs a re-read, and drops them by name."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.paths: dict[str, str] = {}

    def write(self, df: DataFrame, name: str, schema: str | None = None) -> DataFrame:
        path = shared_folder(self.spark, name)
        with finished_steps_leave_no_shuffle(self.spark):
            df.write.parquet(path)
        self.paths[name] = path
        return self.spark.read.schema(schema or df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        """Delete steps that no later step reads."""
        context = self.spark.sparkContext
        for name in names:
            path = context._jvm.org.apache.hadoop.fs.Path(self.paths.pop(name))
            path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)
