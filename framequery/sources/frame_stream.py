"""Captures as a stream of frames: a plan of frame ranges in small files, of which a trigger takes a few.

The plan is a folder of Parquet files, so Spark's file source keeps the offsets, admits a bounded number of files a
trigger, and starts again from a checkpoint where it was. Tasks read the frames of their ranges from the captures.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from framequery.sources.ser import FRAME_SCHEMA, read_frames

PLAN = "path string, first int, last int"
#: Bytes of frames that a task hands on at a time.
BATCH = 8 << 20


def frame_ranges(headers: DataFrame, frames_per_range: int) -> DataFrame:
    """(path, first, last) of consecutive ranges [first, last) of each capture's readable frames. headers: rows of
    ser.HEADER_SCHEMA; captures without a frame have no range."""
    first = F.explode(F.sequence(F.lit(0), F.col("readable_frames") - 1, F.lit(frames_per_range)))
    ranges = headers.where("readable_frames > 0").select("path", first.alias("first"), "readable_frames")
    return ranges.select("path", "first", F.least(F.col("first") + frames_per_range, F.col("readable_frames")).cast("int").alias("last"))


def add_to_plan(ranges: DataFrame, folder: str, ranges_per_file: int = 1) -> None:
    """Append ranges of captures that the plan doesn't have yet, at most ranges_per_file to a file."""
    spark = ranges.sparkSession
    try:
        known = spark.read.schema(PLAN).parquet(folder).select("path").distinct()
        ranges = ranges.join(known, "path", "left_anti")
    except Exception as e:  # the folder isn't there before the first plan
        if "PATH_NOT_FOUND" not in str(e):
            raise
    ranges.select("path", "first", "last").write.mode("append").option("maxRecordsPerFile", ranges_per_file).parquet(folder)


def frame_stream(spark: SparkSession, folder: str, files_per_trigger: int = 32) -> DataFrame:
    """Frames (ser.FRAME_SCHEMA) of the plan as a stream: files_per_trigger bounds what a trigger takes to so many files'
    ranges, so a capture of any length passes in bounded steps. Each range is one task's at most."""
    schema = to_arrow_schema(StructType.fromDDL(FRAME_SCHEMA))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, first, last in zip(*(batch.column(n).to_pylist() for n in ("path", "first", "last")), strict=True):
                rows, size = [], 0
                for row in read_frames(path, first, last):
                    rows.append(row)
                    size += len(row[-1])
                    if size >= BATCH:
                        yield table(rows)
                        rows, size = [], 0
                if rows:
                    yield table(rows)

    def table(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    plan = spark.readStream.schema(PLAN).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)
    return plan.mapInArrow(run, FRAME_SCHEMA)
