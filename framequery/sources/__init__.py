"""Data sources: SER captures and FITS images."""

from __future__ import annotations

from pyspark.sql import SparkSession


def register(spark: SparkSession) -> None:
    """Make "ser" and "fits" known to spark.read."""
    from framequery.sources.fits import FitsDataSource
    from framequery.sources.ser import SerDataSource

    spark.dataSource.register(SerDataSource)
    spark.dataSource.register(FitsDataSource)
