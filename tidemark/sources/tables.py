"""Tables of a data folder, one Parquet file or folder each."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidemark.session import ship_package


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """``{folder}/{name}.parquet``; filters and column selections reach the scan."""
    ship_package(spark)
    return spark.read.parquet(f"{folder}/{name}.parquet")
