"""Reading the parquet tables of one scale directory."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, base: str, name: str, *columns: str) -> DataFrame:
    """``{base}/{name}.parquet`` (a file or a folder), narrowed to ``columns`` if any are given."""
    df = spark.read.parquet(f"{base.rstrip('/')}/{name}.parquet")
    return df.select(*columns) if columns else df
