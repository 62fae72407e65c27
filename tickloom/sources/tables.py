"""Parquet tables of one directory."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, directory: str, name: str, *columns: str) -> DataFrame:
    """Scan ``directory/name.parquet``, only ``columns`` where some are named."""
    df = spark.read.parquet(f"{directory}/{name}.parquet")
    return df.select(*columns) if columns else df
