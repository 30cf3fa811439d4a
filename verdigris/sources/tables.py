"""Readers for the named parquet tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """``folder/name.parquet`` through Spark's reader, so any store works."""
    return spark.read.parquet(f"{folder}/{name}.parquet")
