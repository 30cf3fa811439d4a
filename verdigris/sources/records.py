"""JSON sources: one record a line, or one document a file."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Records of JSONL files by a stated schema (no pass to infer one); blank lines are skipped, a malformed line fails the read."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def json_documents(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Files that each hold one JSON value over many lines; an array gives a row per element."""
    return spark.read.schema(schema).option("mode", "FAILFAST").option("multiLine", True).json(path)
