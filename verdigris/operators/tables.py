"""Upserts, merges and incremental loads as set operations on whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def upsert(old: DataFrame, new: DataFrame, keys: list[str], order: str | None = None) -> DataFrame:
    """Old rows replaced by new ones with the same keys; the last in ``order`` wins among the new."""
    if order:
        n = F.row_number().over(W.partitionBy(*keys).orderBy(F.desc(order)))
        new = new.withColumn("_n", n).where("_n = 1").drop("_n")
    return old.join(new.select(*keys), keys, "left_anti").select(*old.columns).unionByName(new.select(*old.columns))


def insert_missing(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Old rows and new ones whose keys are not there yet."""
    return old.unionByName(new.dropDuplicates(keys).join(old.select(*keys), keys, "left_anti").select(*old.columns))


def merge_edges(old: DataFrame, new: DataFrame) -> DataFrame:
    """(prerequisite, concept, confidence, evidence): the larger confidence, the newer evidence."""
    both = old.withColumn("_age", F.lit(0)).unionByName(new.withColumn("_age", F.lit(1)))
    return both.groupBy("prerequisite", "concept").agg(F.max("confidence").alias("confidence"), F.max_by("evidence", F.struct("_age", "evidence")).alias("evidence"))


def strongest(rows: DataFrame, keys: list[str], value: str, seq: str) -> DataFrame:
    """One row per keys: the largest value, the first of equals."""
    n = F.row_number().over(W.partitionBy(*keys).orderBy(F.desc(value), seq))
    return rows.withColumn("_n", n).where("_n = 1").drop("_n")


def load_plan(stored: DataFrame, fresh: DataFrame) -> DataFrame:
    """(source_file, action): skip files whose chunk count is as stored, replace those that differ, insert others."""
    old = stored.groupBy("source_file").agg(F.count("*").alias("old"))
    new = fresh.groupBy("source_file").agg(F.count("*").alias("new"))
    both = new.join(old, "source_file", "left")
    return both.select("source_file", F.when(F.col("old").isNull(), "insert").when(F.col("old") == F.col("new"), "skip").otherwise("replace").alias("action"))


def apply_load(stored: DataFrame, fresh: DataFrame) -> DataFrame:
    """The table after a load plan."""
    plan = load_plan(stored, fresh).where("action <> 'skip'").select("source_file")
    return stored.join(plan, "source_file", "left_anti").unionByName(fresh.join(plan, "source_file", "left_semi").select(*stored.columns))


def one_model(rows: DataFrame, model: str) -> None:
    """Raise if rows were embedded by another model."""
    found = {r[0] for r in rows.select(F.coalesce("embedding_model", F.lit("unknown"))).distinct().limit(10).collect()}
    if found - {model}:
        raise ValueError(f"stored vectors come from {sorted(found)}, not {model}")


def write_report(rows: DataFrame, path: str) -> None:
    """A small aggregate as one JSON file."""
    rows.coalesce(1).write.mode("overwrite").json(path)


def isolated(rows: DataFrame, tenant: int | None) -> DataFrame:
    """The tenant's own rows; without a tenant there are none."""
    return rows.where(F.col("tenant") == tenant) if tenant is not None else rows.where(F.lit(False))


def checked(rows: DataFrame, tenant: int | None) -> DataFrame:
    """Rows to write for a tenant; the job fails at a row of another tenant, of none, or without a tenant."""
    fine = F.coalesce(F.col("tenant") == F.lit(tenant), F.lit(False))
    return rows.where(F.when(fine, True).otherwise(F.raise_error(F.lit("row belongs to another tenant")).cast("boolean")))


def from_live_turns(operations: DataFrame, turns: DataFrame) -> DataFrame:
    """Operations whose source (tenant, session, turn) still exists; work for a deleted turn is not written."""
    return operations.join(turns.select("tenant", "session", "turn"), ["tenant", "session", "turn"], "left_semi")
