"""Written intermediate tables, which keep iterative plans small and outlive lost executors."""

from __future__ import annotations

import atexit
import uuid

from pyspark.sql import DataFrame, SparkSession


def _folder(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names; where it is unset, the warehouse of a session on one machine."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        master = spark.conf.get("spark.master", "")
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = spark.conf.get("spark.sql.warehouse.dir")
    return folder.rstrip("/")


def _remove(spark: SparkSession, path: str) -> None:
    try:
        target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
    except Exception:  # noqa: BLE001  the session may have ended before
        pass


def step_path(spark: SparkSession) -> str:
    """A new path in the folder that ``spark.checkpoint.dir`` names, removed when the driver ends."""
    path = f"{_folder(spark)}/verdigris-step-{uuid.uuid4().hex}"
    atexit.register(_remove, spark, path)
    return path


def written(df: DataFrame) -> DataFrame:
    """``df`` as a table in the folder that ``spark.checkpoint.dir`` names."""
    spark = df.sparkSession
    path = step_path(spark)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
