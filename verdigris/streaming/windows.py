"""Event-time windows over streams, and runs of a stream to its present end."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from verdigris.operators.lineage import _folder


def read(spark: SparkSession, path: str) -> DataFrame:
    """A parquet table as a stream, with ``ts`` as a timestamp."""
    rows = spark.readStream.schema(spark.read.parquet(path).schema).parquet(f"{path[:-1]}[{path[-1]}]")  # a pattern, as the source may be one file
    return rows.withColumn("ts", F.col("ts").cast("timestamp"))


def counts(events: DataFrame, size: str = "1 day", late: str = "1 day") -> DataFrame:
    """(start, event_type, n, total) of tumbling windows."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", size), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 6).alias("total")).select(F.col("window.start").alias("start"), "event_type", "n", "total")


def session_counts(events: DataFrame, gap: str = "30 minutes", late: str = "1 day") -> DataFrame:
    """(user_id, start, end, n) of sessions."""
    return events.withWatermark("ts", late).groupBy(F.session_window("ts", gap), "user_id").agg(F.count("*").alias("n")).select("user_id", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")


def once_each(events: DataFrame, keys: list[str], late: str = "1 day") -> DataFrame:
    """Rows with new keys within the watermark."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(keys)


def drained(stream: DataFrame, mode: str) -> DataFrame:
    """Run a stream over what there is now; its rows as a table in the shared folder."""
    import uuid

    spark = stream.sparkSession
    path = f"{_folder(spark)}/verdigris-stream-{uuid.uuid4().hex}"

    def put(rows: DataFrame, batch: int) -> None:  # a batch that is tried again writes over its own rows
        rows.write.mode("overwrite").parquet(f"{path}/rows" if mode == "complete" else f"{path}/rows/of_batch={batch}")

    stream.writeStream.outputMode(mode).option("checkpointLocation", f"{path}/checkpoint").foreachBatch(put).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{path}/rows").select(*stream.columns)
