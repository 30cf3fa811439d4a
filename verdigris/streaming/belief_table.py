"""Beliefs that grow by micro-batches: a table of edges in shards, each of which knows the last batch it took.

A batch reads and writes the shards of its subjects and objects only. A shard that already holds the batch
is left alone, so a batch that is tried again, even after it was written in part, changes nothing more. The
same goes for decay, which runs once an hour at most and leaves its time with the shard.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from verdigris.operators import beliefs
from verdigris.operators.lineage import written

STORED = f"{beliefs.EDGE}, batch long, decayed_at timestamp_ntz, shard int"
OPERATION = "tenant int, session long, s string, p string, o string, ts timestamp_ntz, id long, confidence double, evidence string, op string, reason string"


class BeliefTable:
    """A table of edges at ``path``; all opposing predicates of a subject and an object lie in one shard."""

    def __init__(self, spark: SparkSession, path: str, shards: int = 64, every: timedelta = timedelta(hours=1)):
        self.spark, self.path, self.shards, self.every = spark, path, shards, every

    def _shard(self) -> Column:
        return F.pmod(F.xxhash64("tenant", F.lower("s"), F.lower("o")), F.lit(self.shards)).cast("int")

    def stored(self) -> DataFrame:
        """STORED rows; none before the first batch."""
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.path)
        there = path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(path)
        return self.spark.read.schema(STORED).parquet(self.path) if there else self.spark.createDataFrame([], STORED)

    def edges(self) -> DataFrame:
        return self.stored().drop("batch", "decayed_at", "shard")

    def _state(self) -> dict[int, tuple[int, datetime | None]]:
        """The last batch and the last decay of each shard, as many as there are."""
        rows = self.stored().groupBy("shard").agg(F.max("batch").alias("batch"), F.max("decayed_at").alias("decayed_at")).collect()
        return {r.shard: (r.batch, r.decayed_at) for r in rows}

    def _replace(self, rows: DataFrame) -> None:
        """Put ``rows`` in place of their shards; they are written apart first, as they come from the table itself."""
        written(rows).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("shard").parquet(self.path)

    def apply(self, ops: DataFrame, batch: int) -> int:
        """Merge a batch of OPERATION rows; gives the number of shards that were written."""
        asked = written(ops.select(*(F.col(c.split()[0]).cast(c.split()[1]).alias(c.split()[0]) for c in OPERATION.split(", "))).withColumn("shard", self._shard()))
        state = self._state()
        open_ = [r.shard for r in asked.select("shard").distinct().collect() if state.get(r.shard, (-1, None))[0] < batch]
        if not open_:
            return 0
        mine = F.col("shard").isin(open_)
        merged = beliefs.merge(self.stored().where(mine).drop("batch", "decayed_at", "shard"), asked.where(mine).drop("shard")).withColumn("shard", self._shard())
        when = self.spark.createDataFrame([(s, state.get(s, (-1, None))[1]) for s in open_], "shard int, decayed_at timestamp_ntz")
        self._replace(merged.withColumn("batch", F.lit(batch).cast("long")).join(F.broadcast(when), "shard"))  # as many rows as shards
        return len(open_)

    def decay(self, now: datetime) -> int:
        """Let idle edges fade unless that was done in the hour before ``now``; gives the number of shards that were written."""
        state = self._state()
        times = [t for _, t in state.values() if t is not None and t < now]
        left = [s for s, (_, t) in state.items() if t is None or t < now]
        if not left or (times and now - max(times) < self.every) or any(t is not None and t > now for _, t in state.values()):
            return 0
        rows = beliefs.decay(self.stored().where(F.col("shard").isin(left)), now.isoformat(sep=" "))
        self._replace(rows.withColumn("decayed_at", F.lit(now).cast("timestamp_ntz")))
        return len(left)


def kept(ops: DataFrame, table: BeliefTable, checkpoint: str, clock: Callable[[], datetime] | None = None) -> StreamingQuery:
    """Run a stream of operations into a table, batch by batch, over what there is now; ``clock`` tells when to let edges fade."""

    def put(rows: DataFrame, batch: int) -> None:
        table.apply(rows, batch)
        if clock:
            table.decay(clock())

    return ops.writeStream.option("checkpointLocation", checkpoint).foreachBatch(put).trigger(availableNow=True).start()
