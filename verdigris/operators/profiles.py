"""Learner profiles that grow by updates: known values replace others, lists and the timeline of topics grow."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

UNKNOWN = "unknown"


def merged_fields(old: DataFrame, updates: DataFrame) -> DataFrame:
    """(owner, field, value) after updates (owner, field, value, ts, id): the last known value wins; null, empty and unknown ones change nothing."""
    known = updates.where((F.coalesce("value", F.lit("")) != "") & (F.col("value") != UNKNOWN))
    last = known.groupBy("owner", "field").agg(F.max_by("value", F.struct("ts", "id")).alias("new"))
    return old.join(last, ["owner", "field"], "full_outer").select("owner", "field", F.coalesce("new", "value").alias("value"))


def merged_lists(old: DataFrame, updates: DataFrame) -> DataFrame:
    """(owner, field, n, value) after updates (owner, field, value, ts, id): values that are new stand behind the others, n from 0."""
    first = updates.where(F.coalesce("value", F.lit("")) != "").groupBy("owner", "field", "value").agg(F.min(F.struct("ts", "id")).alias("o"))
    fresh = first.join(old.select("owner", "field", "value"), ["owner", "field", "value"], "left_anti")
    many = old.groupBy("owner", "field").agg((F.max("n") + 1).alias("many"))
    place = F.row_number().over(W.partitionBy("owner", "field").orderBy("o")) - 1
    told = fresh.withColumn("place", place).join(many, ["owner", "field"], "left")
    return old.select("owner", "field", "n", "value").unionByName(told.select("owner", "field", (F.col("place") + F.coalesce("many", F.lit(0))).cast("int").alias("n"), "value"))


def timeline(old: DataFrame, updates: DataFrame, recent: int = 3, per_session: int = 5) -> DataFrame:
    """(owner, n, topic, day, session) after updates (owner, topic, day, ts, id), in order; n from 0.

    A topic is left out if it equals one of the last ``recent`` ones but for case. A new session begins
    when the timeline's length is a multiple of ``per_session``. Whether a topic counts depends on those
    kept before it, so an owner's updates go through one task in order, as a stream that remembers the
    last topics only.
    """
    rows = old.select("owner", F.lit(0).alias("late"), F.col("n").cast("long").alias("o"), F.lit(0).cast("long").alias("id"), "topic", "day", "session")
    new = updates.where((F.coalesce("topic", F.lit("")) != "") & (F.col("topic") != UNKNOWN))
    line = rows.unionByName(new.select("owner", F.lit(1).alias("late"), F.unix_micros(F.col("ts").cast("timestamp")).alias("o"), "id", "topic", "day", F.lit(None).cast("int").alias("session")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        owner, near, length, session = None, deque(maxlen=recent), 0, 1
        started = False
        for b in batches:
            out = []
            for who, late, topic, day, told in zip(*(b[c].to_pylist() for c in ("owner", "late", "topic", "day", "session")), strict=True):
                if not started or who != owner:
                    owner, near, length, session, started = who, deque(maxlen=recent), 0, 1, True
                if late:
                    if topic.lower() in near:
                        continue
                    session += int(length > 0 and length % per_session == 0)
                else:
                    session = told
                out.append((who, length, topic, day, session))
                near.append(topic.lower())
                length += 1
            columns = list(zip(*out, strict=True)) or [[]] * 5
            kinds = [b.schema.field("owner").type, pa.int32(), pa.string(), b.schema.field("day").type, pa.int32()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["owner", "n", "topic", "day", "session"])

    kinds = dict(updates.dtypes)
    return line.repartition("owner").sortWithinPartitions("owner", "late", "o", "id").mapInArrow(run, f"owner {kinds['owner']}, n int, topic string, day {kinds['day']}, session int")
