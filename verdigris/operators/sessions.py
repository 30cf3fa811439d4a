"""Chat sessions: summaries, replies, turn numbers, history windows, pending work, deletions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from verdigris.functions.text import title_of


def summaries(turns: DataFrame) -> DataFrame:
    """(session, n_messages, first_turn, last_turn, title) from (session, turn, role, text)."""
    first = F.min_by("text", F.when(F.col("role") == "user", F.col("turn")))
    return turns.groupBy("session").agg(F.count("*").alias("n_messages"), F.min("turn").alias("first_turn"), F.max("turn").alias("last_turn"), title_of(first).alias("title"))


def next_reply(turns: DataFrame) -> DataFrame:
    """(session, turn, text, reply): each user turn with the first assistant turn after it in the session."""
    ahead = W.partitionBy("session").orderBy("turn").rowsBetween(1, W.unboundedFollowing)
    reply = F.first(F.when(F.col("role") == "assistant", F.col("text")), ignorenulls=True).over(ahead)
    return turns.withColumn("reply", reply).where(F.col("role") == "user").select("session", "turn", "text", "reply")


def append_turns(turns: DataFrame, fresh: DataFrame) -> DataFrame:
    """(session, turn, role, text): new (session, seq, role, text) rows numbered on from each session's last turn."""
    last = turns.groupBy("session").agg(F.max("turn").alias("last"))
    n = F.row_number().over(W.partitionBy("session").orderBy("seq"))
    rows = fresh.join(last, "session", "left").select("session", (F.coalesce(F.col("last") + 1, F.lit(0)) + n - 1).alias("turn"), "role", "text")
    return turns.select("session", "turn", "role", "text").unionByName(rows)


def renumber(turns: DataFrame, order: list[Column | str]) -> DataFrame:
    """Repeated turn numbers after the first are moved behind all others."""
    n = F.row_number().over(W.partitionBy("session", "turn").orderBy(*order))
    return turns.withColumn("turn", F.when(n > 1, F.col("turn") + 10_000 + n).otherwise(F.col("turn")))


def history(turns: DataFrame, size: int = 6) -> DataFrame:
    """(session, first_turn, role, text): the last ``size`` turns, neighbours with one role merged."""
    last = turns.withColumn("n", F.row_number().over(W.partitionBy("session").orderBy(F.desc("turn")))).where(F.col("n") <= size)
    order = W.partitionBy("session").orderBy("turn")
    runs = last.withColumn("new", (F.lag("role").over(order).isNull() | (F.lag("role").over(order) != F.col("role"))).cast("int")).withColumn("run", F.sum("new").over(order))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda t: t["text"]), "\n\n")
    return runs.groupBy("session", "run").agg(F.min("turn").alias("first_turn"), F.first("role").alias("role"), text.alias("text")).drop("run")


def memory_text(turns: DataFrame, size: int = 8, chars: int = 220) -> DataFrame:
    """(session, memory): the last turns as lines, each cut to ``chars``."""
    last = turns.withColumn("n", F.row_number().over(W.partitionBy("session").orderBy(F.desc("turn")))).where(F.col("n") <= size)
    line = F.concat("role", F.lit(": "), F.substring("text", 1, chars))
    return last.groupBy("session").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", line.alias("l")))), lambda t: t["l"]), "\n").alias("memory"))


def pending(turns: DataFrame, done: DataFrame, n: int = 3, now: str | None = None, minutes: int = 2) -> DataFrame:
    """(session, turn): the newest user turns of each session that no finished (session, turn) covers; with ``now`` only those whose ``ts`` is ``minutes`` older."""
    left = turns.where(F.col("role") == "user").join(done, ["session", "turn"], "left_anti")
    if now is not None:
        left = left.where(F.col("ts") < F.lit(now).cast("timestamp_ntz") - F.expr(f"INTERVAL {minutes} MINUTES"))
    return left.withColumn("n", F.row_number().over(W.partitionBy("session").orderBy(F.desc("turn")))).where(F.col("n") <= n).select("session", "turn")


def extraction_status(turns: DataFrame, done: DataFrame) -> DataFrame:
    """(session, n_turns, n_user, n_extracted, n_pending): user turns with and without a finished (session, turn)."""
    marked = turns.join(done.select("session", "turn").distinct().withColumn("done", F.lit(True)), ["session", "turn"], "left")
    user, ready = F.col("role") == "user", F.coalesce("done", F.lit(False))
    return marked.groupBy("session").agg(F.count("*").alias("n_turns"), F.count_if(user).alias("n_user"), F.count_if(user & ready).alias("n_extracted"), F.count_if(user & ~ready).alias("n_pending"))


def without_sessions(table: DataFrame, gone: DataFrame) -> DataFrame:
    """Rows of other sessions; as a delete, for any table with a session column."""
    return table.join(gone.select("session"), "session", "left_anti")


def clear_tenant(tables: dict[str, DataFrame], tenant: int, corpus: int) -> dict[str, DataFrame]:
    """Tables without a tenant's rows; the tenant table and the corpus tenant's rows cannot be cleared."""
    if tenant == corpus:
        raise ValueError("the corpus tenant cannot be cleared")
    return {name: df.where(~F.col("tenant").eqNullSafe(F.lit(tenant))) for name, df in tables.items()}
