"""Episodic memory, concept mentions, staged search and amplitude envelopes."""

from __future__ import annotations

import re
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


# What a query says that asks for memories in general.
GENERIC = [
    "who am i", "about me", "remember me", "my name", "my background", "what do you know", "what did we talk", "previous conversation", "our last chat", "last session", "my project", "my goals", "what i do",
]


def relevant(memories: DataFrame, queries: DataFrame, n: int = 5) -> DataFrame:
    """(query_id, id, score, rank): memories that share words with a query, scored by overlap, tags, topic and importance.

    ``memories`` is (id, memory, tags, topic, importance, ts); ``queries`` is (query_id, text). A
    memory without a shared word is not found. A tag counts that is a word of the query, a topic that holds
    one. Blocks of memories meet blocks of queries, a task each, and leave the n best of every query, so
    that pairs are neither kept nor shuffled; their number still grows with the square of the input. A query that asks for memories in general gets the most
    important and recent ones, without a score.
    """

    def words(c: str) -> F.Column:
        return F.array_distinct(F.filter(F.split(F.lower(F.col(c)), "[^a-z0-9]+"), lambda w: w != ""))

    general = F.exists(F.lit(GENERIC), lambda t: F.contains(F.lower(F.col("text")), t))
    m = memories.select("id", "ts", words("memory").alias("w"), F.transform("tags", lambda t: F.lower(t)).alias("tags"), F.lower("topic").alias("topic"), (0.4 * F.least(F.col("importance"), F.lit(3))).alias("base")).where(F.size("w") > 0)
    q = queries.where(~F.coalesce(general, F.lit(False))).select("query_id", words("text").alias("qw")).where(F.size("qw") > 0)
    found = _best_of_blocks(m, q, n)
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), F.desc("ts"), "id"))
    own = found.withColumn("rank", rank).where(F.col("rank") <= n).select("query_id", "id", "score", "rank")
    first = memories.select("id", "importance", "ts").orderBy(F.desc("importance"), F.desc("ts"), "id").limit(n)
    first = first.withColumn("rank", F.row_number().over(W.orderBy(F.desc("importance"), F.desc("ts"), "id"))).select("id", F.lit(None).cast("double").alias("score"), "rank")  # n rows
    return own.unionByName(queries.where(general).select("query_id").join(F.broadcast(first)).select("query_id", "id", "score", "rank"))


#: Memories and queries of a block.
BLOCK, ASKS = 16_384, 4_096


def _best_of_blocks(m: DataFrame, q: DataFrame, n: int) -> DataFrame:
    """(query_id, id, score, ts): for each query the n best memories of every block; ``m`` is (id, ts, w, tags, topic, base), ``q`` is (query_id, qw)."""
    high, wide = -(-m.count() // BLOCK) or 1, -(-q.count() // ASKS) or 1
    every = lambda k: F.explode(F.sequence(F.lit(0), F.lit(k - 1)))
    left = m.withColumn("b", F.pmod(F.xxhash64("id"), F.lit(high)).cast("int")).withColumn("c", every(wide))
    right = q.withColumn("c", F.pmod(F.xxhash64("query_id"), F.lit(wide)).cast("int")).withColumn("b", every(high))
    told = dict(m.dtypes), dict(q.dtypes)

    def run(known: pa.Table, asked: pa.Table) -> pa.Table:
        known = known.sort_by([("ts", "descending"), ("id", "ascending")])  # among equal scores the first rows win
        size, base = len(known), known["base"].to_numpy()
        worst, most = base.min(initial=np.inf), base.max(initial=-np.inf)
        asks = [set(ws) for ws in asked["qw"].to_pylist()]
        wanted = set().union(*asks)
        longest = max(map(len, wanted), default=0)
        runs = defaultdict(list)  # the rows whose topic has a run of letters and digits; a theme is a wanted word within a run
        shared, tagged, themes = defaultdict(list), defaultdict(list), defaultdict(list)
        for i, (ws, tags, topic) in enumerate(zip(known["w"].to_pylist(), known["tags"].to_pylist(), known["topic"].to_pylist(), strict=True)):
            for w in wanted.intersection(ws):
                shared[w].append(i)
            for t in wanted.intersection(tags or ()):
                tagged[t].append(i)
            for t in set(re.findall("[a-z0-9]+", topic or "")):
                runs[t].append(i)
        for t, rows in runs.items():
            rows = np.array(rows)
            for x in {x for a in range(len(t)) for z in range(a + 1, min(len(t), a + longest) + 1) if (x := t[a:z]) in wanted}:
                themes[x].append(rows)
        places = [*({w: np.array(x) for w, x in d.items()} for d in (shared, tagged)), {w: np.concatenate(x) for w, x in themes.items()}]
        for d in places:  # what most rows have is a mask, which is added faster than places
            for w, x in d.items():
                if 8 * len(x) > size:
                    d[w] = np.zeros(size, bool)
                    d[w][x] = True

        def marked(d: dict, ws: set) -> np.ndarray:
            out = np.zeros(size, bool)
            for w in ws & d.keys():
                if d[w].dtype == bool:
                    out |= d[w]
                else:
                    out[d[w]] = True
            return out

        who, where, scores = [], [], []
        for k, ws in enumerate(asks):
            half = np.zeros(size, np.uint32)  # the score without the base, in halves
            for w in ws & places[0].keys():
                half[places[0][w]] += 2
            met = np.flatnonzero(half != 0)
            if not len(met):
                continue
            half = half[met] + marked(places[1], ws)[met] * np.uint32(3) + marked(places[2], ws)[met] * np.uint32(2)
            if len(met) > n:  # n rows reach a level; what even the best base does not lift to it is out
                reach = np.cumsum(np.bincount(half)[::-1])[::-1]
                level = np.flatnonzero(reach >= n)[-1]
                near = np.flatnonzero(half * 0.5 + most + 1e-5 >= level * 0.5 + worst)
                met, half = met[near], half[near]
            score = np.round(half * 0.5 + base[met], 6)
            if len(met) > n:
                least = np.partition(score, -n)[-n]
                above = np.flatnonzero(score > least)
                kept = np.concatenate([above, np.flatnonzero(score == least)[: n - len(above)]])
                met, score = met[kept], score[kept]
            who.append(np.full(len(met), k))
            where.append(met)
            scores.append(score)
        cat = lambda x, t: np.concatenate(x) if x else np.zeros(0, t)
        at = pa.array(cat(where, np.int64))
        return pa.table({"query_id": asked["query_id"].take(pa.array(cat(who, np.int64))), "id": known["id"].take(at), "score": pa.array(cat(scores, np.float64)), "ts": known["ts"].take(at)})

    return left.groupBy("b", "c").cogroup(right.groupBy("b", "c")).applyInArrow(run, f"query_id {told[1]['query_id']}, id {told[0]['id']}, score double, ts {told[0]['ts']}")


def remember(old: DataFrame, new: DataFrame, most: int = 250) -> DataFrame:
    """Memories of each ``owner`` with new ones added: no repeats by lower-cased text, importance in 1..3, the ``most`` most important and recent kept."""
    clean = new.withColumn("importance", F.greatest(F.lit(1), F.least(F.col("importance"), F.lit(3)))).withColumn("tags", F.slice(F.array_distinct("tags"), 1, 6))
    key = F.lower("memory")
    first = W.partitionBy("owner", key).orderBy("ts")
    fresh = clean.withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n")
    fresh = fresh.withColumn("_k", key).join(old.select("owner", key.alias("_k")), ["owner", "_k"], "left_anti").select(*old.columns)
    rank = F.row_number().over(W.partitionBy("owner").orderBy(F.desc("importance"), F.desc("ts"), "memory"))
    return old.unionByName(fresh).withColumn("_n", rank).where(F.col("_n") <= most).drop("_n")


def mentions(messages: DataFrame, concepts: DataFrame, longest: int = 6) -> DataFrame:
    """(id, concept): concepts, already normalised, that stand as whole words in a message's normalised text.

    Messages give their runs of up to ``longest`` words, so this is an equi-join; longer concepts are
    looked for only where their first words match.
    """
    text = F.trim(F.regexp_replace(F.lower("text"), "[^a-z0-9]+", " "))
    words = messages.select("id", text.alias("t"), F.split(text, " ").alias("w"))
    runs = F.flatten(F.transform(F.sequence(F.lit(1), F.size("w")), lambda i: F.transform(F.sequence(F.lit(1), F.least(F.lit(longest), F.size("w") - i + 1)), lambda n: F.array_join(F.slice("w", i, n), " "))))
    seen = words.select("id", "t", F.explode(F.array_distinct(runs)).alias("key"))
    named = concepts.select("concept", F.array_join(F.slice(F.split("concept", " "), 1, longest), " ").alias("key"))
    whole = F.contains(F.concat(F.lit(" "), F.col("t"), F.lit(" ")), F.concat(F.lit(" "), F.col("concept"), F.lit(" ")))
    return seen.join(named, "key").where(whole).select("id", "concept").distinct()


def staged(first: DataFrame, second: DataFrame, n: int) -> DataFrame:
    """(query_id, id, rank): hits of the first list, then of the second that are not in it, n a query."""
    both = first.select("query_id", "id", "rank", F.lit(0).alias("stage")).unionByName(second.select("query_id", "id", "rank", F.lit(1).alias("stage")))
    once = both.groupBy("query_id", "id").agg(F.min(F.struct("stage", "rank")).alias("o"))
    rank = F.row_number().over(W.partitionBy("query_id").orderBy("o.stage", "o.rank", "id"))
    return once.withColumn("rank", rank).where(F.col("rank") <= n).select("query_id", "id", "rank")


def envelope(samples: DataFrame, size: int) -> DataFrame:
    """(track, bucket, level): root mean square of runs of ``size`` samples (track, n, value), as a share of the largest."""
    rms = samples.groupBy("track", F.expr(f"n div {size}").alias("bucket")).agg(F.sqrt(F.avg(F.col("value") * F.col("value"))).alias("rms"))
    top = F.max("rms").over(W.partitionBy("track"))
    return rms.select("track", "bucket", F.when(top > 0, F.round(F.col("rms") / top, 9)).otherwise(0.0).alias("level"))


def adopt_tenant(tenants: DataFrame, users: DataFrame, asked: DataFrame) -> DataFrame:
    """(request, tenant): the asked tenant if it exists and no user has it, else null, for a new one to be made."""
    free = tenants.select("tenant").join(users.select("tenant"), "tenant", "left_anti").withColumn("ok", F.lit(True))
    return asked.join(free, "tenant", "left").select("request", F.when(F.col("ok"), F.col("tenant")).alias("tenant"))
