"""Beliefs by batches: any split gives the whole's result, replays and partly written batches change nothing."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from verdigris.operators import beliefs
from verdigris.streaming.belief_table import OPERATION, BeliefTable, kept

START = datetime(2024, 1, 1)
PREDICATES = ["mastered", "struggles_with", "confused_about", "wants_to_learn", "studied"]


def operations(seed, many=160):
    r = random.Random(seed)
    out = []
    for i in range(many):
        op = "invalidate" if r.random() < 0.15 else "add"
        out.append((r.choice([1, 2]), r.choice([1, 2]), r.choice(["Ann", "ann", "Bo"]), r.choice(PREDICATES), r.choice(["Algebra", "algebra", "Graphs"]), START + timedelta(minutes=i // 2), i, r.choice([0.5, 0.9, 1.0]), r.choice(["", None, f"quote {i}"]), op, r.choice([None, "", "told so"])))
    return out


def plain(ops):
    """One operation after the other over a list of edges."""
    edges = []
    for tenant, session, s, p, o, ts, _, confidence, evidence, op, reason in ops:
        live = [e for e in edges if e["gone"] is None and e["tenant"] == tenant]
        if op == "invalidate":
            for e in live:
                if e["p"] == p and e["s"].lower() == s.lower() and e["o"].lower() == o.lower():
                    e.update(gone=ts, reason=reason or beliefs.RETIRED, updated=ts)
            continue
        for e in live:
            if e["p"] in beliefs.OPPOSES.get(p, []) and (e["s"], e["o"]) == (s, o):
                e.update(gone=ts, reason=beliefs.OPPOSED + p, updated=ts)
        same = [e for e in live if e["gone"] is None and (e["session"], e["s"], e["p"], e["o"]) == (session, s, p, o)]
        if same:
            e = same[0]
            e.update(weight=min(e["weight"] + 0.1 * confidence, 2.0), n=e["n"] + 1, evidence=evidence or e["evidence"], updated=ts)
        else:
            edges.append(dict(tenant=tenant, session=session, s=s, p=p, o=o, weight=confidence, n=1, since=ts, gone=None, reason=None, evidence=evidence or None, updated=ts))
    return sorted((str((e["tenant"], e["session"], e["s"], e["p"], e["o"], round(e["weight"], 9), e["n"], e["since"], e["gone"], e["reason"], e["evidence"] or None, e["updated"])) for e in edges))


def rows(df):
    return sorted(str((e.tenant, e.session, e.s, e.p, e.o, round(e.weight, 9), e.observations, e.valid_from, e.invalidated_at, e.reason, e.evidence or None, e.updated_at)) for e in df.collect())


@pytest.mark.parametrize("seed", range(3))
def test_any_split(spark, tmp_path, seed):
    ops = operations(seed)
    r = random.Random(seed)
    cuts = sorted(r.sample(range(len(ops)), seed * 3))
    table = BeliefTable(spark, str(tmp_path / "b"), shards=3)
    for n, (a, b) in enumerate(zip([0, *cuts], [*cuts, len(ops)], strict=True)):
        if a < b:
            table.apply(spark.createDataFrame(ops[a:b], OPERATION), n)
    assert rows(table.edges()) == plain(ops)
    shared = ["tenant", "session", "s", "p", "o", "observations", "valid_from"]
    if not any(o[9] == "invalidate" for o in ops):
        assert sorted(map(tuple, table.edges().select(shared).collect())) == sorted(map(tuple, beliefs.fold(spark.createDataFrame(ops, OPERATION)).select(shared).collect()))


def test_fold_agrees(spark):
    """Names of one case: the fold over all operations and the merge into an empty table."""
    ops = [(t, n, s.title(), p, o.title(), *rest) for t, n, s, p, o, *rest in operations(9)]
    df = spark.createDataFrame(ops, OPERATION)
    columns = ["tenant", "session", "s", "p", "o", F.round("weight", 9).alias("weight"), "observations", "valid_from", "invalidated_at"]
    merged = beliefs.merge(spark.createDataFrame([], beliefs.EDGE), df)
    assert sorted(str(tuple(x)) for x in merged.select(columns).collect()) == sorted(str(tuple(x)) for x in beliefs.fold(df).select(columns).collect())


def test_replays_and_decay(spark, tmp_path):
    ops = operations(4)
    table = BeliefTable(spark, str(tmp_path / "b"), shards=4)
    first, second = spark.createDataFrame(ops[:90], OPERATION), spark.createDataFrame(ops[90:], OPERATION)
    assert table.apply(first, 0) > 0 and table.apply(first, 0) == 0
    table.apply(second, 1)
    assert rows(table.edges()) == plain(ops)
    assert table.apply(second, 1) == table.apply(first, 0) == 0
    now = START + timedelta(days=30)
    assert table.decay(now) > 0
    once = rows(table.edges())
    live = [e for e in table.edges().collect() if e.invalidated_at is None and e.weight > 0.1]
    assert once != plain(ops) and all(e.updated_at == now for e in live)
    assert table.decay(now) == 0 and table.decay(now + timedelta(minutes=59)) == 0 and rows(table.edges()) == once
    # a decay that wrote one shard before it broke off goes on with the others
    other = BeliefTable(spark, str(tmp_path / "c"), shards=4)
    other.apply(spark.createDataFrame(ops, OPERATION), 0)
    one = other.stored().select("shard").first().shard
    part = beliefs.decay(other.stored().where(F.col("shard") == one), now.isoformat(sep=" ")).withColumn("decayed_at", F.lit(now).cast("timestamp_ntz"))
    other._replace(part)
    assert other.decay(now) > 0 and rows(other.edges()) == once and other.decay(now) == 0
    assert table.decay(now + timedelta(hours=1)) > 0  # due again; what was dated an hour ago is not idle
    assert rows(table.edges()) == once


def test_stream(spark, tmp_path):
    ops = operations(6)
    table = BeliefTable(spark, str(tmp_path / "b"))
    for n in range(2):
        spark.createDataFrame(ops[80 * n : 80 * n + 80], OPERATION).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(OPERATION).parquet(str(tmp_path / "in"))
        kept(stream, table, str(tmp_path / "check"), clock=lambda: START + timedelta(days=1)).awaitTermination()
    assert rows(table.edges()) == plain(ops)  # nothing is idle after a day
