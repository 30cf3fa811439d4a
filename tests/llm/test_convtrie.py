"""The conversation trie against a dictionary of prefixes."""

import hashlib
import random
import re
import zlib
from pathlib import Path

import duckdb
import pytest

from tests.conftest import SF
from verdigris.llm import convtrie

SCHEMA = "conv_id long, turn long, role string, text string, words long, n string"


def brute(rows):
    by = {}
    for c, turn, role, text in rows:
        if c is not None:
            by.setdefault(c, []).append((turn, role or "", text or ""))
    digest = lambda t: hashlib.sha256(f"{len(t[1])}:{t[1]}{t[2]}".encode()).digest()
    turns = {c: [t[1:] for t in sorted(v, key=lambda t: (t[0] is not None, t[0] or 0, digest(t)))] for c, v in by.items()}
    new = {}
    for c, own in turns.items():
        h = zlib.crc32(str(c).encode()) % 4
        base = c - (abs(c) % 20 if c >= 0 else -(abs(c) % 20))
        new[c] = turns.get(base, [])[:h] + own[h:]
    nodes = {}
    for c, seq in new.items():
        for d in range(len(seq) + 1):
            nodes.setdefault(tuple(seq[:d]), []).append(c)
    kids, out = {}, []
    for p in nodes:
        if p:
            kids.setdefault(p[:-1], []).append(p)

    def under(p):
        stack, leaves, saved = [p], 0, 0
        while stack:
            q = stack.pop()
            leaves += q not in kids
            saved += (len(nodes[q]) - 1) * len(re.findall(r"[^\x20\x09-\x0D]+", q[-1][1])) if q else 0
            stack += kids.get(q, [])
        return leaves, saved

    for p, members in nodes.items():
        ends = sorted(c for c in members if len(new[c]) == len(p))
        out.append((min(members), len(p), min(nodes[p[:-1]]) if p else None, len(members), len(kids.get(p, [])), *under(p), hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest()))
    return sorted(out, key=str)


def got(df):
    return sorted(map(tuple, df.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256").collect()), key=str)


def talk(seed, many=90):
    """Shared first turns, copies, long copies, ties, nulls, negative ids, gaps in the numbers, repeated rows."""
    r = random.Random(seed)
    rows = []
    for c in range(-25, many):
        if r.random() < 0.2:
            continue
        turns = [(r.choice(["user", "system", None]), r.choice(["hello there", "a b  c", "", None, "x" * 50 + " y"])) for _ in range(r.choice([1, 2, 3, 6]))]
        if c % 9 == 0:
            turns = [("user", "common start"), ("assistant", "common  answer")] * 15
            if c % 2:
                turns[-1] = ("user", "other end")
        rows += [(c, i * 2 if r.random() < 0.9 else None, role, text) for i, (role, text) in enumerate(turns)]
    rows += rows[:3] + [(None, 1, "user", "nobody's"), (7000, 5, "user", "alone")]
    r.shuffle(rows)
    return rows


@pytest.mark.parametrize("limit", [4096, 60, 9, 1])
def test_tries(spark, limit):
    rows = talk(limit)
    df = spark.createDataFrame([(*x, 1, "clash") for x in rows], SCHEMA).repartition(3)
    assert got(convtrie.report(df, limit, 40)) == brute(rows)


def test_edges(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert convtrie.report(df).collect() == []
    only_null = [(None, 1, "user", "x")]
    assert convtrie.report(spark.createDataFrame([(*x, 1, "") for x in only_null], SCHEMA)).collect() == []
    turnless = [c for c in range(1, 60) if zlib.crc32(str(c).encode()) % 4 and c % 20][:3]  # their only turn is replaced, and their block has no first conversation
    rows = [(c, 0, "user", "gone") for c in turnless]
    for limit in (4096, 1):
        assert got(convtrie.report(spark.createDataFrame([(*x, 1, "") for x in rows], SCHEMA), limit)) == brute(rows)
    rows += [(3000 + 20 * i, t, "user", f"t{t}") for i in range(3) for t in range(4)]
    for limit in (4096, 1):
        assert got(convtrie.report(spark.createDataFrame([(*x, 1, "") for x in rows], SCHEMA), limit)) == brute(rows)


def test_sql_agrees(spark):
    con = duckdb.connect()
    for f in Path(SF).glob("*.parquet"):
        con.execute(f"create view {f.stem} as select * from '{f}'")
    want = con.sql(f"select conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256 from ({convtrie.TRIE_SQL})").fetchall()
    rows = con.sql("select conv_id, turn, role, text from conversations").fetchall()
    assert sorted(want, key=str) == brute(rows) == got(convtrie.report(spark.read.parquet(f"{SF}/conversations.parquet")))
