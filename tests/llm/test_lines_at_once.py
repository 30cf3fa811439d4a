"""Lines and keys of a whole batch at once, and components of few and of many edges."""

import random

import numpy as np
import pyarrow as pa
import pytest
import xxhash

from verdigris.llm import components, lines
from verdigris.llm.common import Hasher

TEXTS = ["one\ntwo\n\n three \r\n", "", None, "\n", " \t\n\v", "no feed", "größe\n日本語 \n", "x\n" * 3, "\f a b \r", "end\n"]


def test_lines_of_a_batch():
    for texts in (TEXTS, [], [None], ["größe"]):
        found = lines.Lines(pa.array(texts, pa.string()))
        got = list(zip(found.text.tolist(), found.number.tolist(), found.blobs(np.arange(len(found.ids))), found.size.tolist(), found.ids.tolist(), strict=True))
        want = [(d, i, s.encode(), len(s), xxhash.xxh3_64_intdigest(s.encode()) >> 2) for d, t in enumerate(texts) for i, s in lines.eligible((t or "").encode())]
        assert got == want


def test_lines_two_edits_apart_share_a_key():
    r = random.Random(5)
    pairs = []
    for _ in range(400):
        a = "".join(r.choice("abcé日 ") for _ in range(r.randint(34, 70)))
        b = list(a)
        for _ in range(r.randint(0, 2)):
            at = r.randrange(1, len(b) - 1)
            b[at : at + r.randint(0, 1)] = r.choice(["", "x", "ü"])
        pairs.append((f"<{a}>", "<" + "".join(b[:]) + ">"))
    found = lines.Lines(pa.array([s for p in pairs for s in p], pa.string()))
    key, tag = lines.keys(found, np.arange(len(found.ids)), Hasher())
    own, every = {}, {}
    for k, t in zip(key.tolist(), tag.tolist(), strict=True):
        every.setdefault(t >> 1, set()).add(k)
        if not t & 1:
            own.setdefault(t >> 1, set()).add(k)
    ids = found.ids.tolist()
    for (a, b), x, y in zip(pairs, ids[::2], ids[1::2], strict=True):
        assert lines.within(a, b) and (own[x] & every[y] or own[y] & every[x])
    assert len(set(ids)) > 600 and sum(map(len, every.values())) < 13 * len(ids)


@pytest.mark.parametrize("edges", [65_536, 30])
def test_components_by_trees(spark, monkeypatch, edges):
    monkeypatch.setattr(components, "EDGES", edges)
    r = random.Random(edges)
    pairs = [(r.randrange(150), r.randrange(150)) for _ in range(90)] + [(1, None), (7, 7)] + [(i, i + 1) for i in range(500, 540)] + [(900, i) for i in range(901, 940)]
    up = {x: x for p in pairs for x in p}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    linked = [(a, b) for a, b in pairs if None not in (a, b) and a != b]
    for a, b in linked:
        x, y = sorted((find(a), find(b)))
        up[y] = x
    out = components.components(spark.createDataFrame(pairs, "a long, b long").repartition(4))
    assert sorted(map(tuple, out.collect())) == sorted((x, find(x)) for x in {x for p in linked for x in p})
    if edges > len(pairs):  # few edges are one task's, so nothing is dealt out
        assert "Exchange" not in out._jdf.queryExecution().executedPlan().toString()
