"""Exact and indexed nearest vectors against a plain loop."""

import numpy as np
import pytest

from verdigris.operators import vectors

ROWS, ASKS = "id long, vec array<float>", "query_id long, qvec array<float>"


def brute(rows, asks, k):
    out = []
    good = [(i, np.array(v, np.float64)) for i, v in rows if v is not None and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    matrix = np.array([v / np.linalg.norm(v) for _, v in good])
    for q, v in asks:
        v = np.array(v, np.float64)
        scores = matrix @ (v / np.linalg.norm(v))
        best = sorted((-round(float(s), 9), i) for s, (i, _) in zip(scores, good, strict=True))[:k]
        out += [(q, i, n) for n, (_, i) in enumerate(best, 1)]
    return sorted(out)


def got(df):
    return sorted((x.query_id, x.id, x.rank) for x in df.collect())


def frame(spark, rows, schema):
    return spark.createDataFrame([(i, [float(x) if x is not None else None for x in v] if v is not None else None) for i, v in rows], schema).repartition(5)


def clustered(r, groups, each, spread):
    centers = r.normal(size=(groups, 32))
    return [(i, (centers[i % groups] + spread * r.normal(size=32)).astype(np.float32).tolist()) for i in range(groups * each)]


@pytest.mark.parametrize(("name", "most"), [("clusters", 0.25), ("one cluster of 4000 and 1000 at random", 1.0), ("random", 1.0)])
def test_index_is_exact_and_reads_less(spark, tmp_path, name, most):
    r = np.random.default_rng(3)
    if name == "clusters":
        rows = clustered(r, 40, 100, 0.05)
    elif name == "random":
        rows = [(i, r.normal(size=32).astype(np.float32).tolist()) for i in range(2000)]
    else:
        rows = clustered(r, 1, 4000, 0.01) + [(4000 + i, r.normal(size=32).astype(np.float32).tolist()) for i in range(1000)]
    asks = rows[:: len(rows) // 20][:20]
    index = vectors.build_index(frame(spark, rows, ROWS), str(tmp_path / "v"))
    found = vectors.search(index, frame(spark, asks, ASKS), 10)
    want = brute(rows, asks, 10)
    assert got(found) == want
    print(name, "share of rows read", round(index.read, 3), "rounds", index.rounds)
    assert index.read <= most
    early = vectors.search(index, frame(spark, asks, ASKS), 10, most_rounds=1)
    assert len(set(got(early))) <= len(want)


def test_ties_copies_and_unusable_vectors(spark, tmp_path):
    r = np.random.default_rng(4)
    base = [(i, r.normal(size=8).astype(np.float32).tolist()) for i in range(30)]
    rows = base + [(100 + i, base[0][1]) for i in range(60)] + [(200, [0.0] * 8), (201, None), (202, [float("nan")] * 8), (203, [1.0, None] + [0.0] * 6), (204, [float("inf")] + [0.0] * 7)]
    asks = [base[0], base[5]]
    want = brute(rows, asks, 7)
    assert got(vectors.topk(frame(spark, rows, ROWS), frame(spark, asks, ASKS), 7)) == want
    index = vectors.build_index(frame(spark, rows, ROWS), str(tmp_path / "v"), cells=4)
    assert got(vectors.search(index, frame(spark, asks, ASKS), 7, first=1)) == want
    assert vectors.topk(frame(spark, rows, ROWS), frame(spark, [(1, [0.0] * 8)], ASKS), 3).collect() == []


def test_empty(spark, tmp_path):
    none = spark.createDataFrame([], ROWS)
    asks = frame(spark, [(1, [1.0, 2.0])], ASKS)
    assert vectors.topk(none, asks, 3).collect() == []
    assert vectors.search(vectors.build_index(none, str(tmp_path / "v")), asks, 3).collect() == []


def test_many_queries_go_in_groups(spark, monkeypatch):
    monkeypatch.setattr(vectors, "QUERY_LIMIT", 10)
    r = np.random.default_rng(8)
    rows = [(i, r.normal(size=4).astype(np.float32).tolist()) for i in range(50)]
    assert got(vectors.topk(frame(spark, rows, ROWS), frame(spark, rows[:33], ASKS), 3)) == brute(rows, rows[:33], 3)
