"""Graphs with diamonds and cycles, reranking, entities, profiles: against plain loops."""

import itertools
import random
from datetime import date, datetime, timedelta

import pytest

from verdigris.operators import entities, graph, profiles, retrieval


def simple_depths(pairs, targets, depth):
    ups = {}
    for p, c in pairs:
        ups.setdefault(c, set()).add(p)
    best = {}

    def walk(target, at, path):
        for p in ups.get(at, ()):
            if p not in path and len(path) <= depth:
                best[target, p] = max(best.get((target, p), 0), len(path))
                walk(target, p, [*path, p])

    for t in targets:
        walk(t, t, [t])
    return best


@pytest.mark.parametrize("seed", range(3))
def test_closure_with_cycles(spark, seed):
    r = random.Random(seed)
    pairs = list({(r.randrange(9), r.randrange(9)) for _ in range(20)})
    edges = spark.createDataFrame([(p, c, 1.0) for p, c in pairs], "prerequisite int, concept int, confidence double")
    got = graph.prerequisites(edges, spark.createDataFrame([(i,) for i in range(9)], "concept int"), depth=4)
    assert {(x.target, x.concept): x.depth for x in got.collect()} == simple_depths(pairs, range(9), 4)


def test_twenty_diamonds_run_in_rows(spark):
    """2^20 paths lead through the lattice; a level has two rows at most."""
    pairs = []
    for i in range(20):
        pairs += [(f"a{i}", f"l{i}"), (f"a{i}", f"r{i}"), (f"l{i}", f"a{i + 1}"), (f"r{i}", f"a{i + 1}")]
    edges = spark.createDataFrame([(p, c, 1.0) for p, c in pairs], "prerequisite string, concept string, confidence double")
    got = graph.prerequisites(edges, spark.createDataFrame([("a20",)], "concept string"), depth=40).collect()
    assert len(got) == 60 and max(x.depth for x in got) == 40 and next(x.depth for x in got if x.concept == "a10") == 20


@pytest.mark.parametrize("seed", range(2))
def test_components_and_cycles(spark, seed):
    r = random.Random(seed)
    rows = list({(g, r.randrange(12), r.randrange(12)) for g in (0, 1) for _ in range(18)})
    rows = [(g, p, c, float(r.randrange(1000))) for g, p, c in rows]
    df = spark.createDataFrame(rows, "group int, prerequisite int, concept int, confidence double")
    reach = {}
    for g in (0, 1):
        near = {(p, c) for h, p, c, _ in rows if h == g}
        while True:
            more = near | {(a, d) for a, b in near for c, d in near if b == c}
            if more == near:
                break
            near = more
        reach[g] = near
    want = {(g, a): min(b for b in range(12) if (a, b) in reach[g] and (b, a) in reach[g]) for g in (0, 1) for a in range(12) if (a, a) in reach[g]}
    assert {(x.group, x.node): x.component for x in graph.components(df).collect()} == want
    kept = []
    for g, p, c, w in sorted(rows, key=lambda e: (-e[3], e[1], e[2])):
        ups = {(a, b) for h, a, b, _ in kept if h == g}
        seen, stack = set(), [p]
        while stack:
            x = stack.pop()
            if x not in seen:
                seen.add(x)
                stack += [a for a, b in ups if b == x]
        if c not in seen:
            kept.append((g, p, c, w))
    assert sorted(map(tuple, graph.drop_cycles(df).collect())) == sorted(kept)


def test_lateral_form_equals_the_joined_one(spark):
    r = random.Random(2)
    edges = spark.createDataFrame(list({(f"n{r.randrange(15)}", f"n{r.randrange(15)}", r.randrange(1, 20) / 10) for _ in range(40)}), "s string, o string, weight double")
    asked = [(1, ["n1"]), (2, ["n2", "n3", "n2"]), (3, []), (4, None), (5, ["none"])]
    got = graph.two_hop_each(edges, spark.createDataFrame(asked, "query_id int, ids array<string>"), limit=6).collect()
    for q, ids in asked:
        want = graph.two_hop(edges, spark.createDataFrame([(i,) for i in ids or []], "node string"), limit=6).collect()
        assert sorted((x.node, x.hop, x.weight) for x in got if x.query_id == q) == sorted(map(tuple, want))


def test_rerank(spark):
    r = random.Random(1)
    rows = [(q, f"query {q}", i, f"text {i % 3}", round(r.random(), 3) if i % 4 else 0.5, i + 1) for q in range(3) for i in range([20, 4, 9][q])]
    df = spark.createDataFrame(rows, "query_id int, qtext string, id int, text string, boost double, rank int").repartition(4)
    score = lambda q, t: int(t[-1]) * 0.3
    got = lambda out: sorted((x.query_id, x.rank, x.id) for x in out.collect())

    def want(add, fail=False):
        out = []
        for q in range(3):
            mine = [x for x in rows if x[0] == q and x[5] <= 12]
            told = lambda x: x[4] + (add(x[1], x[3]) if len(mine) > 5 else 0)  # noqa: B023, E731
            order = sorted(mine, key=lambda x: x[5] if fail and len(mine) > 5 else (-round(told(x), 9), x[5]))  # noqa: B023
            out += [(q, n, x[2]) for n, x in enumerate(order[:5], 1)]
        return sorted(out)

    assert got(retrieval.rerank(df, 5)) == want(lambda q, t: 0)
    assert got(retrieval.rerank(df, 5, lambda qs, ts: [score(q, t) for q, t in zip(qs, ts, strict=True)])) == want(score)

    def broken(qs, ts):
        raise RuntimeError("no model")

    assert got(retrieval.rerank(df, 5, broken)) == want(score, fail=True)


def test_entities_and_aliases(spark):
    nodes = spark.createDataFrame([(1, "Neural Networks", "Concept", {"a": "1", "b": "1"}, 0.0)], "tenant int, name string, type string, metadata map<string,string>, updated_at double")
    aliases = spark.createDataFrame([(1, "nn", "Neural Networks", "llm"), (1, "old", "Neural Networks", "manual")], "tenant int, alias string, name string, source string")
    new = [
        (1, "Neural Networks", "Tool", " NN ", {"b": "2"}, 1.0, 1),
        (1, "Naïve Bayes", "Concept", "Old", None, 2.0, 2),
        (1, "Naïve Bayes", "Tool", "NB", {"c": "3"}, 3.0, 3),
        (1, "NB", "Concept", "nb", {}, 4.0, 4),
        (2, "NB", "Concept", None, {"z": "9"}, 1.0, 5),
        (2, "NB", "Tool", "Nb", {"z": "8", "y": "7"}, 1.0, 6),
    ]
    kept, told = entities.upsert_entities(nodes, aliases, spark.createDataFrame(new, "tenant int, name string, type string, alias string, metadata map<string,string>, ts double, id int"))
    assert {(x.tenant, x.name): (x.type, x.metadata, x.updated_at) for x in kept.collect()} == {
        (1, "Neural Networks"): ("Concept", {"a": "1", "b": "2"}, 1.0), (1, "Naïve Bayes"): ("Concept", {"c": "3"}, 3.0), (1, "NB"): ("Concept", {}, 4.0), (2, "NB"): ("Concept", {"z": "8", "y": "7"}, 1.0),
    }
    assert sorted(map(tuple, told.collect())) == sorted([
        (1, "nn", "Neural Networks", "llm"), (1, "old", "Neural Networks", "manual"), (1, "neural networks", "Neural Networks", "manual"), (1, "naive bayes", "Naïve Bayes", "manual"), (1, "nb", "Naïve Bayes", "llm"), (2, "nb", "NB", "manual"),
    ])


@pytest.mark.parametrize("seed", range(2))
def test_timeline(spark, seed):
    r = random.Random(seed)
    rows = [(r.choice(["a", "b", None]), r.choice(["Trees", "trees", "Graphs", "Sets", "Logic", "unknown", "", None]), date(2024, 1, 1) + timedelta(i), datetime(2024, 1, 1) + timedelta(hours=i // 2), i) for i in range(120)]
    want = {}
    for owner, topic, day, *_ in rows:
        line = want.setdefault(owner, [])
        if topic and topic != "unknown" and topic.lower() not in [t.lower() for t, *_ in line[-3:]]:
            line.append((topic, day, line[-1][2] + (len(line) % 5 == 0) if line else 1))
    schema = "owner string, topic string, day date, ts timestamp_ntz, id int"
    none = spark.createDataFrame([], "owner string, n int, topic string, day date, session int")
    for cut in (0, 50, 120):
        old = profiles.timeline(none, spark.createDataFrame(rows[:cut], schema).repartition(3))
        got = {}
        for x in sorted(profiles.timeline(old, spark.createDataFrame(rows[cut:], schema).repartition(3)).collect(), key=lambda x: (str(x.owner), x.n)):
            got.setdefault(x.owner, []).append((x.topic, x.day, x.session))
        assert got == {k: v for k, v in want.items() if v}


def test_fuzzy_against_all_pairs(spark):
    r = random.Random(3)
    words = ["gradient", "gradients", "descent", "decent", "the", "a", "network", "networks"]
    names = sorted({" ".join(r.choice(words) for _ in range(r.choice([1, 2, 3]))) for _ in range(80)} | {"", "x"})

    def grams(t):
        return {("  " + w + " ")[i : i + 3] for w in t.split() for i in range(len(w) + 1)}

    want = {}
    for a, b in itertools.product(names, names):
        if a != b and grams(a) | grams(b):
            s = round(len(grams(a) & grams(b)) / len(grams(a) | grams(b)), 9)
            if s >= 0.6:
                want[a] = min(want.get(a, (-1.0, b)), (-s, b)) if a in want else (-s, b)
    df = spark.createDataFrame([(n,) for n in names], "name string")
    got = entities.fuzzy(df.withColumnRenamed("name", "surface"), df, others=True)
    assert {x.surface: (-x.similarity, x.name) for x in got.collect()} == want
