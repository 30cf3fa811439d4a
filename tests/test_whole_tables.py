"""Queries over whole tables against brute force."""

from collections import defaultdict

from verdigris.plans import catalog


def test_bfs_over_all_events(spark, tmp_path):
    """A chain of 20 users in which no event_id is divisible by 40, longer than 14 hops, and a part that is out of reach."""
    pairs = [(u, k) for u in range(1, 21) for k in (u, u + 1)] + [(450, 3), (900, 99), (901, 99)]
    rows = [(40 * i + 1, u, f'{{"k": {k}}}') for i, (u, k) in enumerate(pairs)]
    spark.createDataFrame(rows, "event_id long, user_id long, props string").write.parquet(f"{tmp_path}/events.parquet")
    way = defaultdict(set)
    for u, k in pairs:
        way[str(u)].add(f"k{k}")
        way[f"k{k}"].add(str(u))
    want, edge = {"1": 0}, ["1"]
    for node in edge:
        for x in way[node] - set(want):
            want[x] = want[node] + 1
            edge.append(x)
    got = {r.node: r.hop for r in catalog.queries()["bfs_hops"](spark, str(tmp_path)).collect()}
    assert got == want and max(want.values()) > 30 and "900" not in want


def test_fuzzy_over_all_names(spark, tmp_path):
    names = ["green forest lamp", "green forest lamps", "greet forest lamp", "blue river", "blue rivers", "blue river stone", "alone", None, "blue river"]
    spark.createDataFrame([(n,) for n in names], "p_name string").write.parquet(f"{tmp_path}/part.parquet")

    def grams(s):
        return {f"  {w} "[i : i + 3] for w in s.split() for i in range(len(w) + 1)}

    want = {}
    for a in {n for n in names if n}:
        best = []
        for b in {n for n in names if n} - {a}:
            s = round(len(grams(a) & grams(b)) / len(grams(a) | grams(b)), 9)
            if s >= 0.6:
                best.append((-s, b))
        if best:
            want[a] = (min(best)[1], -min(best)[0])
    got = {r.surface: (r.name, r.similarity) for r in catalog.queries()["fuzzy_names"](spark, str(tmp_path)).collect()}
    assert got == want and len(want) >= 5


def test_no_cycles_left_and_none_dropped_in_vain(spark, tmp_path):
    """The most confident edges stay; an edge goes only if those before it lead back (by closure over all pairs)."""
    names = ["click", "view", "error", "purchase", "signup"]
    rows = [(i, f"2024-01-01 00:{i // 60:02d}:{i % 60:02d}", i % 10, names[(i * i + i // 3) % 5]) for i in range(600)]
    spark.createDataFrame(rows, "event_id long, ts string, user_id long, event_type string").write.parquet(f"{tmp_path}/events.parquet")
    weights = defaultdict(int)
    for user in range(10):
        line = [r[3] for r in rows if r[2] == user]
        for a, b in zip(line, line[1:]):
            if a != b:
                weights[user % 5, a, b] += 1
    want = set()
    for group in range(5):
        reach = {(x, x) for x in names}
        for (_, a, b), w in sorted((e for e in weights.items() if e[0][0] == group), key=lambda e: (-e[1], e[0][1:])):
            if (b, a) not in reach:
                want.add((group, a, b, float(w)))
                reach |= {(x, y) for x in names for y in names if (x, a) in reach and (b, y) in reach}
    got = {(r.group, r.prerequisite, r.concept, r.confidence) for r in catalog.queries()["acyclic_edges"](spark, str(tmp_path)).collect()}
    assert got == want and 0 < len(want) < len(weights)
