"""Traversals of relation and prerequisite graphs, a join per hop."""

from __future__ import annotations

from itertools import count
from uuid import uuid4

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from verdigris.functions.rules import sanitize_evidence
from verdigris.operators.lineage import written
from verdigris.operators.retrieval import vector_topk


def both_ways(edges: DataFrame) -> DataFrame:
    """(src, dst, weight) in both directions, so that a hop is an equi-join."""
    return edges.select(F.col("s").alias("src"), F.col("o").alias("dst"), "weight").unionByName(edges.select(F.col("o").alias("src"), F.col("s").alias("dst"), "weight"))


def two_hop(edges: DataFrame, anchors: DataFrame, limit: int = 50, fade: float = 0.85, prune: float = 0.05) -> DataFrame:
    """(node, hop, weight): nodes within two hops of the anchors by their best path, the first ``limit`` by node.

    A step multiplies by the edge's weight and ``fade``; it is dropped when path times edge, before
    fading, does not exceed ``prune``. Paths never enter an anchor or turn back.
    """
    way = both_ways(edges)
    seed = anchors.select(F.col("node").alias("at")).distinct().withColumn("w", F.lit(1.0))
    stop = seed.select(F.col("at").alias("dst"))
    free = way.join(stop, "dst", "left_anti").select("src", "dst", "weight")
    one = seed.join(free, seed.at == free.src).where(F.col("w") * F.col("weight") > prune).select("at", "dst", (F.col("w") * F.col("weight") * fade).alias("w"))
    two = one.select(F.col("at").alias("root"), F.col("dst").alias("mid"), "w").join(free, F.col("mid") == F.col("src")).where((F.col("dst") != F.col("mid")) & (F.col("w") * F.col("weight") > prune))
    rows = seed.select(F.col("at").alias("node"), F.lit(0).alias("hop"), "w").unionByName(one.select(F.col("dst").alias("node"), F.lit(1).alias("hop"), "w")).unionByName(two.select(F.col("dst").alias("node"), F.lit(2).alias("hop"), (F.col("w") * F.col("weight") * fade).alias("w")))
    rows = rows.withColumn("w", F.round("w", 9))
    best = rows.groupBy("node").agg(F.max(F.struct("w", (-F.col("hop")).alias("h"))).alias("m"))
    return best.select("node", (-F.col("m.h")).alias("hop"), F.col("m.w").alias("weight")).orderBy("node").limit(limit)


def two_hop_each(edges: DataFrame, asked: DataFrame, limit: int = 50, fade: float = 0.85, prune: float = 0.05) -> DataFrame:
    """(query_id, node, hop, weight): ``two_hop`` around the anchor array of every (query_id, ids), by a table function called for each.

    The function is SQL with the array as its argument; a lateral join calls it, and the optimiser turns
    that into equi-joins by query. Null and empty arrays reach nothing.
    """
    spark = asked.sparkSession
    name = f"verdigris_{uuid4().hex}"
    edges.createOrReplaceTempView(f"{name}_edges")
    spark.sql(f"""
CREATE TEMPORARY FUNCTION {name}_near(ids ARRAY<STRING>) RETURNS TABLE (node STRING, hop INT, weight DOUBLE) RETURN
WITH way AS (SELECT s AS src, o AS dst, weight FROM {name}_edges UNION ALL SELECT o, s, weight FROM {name}_edges),
seed AS (SELECT DISTINCT explode(ids) AS at),
one AS (SELECT e.dst, e.weight * {fade}D AS w FROM seed JOIN way e ON e.src = seed.at WHERE e.weight > {prune}D AND NOT array_contains(ids, e.dst)),
two AS (SELECT e.dst, one.w * e.weight * {fade}D AS w FROM one JOIN way e ON e.src = one.dst WHERE e.dst <> one.dst AND one.w * e.weight > {prune}D AND NOT array_contains(ids, e.dst)),
every AS (SELECT at AS node, 0 AS hop, 1.0D AS w FROM seed UNION ALL SELECT dst, 1, round(w, 9) FROM one UNION ALL SELECT dst, 2, round(w, 9) FROM two)
SELECT node, -m.h, m.w FROM (SELECT node, max(struct(w, -hop AS h)) AS m FROM every GROUP BY node ORDER BY node LIMIT {limit})""")
    asked.createOrReplaceTempView(f"{name}_asked")
    return spark.sql(f"SELECT a.query_id, near.* FROM {name}_asked a, LATERAL {name}_near(a.ids) near")


def anchored_subgraph(edges: DataFrame, anchors: DataFrame) -> DataFrame:
    """(node, hop, combined): two hops from scored anchors; an anchor keeps its score, others fade with the hop."""
    near = two_hop(edges, anchors.select("node"))
    out = near.join(anchors.select("node", "score"), "node", "left")
    return out.select("node", "hop", F.round(F.when(F.col("hop") == 0, F.col("score")).otherwise(F.col("weight") * (1 - 0.15 * F.col("hop"))), 9).alias("combined"))


def hops(edges: DataFrame, starts: DataFrame) -> DataFrame:
    """(node, hop) by breadth-first search, a join per level until nothing new is reached; the frontier leaves out what was seen."""
    way = written(both_ways(edges).select("src", "dst").distinct())
    seen = starts.select("node").distinct().withColumn("hop", F.lit(0))
    edge = seen
    for level in count(1):
        fresh = edge.join(way, F.col("node") == F.col("src")).select(F.col("dst").alias("node")).distinct().join(seen.select("node"), "node", "left_anti").withColumn("hop", F.lit(level))
        fresh = written(fresh)
        if fresh.isEmpty():
            break
        seen, edge = seen.unionByName(fresh), fresh
    return seen


def session_graph(nodes: DataFrame, edges: DataFrame, fade: float = 0.9) -> DataFrame:
    """(node, type, hop, score): hops from the students over (s, o, weight) edges and a score for display.

    A student scores 1, another node its largest weight (0.5 without an edge) faded by the hop, 1 at
    most. Nodes that no student reaches count as one hop away.
    """
    reached = hops(edges, nodes.where(F.col("type") == "Student").select("node"))
    rows = nodes.join(reached, "node", "left").join(node_weights(edges), "node", "left")
    hop = F.coalesce("hop", F.lit(1))
    score = F.when(F.col("type") == "Student", 1.0).otherwise(F.round(F.least(F.lit(1.0), F.coalesce("weight", F.lit(0.5)) * F.pow(F.lit(fade), hop)), 3))
    return rows.select("node", "type", hop.alias("hop"), score.alias("score"))


def vector_anchors(nodes: DataFrame, asked: DataFrame, k: int = 5, least: float = 0.5) -> DataFrame:
    """(node, score): the nodes nearest to the one query vector of ``asked`` whose cosine reaches ``least``, ``k`` at most."""
    near = vector_topk(nodes, asked, 3 * k, key="node")
    return near.where(F.col("score") >= least).orderBy("rank").limit(k).select("node", "score")


def vector_subgraph(nodes: DataFrame, edges: DataFrame, asked: DataFrame, k: int = 5, least: float = 0.5) -> DataFrame:
    """(node, hop, combined): two hops around the nodes nearest to a query vector."""
    return anchored_subgraph(edges, written(vector_anchors(nodes, asked, k, least)))


def summary_lines(edges: DataFrame, session: int, hidden: list[str], most: int = 60) -> DataFrame:
    """(s, active, past): a student's strongest beliefs as lines, those of one session apart from the others.

    A belief that several sessions hold is told once, by its strongest edge. ``hidden`` predicates are
    left out, after the ``most`` strongest edges are chosen.
    """
    order = [F.desc("weight"), F.desc("observations"), F.desc("valid_from"), "p", "o", "session"]
    top = by_rank(edges, ["s"], order, most).where(~F.col("p").isin(hidden))
    told = by_rank(top, ["s", "p", "o"], order, 1)
    quote = sanitize_evidence("evidence")
    line = F.concat(
        F.lit("- "), "s", F.lit(" -["), "p", F.lit("]-> "), "o",
        F.when(F.col("observations") > 1, F.concat(F.lit(" (mentioned "), F.col("observations"), F.lit(" times)"))).otherwise(""),
        F.when(quote != "", F.concat(F.lit(" <quote>"), quote, F.lit("</quote>"))).otherwise(""),
    )
    placed = told.select("s", "session", F.row_number().over(W.partitionBy("s").orderBy(*order)).alias("n"), line.alias("line"))

    def lines(mine: Column) -> Column:
        return F.array_join(F.transform(F.array_sort(F.collect_list(F.when(mine, F.struct("n", "line")))), lambda x: x["line"]), "\n")

    mine = F.col("session") == session
    return placed.groupBy("s").agg(lines(mine).alias("active"), lines(~mine).alias("past"))


def turning(edges: DataFrame, rounds: int) -> DataFrame:
    """(node): nodes that may lie on a cycle; those that ``rounds`` of peeling off sources and sinks take away do not."""
    left = written(edges.select("prerequisite", "concept").distinct())
    size = left.count()
    for _ in range(rounds):
        inner = left.join(left.select(F.col("concept").alias("prerequisite")).distinct(), "prerequisite", "left_semi").join(left.select(F.col("prerequisite").alias("concept")).distinct(), "concept", "left_semi")
        left = written(inner.select("prerequisite", "concept"))
        before, size = size, left.count()
        if size in (before, 0):
            break
    return left.select(F.explode(F.array("prerequisite", "concept")).alias("node")).distinct()


def prerequisites(edges: DataFrame, targets: DataFrame, depth: int = 6, least: float = 0.5) -> DataFrame:
    """(target, concept, depth): what leads up to each target, at its deepest, over edges of enough confidence.

    A level keeps each (target, concept) once, however many paths lead there. Only nodes that may lie on a
    cycle are remembered along the way, since no path may come to one of them twice.
    """
    kept = written(edges.where(F.col("confidence") >= least).select("prerequisite", "concept").distinct())
    risky = turning(kept, depth)
    way = written(kept.join(risky.select(F.col("node").alias("prerequisite"), F.lit(True).alias("risky")), "prerequisite", "left").select("prerequisite", "concept", F.coalesce("risky", F.lit(False)).alias("risky")))
    start = targets.select(F.col("concept").alias("target")).distinct()
    now = start.select("target", F.col("target").alias("at"), F.array("target").alias("met"))
    found = None
    for level in range(1, depth + 1):
        step = now.join(way, F.col("at") == way.concept).where(~F.array_contains("met", F.col("prerequisite")))
        met = F.when(F.col("risky"), F.array_sort(F.array_append("met", F.col("prerequisite")))).otherwise(F.col("met"))
        now = written(step.select("target", F.col("prerequisite").alias("at"), met.alias("met")).distinct())
        rows = now.select("target", F.col("at").alias("concept"), F.lit(level).alias("depth"))
        found = rows if found is None else found.unionByName(rows)
        if now.isEmpty():
            break
    return found.groupBy("target", "concept").agg(F.max("depth").alias("depth"))


def components(edges: DataFrame) -> DataFrame:
    """(group, node, component): the strongly connected components of (group, prerequisite, concept) that have an edge within.

    Round by round, nodes without a way in or out are peeled off, and each of the others learns the
    smallest node that leads to it; those from which that node is led to in turn are its component.
    """
    spark = edges.sparkSession
    left = written(edges.select("group", "prerequisite", "concept").distinct())
    out = None

    def spread(seed: DataFrame, way: DataFrame, same: bool) -> DataFrame:
        """Labels (group, node, label) after the smallest has gone along ``way`` (src, dst); with ``same`` only within the label's own nodes."""
        now = written(seed)
        while True:
            told = now.select("group", F.col("node").alias("src"), "label").join(way, ["group", "src"]).select("group", F.col("dst").alias("node"), "label")
            if same:
                grown = now.unionByName(told.join(color, ["group", "node", "label"], "left_semi")).distinct()
            else:
                grown = now.unionByName(told).groupBy("group", "node").agg(F.min("label").alias("label"))
            grown = written(grown)
            changed = grown.exceptAll(now).limit(1).count()
            now = grown
            if not changed:
                return now

    while True:
        ins, outs = left.select("group", F.col("concept").alias("prerequisite")).distinct(), left.select("group", F.col("prerequisite").alias("concept")).distinct()
        inner = written(left.where("prerequisite = concept").unionByName(left.where("prerequisite <> concept").join(ins, ["group", "prerequisite"], "left_semi").join(outs, ["group", "concept"], "left_semi").select("group", "prerequisite", "concept")))
        if inner.isEmpty():
            break
        if inner.count() < left.count():
            left = inner
            continue
        way = written(left.select("group", F.col("prerequisite").alias("src"), F.col("concept").alias("dst")))
        nodes = way.select("group", F.explode(F.array("src", "dst")).alias("node")).distinct()
        color = spread(nodes.withColumn("label", F.col("node")), way, False)
        back = way.select("group", F.col("dst").alias("src"), F.col("src").alias("dst"))
        mine = spread(color.where(F.col("node") == F.col("label")), back, True)
        done = written(mine.select("group", "node", F.col("label").alias("component")))
        out = done if out is None else out.unionByName(done)
        gone = done.select("group", F.col("node").alias("prerequisite"))
        left = written(left.join(gone, ["group", "prerequisite"], "left_anti").join(gone.withColumnRenamed("prerequisite", "concept"), ["group", "concept"], "left_anti").select("group", "prerequisite", "concept"))
    kinds = dict(edges.dtypes)
    return out if out is not None else spark.createDataFrame([], f"group {kinds['group']}, node {kinds['concept']}, component {kinds['concept']}")


def roots(edges: DataFrame) -> DataFrame:
    """Concepts that need nothing."""
    return edges.select(F.col("prerequisite").alias("concept")).distinct().join(edges.select("concept"), "concept", "left_anti")


def gaps(closure: DataFrame, states: DataFrame) -> DataFrame:
    """(student, concept, n): unmastered prerequisites that at least two of a student's struggles share.

    ``closure`` is (target, concept); ``states`` is (student, concept, state).
    """
    hard = states.where(F.col("state") == "struggling").select("student", F.col("concept").alias("target"))
    need = hard.join(closure, "target").select("student", "target", "concept")
    open_ = need.join(states.where(F.col("state").isin("mastered", "struggling")).select("student", "concept"), ["student", "concept"], "left_anti")
    return open_.groupBy("student", "concept").agg(F.count_distinct("target").alias("n")).where(F.col("n") >= 2)


def hints(asked: DataFrame, states: DataFrame, edges: DataFrame, most: int = 5, quiet: int = 20) -> DataFrame:
    """(query_id, expand, suppress) for the concepts (query_id, student, concept) of queries.

    ``expand`` has the direct prerequisites that the student has not mastered, and the concepts of the
    query the student struggles with; ``suppress`` has what is mastered and not asked about. Both are
    sorted and cut. ``states`` is (student, concept, state).
    """
    mastered, hard = (states.where(F.col("state") == x).select("student", "concept").distinct() for x in ("mastered", "struggling"))
    asked = asked.distinct()
    up = asked.join(edges.select("concept", "prerequisite").distinct(), "concept").select("query_id", "student", F.col("prerequisite").alias("concept")).join(mastered, ["student", "concept"], "left_anti")
    own = asked.join(hard, ["student", "concept"], "left_semi").select("query_id", "student", "concept")
    more = up.unionByName(own).groupBy("query_id").agg(F.slice(F.array_sort(F.collect_set("concept")), 1, most).alias("expand"))
    known = asked.select("query_id", "student").distinct().join(mastered, "student").join(asked.select("query_id", "concept"), ["query_id", "concept"], "left_anti")
    less = by_rank(known.distinct(), ["query_id"], ["concept"], quiet).groupBy("query_id").agg(F.array_sort(F.collect_list("concept")).alias("suppress"))
    none = F.array().cast(f"array<{dict(asked.dtypes)['concept']}>")
    return asked.select("query_id").distinct().join(more, "query_id", "left").join(less, "query_id", "left").select("query_id", F.coalesce("expand", none).alias("expand"), F.coalesce("suppress", none).alias("suppress"))


def reachable(edges: DataFrame, targets: DataFrame) -> DataFrame:
    """(target, concept): all that a target needs, itself included, however deep; a join per level, over what is new."""
    way = written(edges.select("prerequisite", "concept").distinct())
    seen = fresh = written(targets.select("target", F.col("target").alias("concept")).distinct())
    while not fresh.isEmpty():
        step = fresh.join(way, "concept").select("target", F.col("prerequisite").alias("concept")).distinct()
        fresh = written(step.join(seen, ["target", "concept"], "left_anti"))
        seen = seen.unionByName(fresh)
    return seen


def learning_paths(edges: DataFrame, targets: DataFrame) -> DataFrame:
    """(target, step, concept): each target's prerequisites in order, without the mastered; (target, mastered array) rows ask.

    A level holds the concepts whose prerequisites all stand in earlier ones. Within a level they follow
    the place of their last prerequisite, then the name; what a cycle holds comes last, by name.
    """
    need = written(reachable(edges, targets))
    way = edges.select("prerequisite", "concept").distinct()
    inner = written(need.join(way, "concept").select("target", "concept", "prerequisite"))  # a prerequisite of what is needed is needed
    left = need
    placed = None
    by = W.partitionBy("target").orderBy("last", "concept")
    while True:
        waits = inner.join(left.select("target", F.col("concept").alias("prerequisite")), ["target", "prerequisite"]).select("target", "concept").distinct()
        ready = left.join(waits, ["target", "concept"], "left_anti")
        if placed is None:
            last, offset = ready.withColumn("last", F.lit(-1)), None
        else:
            after = inner.join(placed.withColumnRenamed("concept", "prerequisite"), ["target", "prerequisite"]).groupBy("target", "concept").agg(F.max("place").alias("last"))
            last = ready.join(after, ["target", "concept"], "left")
            offset = placed.groupBy("target").agg(F.count("*").alias("offset"))
        ranked = last.withColumn("rank", F.row_number().over(by))
        ranked = ranked.withColumn("offset", F.lit(0)) if offset is None else ranked.join(offset, "target", "left")
        done = written(ranked.select("target", "concept", (F.col("rank") - 1 + F.coalesce("offset", F.lit(0))).alias("place")))
        if done.isEmpty():
            break
        placed = done if placed is None else placed.unionByName(done)
        left = written(left.join(done.select("target", "concept"), ["target", "concept"], "left_anti"))
    rest = left.withColumn("place", F.lit(1 << 40).cast("long"))
    placed = rest if placed is None else placed.withColumn("place", F.col("place").cast("long")).unionByName(rest)
    open_ = placed.join(targets.select("target", "mastered"), "target").where(~F.coalesce(F.array_contains("mastered", F.col("concept")), F.lit(False)))
    step = F.row_number().over(W.partitionBy("target").orderBy("place", "concept")) - 1
    return open_.select("target", step.alias("step"), "concept")


def drop_cycles(edges: DataFrame) -> DataFrame:
    """(group, prerequisite, concept, confidence) without edges that would close a cycle, the most confident edges first.

    An edge can close a cycle only within a strongly connected component, so the others stay at once.
    Whether an edge of a component closes one depends on all of its edges before, which one task goes
    through in order.
    """

    def keep(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["confidence", "prerequisite", "concept"], ascending=[False, True, True], kind="stable")
        ups: dict = {}

        def reaches(a, b) -> bool:
            stack, seen = [a], set()
            while stack:
                x = stack.pop()
                if x == b:
                    return True
                if x not in seen:
                    seen.add(x)
                    stack += ups.get(x, ())
            return False

        good = []
        for p, c in zip(rows["prerequisite"], rows["concept"], strict=True):
            ok = p != c and not reaches(p, c)
            if ok:
                ups.setdefault(c, set()).add(p)
            good.append(ok)
        return rows[good].drop(columns="component")

    found = components(edges)
    told = edges.join(found.select("group", F.col("node").alias("prerequisite"), "component"), ["group", "prerequisite"], "left").join(found.select("group", F.col("node").alias("concept"), F.col("component").alias("other")), ["group", "concept"], "left")
    told = written(told.select(*edges.columns, "component", (F.col("component") == F.col("other")).alias("inside")))
    free = told.where(~F.coalesce("inside", F.lit(False)) & (F.col("prerequisite") != F.col("concept"))).select(*edges.columns)
    bound = told.where("inside").select(*edges.columns, "component")
    return free.unionByName(bound.groupBy("group", "component").applyInPandas(keep, edges.schema))


def bundle(edges: DataFrame, priority: list[str]) -> DataFrame:
    """(s, o, top, weight, label, evidence): one row per pair of nodes; the top predicate is the first in ``priority``.

    Quotes that are not empty are joined by predicate and session.
    """
    rank = F.array_position(F.lit(priority), F.col("p"))
    quotes = F.array_sort(F.collect_list(F.when(F.coalesce("evidence", F.lit("")) != "", F.struct("p", "session", "evidence"))))
    return edges.groupBy("s", "o").agg(
        F.min_by("p", F.struct(F.when(rank == 0, 999).otherwise(rank), "p")).alias("top"),
        F.max("weight").alias("weight"),
        F.array_join(F.array_sort(F.collect_set("p")), " & ").alias("label"),
        F.array_join(F.transform(quotes, lambda q: q["evidence"]), " | ").alias("evidence"),
    )


def node_weights(edges: DataFrame) -> DataFrame:
    """(node, weight): the largest weight of a node's edges, at either end."""
    return edges.select(F.explode(F.array("s", "o")).alias("node"), "weight").groupBy("node").agg(F.max("weight").alias("weight"))


def repair_self_loops(edges: DataFrame, student: str = "Student") -> DataFrame:
    """Self-loops of student relations start from the student, unless that edge exists; other self-loops go."""
    loops = edges.where(F.col("s") == F.col("o"))
    rest = edges.where(F.col("s") != F.col("o"))
    moved = loops.withColumn("s", F.lit(student)).where(F.col("s") != F.col("o")).dropDuplicates(["s", "p", "o"])
    return rest.unionByName(moved.join(rest.select("s", "p", "o"), ["s", "p", "o"], "left_anti").select(*rest.columns))


def by_rank(df: DataFrame, part: list[str], order: list, n: int) -> DataFrame:
    """The first n rows of each part."""
    return df.withColumn("_n", F.row_number().over(W.partitionBy(*part).orderBy(*order))).where(F.col("_n") <= n).drop("_n")
