"""Belief, traversal and curriculum queries over events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from verdigris.operators import beliefs as B
from verdigris.operators import graph as G
from verdigris.operators.lineage import step_path, written
from verdigris.plans.registry import query
from verdigris.sources.tables import table
from verdigris.streaming.belief_table import BeliefTable

NOW = "2030-01-01 00:00:00"

OPS_SQL = """
ops AS (
  SELECT 0 AS tenant, user_id % 3 AS session, (user_id % 20)::VARCHAR AS s, (json_extract(props, '$.k')::INT % 20)::VARCHAR AS o, ts, event_id AS id,
    CASE event_type WHEN 'error' THEN 'struggles_with' WHEN 'purchase' THEN 'mastered' WHEN 'view' THEN 'confused_about' WHEN 'signup' THEN 'wants_to_learn' ELSE 'studied' END AS p,
    0.5::DOUBLE + (event_id % 6) * 0.1::DOUBLE AS confidence, CASE WHEN event_id % 4 = 0 THEN '' ELSE 'e' || event_id END AS evidence, CASE WHEN event_id % 97 = 0 THEN 'invalidate' ELSE 'add' END AS op
  FROM events
)"""
FOLD_SQL = """
marks AS (
  SELECT tenant, s, o, p, ts, id, 1 AS mark FROM ops WHERE op = 'invalidate'
  UNION ALL SELECT tenant, s, o, unnest(CASE p WHEN 'mastered' THEN ['struggles_with', 'confused_about', 'wants_to_learn'] WHEN 'struggles_with' THEN ['mastered'] WHEN 'confused_about' THEN ['mastered'] ELSE [] END), ts, id, 1 FROM ops WHERE op = 'add'
), line AS (
  SELECT tenant, s, o, p, ts, id, 0 AS mark, session, confidence, evidence FROM ops WHERE op = 'add'
  UNION ALL SELECT tenant, s, o, p, ts, id, mark, NULL, NULL, NULL FROM marks
), cut AS (
  SELECT *, COALESCE(SUM(mark) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + mark AS segment, MIN(CASE WHEN mark = 1 THEN ts END) OVER (w ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS gone
  FROM line WINDOW w AS (PARTITION BY tenant, s, o, p ORDER BY ts, id, mark DESC)
), edges AS (
  SELECT tenant, session, s, p, o, segment::BIGINT AS segment, round(CASE WHEN COUNT(*) = 1 THEN arg_min(confidence, (ts, id)) ELSE LEAST(arg_min(confidence, (ts, id)) + 0.1::DOUBLE * (SUM(confidence) - arg_min(confidence, (ts, id))), 2.0::DOUBLE) END, 9) AS weight,
    COUNT(*) AS observations, MIN(ts) AS valid_from, MIN(gone) AS invalidated_at, arg_max(evidence, (ts, id)) FILTER (evidence <> '') AS evidence
  FROM cut WHERE mark = 0 GROUP BY tenant, session, s, p, o, segment
)"""
FULL = f"WITH {OPS_SQL}, {FOLD_SQL}"


def operations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as belief operations of 20 students on 20 concepts."""
    e = table(spark, sf_dir, "events")
    p = F.when(F.col("event_type") == "error", "struggles_with").when(F.col("event_type") == "purchase", "mastered").when(F.col("event_type") == "view", "confused_about").when(F.col("event_type") == "signup", "wants_to_learn").otherwise("studied")
    k = F.get_json_object("props", "$.k").cast("int")
    return e.select(
        F.lit(0).alias("tenant"), (F.col("user_id") % 3).alias("session"), (F.col("user_id") % 20).cast("string").alias("s"), (k % 20).cast("string").alias("o"), "ts", F.col("event_id").alias("id"), p.alias("p"),
        (F.lit(0.5) + (F.col("event_id") % 6) * F.lit(0.1)).alias("confidence"), F.when(F.col("event_id") % 4 == 0, "").otherwise(F.concat(F.lit("e"), F.col("event_id"))).alias("evidence"),
        F.when(F.col("event_id") % 97 == 0, "invalidate").otherwise("add").alias("op"),
    )


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.fold(operations(spark, sf_dir))


@query(f"{FULL} SELECT * FROM edges")
def belief_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edges(spark, sf_dir)


NAMED_SQL = f"""WITH {OPS_SQL}, told AS (SELECT tenant, session, 'Student ' || s AS s, CASE WHEN id % 2 = 0 THEN 'Topic ' ELSE 'topic ' END || o AS o, ts, id, p, confidence, evidence, op, CASE WHEN op = 'invalidate' AND id % 2 = 0 THEN 'asked to forget' END AS reason FROM ops),
    known AS (SELECT DISTINCT tenant, s, o, p FROM told WHERE op = 'add'),
    marks AS (SELECT k.tenant, k.s, k.o, k.p, t.ts, t.id, COALESCE(t.reason, 'superseded by later conversation') AS reason FROM told t JOIN known k ON k.tenant = t.tenant AND lower(k.s) = lower(t.s) AND lower(k.o) = lower(t.o) AND k.p = t.p WHERE t.op = 'invalidate'
      UNION ALL SELECT tenant, s, o, unnest(CASE p WHEN 'mastered' THEN ['struggles_with', 'confused_about', 'wants_to_learn'] WHEN 'struggles_with' THEN ['mastered'] WHEN 'confused_about' THEN ['mastered'] ELSE [] END), ts, id, 'superseded when the student showed ' || p FROM told WHERE op = 'add'),
    line AS (SELECT tenant, s, o, p, ts, id, 0 AS mark, session, confidence, evidence, NULL AS reason FROM told WHERE op = 'add' UNION ALL SELECT tenant, s, o, p, ts, id, 1, NULL, NULL, NULL, reason FROM marks),
    cut AS (SELECT *, SUM(mark) OVER (w ROWS UNBOUNDED PRECEDING) AS segment, first_value(CASE WHEN mark = 1 THEN ts END IGNORE NULLS) OVER (w ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS gone,
      first_value(reason IGNORE NULLS) OVER (w ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS why FROM line WINDOW w AS (PARTITION BY tenant, s, o, p ORDER BY ts, id, mark DESC))
    SELECT tenant, session, s, p, o, round(CASE WHEN COUNT(*) = 1 THEN arg_min(confidence, (ts, id)) ELSE LEAST(arg_min(confidence, (ts, id)) + 0.1::DOUBLE * (SUM(confidence) - arg_min(confidence, (ts, id))), 2.0::DOUBLE) END, 9) AS weight, COUNT(*) AS observations, MIN(ts) AS valid_from, MIN(gone) AS invalidated_at,
      MIN(why) AS reason, arg_max(evidence, (ts, id)) FILTER (evidence <> '') AS evidence, COALESCE(MIN(gone), MAX(ts)) AS updated_at FROM cut WHERE mark = 0 GROUP BY tenant, session, s, p, o, segment"""


@query(NAMED_SQL)
def belief_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All operations, in four batches of their time, merged into a table of edges with reasons and dates; names differ by case."""
    topic = F.concat(F.when(F.col("id") % 2 == 0, "Topic ").otherwise("topic "), F.col("o"))
    ops = operations(spark, sf_dir).withColumn("s", F.concat(F.lit("Student "), F.col("s"))).withColumn("o", topic).withColumn("reason", F.when((F.col("op") == "invalidate") & (F.col("id") % 2 == 0), "asked to forget"))
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    cuts = ops.agg(F.percentile_approx(at, [0.25, 0.5, 0.75]).alias("c")).first()["c"] or []
    beliefs = BeliefTable(spark, step_path(spark))
    for n, (low, high) in enumerate(zip([None, *cuts], [*cuts, None], strict=True)):
        part = ops if low is None else ops.where(at > low)
        beliefs.apply(part if high is None else part.where(at <= high), n)
    return beliefs.edges().withColumn("weight", F.round("weight", 9))


@query(f"{FULL} SELECT s, p, o, session, weight, observations FROM edges WHERE invalidated_at IS NULL")
def current_beliefs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.current(edges(spark, sf_dir)).select("s", "p", "o", "session", "weight", "observations")


@query(f"{FULL}, mid AS (SELECT TIMESTAMP '2024-01-15 00:00:00' AS t) SELECT s, p, o, session, weight FROM edges, mid WHERE valid_from <= t AND (invalidated_at IS NULL OR invalidated_at > t)")
def beliefs_as_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.as_of(edges(spark, sf_dir), "2024-01-15 00:00:00").select("s", "p", "o", "session", "weight")


@query(f"{FULL} SELECT s, p, o, session, CASE WHEN weight > 0.1 AND valid_from < TIMESTAMP '{NOW}' - INTERVAL 7 DAYS THEN round(GREATEST(weight * 0.95::DOUBLE, 0.1::DOUBLE), 9) ELSE weight END AS weight FROM edges WHERE invalidated_at IS NULL")
def belief_decay(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.decay(B.current(edges(spark, sf_dir)).withColumn("updated_at", F.col("valid_from")), NOW).select("s", "p", "o", "session", "weight")


@query(f"{FULL} SELECT p, o, COUNT(*) AS n, MAX(weight) AS top_weight, round(AVG(weight), 9) AS mean_weight, MAX(valid_from) AS latest FROM edges WHERE p IN ('struggles_with', 'mastered', 'confused_about', 'wants_to_learn', 'studied') GROUP BY p, o")
def learning_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edges(spark, sf_dir).where(F.col("p").isin("struggles_with", "mastered", "confused_about", "wants_to_learn", "studied")).groupBy("p", "o").agg(F.count("*").alias("n"), F.max("weight").alias("top_weight"), F.round(F.avg("weight"), 9).alias("mean_weight"), F.max("valid_from").alias("latest"))


@query(f"{FULL} SELECT * FROM (SELECT s, o, invalidated_at, row_number() OVER (PARTITION BY s ORDER BY invalidated_at DESC, o, session, segment) AS rank FROM edges WHERE p = 'struggles_with' AND invalidated_at IS NOT NULL) WHERE rank <= 10")
def resolved_difficulties(spark: SparkSession, sf_dir: str) -> DataFrame:
    gone = edges(spark, sf_dir).where((F.col("p") == "struggles_with") & F.col("invalidated_at").isNotNull())
    order = W.partitionBy("s").orderBy(F.desc("invalidated_at"), "o", "session", "segment")
    return gone.select("s", "o", "invalidated_at", F.row_number().over(order).alias("rank")).where("rank <= 10")


@query(f"{FULL} SELECT * FROM (SELECT s, p, o, session, weight, row_number() OVER (PARTITION BY s ORDER BY weight DESC, observations DESC, valid_from DESC, p, o, session) AS rank FROM edges WHERE invalidated_at IS NULL) WHERE rank <= 60")
def context_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = W.partitionBy("s").orderBy(F.desc("weight"), F.desc("observations"), F.desc("valid_from"), "p", "o", "session")
    return B.current(edges(spark, sf_dir)).select("s", "p", "o", "session", "weight", F.row_number().over(order).alias("rank")).where("rank <= 60")


@query(f"{FULL} SELECT s, o AS name, weight FROM (SELECT s, o, weight, row_number() OVER (PARTITION BY s ORDER BY weight DESC, observations DESC, valid_from DESC, o, session) AS r FROM edges WHERE p = 'studied' AND weight >= 0.7 AND invalidated_at IS NULL) WHERE r = 1")
def resolved_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The strongest live object of a relation, as names are resolved."""
    live = B.current(edges(spark, sf_dir)).where((F.col("p") == "studied") & (F.col("weight") >= 0.7))
    return G.by_rank(live, ["s"], [F.desc("weight"), F.desc("observations"), F.desc("valid_from"), "o", "session"], 1).select("s", F.col("o").alias("name"), "weight")


@query(
    f"""{FULL}, live AS (SELECT s, p, o FROM edges WHERE invalidated_at IS NULL), m AS (SELECT DISTINCT s, o FROM live WHERE p = 'mastered'), h AS (SELECT DISTINCT s, o FROM live WHERE p IN ('struggles_with', 'confused_about'))
    SELECT s, COALESCE((SELECT list_sort(list(o)) FROM m WHERE m.s = x.s AND o NOT IN (SELECT o FROM h WHERE h.s = x.s)), []) AS mastered, COALESCE((SELECT list_sort(list(o)) FROM h WHERE h.s = x.s), []) AS struggling FROM (SELECT DISTINCT s FROM live) x"""
)
def learner_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    live = B.current(edges(spark, sf_dir))
    hard = F.collect_set(F.when(F.col("p").isin("struggles_with", "confused_about"), F.col("o")))
    rows = live.groupBy("s").agg(F.collect_set(F.when(F.col("p") == "mastered", F.col("o"))).alias("m"), hard.alias("h"))
    return rows.select("s", F.array_sort(F.array_except("m", "h")).alias("mastered"), F.array_sort("h").alias("struggling"))


@query(f"{FULL} SELECT s, CASE WHEN COUNT(DISTINCT CASE WHEN p = 'mastered' THEN o END) >= 6 THEN 'advanced' WHEN COUNT(DISTINCT CASE WHEN p = 'mastered' THEN o END) >= 2 THEN 'intermediate' ELSE 'beginner' END AS level FROM edges WHERE invalidated_at IS NULL GROUP BY s")
def learner_level(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.count_distinct(F.when(F.col("p") == "mastered", F.col("o")))
    return B.current(edges(spark, sf_dir)).groupBy("s").agg(F.when(n >= 6, "advanced").when(n >= 2, "intermediate").otherwise("beginner").alias("level"))


GRAPH_SQL = f"""{FULL}, g AS (SELECT 'u' || s AS s, 'c' || o AS o, MAX(weight) AS weight FROM edges WHERE invalidated_at IS NULL GROUP BY 1, 2), way AS (SELECT s AS src, o AS dst, weight FROM g UNION ALL SELECT o, s, weight FROM g), free AS (SELECT * FROM way WHERE dst NOT IN ('u0', 'u1'))"""


def graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Live relations between all students and concepts, by their strongest edge; written, since each hop reads them in both directions."""
    return written(B.current(edges(spark, sf_dir)).groupBy(F.concat(F.lit("u"), "s").alias("s"), F.concat(F.lit("c"), "o").alias("o")).agg(F.max("weight").alias("weight")))


TWO_HOP_SQL = f"""{GRAPH_SQL}, one AS (SELECT dst, round(weight * 0.85::DOUBLE, 15) AS w FROM free WHERE src IN ('u0', 'u1') AND weight > 0.05),
    two AS (SELECT f.dst, o.w * f.weight * 0.85::DOUBLE AS w FROM one o JOIN free f ON f.src = o.dst WHERE f.dst <> o.dst AND o.w * f.weight > 0.05),
    near AS (SELECT 'u0' AS node, 0 AS hop, 1.0::DOUBLE AS w UNION ALL SELECT 'u1', 0, 1.0 UNION ALL SELECT dst, 1, round(w, 9) FROM one UNION ALL SELECT dst, 2, round(w, 9) FROM two),
    best AS (SELECT node, hop, w AS weight FROM (SELECT *, row_number() OVER (PARTITION BY node ORDER BY w DESC, hop) AS r FROM near) WHERE r = 1 ORDER BY node LIMIT 50)"""


@query(f"{TWO_HOP_SQL} SELECT * FROM best")
def two_hop(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.two_hop(graph(spark, sf_dir), spark.createDataFrame([("u0",), ("u1",)], "node string"))


@query(f"{TWO_HOP_SQL} SELECT node, hop, round(CASE WHEN hop = 0 THEN CASE node WHEN 'u0' THEN 0.9::DOUBLE ELSE 0.6::DOUBLE END ELSE weight * (1 - 0.15::DOUBLE * hop) END, 9) AS combined FROM best")
def anchored_subgraph(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.anchored_subgraph(graph(spark, sf_dir), spark.createDataFrame([("u0", 0.9), ("u1", 0.6)], "node string, score double"))


@query(
    """WITH RECURSIVE e AS (SELECT DISTINCT user_id::VARCHAR AS s, 'k' || json_extract(props, '$.k') AS o FROM events), way AS (SELECT s AS src, o AS dst FROM e UNION SELECT o, s FROM e),
    walk AS (SELECT '1' AS node, 0 AS hop UNION SELECT w.dst, hop + 1 FROM walk JOIN way w ON w.src = walk.node WHERE hop < 30) SELECT node, MIN(hop) AS hop FROM walk GROUP BY node"""
)
def bfs_hops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hops from a user over the graph of all users, concepts and events, until no new node is reached.

    The SQL walks 30 levels (recursion in SQL needs an end); the tables' graphs are far shallower.
    """
    rows = table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("s"), F.concat(F.lit("k"), F.get_json_object("props", "$.k")).alias("o")).distinct()
    return G.hops(rows.withColumn("weight", F.lit(1.0)), spark.createDataFrame([("1",)], "node string"))


@query(f"{FULL} SELECT node, MAX(weight) AS weight FROM (SELECT s AS node, weight FROM edges WHERE invalidated_at IS NULL UNION ALL SELECT o, weight FROM edges WHERE invalidated_at IS NULL) GROUP BY node")
def node_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.node_weights(B.current(edges(spark, sf_dir)))


@query(
    f"""{FULL} SELECT s, o, arg_min(p, (CASE p WHEN 'mastered' THEN 1 WHEN 'struggles_with' THEN 2 WHEN 'studied' THEN 3 ELSE 999 END, p)) AS top, MAX(weight) AS weight, array_to_string(list_sort(list(DISTINCT p)), ' & ') AS label, COALESCE(string_agg(evidence, ' | ' ORDER BY p, session, evidence) FILTER (evidence <> ''), '') AS evidence FROM edges WHERE invalidated_at IS NULL GROUP BY s, o"""
)
def bundled_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.bundle(B.current(edges(spark, sf_dir)), ["mastered", "struggles_with", "studied"])


TREE_SQL = "tree AS (SELECT k // 2 AS prerequisite, k AS concept, 0.4::DOUBLE + (k % 6) * 0.1::DOUBLE AS confidence FROM (SELECT DISTINCT json_extract(props, '$.k')::INT AS k FROM events) WHERE k >= 1)"


def tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("int")
    rows = table(spark, sf_dir, "events").select(k.alias("concept")).distinct().where("concept >= 1")
    return rows.select(F.expr("concept div 2").cast("int").alias("prerequisite"), "concept", (F.lit(0.4) + (F.col("concept") % 6) * F.lit(0.1)).alias("confidence"))


@query(
    f"""WITH RECURSIVE {TREE_SQL}, up AS (SELECT concept AS target, prerequisite AS concept, 1 AS depth FROM tree WHERE confidence >= 0.5 UNION ALL SELECT u.target, t.prerequisite, u.depth + 1 FROM up u JOIN tree t ON t.concept = u.concept WHERE t.confidence >= 0.5 AND u.depth < 6)
    SELECT target, concept, MAX(depth) AS depth FROM up GROUP BY target, concept"""
)
def prerequisite_closure(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = tree(spark, sf_dir)
    return G.prerequisites(t, t.select("concept"))


@query(f"WITH {TREE_SQL} SELECT DISTINCT prerequisite AS concept FROM tree WHERE prerequisite NOT IN (SELECT concept FROM tree)")
def curriculum_roots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.roots(tree(spark, sf_dir))


@query(
    f"""WITH RECURSIVE {OPS_SQL}, {FOLD_SQL}, {TREE_SQL}, up AS (SELECT concept AS target, prerequisite AS concept, 1 AS depth FROM tree UNION ALL SELECT u.target, t.prerequisite, u.depth + 1 FROM up u JOIN tree t ON t.concept = u.concept WHERE u.depth < 6),
    live AS (SELECT DISTINCT s, o::INT AS concept, p FROM edges WHERE invalidated_at IS NULL), hard AS (SELECT DISTINCT s, concept FROM live WHERE p = 'struggles_with')
    SELECT s AS student, u.concept, COUNT(DISTINCT target) AS n FROM hard JOIN up u ON u.target = hard.concept WHERE NOT EXISTS (SELECT 1 FROM live l WHERE l.s = hard.s AND l.concept = u.concept AND l.p IN ('mastered', 'struggles_with')) GROUP BY s, u.concept HAVING COUNT(DISTINCT target) >= 2"""
)
def gap_diagnosis(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = tree(spark, sf_dir)
    state = F.when(F.col("p") == "mastered", "mastered").when(F.col("p") == "struggles_with", "struggling")
    states = B.current(edges(spark, sf_dir)).select(F.col("s").alias("student"), F.col("o").cast("int").alias("concept"), state.alias("state")).where("state is not null").distinct()
    return G.gaps(G.prerequisites(t, t.select("concept"), least=0.0), states)


@query(
    f"""{FULL}, {TREE_SQL}, live AS (SELECT DISTINCT s, o::INT AS concept, p FROM edges WHERE invalidated_at IS NULL), hints AS (SELECT DISTINCT l.s AS student, t.prerequisite AS concept FROM live l JOIN tree t ON t.concept = l.concept WHERE l.p = 'wants_to_learn' AND NOT EXISTS (SELECT 1 FROM live m WHERE m.s = l.s AND m.p = 'mastered' AND m.concept = t.prerequisite))
    SELECT student, list_sort(list(concept))[1:5] AS hints FROM hints GROUP BY student"""
)
def retrieval_hints(spark: SparkSession, sf_dir: str) -> DataFrame:
    live = B.current(edges(spark, sf_dir)).select(F.col("s").alias("student"), F.col("o").cast("int").alias("concept"), "p").distinct()
    need = live.where("p = 'wants_to_learn'").join(tree(spark, sf_dir), "concept").select("student", F.col("prerequisite").alias("concept")).distinct()
    open_ = need.join(live.where("p = 'mastered'").select("student", "concept"), ["student", "concept"], "left_anti")
    return open_.groupBy("student").agg(F.slice(F.array_sort(F.collect_list("concept")), 1, 5).alias("hints"))


@query()
def learning_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ordered prerequisites of every concept of the tree, minus multiples of 7 as mastered."""
    t = tree(spark, sf_dir).select(F.col("prerequisite").cast("string").alias("prerequisite"), F.col("concept").cast("string").alias("concept"))
    return G.learning_paths(t, t.select(F.col("concept").alias("target"), F.lit(["7", "14", "21"]).alias("mastered")))


@query()
def acyclic_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The order graph of customers' event types without edges that close a cycle."""
    e = table(spark, sf_dir, "events")
    pairs = e.select((F.col("user_id") % 5).alias("group"), F.col("event_type").alias("prerequisite"), F.lead("event_type").over(W.partitionBy("user_id").orderBy("ts", "event_id")).alias("concept"))
    rows = pairs.where("concept is not null and concept <> prerequisite").groupBy("group", "prerequisite", "concept").agg(F.count("*").cast("double").alias("confidence"))
    return G.drop_cycles(rows)


@query(
    f"""{FULL}, loops AS (SELECT CASE WHEN id % 5 = 0 THEN o ELSE s END AS s, p, o FROM ops WHERE op = 'add'), rest AS (SELECT DISTINCT s, p, o FROM loops WHERE s <> o), moved AS (SELECT DISTINCT 'Student' AS s, p, o FROM loops WHERE s = o)
    SELECT * FROM rest UNION ALL SELECT * FROM moved m WHERE NOT EXISTS (SELECT 1 FROM rest r WHERE r.s = m.s AND r.p = m.p AND r.o = m.o)"""
)
def repaired_self_loops(spark: SparkSession, sf_dir: str) -> DataFrame:
    ops = operations(spark, sf_dir).where("op = 'add'").select(F.when(F.col("id") % 5 == 0, F.col("o")).otherwise(F.col("s")).alias("s"), "p", "o").distinct()
    return G.repair_self_loops(ops)


@query(
    """WITH raw AS (SELECT (user_id % 7)::VARCHAR AS subject, CASE WHEN event_id % 11 = 0 THEN 'knows' WHEN event_id % 3 = 0 THEN 'related_to' ELSE 'studied' END AS predicate, CASE WHEN event_id % 13 = 0 THEN ' ' ELSE (event_id % 7)::VARCHAR END AS object, CASE WHEN event_id % 2 = 0 THEN 'Tool' ELSE 'Thing' END AS object_type, (event_id % 10) / 10.0::DOUBLE AS confidence FROM events)
    SELECT CASE WHEN predicate = 'related_to' THEN subject ELSE 'Student' END AS subject, CASE WHEN predicate = 'related_to' THEN 'Concept' ELSE 'Student' END AS subject_type, predicate, object, CASE WHEN object_type = 'Tool' THEN 'Tool' ELSE 'Concept' END AS object_type, COUNT(*) AS n
    FROM raw WHERE predicate <> 'knows' AND trim(object) <> '' AND (predicate <> 'related_to' OR trim(subject) <> trim(object)) AND confidence >= 0.5 GROUP BY ALL"""
)
def validated_triplets(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, i = table(spark, sf_dir, "events"), F.col("event_id")
    raw = e.select((F.col("user_id") % 7).cast("string").alias("subject"), F.lit("Thing").alias("subject_type"), F.when(i % 11 == 0, "knows").when(i % 3 == 0, "related_to").otherwise("studied").alias("predicate"), F.when(i % 13 == 0, " ").otherwise((i % 7).cast("string")).alias("object"), F.when(i % 2 == 0, "Tool").otherwise("Thing").alias("object_type"), ((i % 10) / F.lit(10.0)).alias("confidence"))
    return B.validate_triplets(raw).groupBy("subject", "subject_type", "predicate", "object", "object_type").agg(F.count("*").alias("n"))


SESSION_NODES_SQL = "nodes AS (SELECT DISTINCT s AS node, CASE WHEN s = 'u0' THEN 'Student' ELSE 'Person' END AS type FROM g UNION ALL SELECT DISTINCT o, 'Concept' FROM g UNION ALL SELECT n_name, 'Concept' FROM nation)"


@query(
    f"""{GRAPH_SQL.replace("WITH ", "WITH RECURSIVE ", 1)}, {SESSION_NODES_SQL}, walk AS (SELECT node, 0 AS hop FROM nodes WHERE type = 'Student' UNION SELECT w.dst, hop + 1 FROM walk JOIN way w ON w.src = walk.node WHERE hop < 10),
    top AS (SELECT src AS node, MAX(weight) AS weight FROM way GROUP BY src), near AS (SELECT node, MIN(hop) AS hop FROM walk GROUP BY node)
    SELECT node, type, COALESCE(hop, 1) AS hop, CASE type WHEN 'Student' THEN 1.0::DOUBLE ELSE round(LEAST(1.0::DOUBLE, COALESCE(weight, 0.5::DOUBLE) * pow(0.9::DOUBLE, COALESCE(hop, 1))), 3) END AS score FROM nodes LEFT JOIN near USING (node) LEFT JOIN top USING (node)"""
)
def session_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One student's graph with hops and scores; nations are concepts without an edge."""
    g = graph(spark, sf_dir)
    people = g.select(F.col("s").alias("node")).distinct().withColumn("type", F.when(F.col("node") == "u0", "Student").otherwise("Person"))
    lone = table(spark, sf_dir, "nation").select(F.col("n_name").alias("node"))
    concepts = g.select(F.col("o").alias("node")).distinct().unionByName(lone).withColumn("type", F.lit("Concept"))
    return G.session_graph(people.unionByName(concepts), g)


@query(
    f"""{GRAPH_SQL.split(", free AS")[0]}, near AS (SELECT 'c' || e.vec_id AS node, round(list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[]), 9) AS score FROM embeddings e, embeddings q WHERE q.vec_id = 25 AND e.vec_id < 20),
    anchors AS (SELECT node, score FROM (SELECT * FROM near ORDER BY score DESC, node LIMIT 15) WHERE score >= 0.05 ORDER BY score DESC, node LIMIT 5), free AS (SELECT * FROM way WHERE dst NOT IN (SELECT node FROM anchors)),
    one AS (SELECT dst, weight * 0.85::DOUBLE AS w FROM free WHERE src IN (SELECT node FROM anchors) AND weight > 0.05), two AS (SELECT f.dst, o.w * f.weight * 0.85::DOUBLE AS w FROM one o JOIN free f ON f.src = o.dst WHERE f.dst <> o.dst AND o.w * f.weight > 0.05),
    spread AS (SELECT node, 0 AS hop, 1.0::DOUBLE AS w FROM anchors UNION ALL SELECT dst, 1, round(w, 9) FROM one UNION ALL SELECT dst, 2, round(w, 9) FROM two),
    best AS (SELECT node, hop, w AS weight FROM (SELECT *, row_number() OVER (PARTITION BY node ORDER BY w DESC, hop) AS r FROM spread) WHERE r = 1 ORDER BY node LIMIT 50)
    SELECT node, hop, round(CASE WHEN hop = 0 THEN score ELSE weight * (1 - 0.15::DOUBLE * hop) END, 9) AS combined FROM best LEFT JOIN anchors USING (node)"""
)
def vector_subgraph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two hops around the concepts nearest to a vector."""
    vecs = table(spark, sf_dir, "embeddings")
    nodes = vecs.where("vec_id < 20").select(F.concat(F.lit("c"), "vec_id").alias("node"), F.col("embedding").alias("vec"))
    return G.vector_subgraph(nodes, graph(spark, sf_dir), vecs.where("vec_id = 25").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("qvec")), least=0.05)


@query(
    f"""{FULL}, top AS (SELECT * FROM edges WHERE invalidated_at IS NULL QUALIFY row_number() OVER (PARTITION BY s ORDER BY weight DESC, observations DESC, valid_from DESC, p, o, session) <= 60),
    told AS (SELECT * FROM top WHERE p NOT IN ('named', 'is') QUALIFY row_number() OVER (PARTITION BY s, p, o ORDER BY weight DESC, observations DESC, valid_from DESC, session) = 1),
    lines AS (SELECT s, session, row_number() OVER (PARTITION BY s ORDER BY weight DESC, observations DESC, valid_from DESC, p, o, session) AS n, '- ' || s || ' -[' || p || ']-> ' || o || CASE WHEN observations > 1 THEN ' (mentioned ' || observations || ' times)' ELSE '' END || CASE WHEN COALESCE(evidence, '') <> '' THEN ' <quote>' || evidence || '</quote>' ELSE '' END AS line FROM told)
    SELECT s, COALESCE(string_agg(line, chr(10) ORDER BY n) FILTER (session = 1), '') AS active, COALESCE(string_agg(line, chr(10) ORDER BY n) FILTER (session <> 1), '') AS past FROM lines GROUP BY s"""
)
def graph_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.summary_lines(B.current(edges(spark, sf_dir)), 1, ["named", "is"])


TITLES = ["Director of Ops", "Research Scientist", "undergraduate", "Painter", "Product Manager", "cook", "sailor", "", "baker"]
SAID = ["is", "works_at", "prefers", "works_in", "leads", "interested_in", "mastered", "struggles_with", "researches", "mastered", "confused_about"]
TOLD_SQL = f"told AS (SELECT 's' || c_custkey % 211 AS s, {SAID}[1 + c_custkey * 7 % 11] AS p, CASE WHEN {SAID}[1 + c_custkey * 7 % 11] IN ('is', 'works_at', 'leads') THEN {TITLES}[1 + c_custkey * 5 % 9] ELSE 'topic ' || c_nationkey END AS o FROM customer)"


def _marked(words: list[str]) -> str:
    return " OR ".join(f"contains(said, '{w}')" for w in words)


def _top(head: str, name: str, n: int) -> str:
    return f"CASE WHEN len({name}) > 0 THEN '{head}: ' || array_to_string({name}[1:{n}], ', ') || '.' END"


@query(
    f"""WITH {TOLD_SQL}, sets AS (SELECT s, {", ".join(f"COALESCE(list_sort(list(DISTINCT o) FILTER (o <> '' AND p IN ({', '.join(chr(39) + x + chr(39) for x in ps)}))), []) AS {name}0" for name, ps in B.SAYS.items())}, bool_or(p = 'researches' AND o <> '') AS studies FROM told GROUP BY s),
    said AS (SELECT *, solid0 AS solid, hard0 AS hard, curious0 AS curious, context0 AS context, preferences0 AS preferences, CASE WHEN studies AND NOT list_contains(roles0, 'research') THEN list_sort(list_append(roles0, 'research')) ELSE roles0 END AS roles,
      lower(array_to_string(list_concat(CASE WHEN studies THEN list_append(roles0, 'research') ELSE roles0 END, context0), ' ')) AS said FROM sets),
    leveled AS (SELECT *, CASE WHEN {_marked(B.ADVANCED)} OR len(solid) >= 6 THEN 'advanced' WHEN {_marked(B.BUSINESS)} THEN 'business' WHEN len(solid) >= 2 THEN 'intermediate' WHEN {_marked(B.BEGINNER)} THEN 'beginner' ELSE 'unknown' END AS level FROM said)
    SELECT s, level, concat_ws(' ', 'LEARNER PROFILE: ' || level || '.', {_top("Role", "roles", 3)}, {_top("Professional context", "context", 4)}, {_top("Already solid on", "solid", 5)}, {_top("Currently finding hard", "hard", 5)}, {_top("Interested in", "curious", 4)}, {_top("Stated preferences", "preferences", 3)}) AS profile FROM leveled"""
)
def learner_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Profiles of subjects whose roles, interests and skills come from customers."""
    c = F.col("c_custkey")
    p = F.element_at(F.lit(SAID), (c * 7 % 11 + 1).cast("int"))
    o = F.when(p.isin("is", "works_at", "leads"), F.element_at(F.lit(TITLES), (c * 5 % 9 + 1).cast("int"))).otherwise(F.concat(F.lit("topic "), "c_nationkey"))
    return B.learner_profiles(table(spark, sf_dir, "customer").select(F.concat(F.lit("s"), c % 211).alias("s"), p.alias("p"), o.alias("o")))


NEAR_SQL = f"""WITH {OPS_SQL}, {FOLD_SQL}, e AS (SELECT 'u' || s AS s, 'c' || o AS o, MAX(weight) AS weight FROM edges WHERE invalidated_at IS NULL GROUP BY ALL), way AS (SELECT s AS src, o AS dst, weight FROM e UNION ALL SELECT o, s, weight FROM e),
    asked AS (SELECT n AS query_id, ['u' || n, 'c' || (n * 3 % 20)] AS ids FROM range(10) r(n)), seed AS (SELECT DISTINCT query_id, ids, unnest(ids) AS spot FROM asked),
    one AS (SELECT query_id, ids, dst, weight * 0.85::DOUBLE AS w FROM seed JOIN way ON src = spot WHERE weight > 0.05 AND NOT list_contains(ids, dst)),
    two AS (SELECT query_id, y.dst, o.w * y.weight * 0.85::DOUBLE AS w FROM one o JOIN way y ON y.src = o.dst WHERE y.dst <> o.dst AND o.w * y.weight > 0.05 AND NOT list_contains(ids, y.dst)),
    near AS (SELECT query_id, spot AS node, 0 AS hop, 1.0::DOUBLE AS w FROM seed UNION ALL SELECT query_id, dst, 1, round(w, 9) FROM one UNION ALL SELECT query_id, dst, 2, round(w, 9) FROM two),
    best AS (SELECT * FROM near QUALIFY row_number() OVER (PARTITION BY query_id, node ORDER BY w DESC, hop) = 1)
    SELECT query_id, node, hop, w AS weight FROM best QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY node) <= 50"""


@query(NEAR_SQL)
def lateral_two_hop(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two hops around the anchors of ten queries, by a table function for each."""
    ids = F.array(F.concat(F.lit("u"), F.col("id")), F.concat(F.lit("c"), F.col("id") * 3 % 20))
    return G.two_hop_each(graph(spark, sf_dir), spark.range(10).select(F.col("id").alias("query_id"), ids.alias("ids")))


MESH_SQL = "mesh AS (SELECT DISTINCT k % 23 AS prerequisite, (k * k + 1) % 23 AS concept FROM (SELECT DISTINCT json_extract(props, '$.k')::INT AS k FROM events) UNION SELECT DISTINCT k % 23, (k // 3 + 5) % 23 FROM (SELECT DISTINCT json_extract(props, '$.k')::INT AS k FROM events) WHERE k % 4 = 0)"


def mesh(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A graph with diamonds, cycles and loops."""
    k = table(spark, sf_dir, "events").select(F.get_json_object("props", "$.k").cast("int").alias("k")).distinct()
    one = k.select((F.col("k") % 23).alias("prerequisite"), ((F.col("k") * F.col("k") + 1) % 23).alias("concept"))
    two = k.where("k % 4 = 0").select((F.col("k") % 23).alias("prerequisite"), F.expr("(k div 3 + 5) % 23").cast("int").alias("concept"))
    return one.unionByName(two).distinct()


@query(
    f"""WITH RECURSIVE {MESH_SQL}, up AS (SELECT c AS target, c AS spot, [c] AS path, 0 AS depth FROM (SELECT DISTINCT concept AS c FROM mesh) UNION ALL SELECT target, prerequisite, list_append(path, prerequisite), depth + 1 FROM up JOIN mesh ON concept = spot WHERE depth < 6 AND NOT list_contains(path, prerequisite))
    SELECT target, spot AS concept, MAX(depth) AS depth FROM up WHERE depth > 0 GROUP BY target, spot"""
)
def mesh_closure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The deepest prerequisites in a graph with diamonds and cycles."""
    m = mesh(spark, sf_dir)
    return G.prerequisites(m.withColumn("confidence", F.lit(1.0)), m.select("concept").distinct())


@query(
    f"""WITH RECURSIVE {MESH_SQL}, reach AS (SELECT prerequisite AS a, concept AS b FROM mesh UNION SELECT a, concept FROM reach JOIN mesh ON prerequisite = b) SELECT 0 AS "group", x.a AS node, MIN(x.b) AS component FROM reach x JOIN reach y ON y.a = x.b AND y.b = x.a GROUP BY x.a"""
)
def strong_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.components(mesh(spark, sf_dir).select(F.lit(0).alias("group"), "prerequisite", "concept"))


@query(
    f"""{FULL}, {TREE_SQL}, live AS (SELECT DISTINCT s AS student, o::INT AS concept, p FROM edges WHERE invalidated_at IS NULL), ask AS (SELECT DISTINCT student || '-' || (concept % 2) AS query_id, student, concept FROM live WHERE p = 'confused_about'),
    more AS (SELECT DISTINCT query_id, t.prerequisite AS concept FROM ask a JOIN tree t USING (concept) WHERE NOT EXISTS (SELECT 1 FROM live l WHERE l.student = a.student AND l.concept = t.prerequisite AND l.p = 'mastered') UNION SELECT query_id, concept FROM ask a WHERE EXISTS (SELECT 1 FROM live l WHERE l.student = a.student AND l.concept = a.concept AND l.p = 'struggles_with')),
    less AS (SELECT DISTINCT query_id, l.concept FROM (SELECT DISTINCT query_id, student FROM ask) a JOIN live l ON l.student = a.student AND l.p = 'mastered' WHERE NOT EXISTS (SELECT 1 FROM ask b WHERE b.query_id = a.query_id AND b.concept = l.concept))
    SELECT query_id, COALESCE((SELECT list_sort(list(concept))[1:5] FROM more m WHERE m.query_id = q.query_id), []) AS expand, COALESCE((SELECT list_sort(list(concept))[1:20] FROM less m WHERE m.query_id = q.query_id), []) AS suppress FROM (SELECT DISTINCT query_id FROM ask) q"""
)
def hints_with_suppression(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For what each student is confused about: what to explain besides, and what to leave out."""
    live = B.current(edges(spark, sf_dir)).select(F.col("s").alias("student"), F.col("o").cast("int").alias("concept"), "p").distinct()
    asks = live.where("p = 'confused_about'").select(F.concat("student", F.lit("-"), F.col("concept") % 2).alias("query_id"), "student", "concept")
    state = F.when(F.col("p") == "mastered", "mastered").when(F.col("p") == "struggles_with", "struggling")
    return G.hints(asks, live.select("student", "concept", state.alias("state")).where("state is not null"), tree(spark, sf_dir))
