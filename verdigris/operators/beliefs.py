"""The belief table: assertions in arrival order folded into edges with a history.

An assertion of a predicate retires live edges of opposing predicates between the same subject and
object, in every session. The fold is a window expression, not a loop: the number of retirements
before an assertion names its segment, and a segment's rows form one edge.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# Predicates that each predicate retires.
OPPOSES = {
    "mastered": ["struggles_with", "confused_about", "wants_to_learn"],
    "struggles_with": ["mastered"],
    "confused_about": ["mastered"],
}
# The vocabulary of relations and node types.
PREDICATES = [
    "struggles_with", "mastered", "curious_about", "works_in", "studied", "applied", "confused_about", "wants_to_learn", "has_prerequisite", "related_to", "used_in", "named", "is",
    "works_at", "leads", "researches", "building", "interested_in", "prefers", "decided", "concerned_about", "discussed", "collaborates_on",
]
NOT_OF_STUDENT = ["has_prerequisite", "related_to", "used_in"]
NODE_TYPES = ["Student", "Concept", "Project", "Tool", "Paper", "Person", "Organization", "Industry", "Goal", "Preference", "ResearchArea"]


def retires(asserted: Column, held: Column) -> Column:
    """Whether asserting one predicate retires an edge with the other."""
    out = F.lit(False)
    for p, others in OPPOSES.items():
        out = out | ((asserted == p) & held.isin(others))
    return out


def fold(ops: DataFrame, cap: float = 2.0, step: float = 0.1) -> DataFrame:
    """Edges from operations (tenant, session, s, p, o, ts, id, confidence, evidence, op).

    ``op`` is ``add`` or ``invalidate``; the latter retires its predicate in every session. Gives
    (tenant, session, s, p, o, segment, weight, observations, valid_from, invalidated_at, evidence).
    """
    held = sorted({x for xs in OPPOSES.values() for x in xs})
    acts = ops.withColumn("hits", F.when(F.col("op") == "invalidate", F.array("p")).otherwise(F.filter(F.lit(held), lambda h: retires(F.col("p"), h))))
    marks = acts.select("tenant", "s", "o", F.explode("hits").alias("p"), "ts", "id").withColumn("mark", F.lit(1))
    rows = ops.where(F.col("op") != "invalidate").select("tenant", "s", "o", "p", "ts", "id", "session", "confidence", "evidence").withColumn("mark", F.lit(0))
    line = rows.unionByName(marks, allowMissingColumns=True)
    order = W.partitionBy("tenant", "s", "o", "p").orderBy("ts", "id", F.desc("mark"))
    line = line.withColumn("segment", F.coalesce(F.sum("mark").over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)) + F.col("mark"))
    back = W.partitionBy("tenant", "s", "o", "p").orderBy(F.desc("ts"), F.desc("id"), "mark")  # a frame that reaches ahead costs the square of a group's rows
    line = line.withColumn("gone", F.min(F.when(F.col("mark") == 1, F.col("ts"))).over(back.rowsBetween(W.unboundedPreceding, -1)))
    keys = ["tenant", "session", "s", "p", "o", "segment"]
    edge = line.where(F.col("mark") == 0).groupBy(*keys).agg(
        F.count("*").alias("observations"),
        F.min("ts").alias("valid_from"),
        F.min_by("confidence", F.struct("ts", "id")).alias("first"),
        F.sum("confidence").alias("total"),
        F.max_by("evidence", F.when(F.coalesce("evidence", F.lit("")) != "", F.struct("ts", "id"))).alias("evidence"),
        F.min("gone").alias("invalidated_at"),
    )
    weight = F.when(F.col("observations") == 1, F.col("first")).otherwise(F.least(F.col("first") + step * (F.col("total") - F.col("first")), F.lit(cap)))
    return edge.select(*keys, F.round(weight, 9).alias("weight"), "observations", "valid_from", "invalidated_at", "evidence")


def current(edges: DataFrame) -> DataFrame:
    return edges.where(F.col("invalidated_at").isNull())


def as_of(edges: DataFrame, when: str) -> DataFrame:
    """Edges that were live at a time."""
    t = F.lit(when).cast("timestamp_ntz")
    return edges.where((F.col("valid_from") <= t) & (F.col("invalidated_at").isNull() | (F.col("invalidated_at") > t)))


def decay(edges: DataFrame, now: str, factor: float = 0.95, least: float = 0.1, idle_days: int = 7) -> DataFrame:
    """One decay step for live edges that were idle: weight down to ``least`` at most, ``updated_at`` set to now."""
    t = F.lit(now).cast("timestamp_ntz")
    idle = F.col("invalidated_at").isNull() & (F.col("weight") > least) & (F.col("updated_at") < t - F.expr(f"INTERVAL {idle_days} DAYS"))
    return edges.withColumn("weight", F.when(idle, F.round(F.greatest(F.col("weight") * factor, F.lit(least)), 9)).otherwise(F.col("weight"))).withColumn("updated_at", F.when(idle, t).otherwise(F.col("updated_at")))


def retract(edges: DataFrame, asked: DataFrame, now: str) -> tuple[DataFrame, DataFrame]:
    """Soft deletes of live edges by (tenant, edge_id, reason), one for each edge; and (tenant, edge_id, found) for every one asked.

    The edges are (tenant, edge_id, invalidated_at, reason, updated_at, ...); a retired edge, or one of another tenant, is not found.
    """
    t = F.lit(now).cast("timestamp_ntz")
    wanted = asked.groupBy("tenant", "edge_id").agg(F.min(F.coalesce("reason", F.lit("corrected by student"))).alias("_why"))
    hit = F.col("invalidated_at").isNull() & F.col("_why").isNotNull()
    out = edges.join(wanted, ["tenant", "edge_id"], "left")
    changed = {"invalidated_at": F.when(hit, t).otherwise(F.col("invalidated_at")), "reason": F.when(hit, F.col("_why")).otherwise(F.col("reason")), "updated_at": F.when(hit, t).otherwise(F.col("updated_at"))}
    live = edges.where(F.col("invalidated_at").isNull()).select("tenant", "edge_id", F.lit(True).alias("found"))
    found = wanted.join(live, ["tenant", "edge_id"], "left").select("tenant", "edge_id", F.coalesce("found", F.lit(False)).alias("found"))
    return out.select(*(changed.get(c, F.col(c)).alias(c) for c in edges.columns)), found


def validate_triplets(raw: DataFrame) -> DataFrame:
    """Known predicate, names present, unknown types as Concept, student relations from Student, no self-loops, enough confidence."""
    ok = raw.where(F.col("predicate").isin(PREDICATES)).where((F.trim("subject") != "") & (F.trim("object") != ""))
    for side in ("subject_type", "object_type"):
        ok = ok.withColumn(side, F.when(F.col(side).isin(NODE_TYPES), F.col(side)).otherwise("Concept"))
    own = ~F.col("predicate").isin(NOT_OF_STUDENT)
    ok = ok.withColumn("subject", F.when(own, "Student").otherwise(F.col("subject"))).withColumn("subject_type", F.when(own, "Student").otherwise(F.col("subject_type")))
    return ok.where(F.lower(F.trim("subject")) != F.lower(F.trim("object"))).where(F.col("confidence") >= 0.5)


def parse_operations(raw: DataFrame, column: str = "reply") -> DataFrame:
    """Triplet operations from a JSON reply that may stand in a code fence; malformed ones give no row."""
    bare = F.regexp_replace(F.trim(F.col(column)), "^```(?:json)?\\s*|\\s*```$", "")
    schema = "array<struct<subject:string,predicate:string,object:string,op:string,confidence:string>>"
    rows = raw.select("*", F.explode(F.from_json(bare, schema)).alias("t")).where(F.col("t.subject").isNotNull() & F.col("t.predicate").isNotNull() & F.col("t.object").isNotNull())
    op = F.when(F.col("t.op").isin("add", "invalidate"), F.col("t.op")).otherwise("add")
    return rows.select(*raw.columns, "t.subject", "t.predicate", "t.object", op.alias("op"), F.coalesce(F.expr("try_cast(t.confidence as double)"), F.lit(1.0)).alias("confidence"))


# Words in roles and professional context that tell the audience, and predicates by what they say of a person.
ADVANCED = ["phd", "researcher", "research scientist", "scientist", "professor", "ml engineer", "machine learning engineer", "software engineer", "engineer", "research"]
BUSINESS = ["product manager", "product lead", "founder", "co-founder", "cofounder", "entrepreneur", "executive", "ceo", "cto", "coo", "vp", "director", "manager", "business", "strategy", "startup"]
BEGINNER = ["student", "beginner", "new to", "starting out", "undergraduate"]
SAYS = {
    "solid": ["mastered"],
    "hard": ["struggles_with", "confused_about"],
    "curious": ["curious_about", "wants_to_learn", "interested_in"],
    "roles": ["is", "works_in"],
    "context": ["works_at", "leads", "building", "researches", "collaborates_on"],
    "preferences": ["prefers"],
}


#: How to explain things to each audience, in our own words.
GUIDANCE = {
    "advanced": "Use the mathematics as it is, with its assumptions and where it fails; keep examples short.",
    "business": "Stay with decisions and effects: what moves the figures, which data is needed, what can be automated; few formulas.",
    "intermediate": "Take the basics as known, begin with a worked example, and add notation only where it helps.",
    "beginner": "Begin with something from daily life, go one step at a time, and bring in one new word at a time.",
    "unknown": "Begin with an analogy at a middle depth, and offer to go further or simpler.",
}


def learner_profiles(edges: DataFrame, names: DataFrame | None = None, guidance: dict[str, str] | None = None) -> DataFrame:
    """(s, level, profile): the audience of each subject by roles, context and mastery, and a line that sums it up.

    Markers are found anywhere in the joined text. A subject without an object in any edge is unknown.
    ``names`` is (s, name); ``guidance`` has a closing sentence for each level.
    """
    told = edges.where(F.coalesce("o", F.lit("")) != "")
    sets = [F.array_sort(F.collect_set(F.when(F.col("p").isin(ps), F.col("o")))).alias(name) for name, ps in SAYS.items()]
    studies = F.max((F.col("p") == "researches").cast("int")).alias("studies")
    known = told.groupBy("s").agg(*sets, studies)
    known = edges.select("s").distinct().join(known, "s", "left")
    for name in SAYS:
        known = known.withColumn(name, F.coalesce(name, F.array().cast("array<string>")))
    roles = F.when(F.col("studies") == 1, F.array_union("roles", F.array(F.lit("research")))).otherwise(F.col("roles"))
    known = known.withColumn("roles", roles)
    text = F.lower(F.array_join(F.concat("roles", "context"), " "))

    def marks(words: list[str]) -> Column:
        return F.exists(F.lit(words), lambda w: F.contains(text, w))

    level = (
        F.when(marks(ADVANCED) | (F.size("solid") >= 6), "advanced").when(marks(BUSINESS), "business").when(F.size("solid") >= 2, "intermediate").when(marks(BEGINNER), "beginner").otherwise("unknown")
    )

    def top(head: str, name: str, n: int) -> Column:
        return F.when(F.size(name) > 0, F.concat(F.lit(f"{head}: "), F.array_join(F.slice(F.array_sort(name), 1, n), ", "), F.lit(".")))

    parts = [top("Role", "roles", 3), top("Professional context", "context", 4), top("Already solid on", "solid", 5), top("Currently finding hard", "hard", 5), top("Interested in", "curious", 4), top("Stated preferences", "preferences", 3)]
    if names is not None:
        known = known.join(names.select("s", F.col("name").alias("_name")), "s", "left")
        parts.insert(0, F.when(F.coalesce("_name", F.lit("")) != "", F.concat(F.lit("Name: "), "_name", F.lit("."))))
    if guidance:
        parts.append(F.coalesce(*(F.when(level == k, v) for k, v in guidance.items())))
    return known.select("s", level.alias("level"), F.concat_ws(" ", F.concat(F.lit("LEARNER PROFILE: "), level, F.lit(".")), *parts).alias("profile"))


# The reasons that are kept with a retired edge.
OPPOSED, RETIRED = "superseded when the student showed ", "superseded by later conversation"
EDGE = "tenant int, session long, s string, p string, o string, weight double, observations long, valid_from timestamp_ntz, invalidated_at timestamp_ntz, reason string, evidence string, updated_at timestamp_ntz"


def merge(edges: DataFrame, ops: DataFrame, cap: float = 2.0, step: float = 0.1) -> DataFrame:
    """The EDGE rows after a batch of operations (as in ``fold``, with a reason), which follow all earlier ones.

    Live edges stand before the batch's operations and are strengthened or retired by them; retired ones
    stay as they are. An ``invalidate`` names subject and object without regard to case and retires the
    predicate's edges in all sessions, for its own reason. Every edge that is written anew is dated.
    Merging the parts of a list of operations, cut anywhere in their order, gives what merging it whole does.
    """
    columns = edges.columns
    live = edges.where(F.col("invalidated_at").isNull())
    adds = ops.where(F.col("op") != "invalidate")
    held = sorted({x for xs in OPPOSES.values() for x in xs})
    marks = adds.select("tenant", "s", "o", F.explode(F.filter(F.lit(held), lambda h: retires(F.col("p"), h))).alias("h"), "ts", "id", F.concat(F.lit(OPPOSED), "p").alias("reason")).withColumnRenamed("h", "p")
    known = live.select("tenant", "s", "o", "p").unionByName(adds.select("tenant", "s", "o", "p")).distinct()
    gone = ops.where(F.col("op") == "invalidate").select("tenant", F.lower("s").alias("ls"), F.lower("o").alias("lo"), "p", "ts", "id", F.coalesce(F.nullif("reason", F.lit("")), F.lit(RETIRED)).alias("reason"))
    named = known.withColumn("ls", F.lower("s")).withColumn("lo", F.lower("o")).join(gone, ["tenant", "ls", "lo", "p"]).drop("ls", "lo")
    marks = marks.unionByName(named).withColumn("mark", F.lit(1)).withColumn("late", F.lit(1))
    new = adds.select("tenant", "session", "s", "o", "p", "ts", "id", "confidence", "evidence").withColumn("mark", F.lit(0)).withColumn("late", F.lit(1))
    old = live.select("tenant", "session", "s", "o", "p", F.struct("weight", "observations", "valid_from", "evidence", "updated_at").alias("old")).withColumn("mark", F.lit(0)).withColumn("late", F.lit(0))
    line = new.unionByName(marks, allowMissingColumns=True).unionByName(old, allowMissingColumns=True)
    order = W.partitionBy("tenant", "s", "o", "p").orderBy("late", "ts", "id", F.desc("mark"))
    line = line.withColumn("segment", F.coalesce(F.sum("mark").over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    back = W.partitionBy("tenant", "s", "o", "p").orderBy(F.desc("late"), F.desc("ts"), F.desc("id"), "mark")
    line = line.withColumn("gone", F.last(F.when(F.col("mark") == 1, F.struct("ts", "reason")), ignorenulls=True).over(back.rowsBetween(W.unboundedPreceding, -1)))
    asked = F.when(F.col("late") == 1, F.struct("ts", "id"))
    edge = line.where(F.col("mark") == 0).groupBy("tenant", "session", "s", "p", "o", "segment").agg(
        F.first("old", ignorenulls=True).alias("old"),
        F.count("confidence").alias("n"),
        F.min_by("confidence", asked).alias("first"),
        F.coalesce(F.sum("confidence"), F.lit(0.0)).alias("total"),
        F.min("ts").alias("since"),
        F.max("ts").alias("last"),
        F.max_by("evidence", F.when(F.coalesce("evidence", F.lit("")) != "", F.struct("ts", "id"))).alias("said"),
        F.first("gone", ignorenulls=True).alias("gone"),
    )
    begun = F.coalesce(F.col("old.weight"), F.col("first"))
    more = F.col("total") - F.when(F.col("old").isNull(), F.col("first")).otherwise(0.0)
    fresh = F.col("n") - F.col("old").isNull().cast("int") > 0
    out = edge.select(
        "tenant", "session", "s", "p", "o",
        F.when(fresh, F.least(begun + step * more, F.lit(cap))).otherwise(begun).alias("weight"),
        (F.coalesce(F.col("old.observations"), F.lit(0)) + F.col("n")).alias("observations"),
        F.coalesce(F.col("old.valid_from"), F.col("since")).alias("valid_from"),
        F.col("gone.ts").alias("invalidated_at"), F.col("gone.reason").alias("reason"),
        F.coalesce(F.col("said"), F.col("old.evidence")).alias("evidence"),
        F.coalesce(F.col("gone.ts"), F.col("last"), F.col("old.updated_at")).alias("updated_at"),
    )
    return edges.where(F.col("invalidated_at").isNotNull()).unionByName(out).select(*columns)
