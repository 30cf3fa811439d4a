"""Queries of episodic memory, entity resolution, corrections, hashes and streams, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from verdigris.functions import text
from verdigris.operators import beliefs, entities, memory, sessions, style, tables
from verdigris.plans.graph_queries import NAMED_SQL, NOW, belief_batches
from verdigris.plans.registry import query
from verdigris.sources.tables import table
from verdigris.streaming import windows

MEMORY_SQL = """mem AS (SELECT conv_id % 15 AS owner, conv_id * 1000 + turn AS id, string_split(lower(text), ' ')[1] || ' ' || COALESCE(string_split(lower(text), ' ')[3], '') || ' ' || (turn % 3) AS memory, [string_split(lower(text), ' ')[2], role, role] AS tags, role || ' ' || COALESCE(string_split(lower(text), ' ')[4], '') AS topic, (conv_id % 6)::INT AS importance, turn AS ts FROM conversations),
    ask AS (SELECT conv_id AS query_id, CASE WHEN conv_id % 5 = 0 THEN 'What do you know about it' ELSE text END AS text FROM conversations WHERE turn = 0)"""


def _memories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A memory of each turn: its first words, with its role as a tag."""
    w = F.split(F.lower("text"), " ")
    part = lambda i: F.coalesce(F.get(w, F.lit(i)), F.lit(""))
    return table(spark, sf_dir, "conversations").select(
        (F.col("conv_id") % 15).alias("owner"), (F.col("conv_id") * 1000 + F.col("turn")).alias("id"), F.concat(part(0), F.lit(" "), part(2), F.lit(" "), F.col("turn") % 3).alias("memory"),
        F.array(F.get(w, F.lit(1)), "role", "role").alias("tags"), F.concat("role", F.lit(" "), part(3)).alias("topic"), (F.col("conv_id") % 6).cast("int").alias("importance"), F.col("turn").alias("ts"),
    )


@query(
    f"""WITH {MEMORY_SQL}, mw AS (SELECT DISTINCT id, unnest(list_filter(string_split_regex(lower(memory), '[^a-z0-9]+'), lambda w: w <> '')) AS w FROM mem), own AS (SELECT query_id, list_distinct(list_filter(string_split_regex(lower(text), '[^a-z0-9]+'), lambda w: w <> '')) AS qw FROM ask WHERE NOT contains(lower(text), 'what do you know')),
    hit AS (SELECT query_id, id, COUNT(*) AS overlap FROM (SELECT query_id, unnest(qw) AS w FROM own) JOIN mw USING (w) GROUP BY ALL),
    told AS (SELECT query_id, id, m.ts, round(overlap + CASE WHEN list_has_any(list_filter(list_transform(tags, lambda t: lower(t)), lambda t: t IS NOT NULL), qw) THEN 1.5::DOUBLE ELSE 0 END + CASE WHEN len(list_filter(qw, lambda w: contains(lower(topic), w))) > 0 THEN 1.0::DOUBLE ELSE 0 END + 0.4::DOUBLE * LEAST(importance, 3), 6) AS score FROM hit JOIN own USING (query_id) JOIN mem m USING (id)),
    top AS (SELECT id, row_number() OVER (ORDER BY importance DESC, ts DESC, id) AS rank FROM mem QUALIFY rank <= 5)
    SELECT query_id, id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, ts DESC, id) AS rank FROM told QUALIFY rank <= 5 UNION ALL SELECT query_id, id, NULL, rank FROM ask, top WHERE contains(lower(text), 'what do you know')"""
)
def relevant_memories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The memories that fit the first turn of each conversation."""
    first = F.when(F.col("conv_id") % 5 == 0, "What do you know about it").otherwise(F.col("text"))
    asks = table(spark, sf_dir, "conversations").where("turn = 0").select(F.col("conv_id").alias("query_id"), first.alias("text"))
    return memory.relevant(_memories(spark, sf_dir).drop("owner"), asks)


@query(
    f"""WITH {MEMORY_SQL}, old AS (SELECT owner, memory, tags, importance, ts FROM mem WHERE id % 2 = 0 QUALIFY row_number() OVER (PARTITION BY owner, lower(memory) ORDER BY ts, id) = 1), clean AS (SELECT owner, memory, list_distinct(tags) AS tags, GREATEST(1, LEAST(importance, 3)) AS importance, ts, id FROM mem WHERE id % 2 = 1),
    fresh AS (SELECT * EXCLUDE id FROM (SELECT * FROM clean QUALIFY row_number() OVER (PARTITION BY owner, lower(memory) ORDER BY ts, id) = 1) c WHERE NOT EXISTS (SELECT 1 FROM old o WHERE o.owner = c.owner AND lower(o.memory) = lower(c.memory)))
    SELECT owner, memory, importance, ts, len(tags) AS n_tags FROM (SELECT owner, memory, tags, importance, ts FROM old UNION ALL SELECT owner, memory, tags, importance, ts FROM fresh) QUALIFY row_number() OVER (PARTITION BY owner ORDER BY importance DESC, ts DESC, memory) <= 20"""
)
def remembered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The memories of each owner after those of odd turns were added, the twenty most important kept."""
    from pyspark.sql import Window as W

    rows = _memories(spark, sf_dir)
    first = F.row_number().over(W.partitionBy("owner", F.lower("memory")).orderBy("ts", "id"))
    once = lambda part: part.withColumn("_n", first).where("_n = 1").drop("_n", "id", "topic")
    kept = memory.remember(once(rows.where("id % 2 = 0")), once(rows.where("id % 2 = 1")), 20)
    return kept.select("owner", "memory", "importance", "ts", F.size("tags").alias("n_tags"))


@query(
    """WITH names AS (SELECT DISTINCT trim(regexp_replace(lower(w[1] || ' ' || w[2]), '[^a-z0-9]+', ' ', 'g')) AS concept FROM (SELECT string_split(text, ' ') AS w FROM benchmark) WHERE w[2] IS NOT NULL), said AS (SELECT conv_id * 1000 + turn AS id, ' ' || trim(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g')) || ' ' AS t FROM conversations)
    SELECT id, concept FROM said, names WHERE concept <> '' AND contains(t, ' ' || concept || ' ')"""
)
def mentioned_concepts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which turns hold the first two words of a benchmark item."""
    w = F.split("text", " ")
    names = table(spark, sf_dir, "benchmark").where(F.size(w) > 1).select(text.normalise_concept(F.concat(F.get(w, F.lit(0)), F.lit(" "), F.get(w, F.lit(1)))).alias("concept")).where("concept <> ''").distinct()
    return memory.mentions(table(spark, sf_dir, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), "text"), names)


SIMILAR_SQL = "list_distinct(flatten(list_transform(list_filter(string_split_regex(lower({0}), '[^a-z0-9]+'), lambda w: w <> ''), lambda w: list_transform(generate_series(1, length(w) + 1), lambda i: substr('  ' || w || ' ', i, 3)))))"


@query(
    f"""WITH names AS (SELECT DISTINCT p_name AS name FROM part), ask AS (SELECT DISTINCT CASE p_partkey % 4 WHEN 0 THEN ' ' || upper(p_name) WHEN 1 THEN p_name || 's' WHEN 2 THEN replace(p_name, ' ', '  ') ELSE p_brand END AS surface FROM part), als AS (SELECT lower(p_brand) AS alias, MIN(p_name) AS name FROM part WHERE p_partkey % 2 = 0 GROUP BY 1),
    s AS (SELECT surface, {SIMILAR_SQL.format('surface')} AS g FROM ask), n AS (SELECT name, {SIMILAR_SQL.format('name')} AS g FROM names),
    near AS (SELECT surface, name FROM (SELECT surface, name, round(len(list_intersect(s.g, n.g))::DOUBLE / len(list_distinct(list_concat(s.g, n.g))), 9) AS sim FROM s, n WHERE len(s.g) > 0) WHERE sim >= 0.6 QUALIFY row_number() OVER (PARTITION BY surface ORDER BY sim DESC, name) = 1)
    SELECT a.surface, COALESCE(x.name, near.name, y.name) AS name FROM ask a LEFT JOIN als x ON x.alias = lower(trim(a.surface)) LEFT JOIN near USING (surface) LEFT JOIN names y ON lower(y.name) = lower(trim(a.surface))"""
)
def resolved_surfaces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Surface forms of parts to names: by alias, by likeness, by name."""
    p = table(spark, sf_dir, "part")
    k = F.col("p_partkey") % 4
    asks = p.select(F.when(k == 0, F.concat(F.lit(" "), F.upper("p_name"))).when(k == 1, F.concat("p_name", F.lit("s"))).when(k == 2, F.replace("p_name", F.lit(" "), F.lit("  "))).otherwise(F.col("p_brand")).alias("surface"))
    aliases = p.where("p_partkey % 2 = 0").groupBy(F.lower("p_brand").alias("alias")).agg(F.min("p_name").alias("name"))
    return entities.resolve(asks, aliases, p.select(F.col("p_name").alias("name")).distinct())


@query(f"WITH edges_ AS ({NAMED_SQL}) SELECT s, p, o, session, valid_from, CASE WHEN invalidated_at IS NULL AND session = 1 AND p = 'studied' THEN TIMESTAMP '{NOW}' ELSE invalidated_at END AS invalidated_at, CASE WHEN invalidated_at IS NULL AND session = 1 AND p = 'studied' THEN 'corrected by student' ELSE reason END AS reason FROM edges_")
def retracted_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Beliefs after all edges of one session and predicate were taken back by their ids."""
    edge_id = F.sha2(F.concat_ws("|", "session", "s", "p", "o", "valid_from"), 256)
    edges = belief_batches(spark, sf_dir).withColumn("edge_id", edge_id)
    asks = edges.where("session = 1 AND p = 'studied'").select("tenant", "edge_id", F.lit(None).cast("string").alias("reason"))
    return beliefs.retract(edges, asks, NOW)[0].select("s", "p", "o", "session", "valid_from", "invalidated_at", "reason")


@query("SELECT doc_id, md5(translate(text, 'àáâãäåçèéêëìíîïñòóôõöùúûüýÿÀÁÂÃÄÅÇÈÉÊËÌÍÎÏÑÒÓÔÕÖÙÚÛÜÝ', 'aaaaaaceeeeiiiinooooouuuuyyAAAAAACEEEEIIIINOOOOOUUUUY')) AS plain FROM documents")
def unaccented(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(text.unaccent("text").cast("binary")).alias("plain"))


_SPACE = "6ba7b8119dad11d180b400c04fd430c8"


@query(
    rf"""WITH h AS (SELECT page_id, url, sha1(from_hex('{_SPACE}') || url::BLOB) AS h FROM pages) SELECT page_id, sha256(url)[1:16] AS checksum, list_reduce(list_prepend(2166136261::HUGEINT, list_transform(string_split(url, ''), lambda c: ascii(c)::HUGEINT)), lambda a, c: (xor(a, c) * 16777619) % 4294967296)::BIGINT AS fnv,
    h[1:8] || '-' || h[9:12] || '-5' || h[14:16] || '-' || ['8', '9', 'a', 'b'][(instr('0123456789abcdef', h[17]) - 1) % 4 + 1] || h[18:20] || '-' || h[21:32] AS uuid FROM h"""
)
def url_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Checksum, FNV hash and name-based UUID of every page's url."""
    return table(spark, sf_dir, "pages").select("page_id", text.checksum16("url").alias("checksum"), text.fnv1a("url").alias("fnv"), text.uuid5(_SPACE, "url").alias("uuid"))


@query("WITH rms AS (SELECT event_type AS track, n // 50 AS bucket, sqrt(AVG(value * value)) AS rms FROM (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) - 1 AS n FROM events) GROUP BY ALL) SELECT track, bucket, CASE WHEN MAX(rms) OVER (PARTITION BY track) > 0 THEN round(rms / MAX(rms) OVER (PARTITION BY track), 9) ELSE 0.0 END AS level FROM rms")
def value_envelopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The loudness of each event type's values, fifty at a time."""
    from pyspark.sql import Window as W

    n = F.row_number().over(W.partitionBy("event_type").orderBy("ts", "event_id")) - 1
    return memory.envelope(table(spark, sf_dir, "events").select(F.col("event_type").alias("track"), n.alias("n"), "value"), 50)


@query("SELECT conv_id, turn, CASE WHEN (contains(lower(text), 'the ') OR contains(lower(text), 'der ')) AND NOT (contains(lower(text), 'may') OR contains(lower(text), 'ist')) THEN '[as of then] ' || text ELSE text END AS told FROM conversations WHERE role = 'assistant'")
def hedged_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").where("role = 'assistant'")
    return rows.select("conv_id", "turn", text.hedge_note("text", "text", ["the ", "der "], ["may", "ist"], "[as of then] ").alias("told"))


@query(
    """WITH stat AS (SELECT lang, AVG(n_chars) AS a, COUNT(*)::DOUBLE AS b, AVG(doc_id % 7) AS c FROM documents WHERE lang IN ('en', 'de') GROUP BY lang), e AS (SELECT * FROM stat WHERE lang = 'en'), d AS (SELECT * FROM stat WHERE lang = 'de')
    SELECT unnest(['a', 'b', 'c']) AS name, unnest([round(abs(e.a - d.a) / d.a, 3), round(abs(e.b - d.b) / d.b, 3), round(abs(e.c - d.c) / d.c, 3)]) AS distance FROM e, d"""
)
def style_distances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far documents of two languages are apart in three figures."""
    stat = table(spark, sf_dir, "documents").groupBy("lang").agg(F.avg("n_chars").alias("a"), F.count("*").cast("double").alias("b"), F.avg(F.col("doc_id") % 7).alias("c"))
    return style.distance(stat.where("lang = 'en'"), stat.where("lang = 'de'"), ["a", "b", "c"])


@query("SELECT DISTINCT user_id, event_type FROM events")
def stream_once_each(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which users did what, once each within the watermark, from a stream."""
    rows = windows.once_each(windows.read(spark, f"{sf_dir}/events.parquet"), ["user_id", "event_type"], "400 days")
    return windows.drained(rows.select("user_id", "event_type"), "append")


@query("SELECT conv_id AS session, turn FROM (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS n FROM conversations WHERE role = 'user' AND (conv_id + turn) % 3 <> 0 AND TIMESTAMP '2024-01-01' + turn * INTERVAL 1 MINUTE < TIMESTAMP '2024-01-01 00:05:00' - INTERVAL 2 MINUTE) WHERE n <= 3")
def swept_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest turns that wait and are two minutes old."""
    ts = F.lit("2024-01-01").cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), F.lit(0), F.col("turn").cast("int"), F.lit(0).cast("decimal(18,6)"))
    rows = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("session"), "turn", "role", ts.alias("ts"))
    done = rows.where("(session + turn) % 3 = 0").select("session", "turn")
    return sessions.pending(rows, done, 3, "2024-01-01 00:05:00")


@query("SELECT 'edges' AS name, COUNT(*) AS n FROM events WHERE user_id % 10 IS DISTINCT FROM 3 UNION ALL SELECT 'turns', COUNT(*) FROM conversations WHERE conv_id % 10 IS DISTINCT FROM 3")
def cleared_tenant(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left in two tables after a tenant was cleared."""
    rows = {"edges": table(spark, sf_dir, "events").select((F.col("user_id") % 10).alias("tenant")), "turns": table(spark, sf_dir, "conversations").select((F.col("conv_id") % 10).alias("tenant"))}
    left = sessions.clear_tenant(rows, 3, 0)
    return left["edges"].agg(F.lit("edges").alias("name"), F.count("*").alias("n")).unionByName(left["turns"].agg(F.lit("turns").alias("name"), F.count("*").alias("n")))


@query("WITH taken AS (SELECT DISTINCT s_nationkey AS tenant FROM supplier) SELECT c_custkey AS request, CASE WHEN c_nationkey IN (SELECT n_nationkey FROM nation WHERE n_nationkey % 3 <> 0) AND c_nationkey NOT IN (SELECT tenant FROM taken WHERE tenant % 2 = 0) THEN c_nationkey END AS tenant FROM customer")
def adopted_tenants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations play tenants: those that no supplier with an even one has can be taken over."""
    tenants = table(spark, sf_dir, "nation").where("n_nationkey % 3 <> 0").select(F.col("n_nationkey").alias("tenant"))
    users = table(spark, sf_dir, "supplier").where("s_nationkey % 2 = 0").select(F.col("s_nationkey").alias("tenant")).distinct()
    return memory.adopt_tenant(tenants, users, table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("request"), F.col("c_nationkey").alias("tenant")))


@query(
    """SELECT event_id, s AS subject, p AS predicate, o AS object, CASE WHEN op IN ('add', 'invalidate') THEN op ELSE 'add' END AS op, confidence FROM (
    SELECT event_id, 'u' || user_id AS s, CASE WHEN event_id % 11 = 0 THEN NULL ELSE event_type END AS p, 'k' || json_extract(props, '$.k') AS o, CASE event_id % 3 WHEN 0 THEN 'invalidate' WHEN 1 THEN 'other' ELSE 'add' END AS op, CASE WHEN event_id % 5 = 0 THEN 1.0::DOUBLE ELSE (event_id % 10) / 10.0::DOUBLE END AS confidence FROM events) WHERE p IS NOT NULL"""
)
def parsed_operations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operations out of JSON replies, every second one in a code fence, some broken or without a predicate."""
    i = F.col("event_id")
    one = F.struct(
        F.concat(F.lit("u"), "user_id").alias("subject"), F.when(i % 11 != 0, F.col("event_type")).alias("predicate"), F.concat(F.lit("k"), F.get_json_object("props", "$.k")).alias("object"),
        F.when(i % 3 == 0, "invalidate").when(i % 3 == 1, "other").otherwise("add").alias("op"), F.when(i % 5 == 0, "high").otherwise((i % 10 / 10.0).cast("string")).alias("confidence"),
    )
    bare = F.to_json(F.array(one))
    reply = F.when(i % 2 == 0, F.concat(F.lit("```json\n"), bare, F.lit("\n```"))).otherwise(bare)
    return beliefs.parse_operations(table(spark, sf_dir, "events").select("event_id", reply.alias("reply"))).drop("reply")


@query("SELECT COALESCE(lang, 'unknown') AS model, COUNT(*) AS n, COUNT(DISTINCT COALESCE(lang, 'unknown')) OVER () > 1 AS mixed FROM documents GROUP BY COALESCE(lang, 'unknown')")
def mixed_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The languages play embedding models: how many rows each has, and whether the guard would refuse them together."""
    rows = table(spark, sf_dir, "documents").select(F.col("lang").alias("embedding_model"))
    first = rows.select(F.coalesce("embedding_model", F.lit("unknown")).alias("m")).orderBy("m").first()
    try:
        tables.one_model(rows, first.m if first else "unknown")
        mixed = False
    except ValueError:
        mixed = True
    return rows.groupBy(F.coalesce("embedding_model", F.lit("unknown")).alias("model")).agg(F.count("*").alias("n")).withColumn("mixed", F.lit(mixed))
