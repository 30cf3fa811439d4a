"""Queries of profiles and entities that grow by updates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from verdigris.operators import entities, profiles
from verdigris.plans.registry import query
from verdigris.sources.tables import table

UPDATES_SQL = """updates AS (SELECT user_id % 40 AS owner, event_type AS field, CASE WHEN event_id % 5 = 0 THEN 'unknown' WHEN event_id % 7 = 0 THEN '' ELSE event_type || ' ' || (json_extract(props, '$.k')::INT % 9) END AS value, ts, event_id AS id, event_id % 3 = 0 AS early FROM events)"""


def _updates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as updates of 40 profiles; a third of them play what the profile held before."""
    value = F.when(F.col("event_id") % 5 == 0, "unknown").when(F.col("event_id") % 7 == 0, "").otherwise(F.concat("event_type", F.lit(" "), F.get_json_object("props", "$.k").cast("int") % 9))
    return table(spark, sf_dir, "events").select((F.col("user_id") % 40).alias("owner"), F.col("event_type").alias("field"), value.alias("value"), "ts", F.col("event_id").alias("id"), (F.col("event_id") % 3 == 0).alias("early"))


@query(
    f"""WITH {UPDATES_SQL}, old AS (SELECT owner, field, min(value) AS value FROM updates WHERE early AND value <> '' GROUP BY ALL), new AS (SELECT owner, field, arg_max(value, (ts, id)) AS value FROM updates WHERE NOT early AND value NOT IN ('', 'unknown') GROUP BY ALL)
    SELECT owner, field, COALESCE(n.value, o.value) AS value FROM old o FULL OUTER JOIN new n USING (owner, field)"""
)
def merged_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _updates(spark, sf_dir)
    old = rows.where("early and value <> ''").groupBy("owner", "field").agg(F.min("value").alias("value"))
    return profiles.merged_fields(old, rows.where("not early"))


@query(
    f"""WITH {UPDATES_SQL}, old AS (SELECT owner, field, (row_number() OVER (PARTITION BY owner, field ORDER BY value) - 1)::INT AS n, value FROM (SELECT DISTINCT owner, field, value FROM updates WHERE early AND value <> '')),
    fresh AS (SELECT owner, field, value, MIN((ts, id)) AS o FROM updates u WHERE NOT early AND value <> '' AND NOT EXISTS (SELECT 1 FROM old x WHERE x.owner = u.owner AND x.field = u.field AND x.value = u.value) GROUP BY ALL)
    SELECT * FROM old UNION ALL SELECT owner, field, (row_number() OVER (PARTITION BY owner, field ORDER BY o) - 1 + COALESCE((SELECT COUNT(*) FROM old x WHERE x.owner = f.owner AND x.field = f.field), 0))::INT, value FROM fresh f"""
)
def merged_remarks(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window as W

    rows = _updates(spark, sf_dir)
    kept = rows.where("early and value <> ''").select("owner", "field", "value").distinct()
    old = kept.withColumn("n", (F.row_number().over(W.partitionBy("owner", "field").orderBy("value")) - 1).cast("int"))
    return profiles.merged_lists(old, rows.where("not early"))


@query(
    f"""WITH RECURSIVE {UPDATES_SQL}, line AS (SELECT owner, value AS topic, ts::DATE AS day, row_number() OVER (PARTITION BY owner ORDER BY ts, id) AS i FROM updates WHERE value NOT IN ('', 'unknown')),
    walk AS (SELECT owner, 0::BIGINT AS i, []::VARCHAR[] AS near, 0 AS length, 1 AS session, NULL::VARCHAR AS topic, NULL::DATE AS day, false AS kept FROM (SELECT DISTINCT owner FROM line)
      UNION ALL SELECT w.owner, l.i, CASE WHEN list_contains(near, lower(l.topic)) THEN near ELSE list_append(near, lower(l.topic))[-3:] END, length + CASE WHEN list_contains(near, lower(l.topic)) THEN 0 ELSE 1 END,
        session + CASE WHEN NOT list_contains(near, lower(l.topic)) AND length > 0 AND length % 5 = 0 THEN 1 ELSE 0 END, l.topic, l.day, NOT list_contains(near, lower(l.topic)) FROM walk w JOIN line l ON l.owner = w.owner AND l.i = w.i + 1)
    SELECT owner, length - 1 AS n, topic, day, session FROM walk WHERE kept"""
)
def topic_timelines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The topics of each profile in order, from two batches of updates."""
    rows = _updates(spark, sf_dir).select("owner", F.col("value").alias("topic"), F.to_date("ts").alias("day"), "ts", "id")
    none = spark.createDataFrame([], "owner long, n int, topic string, day date, session int")
    half = rows.agg(F.percentile_approx(F.unix_micros(F.col("ts").cast("timestamp")), 0.5).alias("t")).first()["t"]
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    return profiles.timeline(profiles.timeline(none, rows.where(at <= half)), rows.where(at > half))


ENTITY_SQL = """seen AS (SELECT p_partkey % 2 AS tenant, CASE WHEN p_partkey % 3 = 0 THEN upper(p_name) ELSE p_name END AS name, CASE WHEN p_size > 25 THEN 'Tool' ELSE 'Concept' END AS type, ' ' || p_brand || CASE WHEN p_size % 2 = 0 THEN ' É' ELSE '' END AS alias, p_type AS k, p_size::VARCHAR AS v, p_retailprice AS ts, p_partkey AS id, p_partkey % 4 = 0 AS early FROM part)"""


def _seen(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as mentions of entities; a quarter of them play the table before."""
    p = table(spark, sf_dir, "part")
    return p.select(
        (F.col("p_partkey") % 2).alias("tenant"), F.when(F.col("p_partkey") % 3 == 0, F.upper("p_name")).otherwise(F.col("p_name")).alias("name"), F.when(F.col("p_size") > 25, "Tool").otherwise("Concept").alias("type"),
        F.concat(F.lit(" "), "p_brand", F.when(F.col("p_size") % 2 == 0, " É").otherwise("")).alias("alias"), F.create_map("p_type", F.col("p_size").cast("string")).alias("metadata"), F.col("p_retailprice").alias("ts"), F.col("p_partkey").alias("id"), (F.col("p_partkey") % 4 == 0).alias("early"),
    )


def _tables(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    rows = _seen(spark, sf_dir)
    nodes = spark.createDataFrame([], "tenant long, name string, type string, metadata map<string,string>, updated_at double")
    aliases = spark.createDataFrame([], "tenant long, alias string, name string, source string")
    before = entities.upsert_entities(nodes, aliases, rows.where("early"))
    return entities.upsert_entities(*before, rows.where("not early"))


@query(f"WITH {ENTITY_SQL}, told AS (SELECT tenant, name, k, arg_max(v, (NOT early, ts, id)) AS v FROM seen GROUP BY ALL), merged AS (SELECT tenant, name, string_agg(k || '=' || v, ';' ORDER BY k) AS metadata FROM told GROUP BY ALL) SELECT tenant, name, arg_min(type, (NOT early, ts, id)) AS type, any_value(metadata) AS metadata FROM seen JOIN merged USING (tenant, name) GROUP BY tenant, name")
def merged_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entities after two batches of mentions; metadata as text."""
    pairs = F.array_sort(F.transform(F.map_entries("metadata"), lambda e: F.concat(e["key"], F.lit("="), e["value"])))
    return _tables(spark, sf_dir)[0].select("tenant", "name", "type", F.array_join(pairs, ";").alias("metadata"))


@query(f"WITH {ENTITY_SQL}, forms AS (SELECT tenant, lower(replace(trim(alias), 'É', 'E')) AS alias, name, 'llm' AS source, (NOT early, ts, id, 0) AS o FROM seen UNION ALL SELECT tenant, lower(trim(name)), name, 'manual', (NOT early, ts, id, 1) FROM seen) SELECT tenant, alias, arg_min(name, o) AS name, arg_min(source, o) AS source FROM forms GROUP BY tenant, alias")
def registered_aliases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Aliases after two batches of mentions."""
    return _tables(spark, sf_dir)[1]
