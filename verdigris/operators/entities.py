"""Entity resolution: exact alias, fuzzy name by trigrams, exact name."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from verdigris.functions.text import trigrams, unaccent


def fuzzy(surfaces: DataFrame, names: DataFrame, least: float = 0.6, others: bool = False) -> DataFrame:
    """(surface, name, similarity): the most similar name of each surface at or above ``least``; ties to the smaller name.

    Two texts that share enough trigrams share one of each other's rarest few: of n trigrams, those that
    are left when all but one of the least number to be shared are set aside. Only these meet in the
    join, so a common trigram brings no pairs together, and the pairs are then compared whole. With
    ``others``, a surface does not match the name that equals it.
    """
    a = surfaces.select(F.col("surface").alias("t")).distinct().select("t", trigrams("t").alias("g"))
    b = names.select(F.col("name").alias("t")).distinct().select("t", trigrams("t").alias("g"))
    uses = a.unionByName(b).select(F.explode("g").alias("x")).groupBy("x").agg(F.count("*").alias("uses"))

    def rare(rows: DataFrame) -> DataFrame:
        ranked = rows.select("t", F.explode("g").alias("x")).join(uses, "x").groupBy("t").agg(F.array_sort(F.collect_list(F.struct("uses", "x"))).alias("g"))
        some = F.size("g") - F.ceil(F.lit(least) * F.size("g") - 1e-9).cast("int") + 1
        return ranked.select("t", F.transform("g", lambda p: p["x"]).alias("g"), F.explode(F.transform(F.slice("g", F.lit(1), some), lambda p: p["x"])).alias("x"))

    x = rare(a).select(F.col("t").alias("surface"), F.col("g").alias("ga"), "x")
    y = rare(b).select(F.col("t").alias("name"), F.col("g").alias("gb"), "x")
    na, nb = F.size("ga"), F.size("gb")
    near = (na >= least * nb) & (nb >= least * na)
    near = near & (F.col("surface") != F.col("name")) if others else near
    shared = F.size(F.array_intersect("ga", "gb"))
    scored = x.join(y, "x").where(near).select("surface", "name", F.round(shared / (na + nb - shared), 9).alias("similarity")).where(F.col("similarity") >= least).distinct()
    n = F.row_number().over(W.partitionBy("surface").orderBy(F.desc("similarity"), "name"))
    return scored.withColumn("n", n).where("n = 1").drop("n")


def resolve(surfaces: DataFrame, aliases: DataFrame, names: DataFrame, least: float = 0.6) -> DataFrame:
    """(surface, name): by alias (alias, name), else by similarity, else by equal name."""
    low = surfaces.select("surface", F.lower(F.trim("surface")).alias("low")).distinct()
    by_alias = aliases.select(F.lower("alias").alias("low"), F.col("name").alias("n1"))
    by_name = names.select(F.lower("name").alias("low"), F.col("name").alias("n3"))
    by_likeness = fuzzy(surfaces.select("surface").distinct(), names, least).select("surface", F.col("name").alias("n2"))
    return low.join(by_alias, "low", "left").join(by_likeness, "surface", "left").join(by_name, "low", "left").select("surface", F.coalesce("n1", "n2", "n3").alias("name"))


def upsert_entities(nodes: DataFrame, aliases: DataFrame, new: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both tables after new (tenant, name, type, alias, metadata, ts, id), in the order of ts and id.

    Nodes are (tenant, name, type, metadata, updated_at): a name keeps its first type, and metadata is
    merged key by key, the last value winning. Aliases are (tenant, alias, name, source), lower-cased, trimmed and
    without accents: each mention registers its surface form as ``llm``, then the name as ``manual``; an alias that is there stays.
    """
    order = F.struct("ts", "id")
    first = new.groupBy("tenant", "name").agg(F.min_by("type", order).alias("type"), F.max("ts").alias("at"))
    said = new.select("tenant", "name", F.explode("metadata").alias("k", "v"), order.alias("o")).groupBy("tenant", "name", "k").agg(F.max_by("v", "o").alias("v"))
    said = said.groupBy("tenant", "name").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("k", "v")))).alias("more"))
    empty = F.create_map().cast("map<string,string>")
    both = nodes.withColumnsRenamed({"type": "old_type", "metadata": "old"}).join(first.join(said, ["tenant", "name"], "left"), ["tenant", "name"], "full_outer")
    old, more = F.coalesce("old", empty), F.coalesce("more", empty)
    merged = F.map_concat(F.map_filter(old, lambda k, _: ~F.map_contains_key(more, k)), more)
    kept = both.select("tenant", "name", F.coalesce("old_type", "type").alias("type"), merged.alias("metadata"), F.coalesce("at", "updated_at").alias("updated_at"))
    forms = F.explode(F.array(F.struct(F.lit(0).alias("n"), F.col("alias").alias("form"), F.lit("llm").alias("source")), F.struct(F.lit(1).alias("n"), F.col("name").alias("form"), F.lit("manual").alias("source"))))
    told = new.select("tenant", "name", "ts", "id", forms.alias("f")).select("tenant", F.lower(unaccent(F.trim("f.form"))).alias("alias"), "name", F.col("f.source").alias("source"), F.struct("ts", "id", "f.n").alias("o"))
    fresh = told.where(F.col("alias").isNotNull()).groupBy("tenant", "alias").agg(F.min_by(F.struct("name", "source"), "o").alias("x")).select("tenant", "alias", "x.name", "x.source")
    return kept, aliases.unionByName(fresh.join(aliases.select("tenant", "alias"), ["tenant", "alias"], "left_anti").select(*aliases.columns))
