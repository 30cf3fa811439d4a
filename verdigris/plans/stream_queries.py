"""Stream, source and chunking queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from verdigris.functions import text
from verdigris.operators import chunking
from verdigris.operators import semantic_chunks as semantic
from verdigris.plans.registry import query
from verdigris.sources import html
from verdigris.sources.tables import table
from verdigris.streaming import limits, sentences, windows


@query("SELECT date_trunc('day', ts) AS start, event_type, COUNT(*) AS n, round(SUM(value), 6) AS total FROM events GROUP BY 1, 2")
def stream_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = windows.drained(windows.counts(windows.read(spark, f"{sf_dir}/events.parquet")), "complete")
    return out.withColumn("start", F.col("start").cast("timestamp_ntz"))


@query(
    """WITH marked AS (SELECT user_id, ts, CASE WHEN lag(ts) OVER w IS NULL OR ts - lag(ts) OVER w >= INTERVAL 30 MINUTES THEN 1 ELSE 0 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
    cut AS (SELECT *, SUM(new) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS s FROM marked) SELECT user_id, MIN(ts) AS start, MAX(ts) + INTERVAL 30 MINUTES AS "end", COUNT(*) AS n FROM cut GROUP BY user_id, s"""
)
def stream_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = windows.drained(windows.session_counts(windows.read(spark, f"{sf_dir}/events.parquet")), "complete")
    return out.withColumn("start", F.col("start").cast("timestamp_ntz")).withColumn("end", F.col("end").cast("timestamp_ntz"))


@query(
    """WITH RECURSIVE r AS (SELECT user_id AS key, event_id AS id, floor(epoch(ts))::DOUBLE AS seconds, row_number() OVER (PARTITION BY user_id ORDER BY floor(epoch(ts)), event_id) AS i FROM events),
    walk AS (SELECT key, 0::BIGINT AS i, 2.0::DOUBLE AS tokens, NULL::DOUBLE AS last_, NULL::BIGINT AS id, false AS allowed FROM (SELECT DISTINCT key FROM r)
      UNION ALL SELECT key, i, t - CASE WHEN t >= 1 THEN 1 ELSE 0 END, seconds, id, t >= 1 FROM (SELECT r.key, r.i, r.id, r.seconds, CASE WHEN last_ IS NULL THEN tokens ELSE LEAST(2.0::DOUBLE, tokens + (seconds - last_) * 2.0::DOUBLE / 60) END AS t FROM walk w JOIN r ON r.key = w.key AND r.i = w.i + 1))
    SELECT key, id, allowed FROM walk WHERE id IS NOT NULL"""
)
def token_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return limits.allowed(e.select(F.col("user_id").alias("key"), F.col("event_id").alias("id"), F.unix_timestamp(F.col("ts").cast("timestamp")).cast("double").alias("seconds")), 2.0)


@query()
def sentences_of_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), "text")
    return sentences.of_texts(rows, "id")


@query()
def page_articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.articles(table(spark, sf_dir, "pages")).withColumn("day", text.date_prefix("date"))


@query()
def page_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.article_links(html.links(table(spark, sf_dir, "pages")), "^https?://", ["/page/", "/category/", "/tag/", "#"])


@query()
def document_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = chunking.chunks(table(spark, sf_dir, "documents"), "doc_id")
    return rows.withColumn("embed_text", text.embed_text("heading_trail", "chunk_text"))


@query("SELECT vec_id, len(embedding) AS n, true AS same FROM embeddings")
def vector_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select("vec_id", F.size("embedding").alias("n"), (text.text_vector(text.vector_text("embedding")) == F.col("embedding")).alias("same"))


@query()
def semantic_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents cut where the words change; counts of words stand in for an embedding model."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")
    return semantic.semantic_chunks(docs, semantic.hashed_vectors)
