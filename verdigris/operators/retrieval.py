"""Hybrid retrieval: vector and lexical top-k per query, rank fusion, neighbours, passages, confidence.

All operators work on batches of queries: ``query_id`` partitions every window, and top-k filters
on ``row_number`` become limits below the shuffle. Query tables are small and are broadcast only
below ``QUERY_LIMIT`` rows, counted first.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from verdigris.operators import vectors

QUERY_LIMIT = 10_000


def _bounded(queries: DataFrame) -> DataFrame:
    """A hint to broadcast, if the table is proven small."""
    few = queries.limit(QUERY_LIMIT + 1).count() <= QUERY_LIMIT
    return F.broadcast(queries) if few else queries


def cosine(a: Column, b: Column) -> Column:
    """Cosine in double precision; null if either has no length."""

    def dot(x: Column, y: Column) -> Column:
        return F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)

    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norm > 0, dot(a, b) / norm)


def visible(rows: DataFrame, tenant: int | None, kinds: list[str] | None = None) -> DataFrame:
    """Shared rows and the caller's own; without a caller shared rows only."""
    out = rows.where(F.col("is_shared") | (F.col("tenant") == tenant) if tenant is not None else F.col("is_shared"))
    return out.where(F.col("source_type").isin(kinds)) if kinds is not None else out


def vector_topk(rows: DataFrame, queries: DataFrame, k: int, key: str = "id", digits: int = 9) -> DataFrame:
    """(query_id, key, score, rank): the k rows of highest cosine for each (query_id, qvec); ties to the smaller key."""
    return vectors.topk(rows, queries, k, key, digits)


def fuse(vector: DataFrame, lexical: DataFrame, attributes: DataFrame, k: int, rrf_k: int = 60, wv: float = 0.65, wf: float = 0.35, key: str = "id") -> DataFrame:
    """(query_id, key, vector_score, final_score, rank): weighted reciprocal ranks of both lists, times authority.

    Both lists hold 4k rows a query; one missing from a list ranks just behind it.
    """
    v = vector.select("query_id", key, F.col("score").alias("vs"), F.col("rank").alias("vr"))
    f = lexical.select("query_id", key, F.col("score").alias("fs"), F.col("rank").alias("fr"))
    both = v.join(f, ["query_id", key], "full_outer")
    last = F.lit(4 * k + 1)
    rrf = F.lit(wv) / (rrf_k + F.coalesce("vr", last)) + F.lit(wf) / (rrf_k + F.coalesce("fr", last))
    both = both.select("query_id", key, F.coalesce("vs", F.lit(0.0)).alias("vector_score"), rrf.alias("rrf"))
    named = both.join(attributes.select(key, "authority"), key)
    best = W.partitionBy("query_id").orderBy(F.desc("final_score"), key)
    out = named.select("query_id", key, "vector_score", F.round(F.col("rrf") * F.col("authority"), 12).alias("final_score"))
    return out.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def reciprocal_ranks(lists: list[DataFrame], key: str = "id") -> DataFrame:
    """(query_id, key, score): unweighted sum of 1 / (60 + rank) over ranked lists, ranks from 1."""
    union = lists[0].select("query_id", key, "rank")
    for x in lists[1:]:
        union = union.unionByName(x.select("query_id", key, "rank"))
    return union.groupBy("query_id", key).agg(F.round(F.sum(F.lit(1.0) / (60 + F.col("rank"))), 12).alias("score"))


def neighbours(hits: DataFrame, chunks: DataFrame, window: int = 1) -> DataFrame:
    """(query_id, source_file, chunk_index, chunk_text): chunks within ``window`` of a hit in the same file, once each; hits with a text need no lookup for a window of 0."""
    if window <= 0 and "chunk_text" in hits.columns:
        return hits.select("query_id", "source_file", "chunk_index", "chunk_text")
    wanted = hits.select("query_id", "source_file", F.explode(F.sequence(F.col("chunk_index") - window, F.col("chunk_index") + window)).alias("chunk_index")).distinct()
    return chunks.select("source_file", "chunk_index", "chunk_text").join(_bounded(wanted), ["source_file", "chunk_index"]).select("query_id", "source_file", "chunk_index", "chunk_text")


def passages(hits: DataFrame, around: DataFrame) -> DataFrame:
    """(query_id, source_file, start_index, end_index, n_hits, top_score, text): runs of consecutive chunks that hold a hit."""
    scored = around.join(hits.select("query_id", "source_file", "chunk_index", "final_score"), ["query_id", "source_file", "chunk_index"], "left")
    order = W.partitionBy("query_id", "source_file").orderBy("chunk_index")
    runs = scored.withColumn("run", F.col("chunk_index") - F.row_number().over(order))
    out = runs.groupBy("query_id", "source_file", "run").agg(
        F.min("chunk_index").alias("start_index"),
        F.max("chunk_index").alias("end_index"),
        F.count("final_score").alias("n_hits"),
        F.max("final_score").alias("top_score"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("chunk_index", "chunk_text"))), lambda c: c["chunk_text"]), "\n\n").alias("text"),
    )
    return out.where(F.col("n_hits") > 0).drop("run")


def confidence(fused: DataFrame, queries: DataFrame, least: float = 0.35) -> DataFrame:
    """(query_id, confidence, grounded): the best cosine among a query's hits; no hits are not grounded."""
    best = fused.groupBy("query_id").agg(F.max("vector_score").alias("confidence"))
    return queries.select("query_id").join(best, "query_id", "left").select("query_id", F.coalesce("confidence", F.lit(0.0)).alias("confidence"), (F.coalesce("confidence", F.lit(0.0)) >= least).alias("grounded"))


def prerequisite_hits(hints: DataFrame, search: Callable[[DataFrame, int], DataFrame], most: int = 3, k: int = 2) -> DataFrame:
    """(query_id, prerequisite_for, ...): ``k`` hits for each of the first ``most`` hints of a query.

    ``hints`` is (query_id, n, concept, qvec, qtext) with n from 0; ``search`` finds hits for
    (query_id, qvec, qtext) rows. Every pair of a query and a hint is searched as one query.
    """
    asked = hints.where(F.col("n") < most).withColumn("hint_id", F.col("query_id") * most + F.col("n"))
    found = search(asked.select(F.col("hint_id").alias("query_id"), "qvec", "qtext"), k).withColumnRenamed("query_id", "hint_id")
    names = asked.select("hint_id", "query_id", F.col("concept").alias("prerequisite_for"))
    return found.join(names, "hint_id")


def retrieve(asked: DataFrame, hints: DataFrame, search: Callable[[DataFrame, int], DataFrame], chunks: DataFrame, k: int = 10) -> tuple[DataFrame, DataFrame]:
    """Passages and confidence of a batch of queries.

    The passages are (query_id, prerequisite_for, source_file, start_index, end_index, n_hits, top_score,
    text); those for a prerequisite name it and have no neighbours. Confidence is (query_id, confidence,
    grounded), by the queries' own hits alone.
    """
    hits = search(asked, k)
    own = passages(hits, neighbours(hits, chunks)).withColumn("prerequisite_for", F.lit(None).cast("string"))
    extra = prerequisite_hits(hints, search)
    alone = extra.drop("query_id").withColumnRenamed("hint_id", "query_id")
    tied = passages(alone, neighbours(alone, chunks, 0))
    names = extra.select("hint_id", F.col("query_id").alias("asker"), "prerequisite_for").distinct()
    best = W.partitionBy("hint_id").orderBy(F.desc("top_score"), "source_file", "start_index")
    few = tied.withColumnRenamed("query_id", "hint_id").withColumn("_n", F.row_number().over(best)).where(F.col("_n") <= 2).drop("_n")
    background = few.join(names, "hint_id").drop("hint_id").withColumnRenamed("asker", "query_id")
    return own.unionByName(background), confidence(hits, asked)


def knowledge_block(found: DataFrame, grounded: DataFrame) -> DataFrame:
    """(query_id, block): passages under a header that tells how well they match.

    Passages with a ``prerequisite_for`` (the column may be missing) come first, as background.
    """
    rows = found if "prerequisite_for" in found.columns else found.withColumn("prerequisite_for", F.lit(None).cast("string"))
    own = F.col("prerequisite_for").isNull()
    where = F.when(F.col("start_index") == F.col("end_index"), F.concat(F.lit("chunk "), F.col("start_index"))).otherwise(F.concat(F.lit("chunks "), F.col("start_index"), F.lit("-"), F.col("end_index")))
    head = F.when(own, F.concat(F.lit("["), F.col("source_file"), F.lit(", "), where, F.lit("]\n"))).otherwise(F.concat(F.lit("[Prerequisite: "), F.initcap("prerequisite_for"), F.lit("]\n")))
    item = F.struct((-F.col("top_score")).alias("o"), "source_file", "start_index", F.concat(head, "text").alias("line"))

    def part(which: Column) -> Column:
        return F.array_join(F.transform(F.array_sort(F.collect_list(F.when(which, item))), lambda p: p["line"]), "\n\n")

    body = rows.groupBy("query_id").agg(part(own).alias("body"), part(~own).alias("background"))
    body = body.select("query_id", F.nullif("body", F.lit("")).alias("body"), F.nullif("background", F.lit("")).alias("background"))
    title = F.when(F.col("body").isNull(), "NO PASSAGES").when(~F.col("grounded"), "WEAK MATCH").otherwise("PASSAGES")
    extra = F.when(F.col("body").isNotNull() & F.col("background").isNotNull(), F.concat(F.lit("BACKGROUND\n\n"), "background", F.lit("\n\nMATERIAL")))
    return grounded.join(body, "query_id", "left").select("query_id", F.concat_ws("\n\n", title, extra, "body").alias("block"))


# What kinds of documents add to a score, a canonical passage, and what a marked one loses.
KIND_BOOST = {"pdfs": 2.0, "transcripts": 1.8, "newsletters": 0.9, "blog_posts": 0.3}
CANONICAL_BOOST, MARKED_LOSS = 0.5, 0.8


def quality_boost(kind: Column, authority: Column, canonical: Column, named: Column, markers: list[str] = (), kinds: dict[str, float] | None = None) -> Column:
    """What a passage's source adds to its score: twice its authority, its kind, being canonical, less a loss if ``named`` holds a marker."""
    told = F.coalesce(*(F.when(F.lower(kind) == k, F.lit(v)) for k, v in (kinds or KIND_BOOST).items()), F.lit(0.0))
    marked = F.exists(F.lit(list(markers)), lambda m: F.contains(F.lower(named), m)) if markers else F.lit(False)
    return F.coalesce(authority * 2.0, F.lit(0.0)) + told + F.when(canonical, CANONICAL_BOOST).otherwise(0.0) - F.when(marked, MARKED_LOSS).otherwise(0.0)


def rerank(candidates: DataFrame, n: int, scorer: Callable[[list[str], list[str]], list[float]] | None = None, most: int = 12, key: str = "id") -> DataFrame:
    """(query_id, key, score, rank): the n best of each query's first ``most`` candidates (query_id, qtext, key, text, boost, rank).

    ``scorer`` takes texts of queries and of passages, a batch at a time; its scores are added to the
    boosts. A query with n candidates or fewer needs none and follows its boosts, as do all without a
    scorer. Where the scorer fails, its queries keep the order of their ranks, without a score. Equal
    scores follow the ranks.
    """
    few = candidates.where(F.col("rank") <= most)
    sized = few.withColumn("_many", F.count("*").over(W.partitionBy("query_id")))
    if scorer is None:
        scored = sized.withColumn("_told", F.lit(0.0))
    else:

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                open_ = [i for i, m in enumerate(b["_many"].to_pylist()) if m > n]
                told: list[float | None] = [0.0] * b.num_rows
                if open_:
                    texts, asked = b["text"].to_pylist(), b["qtext"].to_pylist()
                    try:
                        found = [float(x) for x in scorer([asked[i] for i in open_], [texts[i] for i in open_])]
                    except Exception:  # noqa: BLE001  the scorer is the caller's; without it the ranks stand
                        found = [None] * len(open_)
                    for i, x in zip(open_, found, strict=True):
                        told[i] = x
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(told, pa.float64())], [*b.schema.names, "_told"])

        scored = sized.mapInArrow(run, ", ".join(f"`{c}` {t}" for c, t in sized.dtypes) + ", _told double")
    failed = F.max(F.col("_told").isNull().cast("int")).over(W.partitionBy("query_id")) == 1
    score = F.when(~failed, F.round(F.col("_told") + F.col("boost"), 9))
    best = W.partitionBy("query_id").orderBy(F.desc_nulls_last("score"), "_was")
    out = scored.select("query_id", key, score.alias("score"), F.col("rank").alias("_was"))
    return out.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= n).drop("_was")
