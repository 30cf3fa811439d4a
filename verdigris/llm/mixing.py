"""Operator 1: mixing sources to target weights, DataFrame functions only.

Targets share ``share`` times all words among the sources by weight; a target stops at ``most``
times its source's words and the excess goes to the others by weight. A source is taken in
complete epochs first. The rest of its target is filled by Efraimidis-Spirakis sampling: each
document draws an exponential key with its quality weight as the rate, and documents join in
ascending key until the running sum of words meets the budget; the document at the edge gives
its first words only, so the taken words equal the floor of the target.

No source is sorted as a whole: keys fall into ordered bins, words are summed by bin, and only the
rows of the bin in which a budget ends are ranked.

Null texts have no words and are taken as 0; sources null come last; an empty table gives none.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from verdigris.llm.common import settle

WORD = "[^\\x20\\x09-\\x0D]+"
BINS = 4096


def sized(docs: DataFrame, carry: Sequence[str] = ()) -> DataFrame:
    """(doc_id, source, size, key) and the columns ``carry``: words and sampling key of every row."""
    out = docs.select(*carry, "doc_id", "source", F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"), F.coalesce(F.length("text"), F.lit(0)).cast("long").alias("_chars"))
    fair = (F.col("size") >= 20) & F.col("_chars").between(4 * F.col("size"), 11 * F.col("size"))
    weight = F.when(fair, F.lit(1.0)).otherwise(F.lit(0.5))
    draw = F.conv(F.substring(F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 1, 12), 16, 10).cast("double")
    return out.select(*carry, "doc_id", "source", "size", (-F.log((draw + 1) / F.lit(281474976710657.0)) / weight).alias("key"))


def targets(sizes: DataFrame, weights: list[int], share: float, most: int) -> DataFrame:
    """(source, source_size, target) from (source, source_size): the weights repeat over the sources by code point.

    Sources fill up in the order of ``most * size / weight``. With the first r of them full, the
    rest share what is left in proportion to weight; the first r at which the next one would not
    overflow settles it.
    """
    one = W.partitionBy(F.lit(1))
    ranked = sizes.withColumn("_i", F.row_number().over(one.orderBy(F.col("source").asc_nulls_last())))
    ranked = ranked.withColumn("_w", F.get(F.lit(weights), (F.col("_i") - 1) % len(weights)).cast("long"))
    ranked = ranked.withColumn("_ratio", F.lit(most) * F.col("source_size") / F.col("_w"))
    order = one.orderBy("_ratio", "_i").rowsBetween(W.unboundedPreceding, -1)
    every = one.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    ranked = ranked.withColumn("_full", F.coalesce(F.sum("source_size").over(order), F.lit(0)))
    ranked = ranked.withColumn("_left", F.sum("_w").over(every) - F.coalesce(F.sum("_w").over(order), F.lit(0)))
    ranked = ranked.withColumn("_level", (F.lit(share) * F.sum("source_size").over(every) - F.lit(most) * F.col("_full")) / F.col("_left"))
    level = F.min(F.when(F.col("_level") <= F.col("_ratio"), F.struct("_ratio", "_i", "_level"))).over(every)["_level"]
    ranked = ranked.withColumn("_flat", level)
    cap = (F.lit(most) * F.col("source_size")).cast("double")
    return ranked.select("source", "source_size", F.when(F.col("_flat").isNull(), cap).otherwise(F.least(cap, F.col("_flat") * F.col("_w"))).alias("target"))


def mix(docs: DataFrame, weights: list[int] = [3, 1, 2], share: float = 1.5, most: int = 2, carry: Sequence[str] = ()) -> DataFrame:  # noqa: B006
    """(doc_id, size, source_size, target, taken, epochs) of every row; ``taken`` counts words, repeats included.

    The columns ``carry`` tell rows of one doc_id apart: they come first in the result and break ties.
    """
    rows = settle(sized(docs, carry).withColumn("bin", F.floor((1 - F.exp(-F.col("key"))) * BINS).cast("int")).withColumn("source", F.col("source").cast("string")))
    bins = rows.groupBy("source", "bin").agg(F.sum("size").alias("words"))
    sizes = bins.groupBy("source").agg(F.sum("words").alias("source_size"))
    goal = targets(sizes, weights, share, most)
    goal = goal.withColumn("epochs", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long"))
    goal = goal.withColumn("budget", F.floor("target").cast("long") - F.col("epochs") * F.col("source_size"))
    before = W.partitionBy("source").orderBy("bin").rowsBetween(W.unboundedPreceding, -1)
    bins = bins.withColumn("before", F.coalesce(F.sum("words").over(before), F.lit(0)))
    same = F.col("g.source").eqNullSafe(F.col("b.source"))
    plan = bins.alias("b").join(goal.alias("g"), same).select("b.source", "bin", "words", "before", "source_size", "target", "epochs", "budget")
    joined = rows.alias("r").join(plan.alias("p"), F.col("r.source").eqNullSafe(F.col("p.source")) & (F.col("r.bin") == F.col("p.bin")))
    joined = joined.select(*carry, "doc_id", "size", "key", F.col("r.source").alias("source"), F.col("r.bin").alias("bin"), "words", "before", "source_size", "target", "epochs", "budget")
    whole = F.col("before") + F.col("words") <= F.col("budget")
    edge = ~whole & (F.col("before") < F.col("budget"))
    plain = joined.where(~edge).withColumn("extra", F.when(whole, F.col("size")).otherwise(0))
    within = W.partitionBy("source", "bin").orderBy("key", "doc_id", "size", *carry).rowsBetween(W.unboundedPreceding, -1)
    cut = joined.where(edge).withColumn("extra", F.greatest(F.lit(0), F.least(F.col("size"), F.col("budget") - F.col("before") - F.coalesce(F.sum("size").over(within), F.lit(0)))))
    return plain.unionByName(cut).select(*carry, "doc_id", "size", "source_size", "target", (F.col("epochs") * F.col("size") + F.col("extra")).cast("long").alias("taken"), "epochs")


MIX_SQL = """
WITH sized AS (
  SELECT doc_id, source, COALESCE(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS size, COALESCE(length(text), 0)::BIGINT AS chars FROM documents
), keyed AS (
  SELECT doc_id, source, size,
    -ln((('0x' || substr(md5(COALESCE(doc_id::VARCHAR, '')), 1, 12))::BIGINT::DOUBLE + 1) / 281474976710657.0::DOUBLE)
      / CASE WHEN size >= 20 AND chars BETWEEN 4 * size AND 11 * size THEN 1.0::DOUBLE ELSE 0.5::DOUBLE END AS key
  FROM sized
), sources AS (
  SELECT source, SUM(size)::BIGINT AS source_size FROM keyed GROUP BY source
), ranked AS (
  SELECT *, row_number() OVER (ORDER BY encode(source) ASC NULLS LAST) AS i FROM sources
), weighted AS (
  SELECT *, CASE (i - 1) % 3 WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 2 END AS w FROM ranked
), filling AS (
  SELECT *, 2 * source_size / w::DOUBLE AS ratio FROM weighted
), levels AS (
  SELECT *, (1.5::DOUBLE * SUM(source_size) OVER () - 2 * COALESCE(SUM(source_size) OVER (ORDER BY ratio, i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE)
    / (SUM(w) OVER () - COALESCE(SUM(w) OVER (ORDER BY ratio, i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE AS level
  FROM filling
), flat AS (
  SELECT arg_min(level, (ratio, i)) AS level FROM levels WHERE level <= ratio
), goals AS (
  SELECT source, source_size, LEAST(2.0::DOUBLE * source_size, COALESCE((SELECT level FROM flat) * w, 2.0::DOUBLE * source_size)) AS target FROM weighted
), budgets AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END::BIGINT AS epochs FROM goals
), running AS (
  SELECT k.*, COALESCE(SUM(size) OVER (PARTITION BY source ORDER BY key, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM keyed k
)
SELECT r.doc_id, r.size, b.source_size, b.target,
  (b.epochs * r.size + GREATEST(0, LEAST(r.size, floor(b.target)::BIGINT - b.epochs * b.source_size - r.before)))::BIGINT AS taken,
  b.epochs
FROM running r JOIN budgets b ON r.source IS NOT DISTINCT FROM b.source
"""
