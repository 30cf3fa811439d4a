"""Connected components of an edge table: trees within tasks, then alternating large-star and small-star steps."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verdigris.llm.common import drop, settle, wide_batches

#: Edges that a task joins into trees before any are dealt out.
EDGES = 65_536


def _trees(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, smallest node) of every node in the components of a task's edges, or of each ``4 * EDGES`` of them."""
    up: dict[int, int] = {}

    def root(x: int) -> int:
        top = x
        while (y := up.setdefault(top, top)) != top:
            top = y
        while up[x] != top:
            up[x], x = top, up[x]
        return top

    def told() -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({"a": pa.array(list(up), pa.int64()), "b": pa.array([root(x) for x in up], pa.int64())})

    held = 0
    for b in batches:
        if held > 4 * EDGES:
            yield told()
            up.clear()
            held = 0
        held += b.num_rows
        for x, y in zip(b["a"].to_pylist(), b["b"].to_pylist(), strict=True):
            x, y = root(x), root(y)
            up[max(x, y)] = min(x, y)
    yield told()


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Large: each node's larger neighbours join its smallest one. Small: its smaller ones and itself do."""
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v"))
    if large:
        both = both.unionByName(both.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        both = both.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
    moved = both.join(least, "u")
    if large:
        return moved.where(F.col("v") > F.col("u")).select(F.col("v").alias("a"), F.col("m").alias("b")).where(F.col("a") != F.col("b"))  # the small step drops repeats
    kept = moved.where(F.col("v") != F.col("m")).select(F.col("v").alias("a"), F.col("m").alias("b"))
    return kept.unionByName(least.select(F.col("u").alias("a"), F.col("m").alias("b"))).where(F.col("a") != F.col("b")).distinct()


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, root) of every node with an edge (a, b); root is the component's smallest node.

    Each task first replaces its edges by trees to their smallest nodes; as many tasks do so as give each
    about ``EDGES`` edges. What one task has held whole is done. Else rounds follow among the trees. The table is
    written between rounds, so no plan grows and a lost executor costs one round. It
    stops when a round leaves every edge as it was, that is when each component is a star.
    """
    given = settle(edges.where(F.col("a").isNotNull() & F.col("b").isNotNull() & (F.col("a") != F.col("b"))).select("a", "b"))
    tasks = max(1, -(-given.count() // EDGES))
    with wide_batches(given.sparkSession):
        now = settle(given.coalesce(tasks).mapInArrow(_trees, "a long, b long"))
    drop(given)
    if tasks == 1:
        return now.toDF("node", "root")
    now = now.where(F.col("a") != F.col("b"))
    mark = None
    for _ in range(rounds):
        old, now = now, settle(_star(_star(now, True), False))
        if mark:
            drop(old)
        sums = now.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("a", "b")).alias("x")).first()
        if (sums["n"], sums["x"]) == mark:
            break
        mark = (sums["n"], sums["x"])
    else:
        raise RuntimeError("components did not settle")
    stars = now.select(F.col("a").alias("node"), F.col("b").alias("root"))  # a star's leaf has one edge
    return stars.unionByName(stars.select(F.col("root").alias("node"), "root").distinct())
