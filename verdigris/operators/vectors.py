"""Nearest vectors by cosine: an exact scan by matrix products, and an inverted file that reads a part of the rows.

Queries are counted first. Up to ``QUERY_LIMIT`` of them are one matrix; every task multiplies its rows by
it, a batch at a time, and keeps each query's best. Rows whose vector is null, has no length or holds a
null or a number that is not finite take no part.

The inverted file deals unit vectors out to cells by their nearest centroid and knows the widest angle in
each cell. By the triangle inequality of angles no row of a cell is nearer to a query than the angle to
the centroid less that width. A search reads the most promising cells first and goes on to others as long
as their bound beats the k-th score found, so its result is the exact one; what differs is how much it reads.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

QUERY_LIMIT = 10_000
#: Rows of a batch that are scored at once, and scores that are kept at once.
STEP, SCORES = 4096, 1 << 24


def usable(vec: Column) -> Column:
    """Whether a vector can be compared."""
    x = vec.cast("array<double>")
    whole = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf")))
    return F.coalesce(whole & F.exists(x, lambda v: v != 0), F.lit(False))


def _matrix(column: pa.Array) -> np.ndarray:
    column = column.cast(pa.list_(pa.float64()))
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]


class Best:
    """The rows of the k highest scores of each query so far, with all that tie with the k-th."""

    def __init__(self, k: int, n: int):
        self.k, self.least = k, np.full(n, -np.inf)
        self.query, self.place, self.score = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)

    def add(self, scores: np.ndarray, queries: np.ndarray, first: int) -> None:
        """``scores`` (rows x queries) of rows numbered from ``first``."""
        if len(scores) > self.k:
            floor = np.maximum(self.least[queries], np.partition(scores, -self.k, 0)[-self.k] - 1e-8)
        else:
            floor = self.least[queries]
        row, col = np.nonzero(scores >= floor)
        self.query = np.concatenate([self.query, queries[col]])
        self.place = np.concatenate([self.place, row + first])
        self.score = np.concatenate([self.score, scores[row, col]])
        if len(self.query) > 8 * self.k * max(1, len(self.least)):
            self.prune()

    def prune(self) -> None:
        order = np.lexsort((-self.score, self.query))
        query, score = self.query[order], self.score[order]
        begins = np.searchsorted(query, np.arange(len(self.least)))
        counts = np.diff(np.append(begins, len(query)))
        full = counts >= self.k
        self.least[full] = score[begins[full] + self.k - 1] - 1e-8
        keep = score >= self.least[query]
        self.query, self.place, self.score = query[keep], self.place[order][keep], score[keep]


def _scan(rows: DataFrame, key: str, ids: list, matrix: np.ndarray, id_type: str, k: int, wanted: dict[int, np.ndarray] | None = None) -> DataFrame:
    """(query_id, key, score) that hold each query's k best among ``rows`` (key, vec, and a cell if ``wanted`` names each cell's queries)."""
    every = np.arange(len(ids))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best, keys, count = Best(k, len(ids)), [], 0
        for b in batches:
            if not b.num_rows:
                continue
            cells = b["cell"].to_numpy() if wanted is not None else np.zeros(b.num_rows, np.int64)
            order = np.argsort(cells, kind="stable")
            vecs = _unit(_matrix(b["vec"]))[order]
            keys.append(b[key].take(pa.array(order)))
            cells = cells[order]
            edges = np.flatnonzero(np.diff(cells, prepend=cells[0] - 1))
            for x, y in zip(edges, [*edges[1:], len(cells)], strict=True):
                queries = every if wanted is None else wanted.get(int(cells[x]), every[:0])
                step = max(1, min(STEP, SCORES // max(1, len(queries))))
                for at in range(x, y, step):
                    if len(queries):
                        best.add(vecs[at : min(y, at + step)] @ matrix[queries].T, queries, count + at)
            count += b.num_rows
        best.prune()
        if len(best.query):
            found = pa.chunked_array(keys).take(pa.array(best.place)).combine_chunks()
            yield pa.RecordBatch.from_arrays([pa.array([ids[q] for q in best.query.tolist()]), found, pa.array(best.score)], ["query_id", key, "score"])

    kept = rows.select(key, "vec", *(["cell"] if wanted is not None else []))
    key_type = dict(rows.dtypes)[key]
    return kept.mapInArrow(run, f"query_id {id_type}, `{key}` {key_type}, score double")


def _asked(queries: DataFrame) -> tuple[list, np.ndarray, str] | None:
    """The queries as ids and a matrix of unit vectors, if they are few."""
    rows = queries.where(usable(F.col("qvec"))).select("query_id", F.col("qvec").cast("array<double>").alias("qvec")).limit(QUERY_LIMIT + 1).collect()
    if len(rows) > QUERY_LIMIT:
        return None
    matrix = np.array([r.qvec for r in rows], np.float64)
    return [r.query_id for r in rows], _unit(matrix) if len(rows) else matrix, dict(queries.dtypes)["query_id"]


def topk(rows: DataFrame, queries: DataFrame, k: int, key: str = "id", digits: int = 9) -> DataFrame:
    """(query_id, key, score, rank): the k rows of highest cosine for each (query_id, qvec); ties to the smaller key.

    More than ``QUERY_LIMIT`` queries are searched for in as many groups, each of them one scan.
    """
    asked = _asked(queries)
    if asked is None:
        groups = -(-queries.count() // (QUERY_LIMIT // 2))
        parts = [topk(rows, queries.where(F.pmod(F.xxhash64("query_id"), F.lit(groups)) == g), k, key, digits) for g in range(groups)]
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        return out
    ids, matrix, id_type = asked
    found = _scan(rows.where(usable(F.col("vec"))), key, ids, matrix, id_type, k)
    return _ranked(found, k, key, digits)


def _ranked(found: DataFrame, k: int, key: str, digits: int) -> DataFrame:
    best = W.partitionBy("query_id").orderBy(F.desc("score"), key)
    scored = found.select("query_id", key, F.round("score", digits).alias("score"))
    return scored.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


@dataclass
class VectorIndex:
    """Where an inverted file lies. ``read`` and ``rounds`` tell of the last search: the share of rows it read, and how often it went on."""

    spark: SparkSession
    path: str
    key: str
    key_type: str
    centroids: np.ndarray
    width: np.ndarray
    count: np.ndarray
    read: float = 0.0
    rounds: int = 0

    def rows(self) -> DataFrame:
        """(key, vec, cell), a folder a cell."""
        return self.spark.read.schema(f"`{self.key}` {self.key_type}, vec array<double>, cell int").parquet(f"{self.path}/rows")


def build_index(rows: DataFrame, path: str, key: str = "id", cells: int | None = None, per_cell: int = 256, seed: int = 7) -> VectorIndex:
    """Write the inverted file of ``rows`` (key, vec) to ``path``.

    ``cells`` is the square root of the rows, 4,096 at most, if not given. Centroids are fitted by k-means
    on about ``per_cell`` rows a cell, drawn by a hash of the key; every row is dealt to its nearest one.
    """
    spark = rows.sparkSession
    good = rows.where(usable(F.col("vec"))).select(key, F.col("vec").cast("array<double>").alias("vec"))
    n = good.count()
    cells = cells or max(1, min(4096, round(n**0.5)))
    share = min(1.0, cells * per_cell / max(1, n))
    norm = F.sqrt(F.aggregate("vec", F.lit(0.0), lambda s, v: s + v * v))
    unit = good.withColumn("vec", F.transform("vec", lambda v: v / norm))
    drawn = unit.where(F.pmod(F.xxhash64(key), F.lit(1 << 20)) < int(share * (1 << 20))).select(array_to_vector("vec").alias("features"))
    if drawn.isEmpty():
        drawn = unit.limit(1).select(array_to_vector("vec").alias("features"))
    centers = np.array(KMeans(k=cells, seed=seed, maxIter=8).fit(drawn).clusterCenters()) if n else np.zeros((1, 1))
    length = np.sqrt(np.einsum("ij,ij->i", centers, centers))
    centers = centers[length > 0] / length[length > 0][:, None] if (length > 0).any() else centers[:1]

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                near = _matrix(b["vec"]) @ centers.T
                cell = near.argmax(1)
                yield pa.RecordBatch.from_arrays([b[key], b["vec"], pa.array(cell.astype(np.int32)), pa.array(near[np.arange(len(cell)), cell])], [key, "vec", "cell", "near"])

    key_type = dict(rows.dtypes)[key]
    dealt = unit.mapInArrow(deal, f"`{key}` {key_type}, vec array<double>, cell int, near double")
    dealt.repartitionByRange("cell", key).write.partitionBy("cell").parquet(f"{path}/rows")  # a full cell is split by its keys
    stored = spark.read.schema(f"`{key}` {key_type}, vec array<double>, near double, cell int").parquet(f"{path}/rows")
    told = {r.cell: r for r in stored.groupBy("cell").agg(F.min("near").alias("near"), F.count("*").alias("n")).collect()}  # as many rows as cells at most
    near = np.array([told[c].near if c in told else 1.0 for c in range(len(centers))])
    return VectorIndex(spark, path, key, key_type, centers, np.arccos(np.clip(near, -1, 1)) + 1e-7, np.array([told[c].n if c in told else 0 for c in range(len(centers))]))


def search(index: VectorIndex, queries: DataFrame, k: int, first: int = 8, most_rounds: int | None = None, digits: int = 9) -> DataFrame:
    """As ``topk``, from the inverted file: ``first`` cells a query, then twice as many each time their bounds leave open.

    With ``most_rounds`` it stops early and may miss rows; else the result is exact. At most ``QUERY_LIMIT`` queries.
    """
    asked = _asked(queries)
    if asked is None:
        raise ValueError(f"more than {QUERY_LIMIT} queries at once")
    ids, matrix, id_type = asked
    if not int(index.count.sum()):
        ids, matrix = [], matrix[:0]
    n, cells = len(ids), len(index.centroids)
    bound = np.zeros((n, cells), np.float32)
    for x in range(0, n, 512):
        angle = np.arccos(np.clip(matrix[x : x + 512] @ index.centroids.T, -1, 1))
        bound[x : x + 512] = np.cos(np.maximum(0, angle - index.width)) + 1e-6
    bound[:, index.count == 0] = -2
    order = np.argsort(-bound, 1, kind="stable")
    at, least, some = np.zeros(n, np.int64), np.full(n, -1.5), first
    found: DataFrame | None = None
    index.rounds, touched = 0, set()
    while most_rounds is None or index.rounds < most_rounds:
        wanted: dict[int, list[int]] = {}
        for q in range(n):
            ahead = order[q, at[q] : at[q] + some]
            ahead = ahead[bound[q, ahead] > least[q] - 1e-8]
            at[q] += some
            for c in ahead.tolist():
                wanted.setdefault(c, []).append(q)
        if not wanted:
            break
        index.rounds += 1
        touched |= wanted.keys()
        rows = index.rows().where(F.col("cell").isin(sorted(wanted)))
        new = _scan(rows, index.key, ids, matrix, id_type, k, {c: np.array(q) for c, q in wanted.items()})
        # what is kept is bounded: k rows a query, and those that tie with the k-th
        both = new if found is None else new.unionByName(found)
        top = both.withColumn("_r", F.rank().over(W.partitionBy("query_id").orderBy(F.desc(F.round("score", digits))))).where(F.col("_r") <= k).drop("_r")
        kept = top.toArrow()
        found = index.spark.createDataFrame(kept, top.schema)
        places = {v: i for i, v in enumerate(ids)}
        scores: dict[int, list[float]] = {}
        for q, s in zip(kept["query_id"].to_pylist(), kept["score"].to_pylist(), strict=True):
            scores.setdefault(places[q], []).append(s)
        for q, s in scores.items():
            if len(s) >= k:
                least[q] = sorted(s, reverse=True)[k - 1]
        some *= 2
    total = int(index.count.sum())
    index.read = sum(int(index.count[c]) for c in touched) / max(1, total)
    if found is None:
        found = index.spark.createDataFrame([], f"query_id {id_type}, `{index.key}` {index.key_type}, score double")
    return _ranked(found, k, index.key, digits)
