"""Operator 4: approximate nearest neighbours by score-aware quantisation.

Vectors are scaled to unit length, so inner product is cosine. They are cut into subspaces of two
dimensions with 16 codewords each. Codes and codewords minimise the anisotropic loss: the part of
the residual parallel to the vector counts more than the rest, since it is what changes large
inner products. A query is turned into a table of partial scores; two four-bit codes address
256 entries at once. The best of each block by table score are scored exactly, in double
precision. A table score misses the exact one by the length of the row's residual at most, so
every row whose table score and residual reach the k-th exact score is scored exactly too: no
number of near copies in a block is too large, and the result is the exact one. The blocks' best
are merged.

Codewords are fitted on at most ``sample`` rows (a documented bound); every row is indexed and
every query meets every block. Equal vectors are held once with their ``k`` smallest ids other than
each query's own, which is all that can be returned of them, so copies never crowd a block. Blocks hold about
``block_rows`` distinct vectors and ``block_queries`` queries, which bounds a task's memory.

Vectors that are null, zero, hold null or non-finite components or differ in length from
most take no part, neither as queries nor as candidates. Null ids take no part. Rows that repeat
an id are one where their vectors are equal; with different vectors each is a candidate, and a repeated query id asks
once, by its smallest vector in Spark's order of arrays. A row is never a candidate of its own id. Ties in score go to the smaller id.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from verdigris.llm.common import settle

WIDTH = 2
WORDS = 16


class Codebook:
    """Codewords of each subspace: subspaces x 16 x WIDTH."""

    def __init__(self, words: np.ndarray, eta: float):
        self.words, self.eta = words, eta

    def _split(self, unit: np.ndarray) -> np.ndarray:
        pad = self.words.shape[0] * WIDTH - unit.shape[1]
        return np.pad(unit, ((0, 0), (0, pad))).reshape(len(unit), -1, WIDTH)

    def encode(self, unit: np.ndarray, sweeps: int = 2) -> np.ndarray:
        """Codes (rows x subspaces) by coordinate descent on the anisotropic loss."""
        x = self._split(unit.astype(np.float32))
        codes = np.empty(x.shape[:2], np.uint8)
        loss = np.empty((x.shape[1], len(x), WORDS), np.float32)
        along = np.empty_like(loss)
        for m in range(x.shape[1]):
            gap = x[:, m, None, :] - self.words[m][None]
            loss[m] = (gap**2).sum(2)
            along[m] = np.einsum("nkw,nw->nk", gap, x[:, m])
            codes[:, m] = loss[m].argmin(1)
        rows = np.arange(len(x))
        total = sum(along[m][rows, codes[:, m]] for m in range(x.shape[1]))
        for _ in range(sweeps):
            for m in range(x.shape[1]):
                rest = total - along[m][rows, codes[:, m]]
                codes[:, m] = (loss[m] + (self.eta - 1) * (rest[:, None] + along[m]) ** 2).argmin(1)
                total = rest + along[m][rows, codes[:, m]]
        return codes

    def residual(self, unit: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """The length of what the codes leave of each row."""
        gap = self._split(unit.astype(np.float32))
        for m in range(codes.shape[1]):
            gap[:, m] -= self.words[m][codes[:, m]]
        return np.sqrt((gap**2).sum((1, 2)))

    def tables(self, query: np.ndarray) -> np.ndarray:
        """Partial scores of pairs of codes: ceil(subspaces / 2) x 256."""
        q = self._split(query[None].astype(np.float32))[0]
        part = np.einsum("mkw,mw->mk", self.words, q)
        if len(part) % 2:
            part = np.vstack([part, np.zeros((1, WORDS), np.float32)])
        return (part[0::2, :, None] + part[1::2, None, :]).reshape(-1, WORDS * WORDS)


def paired(codes: np.ndarray) -> np.ndarray:
    """Two codes to a byte, one row for each pair of subspaces."""
    if codes.shape[1] % 2:
        codes = np.pad(codes, ((0, 0), (0, 1)))
    return np.ascontiguousarray((codes[:, 0::2] * WORDS + codes[:, 1::2]).T)


def fit(unit: np.ndarray, threshold: float = 0.2, rounds: int = 6, seed: int = 7) -> Codebook:
    """Alternate codes and codewords; parallel errors weigh eta times as much, eta following from the score threshold."""
    d = unit.shape[1]
    eta = max(1.0, (d - 1) * threshold**2 / (1 - threshold**2))
    parts = -(-d // WIDTH)
    rng = np.random.default_rng(seed)
    start = np.pad(unit, ((0, 0), (0, parts * WIDTH - d))).reshape(len(unit), parts, WIDTH).astype(np.float32)
    pick = rng.choice(len(unit), WORDS, replace=len(unit) < WORDS)
    book = Codebook(np.ascontiguousarray(start[pick].transpose(1, 0, 2)), eta)
    for r in range(rounds):
        codes = book.encode(unit, sweeps=0 if r < 3 else 1)
        took = np.stack([book.words[m][codes[:, m]] for m in range(parts)], 1)
        along = ((start - took) * start).sum(2)
        total = along.sum(1)
        for m in range(parts):
            x, c = start[:, m], codes[:, m]
            goal = total - along[:, m] + (x**2).sum(1)
            for k in range(WORDS):
                at = c == k
                if not at.any():
                    book.words[m][k] = x[rng.integers(len(x))]
                    continue
                left = at.sum() * np.eye(WIDTH) + (eta - 1) * x[at].T @ x[at]
                right = x[at].sum(0) + (eta - 1) * (goal[at, None] * x[at]).sum(0)
                book.words[m][k] = np.linalg.solve(left, right)
            fresh = ((x - book.words[m][c]) * x).sum(1)
            total += fresh - along[:, m]
            along[:, m] = fresh
    return book


def _matrix(column: pd.Series) -> np.ndarray:
    return np.stack(column.to_numpy()).astype(np.float64) if len(column) else np.zeros((0, 1))


def _unit(x: np.ndarray) -> np.ndarray:
    """Rows at unit length; scaled first, so that no square leaves the range of doubles."""
    x = x / np.abs(x).max(1, keepdims=True, initial=1e-300)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def cosines(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Cosine of one vector to each row, in double precision."""
    return (x @ q) / np.sqrt((x * x).sum(1)) / np.sqrt(q @ q)


def usable(vectors: DataFrame, key: str = "vec_id", column: str = "embedding") -> DataFrame:
    """(id, v) of the rows that take part, components as double."""
    v = F.col("v")
    rows = vectors.select(F.col(key).cast("long").alias("id"), F.col(column).cast("array<double>").alias("v")).where(F.col("id").isNotNull() & v.isNotNull())
    big = F.lit(float("inf"))
    rows = rows.where((F.size(v) > 0) & F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < big)) & F.exists(v, lambda c: c != 0))
    sizes = rows.groupBy(F.size(v).alias("n")).count().orderBy(F.desc("count"), "n").first()
    return rows.where(F.size(v) == (sizes["n"] if sizes else 0))


def search(vectors: DataFrame, queries: DataFrame, k: int = 5, rerank: int = 640, sample: int = 16_384, block_rows: int = 65_536, block_queries: int = 4096) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k nearest other rows. Both inputs come from ``usable``."""
    spark = vectors.sparkSession
    groups = settle(_distinct(vectors, k))
    queries = queries.groupBy("id").agg(F.min("v").alias("v"))
    n, m = groups.count(), queries.count()
    schema = "query_id long, rank int, vec_id long, score double"
    if not n or not m:
        return spark.createDataFrame([], schema)
    seen = groups.where(F.pmod(F.col("h"), F.lit(1_000_000)) < min(1.0, sample / n) * 1_000_000).select("v").limit(2 * sample).toPandas()
    if not len(seen):
        seen = groups.select("v").limit(sample).toPandas()
    book = fit(_unit(_matrix(seen["v"])))
    rblocks, qblocks = -(-n // block_rows), -(-m // block_queries)
    rows = groups.select(F.pmod("h", F.lit(rblocks)).alias("rb"), "ids", "v").withColumn("qb", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(qblocks - 1).cast("long"))))
    asks = queries.select(F.pmod(F.xxhash64("id"), F.lit(qblocks)).alias("qb"), "id", "v").withColumn("rb", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(rblocks - 1).cast("long"))))

    def scan(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out: dict[str, list] = {"query_id": [], "vec_id": [], "score": []}
        if len(left) and len(right):
            x = _matrix(left["v"])
            codes, left_over = [], []
            for a in range(0, len(x), 8192):
                unit = _unit(x[a : a + 8192])
                own = book.encode(unit)
                codes.append(paired(own))
                left_over.append(book.residual(unit, own) + 1e-4)  # what single precision may add
            codes, left_over = np.concatenate(codes, 1), np.concatenate(left_over)
            ids = left["ids"].to_numpy()
            first = np.array([i[0] for i in ids])
            for q_id, q in zip(right["id"], _matrix(right["v"]), strict=True):
                lut = book.tables(_unit(q[None])[0])
                score = lut[0][codes[0]]
                for t, c in zip(lut[1:], codes[1:], strict=True):
                    score += t[c]
                top = np.argpartition(-score, rerank)[:rerank] if len(score) > rerank else np.arange(len(score))
                got = _best(q, q_id, x, ids, first, top, k)
                if len(score) > rerank:
                    least = -got[k - 1][0] if len(got) >= k else -2.0
                    more = score + left_over >= least
                    more[top] = False
                    got = sorted(got + _best(q, q_id, x, ids, first, np.flatnonzero(more), k))
                for s, i in got[:k]:
                    out["query_id"].append(q_id)
                    out["vec_id"].append(i)
                    out["score"].append(-s)
        return pd.DataFrame(out).astype({"query_id": "int64", "vec_id": "int64", "score": "float64"})

    found = rows.groupBy("rb", "qb").cogroup(asks.groupBy("rb", "qb")).applyInPandas(scan, "query_id long, vec_id long, score double")
    best = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _best(q: np.ndarray, q_id: int, x: np.ndarray, ids: np.ndarray, first: np.ndarray, rows: np.ndarray, k: int) -> list[tuple[float, int]]:
    """(-score, id) of the k best ids among ``rows``, ties to the smaller id, a slice of rows at a time."""
    got: list[tuple[float, int]] = []
    for a in range(0, len(rows), 65_536):
        some = rows[a : a + 65_536]
        exact = cosines(q, x[some])
        if len(got) >= k:
            reach = exact >= -got[k - 1][0]
            some, exact = some[reach], exact[reach]
        for g in np.lexsort((first[some], -exact)):
            got += [(-exact[g], i) for i in ids[some[g]] if i != q_id]
            if len(got) >= k and exact[g] < -sorted(got)[k - 1][0]:
                break
        got = sorted(got)[:k]
    return got


def _distinct(vectors: DataFrame, k: int) -> DataFrame:
    """(v, h, ids): distinct vectors with their k + 1 smallest different ids; copies are cut down before the shuffle."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[int]] = {}
        for b in batches:
            keep = []
            for row, (h, i) in enumerate(zip(b["h"].to_pylist(), b["id"].to_pylist(), strict=True)):
                own = held.setdefault(h, [])
                if i not in own and (len(own) <= k or i < own[-1]):
                    own.append(i)
                    own.sort()
                    del own[k + 1 :]
                    keep.append(row)
            if len(held) > 200_000:
                held.clear()
            yield b.take(pa.array(keep, pa.int64()))

    rows = vectors.select("id", "v", F.xxhash64("v").alias("h"))
    thin = rows.mapInArrow(cut, rows.schema)
    by = W.partitionBy("h", "v").orderBy("id")
    ranked = thin.withColumn("n", F.dense_rank().over(by)).where(F.col("n") <= k + 1)
    return ranked.groupBy("h", "v").agg(F.array_sort(F.collect_set("id")).alias("ids"))
