"""What the operators share: readers, cut lineage, word hashing."""

from __future__ import annotations

import atexit
import gc
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows in an Arrow batch handed to Python; long texts make default batches too large.
BATCH_ROWS = 1000


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """``folder/name.parquet`` through Spark's reader, so any store works."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def small_batches(spark: SparkSession) -> None:
    """Bound the rows of an Arrow batch, unless the session has a smaller bound."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key)) > BATCH_ROWS or int(spark.conf.get(key)) <= 0:
        spark.conf.set(key, str(BATCH_ROWS))


@contextmanager
def wide_batches(spark: SparkSession, rows: int = 32_768, size: int = 1 << 21) -> Iterator[None]:
    """Arrow batches of many short rows, bounded by their bytes, for the jobs that run within."""
    bounds = {"spark.sql.execution.arrow.maxRecordsPerBatch": rows, "spark.sql.execution.arrow.maxBytesPerBatch": size}
    before = {key: spark.conf.get(key) for key in bounds}
    try:
        for key, most in bounds.items():
            spark.conf.set(key, str(most))
        yield
    finally:
        for key, old in before.items():
            spark.conf.set(key, old)


def shared_folder(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names; where it is unset, the warehouse of a session on one machine."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        master = spark.conf.get("spark.master", "")
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = spark.conf.get("spark.sql.warehouse.dir")
    return folder.rstrip("/")


def _remove(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
    except Exception:  # noqa: BLE001  the session may have ended before
        pass


def settle(df: DataFrame) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back, which cuts its lineage.

    The files outlive lost executors; they are removed when the driver's process ends.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/verdigris-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    atexit.register(_remove, spark, path)
    out = spark.read.schema(df.schema).parquet(path)
    out._settled_at = path
    return out


def drop(*settled: DataFrame) -> None:
    """Remove the files of tables from ``settle`` that nothing will read any more."""
    for df in settled:
        _remove(df.sparkSession, df._settled_at)


def release(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of finished jobs now, not when the driver next happens to collect garbage."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def long_crc(column: str) -> Column:
    """Unsigned crc32 of the column as text."""
    return F.crc32(F.col(column).cast("string").cast("binary"))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values (the finaliser of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_ODD = np.uint64(0x9E3779B97F4A7C15)


def ngram_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all runs of ``n`` word hashes; empty if there are fewer words."""
    if len(words) < n:
        return words[:0]
    size = len(words) - n + 1
    out = words[:size].copy()
    for k in range(1, n):
        out = out * _ODD + words[k : k + size]
    return mix(out)


def blobs(column: pa.Array | pa.ChunkedArray) -> list[bytes]:
    """The UTF-8 bytes of a string column, null as empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def signed(x: np.ndarray) -> pa.Array:
    """64-bit unsigned values as Spark's signed longs."""
    return pa.array(np.ascontiguousarray(x).view(np.int64))


def id_cuts(df: DataFrame, column: str, per_bucket: int, most: int = 100_000) -> list[int]:
    """Cut points that split the column's values into ranges of about ``per_bucket`` rows.

    Reads that one column; the list is bounded by ``most``, which only makes ranges larger, and their
    rows stream through a task. Ranges steer how rows are dealt out, so approximate cuts are enough.
    """
    n = df.select(column).count()
    k = max(1, min(most, -(-n // per_bucket)))
    if k == 1:
        return []
    shares = [i / k for i in range(1, k)]
    found = df.agg(F.percentile_approx(F.col(column), shares, max(10_000, 4 * k)).alias("c")).first()["c"]
    return sorted(set(found or []))


def range_of(column: Column, cuts: list[int]) -> Column:
    """Number of cuts at or below the value, looked up in two steps; null counts as below all."""
    if not cuts:
        return F.lit(0)
    step = max(1, round(len(cuts) ** 0.5))
    groups = [cuts[i : i + step] for i in range(0, len(cuts), step)]
    heads = F.lit([g[0] for g in groups]).cast("array<bigint>")
    group = F.size(F.filter(heads, lambda c: c <= column)) - 1
    inner = F.get(F.array(*[F.lit(g).cast("array<bigint>") for g in groups]), group)
    return F.when(column.isNull() | (group < 0), F.lit(0)).otherwise(group * step + F.size(F.filter(inner, lambda c: c <= column)))


#: The six ASCII white-space characters, at which words end.
WHITE = b"\t\n\v\f\r "


class Texts:
    """The bytes of a string column in one array, null as empty, and where each text begins and the last one ends."""

    def __init__(self, column: pa.Array | pa.ChunkedArray):
        if isinstance(column, pa.ChunkedArray):
            column = column.combine_chunks()
        column = pc.fill_null(column.cast(pa.large_string()), "")
        _, at, data = column.buffers()
        self.ends = np.frombuffer(at, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
        first = self.ends[0]
        self.data = np.frombuffer(data, np.uint8)[first : self.ends[-1]] if data is not None else np.zeros(0, np.uint8)
        self.ends = self.ends - first


class Words:
    """The words of a batch of texts: ``starts`` and ``stops`` in its bytes; a text's words are those between two of ``ends``."""

    def __init__(self, column: pa.Array | pa.ChunkedArray):
        texts = Texts(column)
        self.data = texts.data
        solid = ~_IS_WHITE[self.data]
        first, last = solid.copy(), solid.copy()
        first[1:] &= ~solid[:-1]
        last[:-1] &= ~solid[1:]
        edge = texts.ends[:-1][texts.ends[:-1] < texts.ends[1:]]
        first[edge] = solid[edge]
        edge = texts.ends[1:][texts.ends[:-1] < texts.ends[1:]] - 1
        last[edge] = solid[edge]
        self.starts, self.stops = np.flatnonzero(first), np.flatnonzero(last) + 1
        self.ends = np.searchsorted(self.starts, texts.ends)

    def __len__(self) -> int:
        return len(self.starts)


_IS_WHITE = np.zeros(256, bool)
_IS_WHITE[list(WHITE)] = True


class Hasher:
    """64-bit hashes of stretches of bytes, many at once: random values of the bytes as a polynomial's coefficients."""

    def __init__(self, seed: int = 0, lower: bool = False):
        rng = np.random.Generator(np.random.PCG64(seed))
        self.values = np.frombuffer(rng.bytes(2048), "<u8").copy()
        self.base = int.from_bytes(rng.bytes(8)) | 1
        if lower:
            self.values[ord("A") : ord("Z") + 1] = self.values[ord("a") : ord("z") + 1]
        self._power(1 << 15)

    def _power(self, n: int) -> None:
        self.powers = np.multiply.accumulate(np.full(n, self.base, np.uint64))
        self.inverse = np.multiply.accumulate(np.full(n, pow(self.base, -1, 1 << 64), np.uint64))

    def __call__(self, data: np.ndarray, starts: np.ndarray, stops: np.ndarray, step: int = 4096) -> np.ndarray:
        out = np.empty(len(starts), np.uint64)
        for a in range(0, len(starts), step):
            first, last = int(starts[a]), int(stops[min(a + step, len(stops)) - 1])
            if last - first > len(self.powers):
                self._power(2 * (last - first))
            total = np.zeros(last - first + 1, np.uint64)
            np.cumsum(self.values[data[first:last]] * self.powers[: last - first], out=total[1:])
            x, y = starts[a : a + step] - first, stops[a : a + step] - first
            out[a : a + step] = (total[y] - total[x]) * self.inverse[x]
        return mix(out)

    def anywhere(self, data: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
        """Hashes of stretches of ``data`` in any order; its sums are held at once."""
        if len(data) > len(self.powers):
            self._power(2 * len(data))
        total = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(self.values[data] * self.powers[: len(data)], out=total[1:])
        return mix((total[stops] - total[starts]) * self.inverse[np.minimum(starts, len(self.inverse) - 1)])


class HashIndex:
    """64-bit hashes to numbers, by open addressing."""

    def __init__(self, bits: int = 14):
        self.keys, self.values, self.many = np.zeros(1 << bits, np.uint64), np.full(1 << bits, -1, np.int32), 0

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """The numbers of ``hashes``, -1 for those not held."""
        last = np.uint64(len(self.keys) - 1)
        out = np.full(len(hashes), -1, np.int64)
        open_, slot = np.arange(len(hashes)), hashes & last
        while len(open_):
            value = self.values[slot]
            same = (self.keys[slot] == hashes[open_]) & (value >= 0)
            out[open_[same]] = value[same]
            on = (value >= 0) & ~same
            open_, slot = open_[on], (slot[on] + np.uint64(1)) & last
        return out

    def add(self, hashes: np.ndarray, numbers: np.ndarray) -> None:
        """Hold distinct ``hashes`` that are not held yet."""
        if 2 * (self.many + len(hashes)) > len(self.keys):
            old = self.values >= 0
            keys, values = self.keys[old], self.values[old]
            bits = int(4 * (self.many + len(hashes))).bit_length()
            self.keys, self.values = np.zeros(1 << bits, np.uint64), np.full(1 << bits, -1, np.int32)
            self._put(keys, values)
        self._put(hashes, numbers.astype(np.int32))
        self.many += len(hashes)

    def _put(self, hashes: np.ndarray, numbers: np.ndarray) -> None:
        last = np.uint64(len(self.keys) - 1)
        slot = hashes & last
        while len(hashes):
            free = np.flatnonzero(self.values[slot] < 0)
            self.values[slot[free]] = numbers[free]
            won = free[self.values[slot[free]] == numbers[free]]
            self.keys[slot[won]] = hashes[won]
            lost = np.ones(len(hashes), bool)
            lost[won] = False
            hashes, numbers, slot = hashes[lost], numbers[lost], (slot[lost] + np.uint64(1)) & last


class WordRows:
    """A row of values for each distinct stretch of bytes, worked out for new ones a batch at a time.

    ``make`` gives an array of rows for a list of bytes. Stretches are told apart by 64-bit hashes. At
    most about ``bound`` rows are kept; past that the first half stays, which holds the most frequent.
    """

    def __init__(self, make, bound: int = 400_000):
        self.make, self.bound = make, bound
        self.index, self.rows, self.names = HashIndex(), None, np.zeros(1024, np.uint64)

    def halve(self) -> None:
        self.keep(self.index.many // 2)

    def keep(self, many: int) -> None:
        """Forget all but the first ``many``."""
        self.index = HashIndex(max(14, int(4 * many).bit_length()))
        self.index.add(self.names[:many], np.arange(many))

    def __call__(self, data: np.ndarray, starts: np.ndarray, stops: np.ndarray, hashes: np.ndarray) -> np.ndarray:
        """Row numbers of the stretches, good until the next call."""
        if self.index.many > self.bound:
            self.halve()
        out = self.index.find(hashes)
        new = np.flatnonzero(out < 0)
        names, first, which = np.unique(hashes[new], return_index=True, return_inverse=True)
        order = np.argsort(first)  # the order of the text, so that early ones get low numbers
        names, first = names[order], first[order]
        rank = np.empty_like(order)
        rank[order] = np.arange(len(order))
        raw = data.tobytes() if len(new) else b""
        at = new[first]
        made = self.make([raw[x:y] for x, y in zip(starts[at].tolist(), stops[at].tolist(), strict=True)])
        many = self.index.many
        if self.rows is None:
            self.rows = np.zeros((1024, *made.shape[1:]), made.dtype)
        need = many + len(names)
        for name in ("rows", "names"):
            old = getattr(self, name)
            if len(old) < need:
                grown = np.zeros((need + need // 2, *old.shape[1:]), old.dtype)
                grown[:many] = old[:many]
                setattr(self, name, grown)
        self.rows[many:need], self.names[many:need] = made, names
        self.index.add(names, np.arange(many, need))
        out[new] = many + rank[which]
        return out


def sums(values: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Sums of ``values`` between consecutive ``ends``; 0 where there is none. Each depends on its own values only."""
    out = np.zeros((len(ends) - 1, *values.shape[1:]), np.float64)
    some = np.flatnonzero(ends[1:] > ends[:-1])
    if len(some):
        out[some] = np.add.reduceat(values, ends[:-1][some], axis=0)
    return out
