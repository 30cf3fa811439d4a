"""Operator 5: exact n-gram Jaccard join with signature trees.

A document's set holds the hashes of its distinct 5-word shingles (fewer words: the whole sequence;
no words: nothing, linked with nothing). Two documents link when 100 * common >= 75 * union.

1. Every document sends a prefix of its set, of n - ceil(0.75 n) + 1 + n // 8 tokens, in one order
   for all: hash order, but shingles that are frequent in a sample come last. In two linked sets
   the j-th common token is preceded by at most n - ceil(0.75 n) others, so the first
   1 + n // 8 common tokens (n of the smaller set) lie in both prefixes.
2. Sets that share fewer of their prefix tokens with anyone cannot link and are left out. A token of at
   most ``FEW`` such sets gives all their pairs, and a pair that comes as often as a link needs is a candidate.
   A token of more chains them to the first one whose size may link, which is a candidate at once: if a linked pair has
   such a token both are chained to each other, and if not all its tokens are counted. The
   components of the candidates are cells; every link lies within a cell, and chance pairs make none.
3. A cell's documents, cut into leaves of bounded size, are joined by a signature tree: nodes hold
   OR-combined bitmaps and size ranges, and a dual traversal drops pairs of nodes whose largest
   possible overlap is too small. Pairs already connected need no check, for the result is the
   components: equal sets are held once, and a cell of near copies costs about one check a document.
4. Cells of several leaves then join leaf to leaf, but only documents outside the cell's largest
   component so far, as every pair across components has one of those.

Null or blank texts get no shingles and their own id. Null doc_ids have no component id. Rows
that repeat a doc_id are documents of their own with that id.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verdigris.llm.common import Hasher, Words, drop, mix, ngram_hashes, release, settle, signed, small_batches
from verdigris.llm.components import components

SHINGLE = 5
NEEDED, OUT_OF = 75, 100
SPARE = 8
#: Sets of one token that are paired one by one.
FEW = 24
#: Tokens of a leaf of a cell, which bounds a task's memory.
LEAF = 300_000
_ODD = np.uint64(0x9E3779B97F4A7C15)


def linked(common: int, a: int, b: int) -> bool:
    return OUT_OF * common >= NEEDED * (a + b - common)


def shingle_sets(texts: pa.Array, hashes: Hasher) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text; ``hashes`` takes A-Z as lower case."""
    words = Words(texts)
    codes = hashes(words.data, words.starts, words.stops)
    runs = ngram_hashes(codes, SHINGLE)
    out = []
    for x, y in zip(words.ends[:-1].tolist(), words.ends[1:].tolist(), strict=True):
        if y - x >= SHINGLE:
            s = np.sort(runs[x : y - SHINGLE + 1])
            out.append(s[np.concatenate([[True], s[1:] != s[:-1]])])
        elif y > x:
            out.append(mix(ngram_hashes(codes[x:y], y - x) + np.uint64(y - x)))
        else:
            out.append(codes[:0])
    return out


def set_id(s: np.ndarray) -> int:
    """A signed 63-bit name of a set of hashes."""
    folded = mix(s ^ _ODD)
    total = int(folded.sum(dtype=np.uint64)) ^ int(np.bitwise_xor.reduce(mix(folded))) ^ len(s)
    return total & (2**63 - 1)


def prefix(s: np.ndarray, heavy: np.ndarray) -> np.ndarray:
    """The first tokens of a set in the order (frequent ones last, hash)."""
    n = len(s)
    if len(heavy):
        often = heavy[np.minimum(np.searchsorted(heavy, s), len(heavy) - 1)] == s
        s = np.concatenate([s[~often], s[often]])
    return s[: n - -(-NEEDED * n // OUT_OF) + 1 + n // SPARE]


def frequent(docs: DataFrame, one_in: int = 16, times: int = 8, most: int = 1_000_000) -> np.ndarray:
    """At most ``most`` hashes of shingles that are in ``times`` sets of a sample of the documents, drawn by their text.

    Any choice gives the same links, since it only moves tokens within the order; this one keeps
    passages that many documents share out of most prefixes.
    """
    sample = docs.where(F.pmod(F.xxhash64("text"), F.lit(one_in)) == 0)
    rows = _tokens(sample, lambda s: s).groupBy("token").count()
    found = rows.where(F.col("count") >= times).orderBy(F.desc("count"), "token").limit(most).select("token").toPandas()
    return np.sort(found["token"].to_numpy(np.int64).view(np.uint64))


def postings(docs: DataFrame, heavy: np.ndarray) -> DataFrame:
    """(token, sid, n): the prefix tokens of the distinct sets."""
    return _tokens(docs, lambda s: prefix(s, heavy))


def _tokens(docs: DataFrame, part) -> DataFrame:
    """(token, sid, n): a part of each set; copies within a task are sent once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, seen = Hasher(lower=True), set()
        for b in batches:
            tokens, sids, sizes = [], [], []
            for s in shingle_sets(b["text"], hashes):
                if len(s) and (sid := set_id(s)) not in seen:
                    seen.add(sid)
                    tokens.append(part(s))
                    sids.append(sid)
                    sizes.append(len(s))
            if len(seen) > 300_000:
                seen.clear()
            if tokens:
                many = [len(t) for t in tokens]
                yield pa.RecordBatch.from_pydict({"token": signed(np.concatenate(tokens)), "sid": pa.array(np.repeat(np.array(sids, np.int64), many)), "n": pa.array(np.repeat(np.array(sizes, np.int32), many))})

    return docs.select(F.col("text").cast("string").alias("text")).mapInArrow(run, "token long, sid long, n int")


def shared(rows: DataFrame) -> DataFrame:
    """The postings whose token another set of a size that may link has in its prefix, each once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple | None = None  # the last row and whether it is shared
        for b in batches:
            if not b.num_rows:
                continue
            token, sid, n = (b[c].to_numpy() for c in ("token", "sid", "n"))
            if held is not None:
                token, sid, n = (np.concatenate([[c], x]) for c, x in zip(held, (token, sid, n), strict=False))
            again = np.zeros(len(token), bool)
            again[1:] = (token[1:] == token[:-1]) & (sid[1:] == sid[:-1])
            token, sid, n = token[~again], sid[~again], n[~again]
            link = np.zeros(len(token) + 1, bool)
            link[1:-1] = (token[1:] == token[:-1]) & (OUT_OF * n[:-1].astype(np.int64) >= NEEDED * n[1:].astype(np.int64))
            flag = link[1:] | link[:-1]
            flag[0] |= held is not None and held[3]
            held = (token[-1], sid[-1], n[-1], flag[-1])
            out = flag[:-1]
            yield pa.RecordBatch.from_pydict({"token": pa.array(token[:-1][out], pa.int64()), "sid": pa.array(sid[:-1][out], pa.int64()), "n": pa.array(n[:-1][out], pa.int32())})
        if held is not None and held[3]:
            yield pa.RecordBatch.from_pydict({"token": pa.array([held[0]], pa.int64()), "sid": pa.array([held[1]], pa.int64()), "n": pa.array([held[2]], pa.int32())})

    return rows.repartition("token").sortWithinPartitions("token", "n", "sid").mapInArrow(run, "token long, sid long, n int")


def candidates(rows: DataFrame, few: int | None = None) -> DataFrame:
    """(a, b): pairs of sets with enough prefix tokens in common, or chained by a token of more than ``few`` sets."""
    few = few or FEW
    always = 1 << 40

    def pairs(token: np.ndarray, sid: np.ndarray, n: np.ndarray, crowded: bool) -> Iterator[pa.RecordBatch]:
        """Of whole groups, of which the first one may go on from rows before."""
        new = np.ones(len(token), bool)
        new[1:] = token[1:] != token[:-1]
        group = np.cumsum(new) - 1
        crowd = np.bincount(group)[group] > few
        if crowded:
            crowd[group == 0] = True
        a, b, size, many = [], [], [], []
        at = np.flatnonzero(~crowd)
        for d in range(1, few):
            x, y = at[:-d], at[d:]
            same = token[x] == token[y]
            if not same.any():
                break
            may = same & (OUT_OF * n[x].astype(np.int64) >= NEEDED * n[y].astype(np.int64))
            x, y = x[may], y[may]
            a.append(sid[x])
            b.append(sid[y])
            size.append(n[x])
            many.append(np.ones(len(x), np.int64))
        at = np.flatnonzero(crowd)
        if len(at):
            leader = self_lead(token[at], n[at])
            other = sid[at] != sid[at][leader]
            a.append(sid[at][leader][other])
            b.append(sid[at][other])
            size.append(n[at][other])
            many.append(np.full(int(other.sum()), always))
        if sum(map(len, a)):
            a, b, size, many = (np.concatenate(x) for x in (a, b, size, many))
            yield pa.RecordBatch.from_pydict({"a": pa.array(np.minimum(a, b), pa.int64()), "b": pa.array(np.maximum(a, b), pa.int64()), "n": pa.array(size.astype(np.int64)), "c": pa.array(many)})

    def self_lead(token: np.ndarray, n: np.ndarray) -> np.ndarray:
        new = np.ones(len(token), bool)
        new[1:] = (token[1:] != token[:-1]) | (OUT_OF * n[:-1].astype(np.int64) < NEEDED * n[1:].astype(np.int64))
        return np.maximum.accumulate(np.where(new, np.arange(len(token)), 0))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)]  # rows of the last token so far
        crowded = False  # its earlier rows are chained already; the first row held is then the leader, with the last size
        for b in batches:
            if not b.num_rows:
                continue
            cols = [np.concatenate([h, b[c].to_numpy()]) for h, c in zip(held, ("token", "sid", "n"), strict=True)]
            token, sid, n = cols
            edge = int(np.searchsorted(token, token[-1]))
            if edge:
                yield from pairs(token[:edge], sid[:edge], n[:edge], crowded)
                crowded = False
            held = [c[edge:] for c in cols]
            if len(held[0]) > few:
                yield from pairs(*held, True)
                lead = self_lead(held[0], held[2])[-1]
                held = [held[0][-1:], held[1][lead : lead + 1], held[2][-1:]]
                crowded = True
        if len(held[0]):
            yield from pairs(*held, crowded)

    dealt = rows.repartition("token").sortWithinPartitions("token", "n", "sid")
    counted = dealt.mapInArrow(run, "a long, b long, n long, c long").groupBy("a", "b").agg(F.sum("c").alias("c"), F.min("n").alias("n"))
    return counted.where(F.col("c") > F.floor(F.col("n") / SPARE)).select("a", "b")


def bloom(ids: DataFrame) -> np.ndarray:
    """A bit table over the longs of the first column; may hold others, never misses one.

    It has 16 bits or more an id, up to 32 MB in all: past 16 million ids it lets more others through, and
    these cost a shuffle of what they stand for, once each, but change no result.
    """
    name = ids.columns[0]
    bits = 1 << min(28, max(16, (16 * ids.count()).bit_length()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros(bits, bool)
        for b in batches:
            for h in _slots(b[name].to_numpy(), bits):
                table[h] = True
        yield pa.RecordBatch.from_pydict({"t": pa.array([np.packbits(table).tobytes()], pa.binary())})

    out = np.zeros(bits // 8, np.uint8)
    for r in ids.coalesce(8).mapInArrow(run, "t binary").toLocalIterator():  # at most 8 tables
        out |= np.frombuffer(r["t"], np.uint8)
    return np.unpackbits(out).view(bool)


def _slots(ids: np.ndarray, bits: int) -> list[np.ndarray]:
    h = mix(ids.astype(np.int64).view(np.uint64))
    return [(h >> np.uint64(s)) % np.uint64(bits) for s in (0, 29)]


def described(docs: DataFrame, wanted: np.ndarray) -> DataFrame:
    """(doc_id, n, sid, tokens): every document; the set itself only if ``wanted`` may hold it, once a task."""
    bits = len(wanted)
    packed = np.packbits(wanted)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, hashes, seen = np.unpackbits(packed).view(bool), Hasher(lower=True), set()
        for b in batches:
            sets = shingle_sets(b["text"], hashes)
            sids = np.array([set_id(s) if len(s) else -1 for s in sets], np.int64)
            hit = np.logical_and.reduce([table[h] for h in _slots(sids, bits)])
            tokens = []
            for s, sid, h in zip(sets, sids.tolist(), hit.tolist(), strict=True):
                if h and len(s) and sid not in seen:
                    seen.add(sid)
                    tokens.append(s.astype("<u8").tobytes())
                else:
                    tokens.append(None)
            if len(seen) > 300_000:
                seen.clear()
            yield pa.RecordBatch.from_pydict({"doc_id": b["doc_id"], "n": pa.array([len(s) for s in sets], pa.int64()), "sid": pa.array(sids), "tokens": pa.array(tokens, pa.binary())})

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, n long, sid long, tokens binary")


class Groups:
    """Disjoint sets of numbered items."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def find(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = x = self.up[self.up[x]]
        return x

    def merge(self, x: int, y: int) -> None:
        x, y = self.find(x), self.find(y)
        self.up[max(x, y)] = min(x, y)


class SignatureTree:
    """Levels of nodes over sets, leaves first: OR-combined bitmaps, size ranges, most bit collisions."""

    FAN = 4

    def __init__(self, sets: list[np.ndarray], bits: int):
        maps = np.zeros((len(sets), bits // 64), np.uint64)
        for row, s in zip(maps, sets, strict=True):
            flags = np.zeros(bits, bool)
            flags[s & np.uint64(bits - 1)] = True
            row[:] = np.packbits(flags, bitorder="little").view(np.uint64)
        size = np.array([len(s) for s in sets], np.int64)
        lost = size - np.bitwise_count(maps).sum(1, dtype=np.int64)
        self.levels = [(maps, size, size, lost)]
        while len(self.levels[-1][0]) > 1:
            maps, low, high, lost = self.levels[-1]
            at = np.arange(0, len(maps), self.FAN)
            self.levels.append((np.bitwise_or.reduceat(maps, at), np.minimum.reduceat(low, at), np.maximum.reduceat(high, at), np.maximum.reduceat(lost, at)))

    def _level(self, level: int) -> tuple[np.ndarray, ...]:
        return self.levels[min(level, len(self.levels) - 1)]

    def _children(self, at: np.ndarray, level: int) -> np.ndarray:
        """One row of child numbers for each node, -1 where there is none; a node above the root is the root."""
        if level >= len(self.levels):
            return at[:, None]
        below = at[:, None] * self.FAN + np.arange(self.FAN)
        return np.where(below < len(self.levels[level - 1][0]), below, -1)

    def pairs(self, other: SignatureTree) -> tuple[np.ndarray, np.ndarray]:
        """Pairs of leaves that may link; both trees are walked down together, a level at a time."""
        x = y = np.zeros(1, np.int64)
        for level in range(max(len(self.levels), len(other.levels)) - 1, -1, -1):
            keep = self._possible(self._level(level), other._level(level), x, y)
            x, y = x[keep], y[keep]
            if level and len(x):
                cx, cy = self._children(x, level)[:, :, None], other._children(y, level)[:, None, :]
                both = (cx >= 0) & (cy >= 0)
                x, y = np.broadcast_to(cx, both.shape)[both], np.broadcast_to(cy, both.shape)[both]
                if self is other:
                    x, y = x[x <= y], y[x <= y]
        return x, y

    @staticmethod
    def _possible(mine: tuple, theirs: tuple, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Whether the largest overlap that bitmaps and sizes allow would do for the smallest sizes."""
        out = np.zeros(len(x), bool)
        step = max(1, (1 << 21) // mine[0].shape[1])
        for a in range(0, len(x), step):
            i, j = x[a : a + step], y[a : a + step]
            small = np.minimum(mine[2][i], theirs[2][j])
            common = np.bitwise_count(mine[0][i] & theirs[0][j]).sum(1, dtype=np.int64) + np.minimum(mine[3][i], theirs[3][j])
            most = np.minimum(small, common)
            out[a : a + step] = ((OUT_OF + NEEDED) * most >= NEEDED * (mine[1][i] + theirs[1][j])) & (OUT_OF * small >= NEEDED * np.maximum(mine[1][i], theirs[1][j]))
        return out


def _stars(sid: np.ndarray, groups: Groups) -> pa.RecordBatch:
    """(a, b): each set of a group that is not its root, and the root."""
    root = sid[[groups.find(i) for i in range(len(sid))]]
    other = root != sid
    return pa.RecordBatch.from_pydict({"a": pa.array(sid[other]), "b": pa.array(root[other])})


def tree_links(sets: list[np.ndarray], others: list[np.ndarray] | None, groups: Groups) -> list[tuple[int, int]]:
    """Links that join groups, as numbers in ``sets`` and, after them, ``others``; checked exactly."""
    every = sets + (others or [])
    usual = sorted(len(s) for s in every)[len(every) // 2]
    bits = 1 << min(16, max(8, (4 * usual).bit_length()))
    tree = SignatureTree(sets, bits)
    x, y = tree.pairs(tree if others is None else SignatureTree(others, bits))
    out = []
    for i, j in zip(x.tolist(), (y if others is None else y + len(sets)).tolist(), strict=True):
        if groups.find(i) != groups.find(j) and linked(len(np.intersect1d(every[i], every[j], assume_unique=True)), len(every[i]), len(every[j])):
            groups.merge(i, j)
            out.append((i, j))
    return out


def _runs(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pd.DataFrame]:
    """Consecutive rows with equal keys, a frame each."""
    held: list[pd.DataFrame] = []
    last = None
    for b in batches:
        frame = b.to_pandas()
        if not len(frame):
            continue
        codes = frame[keys].to_numpy()
        edges = [0, *(np.flatnonzero((codes[1:] != codes[:-1]).any(1)) + 1).tolist(), len(frame)]
        for x, y in zip(edges[:-1], edges[1:], strict=True):
            key = tuple(codes[x])
            if key != last and held:
                yield pd.concat(held)
                held = []
            last = key
            held.append(frame.iloc[x:y])
    if held:
        yield pd.concat(held)


def _sets(column: pd.Series) -> list[np.ndarray]:
    return [np.frombuffer(t, "<u8") for t in column]


def join_groups(rows: DataFrame, keys: list[str]) -> DataFrame:
    """(a, b) from each group of (keys, sid, root, side, tokens) rows.

    With side 0 only, all pairs of the group are joined: a is connected to b, its component's root. Otherwise
    the pairs of a side 0 and a side 1: a and b link. Rows with one root count as connected from the start.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for g in _runs(batches, keys):
            g = g.sort_values(["side", "tokens", "sid"])
            sid, side = g.sid.to_numpy(), g.side.to_numpy()
            sets = _sets(g.tokens)
            groups, first = Groups(len(g)), {}
            for i, (r, own) in enumerate(zip(g.root.tolist(), sid.tolist(), strict=True)):
                for name in (("root", r), ("sid", own)):
                    groups.merge(i, first.setdefault(name, i))
            cut = int((side == 0).sum())
            if cut and (both := (side == 1).any()) or cut > 1:
                links = tree_links(sets[:cut], sets[cut:] if both else None, groups)
                if not both:
                    yield _stars(sid, groups)
                elif links:
                    at = np.array(links)
                    yield pa.RecordBatch.from_pydict({"a": pa.array(sid[at[:, 0]]), "b": pa.array(sid[at[:, 1]])})

    columns = [*keys, "sid", "root", "side", "tokens"]
    return rows.select(*columns).repartition(*keys).sortWithinPartitions(*keys).mapInArrow(run, "a long, b long")


def _chunk(total: str, tokens: int) -> F.Column:
    """A chunk number by hash, so that chunks hold about ``tokens`` tokens."""
    return F.pmod(F.xxhash64("sid"), F.ceil(F.col(total) / tokens).cast("long"))


def celled(sets: DataFrame, cells: DataFrame, sizes: DataFrame, leaf: int) -> DataFrame:
    """(sid, cell, leaf, n, total, root, side, tokens) from (sid, n, tokens), (sid, cell) and (sid, n) rows."""
    total = cells.join(sizes, "sid").groupBy("cell").agg(F.sum("n").alias("total"))
    rows = sets.dropDuplicates(["sid"]).join(cells, "sid").join(total, "cell")
    return rows.select("sid", "cell", _chunk("total", leaf).alias("leaf"), "n", "total", F.col("sid").alias("root"), F.lit(0).alias("side"), "tokens")


def links(rows: DataFrame, leaf: int | None = None) -> DataFrame:
    """(node, root) of the sets that link with others, from a written table of ``celled`` rows."""
    leaf = leaf or LEAF
    stars = settle(join_groups(rows, ["cell", "leaf"]))  # in a cell of one leaf these are the components
    large = rows.where(F.col("total") > leaf).drop("root")
    if large.isEmpty():
        return stars.select(F.col("a").alias("node"), F.col("b").alias("root"))
    now = settle(large.join(stars.withColumnRenamed("a", "sid"), "sid", "left").withColumn("root", F.coalesce("b", "sid")).drop("b"))
    heads = now.where(F.col("root") == F.col("sid"))
    weight = heads.groupBy("cell").agg(F.sum("n").alias("heads"))
    heads = heads.join(weight, "cell").withColumn("leaf", _chunk("heads", leaf))
    upper = settle(join_groups(heads, ["cell", "leaf"]).withColumnRenamed("a", "root"))
    now = now.join(upper, "root", "left").withColumn("root", F.coalesce("b", "root")).drop("b")
    parts = now.groupBy("cell", "root").agg(F.sum("n").alias("n"))
    main = parts.groupBy("cell").agg(F.max_by("root", F.struct("n", "root")).alias("main"), F.sum("n").alias("all"), F.max("n").alias("most"))
    main = settle(main.where(F.col("all") > F.col("most")).withColumn("minor", F.col("all") - F.col("most")))
    names = now.select(F.col("sid").alias("node"), "root")
    if main.isEmpty():  # every large cell is one component, as cells of near copies are
        rest = stars.select(F.col("a").alias("node"), F.col("b").alias("root")).join(names.select("node"), "node", "left_anti")
        return rest.unionByName(names)
    open_ = now.join(main, "cell")
    many = F.ceil(F.col("total") / leaf).cast("long") - 1
    chunks = F.ceil(F.col("minor") / leaf).cast("long") - 1
    zero = F.lit(0).cast("long")
    left = open_.select("cell", "leaf", F.explode(F.sequence(zero, chunks)).alias("chunk"), "sid", "root", F.lit(0).alias("side"), "tokens")
    right = open_.where(F.col("root") != F.col("main"))
    right = right.select("cell", F.explode(F.sequence(zero, many)).alias("leaf"), _chunk("minor", leaf).alias("chunk"), "sid", "root", F.lit(1).alias("side"), "tokens")
    across = join_groups(left.unionByName(right), ["cell", "leaf", "chunk"])
    merged = components(names.toDF("a", "b").unionByName(across))
    rest = stars.select(F.col("a").alias("node"), F.col("b").alias("root")).join(merged.select("node"), "node", "left_anti")
    return rest.unionByName(merged)


def joined(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row."""
    small_batches(docs.sparkSession)
    heavy = frequent(docs)
    rows = settle(shared(postings(docs, heavy)))
    enough = rows.groupBy("sid").agg(F.count("*").alias("c"), F.min("n").alias("n")).where(F.col("c") > F.floor(F.floor(F.col("n") * NEEDED / OUT_OF) / SPARE))
    spark = docs.sparkSession
    release(spark)  # the postings
    edges = settle(candidates(rows.join(enough.select("sid"), "sid", "left_semi")))
    drop(rows)
    cells = settle(components(edges).select(F.col("node").alias("sid"), F.col("root").alias("cell")))
    every = settle(described(docs, bloom(cells.select("sid"))))
    release(spark)
    plain = settle(every.select("doc_id", "n", "sid"))
    sizes = every.where(F.col("tokens").isNotNull()).select("sid", "n").distinct()
    rows = settle(celled(every.where(F.col("tokens").isNotNull()).select("sid", "n", "tokens"), cells, sizes, LEAF))
    drop(every)
    release(spark)
    roots = settle(links(rows))
    drop(rows)
    known = F.col("sid") >= 0
    first = plain.where(known).groupBy("sid").agg(F.min("doc_id").alias("first"))  # copies are one row from here on
    named = settle(first.join(roots.withColumnRenamed("node", "sid"), "sid", "left").withColumn("class", F.coalesce("root", "sid")))
    least = named.groupBy("class").agg(F.min("first").alias("component_id"))
    classes = named.join(least, "class").select("sid", "component_id")
    told = plain.where(known).join(classes, "sid").select("doc_id", F.col("n").alias("n_shingles"), "component_id")
    return told.unionByName(plain.where(~known).select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id")))
