"""Operator 6: near-duplicate lines by a segment-partition edit join.

Lines (split at line feeds, outer white space aside) that are equal link, and so do lines of at least
``SHORTEST`` characters within ``EDITS`` edits of each other; linked lines form classes, and of each
class the first line in (doc_id, line) order stays. Shorter lines link with equal ones only, as two
edits turn many short lines into others. Empty lines are left alone.

1. A line is cut into EDITS + 1 even segments. If a line of length L links with one of length l >= L,
   a substring of the longer equals a segment of the shorter, at one of the few places that the
   lengths allow. Segments and substrings meet in one key space, each key's rows streaming by.
2. Keys with few lines give all their pairs. Of keys with more, lines first meet the key's leader
   only; then lines still in different classes meet if sketches that an edit changes in at most four
   bits differ in few enough. So copies of one line never form all pairs, yet no link is lost.
3. Pairs are verified by a banded bit-parallel edit distance.

Null texts have no lines. Null doc_ids come first. Rows with the same doc_id and text are one document
and get equal results. Texts keep their other lines as they are.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verdigris.llm.common import _IS_WHITE, HashIndex, Hasher, Texts, blobs, mix, settle, signed, small_batches, wide_batches
from verdigris.llm.components import components
from verdigris.llm.jaccard import _slots, bloom
from verdigris.llm.substrings import LOWEST, keyed, repeated_ids, told_apart

EDITS = 2
SHORTEST = 32
#: Keys with more lines than this are joined through their leader first.
MANY = 48
#: Bytes of lines whose substrings are hashed at once.
PORTION = 1 << 17


def line_id(line: str) -> int:
    return xxhash.xxh3_64_intdigest(line.encode()) >> 2


def eligible(text: bytes) -> Iterator[tuple[int, str]]:
    """(number, line) of the lines that take part."""
    for i, line in enumerate(text.decode().split("\n")):
        line = line.strip(" \t\r\v\f")
        if line:
            yield i, line


class Lines:
    """The lines that take part of a batch of texts: bytes from ``starts`` to ``stops``, numbers of their texts and within these, ids."""

    def __init__(self, column: pa.Array):
        texts = Texts(column)
        data = self.data = texts.data
        feeds = np.flatnonzero(data == 10)
        many = np.diff(np.searchsorted(feeds, texts.ends)) + 1
        text = np.repeat(np.arange(len(many)), many)
        number = np.arange(len(text)) - np.repeat(np.cumsum(many) - many, many)
        last = number == many[text] - 1
        stops = np.empty(len(text), np.int64)
        stops[last], stops[~last] = texts.ends[1:], feeds
        starts = np.concatenate([[0], stops + 1])[:-1]
        starts[number == 0] = texts.ends[:-1]
        some = np.flatnonzero(starts < stops)
        starts, stops, self.text, self.number = starts[some], stops[some], text[some], number[some]
        if len(some) and (_IS_WHITE[data[starts]] | _IS_WHITE[data[stops - 1]]).any():
            solid = np.flatnonzero(~_IS_WHITE[data])
            first, after = np.searchsorted(solid, starts), np.searchsorted(solid, stops)
            some = np.flatnonzero(first < after)
            starts, stops, self.text, self.number = solid[first[some]], solid[after[some] - 1] + 1, self.text[some], self.number[some]
        self.starts, self.stops = starts, stops
        self.raw = data.tobytes()
        name = xxhash.xxh3_64_intdigest
        self.ids = np.array([name(self.raw[x:y]) for x, y in zip(starts.tolist(), stops.tolist(), strict=True)], np.uint64) >> np.uint64(2)
        self.ids = self.ids.view(np.int64)
        # where characters begin; a line's are those from ``first`` on
        self.characters = np.append(np.flatnonzero((data & 0xC0) != 0x80), len(data))
        self.first = np.searchsorted(self.characters, starts)
        self.size = np.searchsorted(self.characters, stops) - self.first

    def blobs(self, some: np.ndarray) -> list[bytes]:
        return [self.raw[x:y] for x, y in zip(self.starts[some].tolist(), self.stops[some].tolist(), strict=True)]


def segments(length: int, edits: int = EDITS) -> list[tuple[int, int]]:
    """(start, length) of the even segments of a line of that length; later ones take the remainder."""
    parts = edits + 1
    short, longer = divmod(length, parts)
    sizes = [short] * (parts - longer) + [short + 1] * longer
    return [(sum(sizes[:i]), sizes[i]) for i in range(parts)]


@lru_cache(1 << 14)
def _places(n: int, edits: int = EDITS) -> np.ndarray:
    """(start, end, seed, whether a substring) of the segments of a line of n characters, and of its substrings that may equal a segment of a line no longer than it."""
    out = []
    for shorter in range(max(0, n - edits), n + 1):
        gap = n - shorter
        for i, (start, size) in enumerate(segments(shorter, edits)):
            low = max(0, start - i, start + gap - (edits - i))
            high = min(n - size, start + i, start + gap + (edits - i))
            for at in range(low, high + 1):
                out.append((at, at + size, shorter * 16 + i, int(gap > 0 or at != start)))
    return np.array(out, np.int64).reshape(-1, 4)


def keys(lines: Lines, some: np.ndarray, hashes: Hasher) -> tuple[np.ndarray, np.ndarray]:
    """Keys of the segments and substrings of ``some`` lines, and tags: twice the line's id, plus one for a substring."""
    sizes, which = np.unique(lines.size[some], return_inverse=True)
    tables = [_places(n) for n in sizes.tolist()]
    many = np.array([len(t) for t in tables], np.int64)
    own = many[which]
    row = np.repeat((np.cumsum(many) - many)[which] - (np.cumsum(own) - own), own) + np.arange(int(own.sum()))
    start, end, seed, part = np.concatenate(tables)[row].T
    line = np.repeat(some, own)
    at = lines.first[line]
    x, y = lines.characters[at + start], lines.characters[at + end]
    out = np.empty(len(x), np.uint64)
    stop = np.cumsum(own)
    a = 0
    while a < len(some):  # lines of about ``PORTION`` bytes at a time
        base = int(lines.starts[some[a]])
        b = max(a + 1, int(np.searchsorted(lines.stops[some], base + PORTION, "right")))
        low, high = int(stop[a] - own[a]), int(stop[b - 1])
        out[low:high] = hashes.anywhere(lines.data[base : int(lines.stops[some[b - 1]])], x[low:high] - base, y[low:high] - base)
        a = b
    return mix(out ^ mix(seed.astype(np.uint64))), 2 * lines.ids[line] + part


def within(a: str, b: str, edits: int = EDITS) -> bool:
    """Whether two strings are at most ``edits`` apart, by bit vectors over the band of diagonals that matter."""
    if abs(len(a) - len(b)) > edits:
        return False
    low, high = 0, min(len(a), len(b))
    while low < high and a[low] == b[low]:
        low += 1
    a, b = a[low:], b[low:]
    cut = 0
    while cut < min(len(a), len(b)) and a[-1 - cut] == b[-1 - cut]:
        cut += 1
    a, b = a[: len(a) - cut], b[: len(b) - cut]
    if len(a) < len(b):
        a, b = b, a
    if len(a) <= edits or not b:
        return len(a) <= edits
    width = 2 * edits + 1
    every, bottom = (1 << width) - 1, 1 << (width - 1)
    up, down, score = every & ~((1 << edits) - 1), 0, edits
    last = bottom
    for j, c in enumerate(b):
        same = 0
        for t in range(width):
            i = j + t - edits
            if 0 <= i < len(a) and a[i] == c:
                same |= 1 << t
        diagonal = ((((same & up) + up) ^ up) | same | down) & every
        right = down | (every & ~(diagonal | up))
        left = diagonal & up
        if j < len(a) - edits:
            score += not diagonal & bottom
        else:
            last >>= 1
            score += bool(right & last) - bool(left & last)
        up = left | (every & ~((diagonal >> 1) | right))
        down = (diagonal >> 1) & right
        if score > edits + width:
            return False
    return score <= edits


def sketch(line: str) -> int:
    """64 parities of character pairs: an edit touches three pairs at most on either side, so four bits at most change."""
    codes = np.frombuffer(line.encode("utf-32-le"), np.uint32).astype(np.uint64)
    pairs = (codes[:-1] * np.uint64(0x9E3779B97F4A7C15) + codes[1:] * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(58)
    odd = np.bincount(pairs.astype(np.int64), minlength=64) & 1
    return int(np.packbits(odd.astype(np.uint8), bitorder="little").view(np.int64)[0])


def occurrences(rows: DataFrame) -> DataFrame:
    """(lid, k, r, ln) of every line that takes part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = Lines(b["text"])
            at = pa.array(found.text)
            yield pa.RecordBatch.from_pydict({"lid": pa.array(found.ids), "k": b["k"].take(at), "r": b["r"].take(at), "ln": pa.array(found.number.astype(np.int32))})

    return rows.mapInArrow(run, "lid long, k long, r long, ln int")


def _distinct_lines(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[Lines, np.ndarray]]:
    """The lines of a batch at a time, and which are long enough for the edit join and not met before in the task."""
    seen = HashIndex()
    for b in batches:
        if seen.many > 300_000:
            seen = HashIndex()
        lines = Lines(b["text"])
        long = np.flatnonzero(lines.size >= SHORTEST)
        names, first = np.unique(lines.ids[long].view(np.uint64), return_index=True)
        new = seen.find(names) < 0
        seen.add(names[new], np.zeros(int(new.sum()), np.int32))
        yield lines, long[np.sort(first[new])]


def postings(rows: DataFrame) -> DataFrame:
    """(key, tag): tag is twice the line's id, plus one for a substring."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = Hasher()
        for lines, some in _distinct_lines(batches):
            if len(some):
                key, tag = keys(lines, some, hashes)
                yield pa.RecordBatch.from_pydict({"key": signed(key), "tag": pa.array(tag)})

    return rows.select("text").mapInArrow(run, "key long, tag long")


def meetings(rows: DataFrame) -> DataFrame:
    """(key, a, b): pairs of lines to verify; for keys with many lines the pairs with the leader, and (key, a, null) for each line."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key0, held = None, []  # the last key and its tags so far
        many = False
        for b in batches:
            if not b.num_rows:
                continue
            key, tag = b["key"].to_numpy(), b["tag"].to_numpy()
            out: list[tuple[int, int, int | None]] = []
            edge = np.flatnonzero(key[1:] != key[:-1]) + 1
            starts, ends = np.concatenate([[0], edge]), np.concatenate([edge, [len(key)]])
            # groups of one row that neither continue nor may go on are most, and give nothing
            real = (ends - starts > 1) | (starts == 0) | (ends == len(key))
            for x, y in zip(starts[real].tolist(), ends[real].tolist(), strict=True):
                if key[x] != key0:
                    _close(key0, held, many, out)
                    key0, held, many = int(key[x]), [], False
                held += tag[x:y].tolist()
                if len(held) > MANY and (many or len({t >> 1 for t in held}) > MANY):
                    _flush(key0, held, many, out)
                    held, many = held[:1], True
                if y < len(key):
                    _close(key0, held, many, out)
                    key0, held, many = None, [], False
            if out:
                yield _batch(out)
        out = []
        _close(key0, held, many, out)
        if out:
            yield _batch(out)

    dealt = rows.repartition("key").sortWithinPartitions("key", "tag")
    return dealt.mapInArrow(run, "key long, a long, b long")


def _batch(out: list) -> pa.RecordBatch:
    key, a, b = zip(*out, strict=True)
    return pa.RecordBatch.from_pydict({"key": pa.array(key, pa.int64()), "a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})


def _close(key: int | None, tags: list[int], many: bool, out: list) -> None:
    """Pairs of a key whose rows have all been seen."""
    if many:
        _flush(key, tags, True, out)
    elif len(tags) > 1:
        own = {t >> 1 for t in tags if not t & 1}
        lines = sorted({t >> 1 for t in tags})
        out += [(key, x, y) for x, y in combinations(lines, 2) if x in own or y in own]


def _flush(key: int, tags: list[int], begun: bool, out: list) -> None:
    """Rows of a key with many lines: each line, and its pair with the leader, the first line of all."""
    lines = sorted({t >> 1 for t in tags})
    leader = tags[0] >> 1
    out += [(key, x, None) for x in lines if not begun or x != leader]
    out += [(key, leader, x) for x in lines if x != leader]


def fetched(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """(lid, line) of the lines whose ids the first column of ``ids`` holds, and perhaps of some others."""
    table = np.packbits(bloom(ids))

    def texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.unpackbits(table).view(bool)
        for lines, some in _distinct_lines(batches):
            own = lines.ids[some]
            some = some[np.logical_and.reduce([bits[h] for h in _slots(own, len(bits))])]
            yield pa.RecordBatch.from_pydict({"lid": pa.array(lines.ids[some]), "line": pa.array(lines.blobs(some), pa.binary()).cast(pa.string())})

    return settle(rows.select("text").mapInArrow(texts, "lid long, line string").dropDuplicates(["lid"]))


def verified(lines: DataFrame, pairs: DataFrame) -> DataFrame:
    """The (a, b) of ``pairs`` that link, by the texts in ``lines``."""

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            good = [within(x, y) for x, y in zip(b["la"].to_pylist(), b["lb"].to_pylist(), strict=True)]
            yield b.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

    both = pairs.join(lines.select(F.col("lid").alias("a"), F.col("line").alias("la")), "a").join(lines.select(F.col("lid").alias("b"), F.col("line").alias("lb")), "b")
    return settle(both.select("a", "b", "la", "lb").mapInArrow(check, "a long, b long"))


def _crossings(rows: DataFrame) -> DataFrame:
    """(a, b): lines of one key (key, a, root, sketch) in different classes whose sketches allow a link."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, block = None, []
        for b in batches:
            frame = b.to_pandas()
            for k, own in frame.groupby("key", sort=False):
                if k != key:
                    key, block = k, []
                a, root, bits = own.a.to_numpy(), own.root.to_numpy(), own.sketch.to_numpy().view(np.uint64)  # counts of negative numbers differ
                block.append((a, root, bits))
                for a2, root2, bits2 in block:
                    for x in range(0, len(a), 256):
                        near = (np.bitwise_count(bits[x : x + 256, None] ^ bits2[None]) <= 4 * EDITS) & (root[x : x + 256, None] != root2[None])
                        i, j = np.nonzero(near)
                        if len(i):
                            yield pa.RecordBatch.from_pydict({"a": pa.array(a[x + i]), "b": pa.array(a2[j])})

    return rows.repartition("key").sortWithinPartitions("key", "a").mapInArrow(run, "a long, b long")


def classes(rows: DataFrame) -> DataFrame:
    """(lid, root) of the lines that link with others, from (k, r, text) rows."""
    with wide_batches(rows.sparkSession):
        met = settle(meetings(postings(rows)))
    pairs = settle(met.where(F.col("b").isNotNull()).select("a", "b").distinct())
    lines = fetched(rows, pairs.select("a").unionByName(pairs.select(F.col("b").alias("a"))))
    roots = components(verified(lines, pairs)).withColumnRenamed("node", "lid")
    crowds = met.where(F.col("b").isNull()).select("key", F.col("a").alias("lid")).distinct()
    if crowds.isEmpty():
        return roots

    def sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            drawn = pa.array([sketch(s) for s in b["line"].to_pylist()], pa.int64())
            yield pa.RecordBatch.from_pydict({"lid": b["lid"], "sketch": drawn})

    drawn = lines.join(crowds.select("lid").distinct(), "lid", "left_semi").mapInArrow(sketches, "lid long, sketch long")
    open_ = crowds.join(roots, "lid", "left").withColumn("root", F.coalesce("root", "lid")).join(drawn, "lid")
    crossing = settle(_crossings(open_.select("key", F.col("lid").alias("a"), "root", "sketch")).distinct())
    if crossing.isEmpty():
        return roots
    more = verified(lines, crossing)
    return components(roots.toDF("a", "b").unionByName(more)).withColumnRenamed("node", "lid")


def repeated(docs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The keyed rows, the doc_ids of several rows, and (k, r, gone) with the numbers of the lines that an earlier line of their class makes repeats."""
    small_batches(docs.sparkSession)
    ids = repeated_ids(docs)
    rows = keyed(docs, ids)
    every = occurrences(rows)
    named = every.join(classes(rows), "lid", "left").select(F.coalesce("root", "lid").alias("class"), "k", "r", "ln")
    firsts = named.groupBy("class").agg(F.count("*").alias("c"), F.min(F.struct("k", "r", "ln")).alias("first")).where(F.col("c") > 1)
    again = named.join(firsts, "class").where(F.struct("k", "r", "ln") != F.col("first"))
    return rows, ids, again.groupBy("k", "r").agg(F.collect_list("ln").alias("gone"))  # a document's own, so bounded by its length


def _without(text: bytes, gone: list[int] | None) -> tuple[list[bytes], int]:
    """The kept lines, and how many there were."""
    lines = text.split(b"\n") if text else []
    if not gone:
        return lines, len(lines)
    out = set(gone)
    return [x for i, x in enumerate(lines) if i not in out], len(lines)


def report(docs: DataFrame) -> DataFrame:
    """(doc_id, n_lines, n_removed, kept_sha256) of every row; the kept lines joined by line feeds, UTF-8."""
    rows, _, gone = repeated(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            kept = [_without(t, g) for t, g in zip(blobs(b["text"]), b["gone"].to_pylist(), strict=True)]
            yield pa.RecordBatch.from_pydict({"doc_id": b["doc_id"], "n_lines": pa.array([n for _, n in kept], pa.int64()), "n_removed": pa.array([n - len(x) for x, n in kept], pa.int64()), "kept_sha256": pa.array([hashlib.sha256(b"\n".join(x)).hexdigest() for x, _ in kept], pa.string())})

    joined = rows.join(gone, ["k", "r"], "left").select(F.nullif("k", F.lit(LOWEST)).alias("doc_id"), "text", "gone")
    return joined.mapInArrow(run, "doc_id long, n_lines long, n_removed long, kept_sha256 string")


def deduped(docs: DataFrame) -> DataFrame:
    """``docs`` with repeated lines taken out of ``text``; rows left without any text go, rows that had none stay."""
    _, ids, gone = repeated(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cut = [None if g is None else b"\n".join(_without(t, g)[0]).decode() for t, g in zip(blobs(b["_t"]), b["_gone"].to_pylist(), strict=True)]
            old = b["_t"].to_pylist()
            text = pa.array([o if c is None else c for o, c in zip(old, cut, strict=True)], pa.string())
            keep = pa.array([c is None or bool(c.strip()) for c in cut], pa.bool_())
            yield pa.RecordBatch.from_arrays([*(b[c] for c in rest), text], names=[*rest, "_t"]).filter(keep)

    rest = [f"c{i}" for i, c in enumerate(docs.columns) if c != "text"]
    names = [c for c in docs.columns if c != "text"]
    plain = docs.select(*[F.col(f"`{c}`").alias(r) for c, r in zip(names, rest, strict=True)], F.col("text").cast("string").alias("_t"), F.coalesce(F.col("doc_id").cast("long"), F.lit(LOWEST)).alias("_k"))
    plain = told_apart(plain, ids, "_k", "_t", "_r")
    joined = plain.join(gone.select(F.col("k").alias("_k"), F.col("r").alias("_r"), F.col("gone").alias("_gone")), ["_k", "_r"], "left").select(*rest, "_t", "_gone")
    out = joined.mapInArrow(run, joined.drop("_gone").schema)
    back = dict(zip(names, rest, strict=True))
    return out.select(*[F.col("_t").alias(c) if c == "text" else F.length("_t").cast("long").alias(c) if c == "n_chars" else F.col(back[c]).alias(c) for c in docs.columns])
