"""Operator 10: substring dedup by groups of word suffixes with a common sparse prefix. This is not a suffix tree.

Only repeats of at least ``width`` words matter, so suffixes are taken that long. A suffix's group is the
smallest fingerprint among the runs of ``width // 2`` words within its first ``width`` words, so equal
suffixes share a group. Groups with a single place cannot hold a repeat and are dropped before any suffix
is sent. The others' suffixes are dealt out by group and fingerprint and sorted, so that equal ones are
neighbours in the order of document and start: every one but the first repeats something earlier. Ranges
of that order spill to disk instead of having to fit in memory, so no group is too large. Two words' runs
are taken as equal when two independent 64-bit fingerprints agree.

Null texts have no words. Null doc_ids come before all others. Rows with the same doc_id and
the same text are one document and get equal results; rows with the same doc_id and different
texts are told apart and ordered by a 64-bit hash of the text.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verdigris.llm.common import Hasher, Words, blobs, ngram_hashes, release, settle, signed, small_batches

WIDTH = 20
LOWEST = -(2**63)


#: Rows of a table that is broadcast, counted first.
FEW = 100_000


def repeated_ids(docs: DataFrame) -> DataFrame:
    """(k): the doc_ids, null as the lowest number, that several rows have; a hint to broadcast if they are few."""
    k = F.coalesce(F.col("doc_id").cast("long"), F.lit(LOWEST)).alias("k")
    found = settle(docs.groupBy(k).agg(F.count("*").alias("n")).where(F.col("n") > 1).select("k"))
    return F.broadcast(found) if found.count() <= FEW else found


def told_apart(rows: DataFrame, repeated: DataFrame, k: str, text: str, r: str) -> DataFrame:
    """``rows`` with a column ``r`` that tells texts with one doc_id apart: 64 bits of the text, 0 where the doc_id is one row's."""
    again = repeated.select(F.col("k").alias(k), F.lit(True).alias("_again"))
    return rows.join(again, k, "left").withColumn(r, F.when(F.col("_again"), F.xxhash64(F.coalesce(F.col(text), F.lit("")))).otherwise(F.lit(0).cast("long"))).drop("_again")


def keyed(docs: DataFrame, repeated: DataFrame | None = None) -> DataFrame:
    """(k, r, text): k orders documents, r tells texts with one doc_id apart."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(LOWEST)).alias("k"), text.alias("text"))
    return told_apart(rows, repeated_ids(docs) if repeated is None else repeated, "k", "text", "r").select("k", "r", "text")


def _anchored(words: np.ndarray, ends: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """All windows of ``width`` words within a text: (start, its anchor's place, anchor fingerprints by place, text number)."""
    part = width // 2
    runs = ngram_hashes(words, part)
    last = ends[1:] - width
    many = np.maximum(last - ends[:-1] + 1, 0)
    text = np.repeat(np.arange(len(many)), many)
    start = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many) + ends[:-1][text]
    place = start.copy()
    best = runs[start]
    for o in range(1, width - part + 1):
        here = runs[start + o]
        less = here < best
        best = np.where(less, here, best)
        place[less] = start[less] + o
    return start, place, runs, text


def anchors(rows: DataFrame, width: int = WIDTH) -> DataFrame:
    """(h, k, r): the group nodes of every document, a row for each place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = Hasher()
        for b in batches:
            words = Words(b["text"])
            start, place, runs, text = _anchored(hashes(words.data, words.starts, words.stops), words.ends, width)
            if not len(start):
                continue
            new = np.ones(len(place), bool)
            new[1:] = place[1:] != place[:-1]
            at, text = place[new], pa.array(text[new])
            yield pa.RecordBatch.from_pydict({"h": signed(runs[at]), "k": b["k"].take(text), "r": b["r"].take(text)})

    return rows.mapInArrow(run, "h long, k long, r long")


def shared(nodes: DataFrame) -> DataFrame:
    """The rows of ``anchors`` whose node has several leaves."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.RecordBatch | None = None  # the last row
        paired = False  # it has been sent
        for b in batches:
            if not b.num_rows:
                continue
            if held is not None:
                b = pa.Table.from_batches([held, b]).combine_chunks().to_batches()[0]
            h = b["h"].to_numpy()
            same = h[1:] == h[:-1]
            several = np.zeros(len(h), bool)
            several[1:] |= same
            several[:-1] |= same
            if held is not None and paired:
                several[h == h[0]] = True
                several[0] = False  # sent before
            paired = bool(several[-1]) or (held is not None and len(h) == 1 and paired)
            yield b.filter(pa.array(several))
            held = b.slice(len(h) - 1)

    return nodes.repartition("h").sortWithinPartitions("h").mapInArrow(run, nodes.schema)


def suffixes(rows: DataFrame, groups: DataFrame, width: int = WIDTH) -> DataFrame:
    """(a, w, k, r, s): fingerprints and places of the suffixes in ``groups`` (h, k, r)."""
    lists = groups.groupBy("k", "r").agg(F.collect_set("h").alias("hs"))  # a document's own, so bounded by its length
    both = rows.join(lists, ["k", "r"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, others = Hasher(), Hasher(seed=1)
        for b in batches:
            words = Words(b["text"])
            ends = words.ends
            start, place, runs, text = _anchored(hashes(words.data, words.starts, words.stops), ends, width)
            wanted = [np.array(x, np.int64).view(np.uint64) for x in b["hs"].to_pylist()]
            anchor = runs[place]
            edge = np.searchsorted(text, np.arange(len(wanted) + 1))
            keep = np.concatenate([np.isin(anchor[x:y], own) for x, y, own in zip(edge[:-1], edge[1:], wanted, strict=True)]) if wanted else np.zeros(0, bool)
            if not keep.any():
                continue
            whole = ngram_hashes(others(words.data, words.starts, words.stops), width)
            at, text = start[keep], text[keep]
            own = pa.array(text)
            yield pa.RecordBatch.from_pydict({"a": signed(anchor[keep]), "w": signed(whole[at]), "k": b["k"].take(own), "r": b["r"].take(own), "s": pa.array((at - ends[text]).astype(np.int32))})

    return both.select("k", "r", "text", "hs").mapInArrow(run, "a long, w long, k long, r long, s int")


def later(leaves: DataFrame) -> DataFrame:
    """(k, r, s): every leaf of a deep node but the first in document order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first: tuple | None = None
        for b in batches:
            if not b.num_rows:
                continue
            cols = [b[c].to_numpy() for c in ("a", "w", "k", "r", "s")]
            if first is not None:
                cols = [np.concatenate([[f], c]) for f, c in zip(first, cols, strict=True)]
            a, w, k, r, s = cols
            new = np.ones(len(a), bool)
            new[1:] = (a[1:] != a[:-1]) | (w[1:] != w[:-1])
            head = np.maximum.accumulate(np.where(new, np.arange(len(a)), 0))
            again = (k != k[head]) | (r != r[head]) | (s != s[head])
            first = tuple(c[head[-1]] for c in cols)
            yield pa.RecordBatch.from_pydict({"k": pa.array(k[again], pa.int64()), "r": pa.array(r[again], pa.int64()), "s": pa.array(s[again], pa.int32())})

    dealt = leaves.repartition("a", "w").sortWithinPartitions("a", "w", "k", "r", "s")
    return dealt.mapInArrow(run, "k long, r long, s int")


def repeats(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """(doc_id, text, starts): every row with the starts of its windows whose words also start earlier (null: none)."""
    small_batches(docs.sparkSession)
    rows = keyed(docs)
    groups = settle(shared(anchors(rows, width)))
    release(docs.sparkSession)  # the shuffled anchors, most of which are gone
    found = later(suffixes(rows, groups, width))
    starts = found.groupBy("k", "r").agg(F.collect_list("s").alias("starts"))  # a document's own, so bounded by its length
    return rows.join(starts, ["k", "r"], "left").select(F.nullif("k", F.lit(LOWEST)).alias("doc_id"), "text", "starts")


def _covered(size: int, starts: list[int] | None, width: int) -> np.ndarray:
    change = np.zeros(size + 1, np.int64)
    if starts:
        at = np.unique(starts)
        change[at] += 1
        change[at + width] -= 1
    return np.cumsum(change)[:size] > 0


def removed(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256, spans): spans are the removed stretches as first word and length."""
    shape = "doc_id long, n_words long, n_removed long, kept_sha256 string, spans array<struct<first:int,words:int>>"
    span = pa.list_(pa.struct([("first", pa.int32()), ("words", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, gone, sha, spans = [], [], [], []
            for text, starts in zip(blobs(b["text"]), b["starts"].to_pylist(), strict=True):
                words = text.split()
                out = _covered(len(words), starts, width)
                kept = [w for w, x in zip(words, out.tolist(), strict=True) if not x] if out.any() else words
                n.append(len(words))
                gone.append(len(words) - len(kept))
                sha.append(hashlib.sha256(b" ".join(kept)).hexdigest())
                edge = np.flatnonzero(np.diff(np.concatenate([[0], out.view(np.int8), [0]])))
                spans.append([{"first": int(x), "words": int(y - x)} for x, y in zip(edge[::2], edge[1::2], strict=True)])
            yield pa.RecordBatch.from_pydict({"doc_id": b["doc_id"], "n_words": pa.array(n, pa.int64()), "n_removed": pa.array(gone, pa.int64()), "kept_sha256": pa.array(sha, pa.string()), "spans": pa.array(spans, span)})

    return repeats(docs, width).mapInArrow(run, shape)
