"""Operator 12: alignment of two tokenizers' tokens over the same bytes.

Tokenizer A (byte-level BPE) encodes a space and the text, tokenizer B (SentencePiece) the text, to which
it adds the space itself. Both give intervals of the same bytes. Each Arrow partition hands its texts, some
``CHUNK`` bytes at a time, to DuckDB as two interval tables: an ASOF join finds the B token under each A
token's first byte, a range join those that begin inside an A token, which together are all overlaps, and
window sums over the shared starts number the groups. About ``BLOCK`` bytes of texts share a list of their
distinct id pairs with their counts; Spark adds up these partial counts, marks each B id's most frequent
pairs, and hands the totals back to the block, where they are summed over every document's links. Nothing
is gathered beyond a block, whose size is bounded but for a single longer text.

Texts that are null or empty, or whose tokens of A or B do not spell the space and the text (B takes U+2581
for a space), have no tokens: zeros and an empty string. Special tokens' strings are plain text. Every row
counts, be its doc_id null or repeated or the whole row repeated; an empty table gives an empty one.
"""

from __future__ import annotations

import hashlib
import struct
from array import array
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from verdigris.llm.bpe import Coder
from verdigris.llm.common import Hasher, Texts, settle, small_batches
from verdigris.llm.tokenfile import _Stretches

CHUNK = 2 << 20
BLOCK = 8 << 20
#: Stretches that an encoder keeps, and ids.
KEPT, POOL = 400_000, 8 << 20


class Pieces:
    """Texts to ids by the SentencePiece library, which sees each distinct stretch once.

    A stretch begins at a space that follows another character: no piece holds a space after another
    character (checked), so no merge crosses that place.
    """

    def __init__(self, model: str):
        import sentencepiece

        self.sp = sp = sentencepiece.SentencePieceProcessor(model_file=model)
        names = [sp.id_to_piece(i) for i in range(sp.get_piece_size())]
        plain = [not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i)) for i in range(len(names))]
        if any(p and "▁" in n.lstrip("▁") for n, p in zip(names, plain, strict=True)):
            raise ValueError("a piece holds a space after another character")
        spelled = [n.replace("▁", " ").encode() if p else bytes([int(n[3:5], 16)]) if sp.is_byte(i) else b"" for i, (n, p) in enumerate(zip(names, plain, strict=True))]
        self.size_of = np.array([len(x) for x in spelled], np.int64)
        self.spelling = np.frombuffer(b"".join(spelled), np.uint8)
        self.spelling_at = np.cumsum(self.size_of) - self.size_of
        self.lead = len(sp.encode("\n"))  # a line feed before a stretch takes the space that the library adds
        self.stretches, self.hashes = _Stretches(self._learn, KEPT), Hasher()

    def _learn(self, stretches: list[bytes]) -> np.ndarray:
        found = self.sp.encode(["\n" + s.decode() for s in stretches], num_threads=1)
        return self.stretches.add([array("I", x[self.lead :]).tobytes() for x in found])

    def flat(self, texts: Texts) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, which begin with the space that the library would add, in a row, and where each text's begin and the last one's end."""
        if self.stretches.used > POOL:
            self.stretches.halve()
        data, ends = texts.data, texts.ends
        head = np.zeros(len(data) + 1, bool)
        head[1:-1] = (data[1:] == 32) & (data[:-1] != 32)
        head[ends[:-1]] = True
        starts = np.flatnonzero(head[:-1])
        stops = np.append(starts[1:], len(data))
        at = self.stretches(data, starts, stops, self.hashes(data, starts, stops))
        at = self.stretches.rows[at]
        many = at[:, 1].astype(np.int64)
        total = np.cumsum(many)
        ids = self.stretches.ids[np.repeat(at[:, 0] - total + many, many) + np.arange(int(total[-1]))]
        return ids, np.concatenate([[0], total])[np.searchsorted(starts, ends)]

    spell = Coder.spell


_BOTH: dict[tuple[str, str], tuple[Coder, Pieces]] = {}


def both(a: str, b: str) -> tuple[Coder, Pieces]:
    """One pair for each Python worker."""
    if (a, b) not in _BOTH:
        _BOTH[a, b] = Coder(a, plain=True), Pieces(b)
    return _BOTH[a, b]


def intervals(texts: list[str | None], a: Coder, b: Pieces) -> tuple[np.ndarray, pa.Table, pa.Table]:
    """Which texts have tokens, and the two tables (k, doc, id, lo, hi) of those tokens' byte intervals, the texts one after the other."""
    ok = np.array([bool(t) for t in texts], bool)
    while True:
        where = np.flatnonzero(ok)
        column = pa.array([" " + texts[i] for i in where], pa.large_string())
        spaced = Texts(column)
        if not len(where):
            none = pa.table({c: pa.array([], pa.int32()) for c in ("k", "doc", "id", "lo", "hi")})
            return ok, none, none
        out, bad = [], set()
        for code, (ids, ends) in ((a, a.encode(column)), (b, b.flat(spaced))):
            sizes = code.size_of[ids]
            hi = np.cumsum(sizes)
            at = np.concatenate([[0], hi])[ends]
            spelled = code.spell(ids)
            if not (np.array_equal(at, spaced.ends) and np.array_equal(spelled, spaced.data)):
                raw, want = spelled.tobytes(), spaced.data.tobytes()
                bad |= {i for i in range(len(where)) if raw[at[i] : at[i + 1]] != want[spaced.ends[i] : spaced.ends[i + 1]]}
            doc = np.repeat(where, np.diff(ends))
            out.append(pa.table({"k": np.arange(len(ids), dtype=np.int32), "doc": doc.astype(np.int32), "id": ids.astype(np.int32), "lo": (hi - sizes).astype(np.int32), "hi": hi.astype(np.int32)}))
        if not bad:
            return ok, *out
        ok[where[sorted(bad)]] = False


#: A tokens with the B token under their first byte; B tokens that begin inside an A token.
UNDER = "SELECT a.doc, a.k, a.id, b.id AS other, a.lo, (a.lo = b.lo)::INT AS shared FROM a ASOF JOIN b ON a.lo >= b.lo"
INSIDE = "SELECT a.doc, b.k, a.id, b.id AS other FROM (SELECT * FROM a WHERE hi - lo > 1) a JOIN (SELECT * FROM b ANTI JOIN (SELECT lo FROM under WHERE shared = 1) USING (lo)) b ON b.lo > a.lo AND b.lo < a.hi"
COUNTS = """
SELECT doc, pair, COUNT(*)::INT AS n FROM (SELECT doc, other::BIGINT << 32 | id AS pair FROM under UNION ALL SELECT doc, other::BIGINT << 32 | id FROM inside) GROUP BY doc, pair"""
#: The group of each token, by the shared starts so far.
GROUPS = {
    "a": "SELECT k, SUM(shared) OVER (ORDER BY k ROWS UNBOUNDED PRECEDING)::INT AS grp FROM under",
    "b": "SELECT k, SUM((i.k IS NULL)::INT) OVER (ORDER BY k ROWS UNBOUNDED PRECEDING)::INT AS grp FROM b LEFT JOIN inside i USING (k)",
}


class Aligner:
    """DuckDB and the two encoders of a task."""

    def __init__(self, a: str, b: str):
        import duckdb

        self.a, self.b = both(a, b)
        self.duck = duckdb.connect(config={"threads": 1, "memory_limit": "600MB", "temp_directory": ""})
        size = max(len(self.a.size_of), len(self.b.size_of))
        self.words = np.array([sep + str(i) for sep in ("", ";", "|", ",") for i in range(size)], object)
        self.size = size

    def chunk(self, texts: list[str | None]) -> tuple[dict[str, np.ndarray], list[str], tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Counts of every text, its groups' digest, and its distinct links as (text, pair, count) in the order of texts and pairs."""
        ok, a, b = intervals(texts, self.a, self.b)
        n = len(texts)
        counts = {"n_a": np.bincount(a["doc"].to_numpy(), minlength=n), "n_b": np.bincount(b["doc"].to_numpy(), minlength=n)}
        if not ok.any():
            return counts | {"n_groups": np.zeros(n, np.int64), "n_links": np.zeros(n, np.int64)}, [""] * n, (np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int32))
        for name, rows in (("a", a), ("b", b)):
            self.duck.register("_in", rows)
            self.duck.execute(f"CREATE OR REPLACE TEMP TABLE {name} AS SELECT * FROM _in")
            self.duck.unregister("_in")
        self.duck.execute(f"CREATE OR REPLACE TEMP TABLE under AS {UNDER}")
        self.duck.execute(f"CREATE OR REPLACE TEMP TABLE inside AS {INSIDE}")
        links = self.duck.execute(COUNTS).fetchnumpy()
        order = np.lexsort((links["pair"], links["doc"]))
        doc, pair, many = (np.asarray(links[c])[order] for c in ("doc", "pair", "n"))
        grp = []
        for name, rows in (("a", a), ("b", b)):
            found = self.duck.execute(GROUPS[name]).fetchnumpy()
            grp.append(np.zeros(len(rows), np.int32))
            grp[-1][found["k"]] = found["grp"]
        grp = np.concatenate(grp)
        order = np.argsort(grp, kind="stable")  # two ascending runs are merged; of one group A's tokens come first
        told = {"doc": np.concatenate([a["doc"].to_numpy(), b["doc"].to_numpy()])[order], "id": np.concatenate([a["id"].to_numpy(), b["id"].to_numpy()])[order], "grp": grp[order], "side": order >= len(a)}
        fresh = np.ones(len(told["doc"]), bool)
        fresh[1:] = told["grp"][1:] != told["grp"][:-1]
        turn = np.zeros(len(fresh), bool)
        turn[1:] = told["side"][1:] != told["side"][:-1]
        ends = np.searchsorted(told["doc"], np.arange(n + 1))
        mark = np.where(fresh, 1, np.where(turn, 2, 3))
        mark[ends[:-1][ends[:-1] < ends[1:]]] = 0
        spelled = self.words[mark * self.size + told["id"]].tolist()
        digests = [hashlib.sha256("".join(spelled[x:y]).encode()).hexdigest() if y > x else "" for x, y in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
        counts |= {"n_groups": np.bincount(told["doc"][fresh], minlength=n), "n_links": np.bincount(doc, many, n).astype(np.int64)}
        return counts, digests, (doc, pair, many)


def _packed(squeeze, number: np.ndarray, many: np.ndarray) -> bytes:
    """A document's links: numbers of pairs, ascending, as differences, and how often each occurs; bytes of one weight stand together."""
    gaps = np.diff(number, prepend=0).astype("<u4")
    return squeeze.compress(struct.pack("<I", len(gaps)) + np.stack([gaps, many.astype("<u4")]).view(np.uint8).reshape(-1, 4).T.tobytes())


def _opened(expand, packed: bytes) -> tuple[np.ndarray, np.ndarray]:
    raw = expand.decompress(packed)
    (n,) = struct.unpack_from("<I", raw)
    gaps, many = np.ascontiguousarray(np.frombuffer(raw, np.uint8, offset=4).reshape(4, -1).T).view("<u4").reshape(2, n)
    return np.cumsum(gaps, dtype=np.int64), many.astype(np.int64)


MEASURES = ["n_a", "n_b", "n_groups", "n_links"]


def aligned(docs: DataFrame, a: str, b: str, keep: Sequence[str] = ("doc_id",), text: str = "text", chunk: int = CHUNK, block: int = BLOCK) -> DataFrame:
    """One row a document in ``kept``, with counts, the groups' digest and its packed links; and one row a block with its pairs and counts."""
    small_batches(docs.sparkSession)
    rows = docs.select(F.struct(*keep).alias("kept"), F.col(text).cast("string").alias("text"))
    kept = rows.dtypes[0][1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        align, squeeze = Aligner(a, b), zstandard.ZstdCompressor(level=1)
        task, number, held = TaskContext.get().partitionId() << 32, 0, 0
        done: list[tuple] = []
        shape = None

        def flush() -> Iterator[pa.RecordBatch]:
            """The documents of a block, then its pairs."""
            nonlocal number, held
            pairs, at = np.unique(np.concatenate([d[3][1] for d in done]), return_inverse=True)
            begin = 0
            for own, counts, digests, (doc, pair, many) in done:
                place = at[begin : begin + len(pair)]
                begin += len(pair)
                ends = np.searchsorted(doc, np.arange(len(digests) + 1))
                links = [_packed(squeeze, place[x:y], many[x:y]) if y > x else None for x, y in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
                k = len(digests)
                cols = [pa.array([task + number] * k), own, *(pa.array(counts[m].astype(np.int64)) for m in MEASURES), pa.array(digests), pa.array(links, pa.binary()), pa.nulls(k, pa.list_(pa.int64())), pa.nulls(k, pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays(cols, names)
            if len(pairs):
                total = np.bincount(at, np.concatenate([d[3][2] for d in done])).astype(np.int64)
                none = [pa.nulls(1, shape), *(pa.nulls(1, pa.int64()) for _ in MEASURES), pa.nulls(1, pa.string()), pa.nulls(1, pa.binary())]
                yield pa.RecordBatch.from_arrays([pa.array([task + number]), *none, pa.array([pairs.tolist()]), pa.array([total.tolist()])], names)
            done.clear()
            number, held = number + 1, 0

        for batch in batches:
            shape = batch["kept"].type
            texts = batch["text"].to_pylist()
            sizes = np.cumsum([len((t or "").encode()) for t in texts])
            x = 0
            while x < len(texts):
                before = int(sizes[x - 1]) if x else 0
                y = max(x + 1, int(np.searchsorted(sizes, before + chunk, "right")))
                done.append((batch["kept"].slice(x, y - x), *align.chunk(texts[x:y])))
                held += int(sizes[y - 1]) - before
                x = y
                if held >= block:
                    yield from flush()
        if done:
            yield from flush()

    names = ["block", "kept", *MEASURES, "groups_sha256", "links", "pairs", "counts"]
    return rows.mapInArrow(run, f"block long, kept {kept}, {', '.join(m + ' long' for m in MEASURES)}, groups_sha256 string, links binary, pairs array<long>, counts array<long>")


def pair_counts(found: DataFrame) -> DataFrame:
    """(pair, count, best) of a table of ``aligned``: how many links hold the pair, and whether no pair of its B id has more; pair is B id * 2^32 + A id."""
    part = found.where(F.col("pairs").isNotNull()).select(F.explode(F.arrays_zip("pairs", "counts")).alias("p")).select(F.col("p.pairs").alias("pair"), F.col("p.counts").alias("n"))
    total = part.groupBy("pair").agg(F.sum("n").alias("count"))
    most = F.max("count").over(W.partitionBy(F.shiftright("pair", 32)))  # as many rows as A has ids at most
    return total.select("pair", "count", (F.col("count") == most).alias("best"))


def scored(found: DataFrame) -> DataFrame:
    """The kept columns, counts, digest, n_best and count_sum of every document of a written table of ``aligned``."""
    counts = pair_counts(found)
    numbers = found.where(F.col("pairs").isNotNull()).select("block", F.posexplode("pairs").alias("number", "pair")).join(counts, "pair").select(F.col("block").alias("of"), "number", "count", "best")
    docs = found.where(F.col("pairs").isNull()).drop("pairs", "counts")
    kept = dict(found.dtypes)["kept"]

    def total(left: pa.Table, right: pa.Table) -> pa.Table:
        import zstandard

        expand = zstandard.ZstdDecompressor()
        left = left.combine_chunks()
        number = right["number"].to_numpy()
        count, best = np.zeros(len(number), np.int64), np.zeros(len(number), np.int64)
        count[number], best[number] = right["count"].to_numpy(), right["best"].to_numpy(zero_copy_only=False)
        sums, bests = [], []
        for packed in left["links"].to_pylist():
            at, many = _opened(expand, packed) if packed else (np.zeros(0, np.int64), np.zeros(0, np.int64))
            sums.append(int(count[at] @ many))
            bests.append(int(best[at] @ many))
        cols = [left["kept"], *(left[m] for m in MEASURES), pa.array(bests, pa.int64()), pa.array(sums, pa.int64()), left["groups_sha256"]]
        return pa.Table.from_arrays(cols, ["kept", *MEASURES, "n_best", "count_sum", "groups_sha256"])

    both_ = docs.groupBy("block").cogroup(numbers.groupBy("of"))
    return both_.applyInArrow(total, f"kept {kept}, {', '.join(m + ' long' for m in MEASURES)}, n_best long, count_sum long, groups_sha256 string").select("kept.*", *MEASURES, "n_best", "count_sum", "groups_sha256")


def report(docs: DataFrame, a: str, b: str) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) of every document."""
    return scored(settle(aligned(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), a, b)))
