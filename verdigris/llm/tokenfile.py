"""Operator 7: token ids written as patched frame-of-reference blocks.

A file row holds about ``ROW_IDS`` ids of consecutive documents: their doc_ids and lengths, and a
payload of blocks of 256 ids. A block keeps its minimum, packs the differences at the width in bits
that 90 % of them need, and lists the others as exceptions. An index at the payload's head gives each
block's first byte. Rows are written by Spark's writer, so a retried task leaves no trace and any
store works; ``shard`` and ``start`` place a row's ids in ascending doc_id order.

Null texts are empty and give only the end id. Null doc_ids come first; rows with the same doc_id
follow in the order of their ids' checksum. An empty table gives an empty file.
"""

from __future__ import annotations

import os
import struct
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from verdigris.llm.common import Hasher, Texts, WordRows, id_cuts, range_of, settle, small_batches

BLOCK = 256
ROW_IDS = 1 << 16
MAGIC = b"PFR1"
def _squeeze(values: np.ndarray, w: int) -> np.ndarray:
    """The low ``w`` bits of 32-bit values (blocks x BLOCK) without gaps, lowest first: blocks x bytes."""
    if w > 16:
        bits = np.unpackbits(values.astype("<u4").view(np.uint8).reshape(len(values), BLOCK, 4), axis=2, bitorder="little")
        return np.packbits(bits[:, :, :w].reshape(len(values), -1), axis=1, bitorder="little")
    low = (values & np.uint32((1 << w) - 1)).astype("<u8").reshape(len(values), -1, 8)
    shift = (np.arange(4, dtype=np.uint64) * np.uint64(w))[None, None]
    a, b = (low[:, :, :4] << shift).sum(2, dtype=np.uint64), (low[:, :, 4:] << shift).sum(2, dtype=np.uint64)
    half = w // 2  # eight values fill w bytes; for an odd w the middle byte is shared
    out = np.empty((len(values), low.shape[1], w), np.uint8)
    if w % 2:
        out[:, :, : half + 1] = a.view(np.uint8).reshape(*a.shape, 8)[:, :, : half + 1]
        out[:, :, half] |= ((b & np.uint64(15)) << np.uint64(4)).astype(np.uint8)
        out[:, :, half + 1 :] = (b >> np.uint64(4)).view(np.uint8).reshape(*b.shape, 8)[:, :, :half]
    else:
        out[:, :, :half] = a.view(np.uint8).reshape(*a.shape, 8)[:, :, :half]
        out[:, :, half:] = b.view(np.uint8).reshape(*b.shape, 8)[:, :, :half]
    return out.reshape(len(values), -1)


def _spread(packed: np.ndarray, w: int) -> np.ndarray:
    """The values that ``_squeeze`` has packed."""
    if w > 16:
        bits = np.unpackbits(packed, axis=1, bitorder="little").reshape(len(packed), BLOCK, w)
        wide = np.zeros((len(packed), BLOCK, 32), np.uint8)
        wide[:, :, :w] = bits
        return np.packbits(wide.reshape(len(packed), -1), axis=1, bitorder="little").view("<u4")
    groups, half = packed.reshape(len(packed), -1, w), w // 2
    parts = np.zeros((2, *groups.shape[:2], 8), np.uint8)
    parts[0, :, :, : half + w % 2] = groups[:, :, : half + w % 2]
    parts[1, :, :, : half + w % 2] = groups[:, :, half:]
    a, b = parts.view("<u8")[..., 0]
    if w % 2:
        b = b >> np.uint64(4)
    shift = (np.arange(4, dtype=np.uint64) * np.uint64(w))[None, None]
    both = np.concatenate([a[:, :, None] >> shift, b[:, :, None] >> shift], 2) & np.uint64((1 << w) - 1)
    return both.astype(np.uint32).reshape(len(packed), BLOCK)


def pack(ids: np.ndarray, quantile: float = 0.9) -> bytes:
    """A payload of blocks of ``ids`` (unsigned 32-bit)."""
    n = len(ids)
    count = -(-n // BLOCK)
    if not count:
        return MAGIC + struct.pack("<II", 0, 0)
    padded = np.full(count * BLOCK, ids[-1], np.uint32)
    padded[:n] = ids
    grid = padded.reshape(count, BLOCK)
    base = grid.min(1)
    gap = grid - base[:, None]
    rank = min(BLOCK - 1, int(BLOCK * quantile))
    usual = np.partition(gap, rank, 1)[:, rank]
    width = np.array([int(x).bit_length() for x in usual], np.uint8)
    outlier = gap > ((np.uint64(1) << width.astype(np.uint64)) - np.uint64(1)).astype(np.uint32)[:, None]
    bodies: list[bytes] = [b""] * count
    for w in np.unique(width[width > 0]).tolist():
        at = np.flatnonzero(width == w)
        packed = _squeeze(gap[at], w)
        for i, row in zip(at.tolist(), packed, strict=True):
            bodies[i] = row.tobytes()
    many = outlier.sum(1)
    blocks = []
    for i in range(count):
        patch = b""
        if many[i]:
            place = np.flatnonzero(outlier[i])
            patch = place.astype(np.uint8).tobytes() + gap[i][place].astype("<u4").tobytes()
        blocks.append(struct.pack("<IBB", int(base[i]), int(width[i]), int(many[i])) + bodies[i] + patch)
    starts = np.concatenate([[0], np.cumsum([len(b) for b in blocks])[:-1]]).astype("<u4")
    return MAGIC + struct.pack("<II", n, count) + starts.tobytes() + b"".join(blocks)


def unpack(payload: bytes) -> np.ndarray:
    """The ids of a payload."""
    if payload[:4] != MAGIC:
        raise ValueError("not a block payload")
    n, count = struct.unpack_from("<II", payload, 4)
    if not n:
        return np.empty(0, np.uint32)
    starts = np.frombuffer(payload, "<u4", count, 12).astype(np.int64) + 12 + 4 * count
    raw = np.frombuffer(payload, np.uint8)
    width, many = raw[starts + 4], raw[starts + 5]
    base = np.frombuffer(raw[starts[:, None] + np.arange(4)].tobytes(), "<u4")
    gap = np.zeros((count, BLOCK), np.uint32)
    for w in np.unique(width[width > 0]).tolist():
        at = np.flatnonzero(width == w)
        gap[at] = _spread(raw[starts[at][:, None] + 6 + np.arange(BLOCK * w // 8)], w)
    for i in np.flatnonzero(many).tolist():
        at, k = int(starts[i]) + 6 + BLOCK * int(width[i]) // 8, int(many[i])
        gap[i, raw[at : at + k]] = np.frombuffer(payload, "<u4", k, at + k)
    return (gap + base[:, None]).reshape(-1)[:n]


class _Stretches(WordRows):
    """Where the ids of each stretch stand in a pool of ids; the pool goes with the rows."""

    def __init__(self, make, bound: int):
        super().__init__(make, bound)
        self.ids, self.used = np.zeros(1 << 16, np.uint32), 0

    def add(self, ids: list[bytes]) -> np.ndarray:
        flat = np.frombuffer(b"".join(ids), "<u4")
        many = np.array([len(x) // 4 for x in ids], np.int64)
        at = self.used + np.cumsum(many) - many
        if self.used + len(flat) > len(self.ids):
            self.ids = np.concatenate([self.ids[: self.used], np.zeros(self.used // 2 + len(flat), np.uint32)])
        self.ids[self.used : self.used + len(flat)] = flat
        self.used += len(flat)
        return np.stack([at, many], 1).astype(np.int32)

    def halve(self) -> None:
        super().halve()
        self.used = int(self.rows[self.index.many - 1].sum())
        self.ids = self.ids[: self.used].copy()


class CachedEncoder:
    """Texts to ids by the tokenizers library, which sees each distinct stretch of text once.

    A text is cut before white space, between an ASCII letter and another ASCII character, and between
    a single line feed and an ASCII letter: there the byte-level pre-tokenizer always ends a token, so the
    stretches' ids in a row are the text's ids. New ASCII words are put into one text for the library.
    At most about ``bound`` stretches are kept (some 80 bytes each), by 64-bit hashes.
    """

    def __init__(self, path: str, bound: int = 1_500_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab()  # byte-level: a character of a token stands for a byte
        self.lengths = np.zeros(max(vocabulary.values()) + 1, np.int64)
        for token, i in vocabulary.items():
            self.lengths[i] = len(token)
        self.whole = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()]  # found before all else
        self.stretches, self.hashes = _Stretches(self._learn, bound), Hasher()

    def _ids(self, texts: list[str]) -> list[bytes]:
        got = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [array("I", x.ids).tobytes() for x in got]

    def _joined(self, parts: list[bytes], before: bytes, skip: int) -> dict[bytes, bytes]:
        """Ids of parts that are a space, or ``before``, and letters, as one text: tokens spell bytes, so lengths tell whose they are."""
        out = {}
        for a in range(0, len(parts), 2000):
            some = parts[a : a + 2000]
            ids = np.frombuffer(self._ids([(before + before.join(some)).decode()])[0], "<u4")
            at = np.cumsum(np.array([len(p) + skip for p in some]))
            stops = np.searchsorted(np.cumsum(self.lengths[ids]), at) + 1
            flat, starts = ids.tobytes(), [0, *stops[:-1].tolist()]
            out.update((p, flat[4 * (x + skip) : 4 * y]) for p, x, y in zip(some, starts, stops.tolist(), strict=True))
        return out

    def _learn(self, stretches: list[bytes]) -> np.ndarray:
        spaced, bare, other = [], [], []
        for c in stretches:
            if c.isalpha():
                bare.append(c)
            elif c[:1] == b" " and c[1:].isalpha():
                spaced.append(c)
            else:
                other.append(c)
        known = self._joined(spaced, b"", 0) | self._joined(bare, b"\n", 1)
        known.update(zip(other, self._ids([c.decode() for c in other]), strict=True))
        return self.stretches.add([known[c] for c in stretches])

    def flat(self, texts: Texts) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in a row, and where each text's begin and the last one's end."""
        data, ends = texts.data, texts.ends
        if not len(data):
            return np.zeros(0, np.uint32), np.zeros(len(ends), np.int64)
        white = _ENDS_WHITE[data]
        wide = np.flatnonzero(_LAST_OF_WIDE[data])  # the last bytes of white space beyond ASCII, told by those before them; some others too
        wide = wide[wide > 1]
        white[wide] = (data[wide - 1] == 0xC2) | (np.isin(data[wide - 2], (0xE1, 0xE2, 0xE3)) & np.isin(data[wide - 1], (0x9A, 0x80, 0x81)))
        white[: min(2, len(data))] |= data[: min(2, len(data))] >= 0x80
        head = np.zeros(len(data) + 1, bool)
        letter = _LETTERS[data]
        head[1:-1] = _WHITE[data[1:]] & ~white[:-1] | letter[:-1] & ~letter[1:] & (data[1:] < 0x80)
        head[2:-1] |= letter[2:] & (data[1:-1] == ord("\n")) & _VISIBLE[data[:-2]]
        raw = data.tobytes()
        for token in self.whole:
            at = raw.find(token)
            while at >= 0:
                head[at + 1 : at + len(token)] = False
                at = raw.find(token, at + 1)
        head[ends[:-1]] = True
        starts = np.flatnonzero(head[:-1])
        stops = np.append(starts[1:], len(data))
        at = self.stretches(data, starts, stops, self.hashes(data, starts, stops))
        at = self.stretches.rows[at]
        many = at[:, 1].astype(np.int64)
        total = np.cumsum(many)
        ids = self.stretches.ids[np.repeat(at[:, 0] - total + many, many) + np.arange(int(total[-1]))]
        return ids, np.concatenate([[0], total])[np.searchsorted(starts, ends)]

    def __call__(self, texts: list[bytes]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers."""
        ids, ends = self.flat(Texts(pa.array(texts, pa.large_binary()).cast(pa.large_string())))
        return [ids[x:y].astype("<u4").tobytes() for x, y in zip(ends[:-1], ends[1:], strict=True)]


_WHITE, _LETTERS, _VISIBLE = np.zeros(256, bool), np.zeros(256, bool), np.zeros(256, bool)
_WHITE[list(b"\t\n\v\f\r ")] = True
_LETTERS[[*range(ord("A"), ord("Z") + 1), *range(ord("a"), ord("z") + 1)]] = True
_VISIBLE[33:127] = True
_ENDS_WHITE = np.zeros(256, bool)
_ENDS_WHITE[[*range(9, 14), *range(28, 33)]] = True
_LAST_OF_WIDE = np.zeros(256, bool)
_LAST_OF_WIDE[[*range(0x80, 0x8B), 0x9F, 0xA0, 0xA8, 0xA9, 0xAF]] = True

_ENCODERS: dict[str, CachedEncoder] = {}


def encoder(path: str) -> CachedEncoder:
    """One for each Python worker."""
    if path not in _ENCODERS:
        _ENCODERS[path] = CachedEncoder(path)
    return _ENCODERS[path]


def _widen(ids: bytes) -> np.ndarray:
    return np.frombuffer(ids, "<u2" if ids[0] == 2 else "<u4", offset=1).astype(np.uint32)


def _batch(encode: CachedEncoder, column: pa.Array, end_id: int) -> tuple[list[int], list[bytes]]:
    """Checksums of the texts' ids with the end id, and the ids: 16-bit where all of a batch fit; the first byte tells the width."""
    ids, ends = encode.flat(Texts(column))
    ids = np.insert(ids, ends[1:], end_id).astype("<u4")
    ends = ends + np.arange(len(ends))
    narrow = not len(ids) or ids.max() < 65536
    raw, kept = ids.tobytes(), ids.astype("<u2").tobytes() if narrow else ids.tobytes()
    head, wide = (b"\2", 2) if narrow else (b"\4", 4)
    pairs = list(zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True))
    return [zlib.crc32(raw[4 * x : 4 * y]) for x, y in pairs], [head + kept[wide * x : wide * y] for x, y in pairs]


def encoded(docs: DataFrame, path: str, end_id: int = 2) -> DataFrame:
    """(doc_id, shard, crc, ids): each document's ids with the end id; ``shard`` ascends with doc_id."""
    small_batches(docs.sparkSession)
    cuts = id_cuts(docs, "doc_id", 2000)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path)
        for b in batches:
            crc, ids = _batch(encode, b["text"], end_id)
            yield pa.RecordBatch.from_pydict({"doc_id": b["doc_id"], "shard": b["shard"], "crc": pa.array(crc, pa.int64()), "ids": pa.array(ids, pa.binary())})

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), range_of(F.col("doc_id"), cuts).cast("int").alias("shard"))
    return rows.mapInArrow(run, "doc_id long, shard int, crc long, ids binary")


FILE = "shard int, start long, doc_ids array<bigint>, lengths array<int>, ids long, payload binary"


def file_rows(rows: DataFrame) -> DataFrame:
    """File rows of ``encoded`` rows: ids in ascending doc_id order within each shard."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, start, held, ids = None, 0, 0, []
        keys: list[int | None] = []

        def flush() -> pa.RecordBatch:
            nonlocal start, held, ids, keys
            row = {"shard": [shard], "start": [start], "doc_ids": [keys], "lengths": [[len(x) for x in ids]], "ids": [held], "payload": [pack(np.concatenate(ids))]}
            start, held, ids, keys = start + held, 0, [], []
            return pa.RecordBatch.from_pydict({k: pa.array(v, t) for (k, v), t in zip(row.items(), (pa.int32(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.int64(), pa.binary()), strict=True)})

        for b in batches:
            for s, key, x in zip(b["shard"].to_pylist(), b["doc_id"].to_pylist(), b["ids"].to_pylist(), strict=True):
                if s != shard or held >= ROW_IDS:
                    if held:
                        yield flush()
                    if s != shard:
                        shard, start = s, 0
                ids.append(_widen(x))
                keys.append(key)
                held += len(ids[-1])
        if held:
            yield flush()

    dealt = rows.repartition("shard").sortWithinPartitions("shard", F.col("doc_id").asc_nulls_first(), "crc")
    return dealt.mapInArrow(run, FILE)


def read_documents(file: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of each document in the file, from its blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for shard, start, keys, lengths, payload in zip(*(b[c].to_pylist() for c in ("shard", "start", "doc_ids", "lengths", "payload")), strict=True):
                ids = unpack(payload).astype("<u4")
                ends = np.cumsum(lengths, dtype=np.int64)
                begins = ends - np.array(lengths, np.int64)
                crc = [zlib.crc32(ids[x:y].tobytes()) for x, y in zip(begins, ends, strict=True)]
                yield pa.RecordBatch.from_pydict({"doc_id": pa.array(keys, pa.int64()), "shard": pa.array([shard] * len(keys), pa.int32()), "local": pa.array(begins + start), "n_tokens": pa.array(lengths, pa.int64()), "ids_crc32": pa.array(crc, pa.int64())})

    docs = file.select("shard", "start", "doc_ids", "lengths", "payload").mapInArrow(run, "doc_id long, shard int, local long, n_tokens long, ids_crc32 long")
    before = W.partitionBy(F.lit(1)).orderBy("shard").rowsBetween(W.unboundedPreceding, -1)
    offsets = file.groupBy("shard").agg(F.sum("ids").alias("n")).select("shard", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    return docs.join(F.broadcast(offsets), "shard").select("doc_id", (F.col("before") + F.col("local")).alias("start"), "n_tokens", "ids_crc32")  # as many rows as ``id_cuts`` gives at most


def write_file(docs: DataFrame, path: str, end_id: int = 2) -> DataFrame:
    """Write ``docs`` as a file in the shared folder; gives the file as a table of FILE rows."""
    return settle(file_rows(encoded(docs, path, end_id)))
