"""Operator 11: byte-level BPE encoding and decoding, with long texts put together from parts by tree concatenation.

Texts are encoded as the tokenizers library does. One of up to ``LONG_TEXT`` bytes is encoded where it is
read. A longer one is cut into parts of about ``PART`` characters, which Spark deals out to be encoded in
parallel; so is, within its task, one that holds more than ``UNSPLIT`` bytes without white space. The
parts' ids are joined pair by pair, as a tree. Some cuts fall where the pre-tokenizer splits the text
anyway. The others lie inside a run of letters, digits, signs or white space that it keeps whole; there a
window of ids around the join is encoded again and grows until its first id is the left part's and its
last id the right part's, or until it holds the whole run. A sequence of tokens is what BPE gives for a
run exactly when every two neighbours in it are what BPE gives for the two; the pairs inside the window,
inside each part and at the window's agreeing edges all are, so the joined ids are the library's.

Null texts are empty and have no ids. Every row has its own result, be its doc_id null or repeated or the
whole row repeated; an empty table gives an empty one. Other columns are dropped unless ``keep`` names
them, and may have any name.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verdigris.llm.common import Texts, small_batches
from verdigris.llm.tokenfile import CachedEncoder

LONG_TEXT = 1 << 16
UNSPLIT = 2048
PART = 8192
#: Bytes that are worked on at once, and stretches of text that an encoder keeps.
SLICE, KEPT = 1 << 20, 400_000
#: Characters of one kind that a cut inside a run has on either side: more than a contraction's.
INSIDE = 8


class Part(NamedTuple):
    """Ids of a stretch of text; ``head`` and ``tail`` of them are of its first and its last pre-token."""

    ids: np.ndarray
    head: int
    tail: int


def joined(left: Part, right: Part, inside: bool, again: Callable[[np.ndarray], np.ndarray], least: int = 2) -> Part:
    """The ids of both stretches in a row; ``inside``: the join lies in a pre-token, of which ``again`` encodes a window of ids anew."""
    if not len(left.ids) or not len(right.ids):
        return right if not len(left.ids) else left
    whole_left, whole_right = left.head == len(left.ids), right.head == len(right.ids)
    if not inside:
        return Part(np.concatenate([left.ids, right.ids]), left.head, right.tail)
    i = j = least
    while True:
        i, j = min(i, left.tail), min(j, right.head)
        middle = again(np.concatenate([left.ids[-i:], right.ids[:j]]))
        agrees_left = i == left.tail or middle[0] == left.ids[-i]
        agrees_right = j == right.head or middle[-1] == right.ids[j - 1]
        if agrees_left and agrees_right:
            break
        i, j = i if agrees_left else 2 * i, j if agrees_right else 2 * j
    ids = np.concatenate([left.ids[:-i], middle, right.ids[j:]])
    head = len(ids) - len(right.ids) + right.head if whole_left else left.head
    tail = len(ids) - len(left.ids) + left.tail if whole_right else right.tail
    return Part(ids, head, tail)


class Tree:
    """Joins parts as they come, two of one height at a time; holds a part for each height."""

    def __init__(self, again: Callable[[np.ndarray], np.ndarray]):
        self.again = again
        self.stack: list[tuple[int, bool, Part]] = []

    def add(self, part: Part, inside: bool) -> None:
        """``inside``: the cut before the part lies in a pre-token."""
        self.stack.append((0, inside, part))
        while len(self.stack) > 1 and self.stack[-1][0] == self.stack[-2][0]:
            self._join()

    def _join(self) -> None:
        _, inside, right = self.stack.pop()
        height, before, left = self.stack.pop()
        self.stack.append((height + 1, before, joined(left, right, inside, self.again)))

    def ids(self) -> np.ndarray:
        while len(self.stack) > 1:
            self._join()
        return self.stack.pop()[2].ids if self.stack else np.zeros(0, np.uint32)


def _byte_letters() -> dict[str, int]:
    """The letters that stand for bytes in byte-level vocabularies: visible Latin-1 ones for themselves, the others from 256 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


class Spelling:
    """The bytes of each id of a byte-level tokenizer."""

    def __init__(self, tokenizer):
        vocabulary = tokenizer.get_vocab()
        self.names = [""] * (max(vocabulary.values()) + 1)
        for token, i in vocabulary.items():
            self.names[i] = token
        letters, added = _byte_letters(), {t.content for t in tokenizer.get_added_tokens_decoder().values()}
        spelled = [x.encode() if x in added else bytes(letters[c] for c in x) for x in self.names]
        self.size_of = np.array([len(x) for x in spelled], np.int64)
        self.spelling = np.frombuffer(b"".join(spelled), np.uint8)
        self.spelling_at = np.cumsum(self.size_of) - self.size_of

    def spell(self, ids: np.ndarray) -> np.ndarray:
        """The bytes of ``ids`` in a row."""
        many = self.size_of[ids]
        ends = np.cumsum(many)
        return self.spelling[np.repeat(self.spelling_at[ids] - ends + many, many) + np.arange(int(ends[-1]) if len(ends) else 0)]

    def decode(self, ids: np.ndarray, ends: np.ndarray) -> list[str]:
        """The texts of ids in a row, some ``SLICE`` bytes at a time; bytes that are no UTF-8 become U+FFFD."""
        at = np.concatenate([[0], np.cumsum(self.size_of[ids])])[ends]
        out = []
        for x, y in slices(at):
            raw = self.spell(ids[ends[x] : ends[y]]).tobytes()
            own = (at[x : y + 1] - at[x]).tolist()
            out += [raw[p:q].decode("utf-8", "replace") for p, q in zip(own[:-1], own[1:], strict=True)]
        return out


class Coder(Spelling):
    """Encodes and cuts with one tokenizer file."""

    def __init__(self, path: str, plain: bool = False):
        self.cached = CachedEncoder(path, KEPT)
        self.tokenizer = self.cached.tokenizer
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        if plain:  # special tokens' strings are text like any other
            self.tokenizer.encode_special_tokens = True
            self.cached.whole = []
        self.special = [x.decode() for x in self.cached.whole]
        self.model = self.tokenizer.model
        super().__init__(self.tokenizer)
        self.kind = lru_cache(1 << 16)(self._kind)

    def again(self, ids: np.ndarray) -> np.ndarray:
        """What BPE gives for the bytes of ``ids`` as one pre-token."""
        return np.array([t.id for t in self.model.tokenize("".join([self.names[i] for i in ids.tolist()]))], np.uint32)

    def _kind(self, c: str) -> str:
        """L, N, O or S: what the pre-tokenizer puts the character together with."""
        for kind, other in (("L", "a"), ("N", "1"), ("O", "!")):
            if len(self.tokenizer.pre_tokenizer.pre_tokenize_str(other + c)) == 1:
                return kind
        return "S"

    def cuts(self, text: str, part: int = PART) -> list[tuple[int, bool]]:
        """(place, inside) of the cuts of ``text``, about every ``part`` characters.

        A cut is sure where a special token begins or ends, before white space, and between two kinds of
        characters but for a sign before a letter (which may be a contraction). It is inside where the
        ``INSIDE`` characters on both sides are of one kind. One of these is found after a few dozen.
        """
        out, at = [], part
        while at + INSIDE < len(text):
            for q in range(at, len(text) - INSIDE):
                near = [x for t in self.special for x in _places(text, t, q - INSIDE - len(t) + 1, q + INSIDE + len(t) - 1)]
                if any(q in (x, y) for x, y in near):
                    sure, inside = True, False
                elif near:
                    continue
                else:
                    a, b = self.kind(text[q - 1]), self.kind(text[q])
                    sure = a != b and a != "S" and (a, b) != ("O", "L")
                    inside = a == b and len({self.kind(c) for c in text[q - INSIDE : q + INSIDE]}) == 1
                if sure or inside:
                    out.append((q, inside))
                    break
            else:
                break
            at = out[-1][0] + part
        return out

    def part(self, text: str, inside: bool) -> Part:
        """The ids of a part of a text; ``inside``: one of its ends lies in a pre-token, so its outer pre-tokens are told apart."""
        if not inside:
            ids = self.flat(pa.array([text]))[0] if not _unsplit(text) else np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint32)
            return Part(ids, 0, 0)
        found = self.tokenizer.encode(text, add_special_tokens=False)
        words = np.array([-1 if w is None else w for w in found.word_ids])
        other = np.flatnonzero(words != words[0]) if len(words) else []
        head = int(other[0]) if len(other) else len(words)
        other = np.flatnonzero(words != words[-1]) if len(words) else []
        return Part(np.array(found.ids, np.uint32), head, len(words) - (int(other[-1]) + 1 if len(other) else 0))

    def long(self, text: str, part: int = PART) -> np.ndarray:
        """The ids of a text with long runs, from its parts."""
        tree = Tree(self.again)
        for _, piece, before, after in pieces(text, self.cuts(text, part)):
            tree.add(self.part(piece, before or after), before)
        return tree.ids()

    def flat(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in a row, and where each text's begin and the last one's end."""
        return self.cached.flat(Texts(texts))

    def encode(self, column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
        """As ``flat``, some ``SLICE`` bytes at a time; texts with long runs go through their parts."""
        texts = Texts(column)
        slow = _long_runs(texts)
        ids, sizes = [], []
        for x, y in slices(texts.ends):
            if slow[x:y].any():
                for i in range(x, y):
                    ids.append(self.long(column[i].as_py()) if slow[i] else self.flat(column.slice(i, 1))[0])
                    sizes.append([len(ids[-1])])
            else:
                found, ends = self.flat(column.slice(x, y - x))
                ids.append(found)
                sizes.append(np.diff(ends))
        return np.concatenate([np.zeros(0, np.uint32), *ids]), np.concatenate([[0], np.cumsum(np.concatenate([np.zeros(0, np.int64), *sizes]))]).astype(np.int64)


def slices(ends: np.ndarray, most: int | None = None) -> Iterator[tuple[int, int]]:
    """Ranges of rows that hold ``most`` bytes or one row; ``ends`` has where each row's bytes begin and the last one's end."""
    x = 0
    while x < len(ends) - 1:
        y = max(x + 1, int(np.searchsorted(ends, ends[x] + (most or SLICE), "right")) - 1)
        yield x, y
        x = y


def _places(text: str, token: str, a: int, b: int) -> Iterator[tuple[int, int]]:
    at = text.find(token, max(0, a), b)
    while at >= 0:
        yield at, at + len(token)
        at = text.find(token, at + 1, b)


def pieces(text: str, cuts: list[tuple[int, bool]]) -> Iterator[tuple[int, str, bool, bool]]:
    """(number, text, whether the cut before and the one after lie in a pre-token) of the parts."""
    ends = [(0, False), *cuts, (len(text), False)]
    for i, ((x, before), (y, after)) in enumerate(zip(ends[:-1], ends[1:], strict=True)):
        yield i, text[x:y], before, after


def _long_runs(texts: Texts) -> np.ndarray:
    """Whether each text has more than ``UNSPLIT`` bytes without ASCII white space."""
    mark = (texts.data == 32) | ((texts.data >= 9) & (texts.data <= 13))
    mark[texts.ends[:-1][texts.ends[:-1] < len(mark)]] = True
    marks = np.append(np.flatnonzero(mark), len(mark))
    out = np.zeros(len(texts.ends) - 1, bool)
    out[np.searchsorted(texts.ends, marks[:-1][np.diff(marks) > UNSPLIT], "right") - 1] = True
    return out


def _unsplit(text: str) -> bool:
    return len(text) > UNSPLIT // 4 and bool(_long_runs(Texts(pa.array([text])))[0])


_CODERS: dict[tuple[str, bool], Coder] = {}
_SPELLINGS: dict[str, Spelling] = {}


def coder(path: str, plain: bool = False) -> Coder:
    """One for each Python worker."""
    if (path, plain) not in _CODERS:
        _CODERS[path, plain] = Coder(path, plain)
    return _CODERS[path, plain]


def spelling(path: str) -> Spelling:
    """One for each Python worker; it does not keep the tokenizer."""
    if path not in _SPELLINGS:
        from tokenizers import Tokenizer

        _SPELLINGS[path] = Spelling(Tokenizer.from_file(path))
    return _SPELLINGS[path]


def _lists(ids: np.ndarray, ends: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(ids.astype(np.int32)))


def _whole(docs: DataFrame, path: str, kept: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = coder(path)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b["kept"], _lists(*code.encode(b["text"]))], ["kept", "ids"])

    return docs.mapInArrow(run, f"kept {kept}, ids array<int>")


def _by_parts(docs: DataFrame, path: str, kept: str, part: int) -> DataFrame:
    """Parts of each text are encoded by any task, and joined by the task of their text."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = coder(path)
        for b in batches:
            for i, (row, text) in enumerate(zip(b["row"].to_pylist(), b["text"].to_pylist(), strict=True)):
                found = list(pieces(text, code.cuts(text, part)))
                number, piece, before, after = zip(*found, strict=True)
                same = b["kept"].take(pa.array([i] * len(found)))
                yield pa.RecordBatch.from_arrays([same, pa.array([row] * len(found)), pa.array(number, pa.int32()), pa.array(piece), pa.array(before), pa.array(after)], ["kept", "row", "part", "piece", "before", "after"])

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = coder(path)
        for b in batches:
            done = [code.part(t, x or y) for t, x, y in zip(b["piece"].to_pylist(), b["before"].to_pylist(), b["after"].to_pylist(), strict=True)]
            new = [pa.array([p.ids.astype("<u4").tobytes() for p in done], pa.binary()), pa.array([p.head for p in done], pa.int32()), pa.array([p.tail for p in done], pa.int32())]
            old = ["kept", "row", "part", "before"]
            yield pa.RecordBatch.from_arrays([*(b[n] for n in old), *new], [*old, "ids", "head", "tail"])

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = coder(path)
        last, own, tree = None, None, Tree(code.again)

        def done() -> pa.RecordBatch:
            ids = tree.ids()
            return pa.RecordBatch.from_arrays([own, _lists(ids, np.array([0, len(ids)]))], ["kept", "ids"])

        for b in batches:
            columns = [b[n].to_pylist() for n in ("row", "before", "ids", "head", "tail")]
            for i, (row, before, ids, head, tail) in enumerate(zip(*columns, strict=True)):
                if row != last:
                    if last is not None:
                        yield done()
                    last, own, tree = row, b["kept"].slice(i, 1), Tree(code.again)
                tree.add(Part(np.frombuffer(ids, "<u4"), head, tail), before)
        if last is not None:
            yield done()

    lead = f"kept {kept}, row long, part int"
    parts = docs.withColumn("row", F.monotonically_increasing_id()).mapInArrow(cut, f"{lead}, piece string, before boolean, after boolean").repartition("row", "part")
    found = parts.mapInArrow(encode, f"{lead}, before boolean, ids binary, head int, tail int")
    return found.repartition("row").sortWithinPartitions("row", "part").mapInArrow(join, f"kept {kept}, ids array<int>")


def encoded(docs: DataFrame, path: str, keep: Sequence[str] = ("doc_id",), text: str = "text", long_text: int = LONG_TEXT, part: int = PART) -> DataFrame:
    """The columns ``keep`` and ``ids``, an array, of every row's text."""
    small_batches(docs.sparkSession)
    rows = docs.select(F.struct(*keep).alias("kept"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    kept = rows.dtypes[0][1]
    long = F.octet_length("text") > long_text
    return _whole(rows.where(~long), path, kept).unionByName(_by_parts(rows.where(long), path, kept, part)).select("kept.*", "ids")


def decoded(rows: DataFrame, path: str, column: str = "decoded") -> DataFrame:
    """``rows`` with the text of their ``ids``, special tokens' included, as a column more."""
    small_batches(rows.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = spelling(path)
        for b in batches:
            ids = b["ids"]
            ends = ids.offsets.to_numpy().astype(np.int64)
            texts = code.decode(ids.flatten().to_numpy(), ends - ends[0])
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(texts, pa.string())], [*b.schema.names, column])

    kept = ", ".join(f"`{k}` {kind}" for k, kind in rows.dtypes)
    return rows.mapInArrow(run, f"{kept}, `{column}` string")


def report(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of every document."""
    both = decoded(encoded(docs, path), path)
    digest = F.sha2(F.array_join(F.col("ids").cast("array<string>"), ",").cast("binary"), 256)
    return both.select(F.col("doc_id").cast("long").alias("doc_id"), F.size("ids").cast("long").alias("n_tokens"), digest.alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))
