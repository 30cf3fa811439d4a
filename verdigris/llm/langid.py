"""Operator 3: language identification by segmentation-marginalised unigrams.

Pieces of a fixed public vocabulary have a probability for each language. A word's probability
is the sum over all its segmentations into pieces, found by the forward algorithm; a text's is the
product over its words. Words are lower-cased and reduced to letters, and scored whole; long ones
are summed in logarithms. The piece probabilities are fitted by expectation maximisation on the word
counts of at most about ``sample_docs`` distinct texts a language, and one at least. For the fit alone
words of more than ``STRETCH`` letters, as languages without spaces have them, are taken in stretches.

Null texts and texts without a letter get ``und`` and score 0, as does every text when there is
nothing to learn from. A text's result depends on that text alone, so equal texts get equal results;
equal likelihoods go to the first language by code point. Rows may repeat and ids may be null.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verdigris.llm.common import Hasher, WordRows, Words, blobs, long_crc, small_batches, sums
from verdigris.llm.trie import Trie

#: Words of more letters are summed in logarithms, as products of their pieces leave the range of doubles.
LONG = 48
#: Cells of a table of words by letters that are worked on at once.
CELLS = 400_000
#: Letters of a stretch of a word in the fit.
STRETCH = 256
UNKNOWN = 1e-8
START = "▁"


class Pieces(Trie):
    """The vocabulary's letter pieces in lower case."""

    def __init__(self, model: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=model)
        raw = {sp.id_to_piece(i).lower() for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i))}
        self.pieces = sorted(p for p in raw if p.removeprefix(START).isalpha() or p == START)
        super().__init__(self.pieces)

    def codes(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Letter numbers of the words after a word start, and their lengths with it."""
        return super().codes([START + w for w in words])

    def forward(self, codes: np.ndarray, size: np.ndarray, prob: np.ndarray) -> np.ndarray:
        """Sums over segmentations of all prefixes: words x positions x languages; ``prob`` has row 0 for unknown letters."""
        out = np.zeros((len(codes), codes.shape[1] + 1, prob.shape[1]))
        out[:, 0] = 1
        for i, j, words, piece in self.spans(codes, size):
            out[words, j] += out[words, i] * prob[piece]
        return out

    def log_forward(self, codes: np.ndarray, size: np.ndarray, logs: np.ndarray) -> np.ndarray:
        """Log-sums over segmentations of whole words: words x languages, from log-probabilities."""
        out = np.full((len(codes), codes.shape[1] + 1, logs.shape[1]), -np.inf)
        out[:, 0] = 0
        for i, j, words, piece in self.spans(codes, size):
            out[words, j] = np.logaddexp(out[words, j], out[words, i] + logs[piece])
        return out[np.arange(len(codes)), size]

    def expect(self, codes: np.ndarray, size: np.ndarray, prob: np.ndarray, count: np.ndarray) -> np.ndarray:
        """Expected uses of each piece in words that occur ``count`` times, one language."""
        ahead = self.forward(codes, size, prob[:, None])[:, :, 0]
        back = np.zeros_like(ahead)
        back[np.arange(len(codes)), size] = 1
        spans = list(self.spans(codes, size))
        for i, j, words, piece in sorted(spans, key=lambda s: (-s[0], s[1])):
            back[words, i] += prob[piece] * back[words, j]
        total = ahead[np.arange(len(codes)), size]
        used = np.zeros(len(prob))
        for i, j, words, piece in spans:
            np.add.at(used, piece, count[words] * ahead[words, i] * prob[piece] * back[words, j] / total[words])
        return used


    def log_expect(self, codes: np.ndarray, size: np.ndarray, logs: np.ndarray, count: np.ndarray) -> np.ndarray:
        """As ``expect``, by log-sums, from log-probabilities of one language."""
        ahead = np.full((len(codes), codes.shape[1] + 1), -np.inf)
        back = ahead.copy()
        ahead[:, 0], back[np.arange(len(codes)), size] = 0, 0
        spans = list(self.spans(codes, size))
        for i, j, words, piece in spans:
            ahead[words, j] = np.logaddexp(ahead[words, j], ahead[words, i] + logs[piece])
        for i, j, words, piece in sorted(spans, key=lambda s: (-s[0], s[1])):
            back[words, i] = np.logaddexp(back[words, i], logs[piece] + back[words, j])
        used = np.zeros(len(logs))
        for i, j, words, piece in spans:
            np.add.at(used, piece, count[words] * np.exp(ahead[words, i] + logs[piece] + back[words, j] - back[words, 0]))
        return used


def letters_only(word: bytes) -> str:
    return "".join(filter(str.isalpha, word.decode("utf-8", "replace").lower()))


def by_length(words: list[str]) -> Iterator[np.ndarray]:
    """Numbers of the non-empty words in portions of like length and bounded tables."""
    size = np.array([len(w) for w in words], np.int64)
    order = np.argsort(size, kind="stable")
    order = order[np.searchsorted(size[order], 1) :]
    a = 0
    while a < len(order):
        b = len(order)
        while b - a > 1 and (b - a) * (size[order[b - 1]] + 20) > CELLS or (size[order[b - 1]] > LONG) != (size[order[a]] > LONG):
            b = a + max(1, (b - a) // 2)
        yield order[a:b]
        a = b


def word_scores(trie: Pieces, words: list[str], prob: np.ndarray) -> np.ndarray:
    """Log-probability of each word in each language, and its letters."""
    out = np.zeros((len(words), prob.shape[1] + 1))
    with np.errstate(divide="ignore"):
        logs = np.log(prob)
    for at in by_length(words):
        codes, size = trie.codes([words[i] for i in at.tolist()])
        if not prob.shape[1]:
            pass  # no language to score
        elif size[-1] > LONG + 1:
            out[at, :-1] = trie.log_forward(codes, size, logs)
        else:
            out[at, :-1] = np.log(np.maximum(trie.forward(codes, size, prob)[np.arange(len(at)), size], 1e-300))
        out[at, -1] = size - 1
    return out


_PIECES: dict[str, Pieces] = {}


def pieces(model: str) -> Pieces:
    if model not in _PIECES:
        _PIECES[model] = Pieces(model)
    return _PIECES[model]


def train(docs: DataFrame, model: str, sample_docs: int = 600, rounds: int = 4) -> tuple[list[str], np.ndarray]:
    """Languages and piece probabilities (row 0: unknown letter) from (text, lang) rows."""
    small_batches(docs.sparkSession)
    rows = docs.where(F.col("lang").isNotNull()).select(F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    draw = F.pmod(F.xxhash64("text"), F.lit(1_000_000))  # by the text, and each text once: copies do not add to the sample
    texts = rows.select("lang", F.xxhash64("text").alias("h"), draw.alias("d")).distinct()
    sizes = {r["lang"]: r for r in texts.groupBy("lang").agg(F.count("*").alias("n"), F.min("d").alias("first")).collect()}  # a row a language
    langs = sorted(sizes)
    if not langs:
        return [], np.zeros((1, 0))
    most = F.element_at(F.create_map(*[x for k in langs for x in (F.lit(k), F.lit(max(int(1_000_000 * min(1.0, sample_docs / sizes[k]["n"])), sizes[k]["first"] + 1)))]), F.col("lang"))
    sample = rows.where(draw < most).distinct()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            seen: Counter = Counter()
            for lang, text in zip(b["lang"].to_pylist(), blobs(b["text"]), strict=True):
                for w, n in Counter(text.split()).items():
                    plain = letters_only(w)
                    for x in range(0, len(plain), STRETCH):
                        seen[lang, plain[x : x + STRETCH]] += n
            yield pa.RecordBatch.from_pydict({"lang": pa.array([k for k, _ in seen], pa.string()), "word": pa.array([w for _, w in seen], pa.string()), "n": pa.array(list(seen.values()), pa.int64())})

    words = sample.mapInArrow(count, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n")).toPandas()  # of the sample
    trie = pieces(model)
    prob = np.zeros((len(trie.pieces) + 1, len(langs)))
    for k, lang in enumerate(langs):
        own = words[words.lang == lang].sort_values("word")
        every, n = own.word.tolist(), own.n.to_numpy(float)
        parts = [(*trie.codes([every[i] for i in at.tolist()]), n[at]) for at in by_length(every)]
        p = np.full(len(prob), 1 / len(prob))
        for _ in range(rounds if parts else 0):
            logs = np.log(p)
            used = sum(trie.log_expect(codes, size, logs, m) if size[-1] > LONG + 1 else trie.expect(codes, size, p, m) for codes, size, m in parts) + 0.02
            p = used / used.sum()
            p[0] = UNKNOWN
        prob[:, k] = p
    return langs, prob


def predict(docs: DataFrame, langs: list[str], prob: np.ndarray, model: str, keep: list[str] | None = None, names: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """The columns ``keep`` (all, unless given) with the predicted language and its score as ``names``, from the text alone.

    Columns of ``docs`` that are already called so are left out; other names for the result keep them.
    """
    small_batches(docs.sparkSession)
    keep = [c for c in (docs.columns if keep is None else keep) if c not in names]
    own = [f"c{i}" for i in range(len(keep))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie, hashes = pieces(model), Hasher()
        rows = WordRows(lambda words: word_scores(trie, [letters_only(w) for w in words], prob), 300_000)
        for b in batches:
            words = Words(b["t"])
            at = rows(words.data, words.starts, words.stops, hashes(words.data, words.starts, words.stops))
            total = sums(rows.rows[at], words.ends)
            logs, letters = total[:, :-1], np.rint(total[:, -1])
            if langs:
                odds = np.exp(logs - logs.max(1, keepdims=True))
                best, score = odds.argmax(1), 1 / odds.sum(1)
            else:
                best, score = np.zeros(len(total), int), np.zeros(len(total))
            known = (letters > 0) & bool(langs)
            pred = [langs[i] if ok else "und" for i, ok in zip(best, known, strict=True)]
            yield pa.RecordBatch.from_arrays([*(b[c] for c in own), pa.array(pred, pa.string()), pa.array(np.where(known, score, 0.0))], names=[*own, "p", "s"])

    source = docs.select(*[F.col(f"`{c}`").alias(o) for c, o in zip(keep, own, strict=True)], F.col("text").cast("string").alias("t"))
    told = source.mapInArrow(run, source.drop("t").schema.add("p", "string").add("s", "double"))
    return told.select(*[F.col(o).alias(c) for c, o in zip(keep, own, strict=True)], F.col("p").alias(names[0]), F.col("s").alias(names[1]))


def held_out(df: DataFrame) -> DataFrame:
    """With ``held_out``: rows that training never sees (crc32 of doc_id as text leaves 2 by 4; a null id is trained on)."""
    return df.withColumn("held_out", F.coalesce(F.pmod(long_crc("doc_id"), F.lit(4)) == 2, F.lit(False)))
