"""Operator 8: toxicity by multiple-instance learning.

A document is a bag of sentences. A sentence's probability is logistic in its words and word pairs;
the document's is their noisy-or. Only document labels are known, so the likelihood of the labels
is climbed through the noisy-or, and the fitted sentence scores then locate offending sentences.

The fit sees at most about ``sample`` texts of each label (a documented bound): their features are
counted on the executors, and the driver gets only those that the counts tie to the label. Every text is scored
whole. Null and word-less texts have the score of an empty bag, which is 0. Without labels of both
kinds all scores are 0. Labels whose ``toxic`` is null are ignored. A text's score depends on that
text alone, so equal texts get equal scores; rows may repeat and ids may be null.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verdigris.llm.common import Hasher, WordRows, Words, long_crc, settle, small_batches, sums
from verdigris.llm.langid import letters_only

SPACE = 1 << 18


def _features(words: list[bytes]) -> np.ndarray:
    """Per word: its feature, and whether a sentence ends with it."""
    out = np.zeros((len(words), 2), np.int64)
    for i, w in enumerate(words):
        plain = letters_only(w)
        out[i, 0] = 1 + xxhash.xxh3_64_intdigest(plain.encode()) % (SPACE - 1) if plain else 0
        out[i, 1] = w[-1:] in b".!?"
    return out


class Sentences:
    """Texts as word features, word-pair features, sentence ends and document ends; sentences end at stops and line feeds."""

    def __init__(self):
        self.rows, self.hashes = WordRows(_features, 400_000), Hasher()

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(unigrams, pairs, sentence number of each word, sentence ends by text)."""
        words = Words(texts)
        ends = words.ends
        if not len(words):
            none = np.zeros(0, np.int64)
            return none, none, none, np.zeros(len(ends), np.int64)
        at = self.rows(words.data, words.starts, words.stops, self.hashes(words.data, words.starts, words.stops))
        one, stop = self.rows.rows[at, 0], self.rows.rows[at, 1].copy()
        lines = np.concatenate([[0], np.cumsum(words.data == ord("\n"))])
        stop[:-1] |= lines[words.starts[1:]] > lines[words.stops[:-1]]
        stop[ends[1:][ends[1:] > ends[:-1]] - 1] = 1
        sentence = np.concatenate([[0], np.cumsum(stop)[:-1]])
        pair = np.zeros(len(one), np.int64)
        if len(one) > 1:
            follows = (stop[:-1] == 0) & (one[:-1] > 0) & (one[1:] > 0)
            mixed = (one[:-1] * np.int64(1_000_003) + one[1:] * np.int64(31)) % (SPACE - 1) + 1
            pair[1:] = np.where(follows, mixed, 0)
        counts = np.concatenate([[0], np.cumsum(stop)])
        return one, pair, sentence, counts[ends]


def _noisy_or(z: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Log of the probability that no sentence is toxic, by document."""
    return sums(-np.logaddexp(0, z), ends)


class Model:
    def __init__(self, one: np.ndarray, pair: np.ndarray, bias: float):
        self.one, self.pair, self.bias = one, pair, bias

    def sentences(self, one: np.ndarray, pair: np.ndarray, sentence: np.ndarray, count: int) -> np.ndarray:
        return self.bias + np.bincount(sentence, self.one[one] + self.pair[pair], count)


def telling(counts: np.ndarray, bad: int, good: int, significant: float = 15.0) -> np.ndarray:
    """Whether toxic texts have a feature significantly more often, from (toxic, other) text counts of each feature."""
    a, b = counts[:, 0].astype(float), counts[:, 1].astype(float)
    n = bad + good
    cross = a * (good - b) - b * (bad - a)
    chi2 = n * cross**2 / np.maximum((a + b) * (n - a - b) * float(bad * good), 1)
    return (a >= 3) & (cross > 0) & (chi2 >= significant)


def fit(toxic: np.ndarray, ends: np.ndarray, place: np.ndarray, feature: np.ndarray, rounds: int = 150, rate: float = 0.3, decay: float = 5e-5) -> Model:
    """Climb the labels' likelihood through the noisy-or with Adagrad: features (pairs from SPACE on) at numbered sentences."""
    count = int(ends[-1])
    doc_of = np.repeat(np.arange(len(toxic)), np.diff(ends))
    used, feature = np.unique(feature, return_inverse=True)
    w, bias = np.zeros(len(used)), -3.0
    gw, gb = np.full(len(used), 1e-6), 1e-6
    for _ in range(rounds):
        z = bias + np.bincount(place, w[feature], count)
        quiet = _noisy_or(z, ends)
        any_ = np.maximum(-np.expm1(quiet), 1e-9)
        push = np.where(toxic > 0, np.exp(quiet) / any_, -1.0)
        dz = push[doc_of] / (1 + np.exp(-z))
        dw = np.bincount(feature, dz[place], len(used)) / len(toxic) - decay * w
        db = dz.sum() / len(toxic)
        gw += dw * dw
        gb += db * db
        w += rate * dw / np.sqrt(gw)
        bias += rate * db / np.sqrt(gb)
    full = np.zeros(2 * SPACE)
    full[used] = w
    return Model(full[:SPACE].astype(np.float32), full[SPACE:].astype(np.float32), float(bias))


def train(docs: DataFrame, labels: DataFrame, sample: int = 3000) -> Model | None:
    """Fit on (doc_id, text) and (doc_id, toxic) rows: at most about ``sample`` texts of each label, chosen by a hash of doc_id."""
    small_batches(docs.sparkSession)
    rows = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).select("doc_id", F.when(F.col("toxic") > 0, 1).otherwise(0).alias("toxic")).distinct()
    sizes = {r["toxic"]: r["count"] for r in rows.groupBy("toxic").count().collect()}
    if len(sizes) < 2:
        return None
    share = F.when(F.col("toxic") == 1, min(1.0, sample / sizes[1])).otherwise(min(1.0, sample / sizes[0]))
    chosen = rows.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < share * 1_000_000)
    seen = docs.select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(chosen), "doc_id")  # about 2 * sample rows
    texts = settle(seen.select("text", "toxic").distinct())

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cut = Sentences()
        for b in batches:
            one, pair, sentence, ends = cut(b["text"])
            doc = np.repeat(np.arange(b.num_rows), np.diff(ends))[sentence]
            both = np.unique(np.concatenate([one, pair + SPACE]) + 2 * SPACE * np.concatenate([doc, doc]))
            feature, label = both % (2 * SPACE), b["toxic"].to_numpy()[both // (2 * SPACE)]
            tally = np.bincount(2 * feature + (label == 0), minlength=4 * SPACE)
            some = np.flatnonzero(tally)
            yield pa.RecordBatch.from_pydict({"f": pa.array(some, pa.int64()), "n": pa.array(tally[some], pa.int64())})

    tally = np.zeros(4 * SPACE, np.int64)
    for r in texts.mapInArrow(features, "f long, n long").groupBy("f").agg(F.sum("n").alias("n")).toPandas().itertuples():  # at most 4 * SPACE rows
        tally[r.f] = r.n
    many = {r["toxic"]: r["count"] for r in texts.groupBy("toxic").count().collect()}
    good = telling(tally.reshape(-1, 2), many.get(1, 0), many.get(0, 0))
    good[[0, SPACE]] = False

    def bags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cut = Sentences()
        for b in batches:
            one, pair, sentence, ends = cut(b["text"])
            feature, place = np.concatenate([one, pair + SPACE]), np.concatenate([sentence, sentence])
            held = good[feature]
            feature, place = feature[held], place[held]
            order = np.argsort(place, kind="stable")
            feature, place = feature[order], place[order]
            edge = np.searchsorted(place, ends)
            local = place - np.repeat(ends[:-1], np.diff(edge))
            parts = [(local[x:y].tolist(), feature[x:y].tolist()) for x, y in zip(edge[:-1], edge[1:], strict=True)]
            yield pa.RecordBatch.from_pydict({"toxic": b["toxic"].cast(pa.int32()), "sentences": pa.array(np.diff(ends), pa.int64()), "place": pa.array([p for p, _ in parts], pa.list_(pa.int64())), "feature": pa.array([f for _, f in parts], pa.list_(pa.int64()))})

    got = texts.mapInArrow(bags, "toxic int, sentences long, place array<long>, feature array<long>").toPandas()  # telling features of the sample
    got = got.assign(key=[tuple(f) for f in got.feature], at=[tuple(p) for p in got.place]).sort_values(["toxic", "sentences", "key", "at"])
    ends = np.concatenate([[0], np.cumsum(got.sentences.to_numpy())]).astype(np.int64)
    if not good.any() or not ends[-1]:
        return None
    place = np.concatenate([np.asarray(p, np.int64) + a for p, a in zip(got.place, ends[:-1], strict=True)])
    return fit(got.toxic.to_numpy(), ends, place, np.concatenate([np.asarray(f, np.int64) for f in got.feature]))


def score(docs: DataFrame, model: Model | None, offending: float = 0.5) -> DataFrame:
    """(doc_id, score, n_sentences, n_offending, worst): worst is the number of the likeliest sentence, from 0."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cut = Sentences()
        edge = float(np.log(offending / (1 - offending)))
        for b in batches:
            one, pair, sentence, ends = cut(b["text"])
            z = model.sentences(one, pair, sentence, int(ends[-1])) if model else np.full(int(ends[-1]), -np.inf)
            many = np.diff(ends)
            over = np.concatenate([[0], np.cumsum(z >= edge)])
            worst = [int(z[x:y].argmax()) if y > x else None for x, y in zip(ends[:-1], ends[1:], strict=True)]
            p = -np.expm1(_noisy_or(z, ends))
            yield pa.RecordBatch.from_pydict({"doc_id": b["doc_id"], "score": pa.array(np.clip(p, 0, 1)), "n_sentences": pa.array(many), "n_offending": pa.array(over[ends[1:]] - over[ends[:-1]]), "worst": pa.array(worst, pa.int64())})

    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, rows.select("doc_id").schema.add("score", "double").add("n_sentences", "long").add("n_offending", "long").add("worst", "long"))


def held_out(df: DataFrame) -> DataFrame:
    """With ``held_out``: rows whose labels are never learned (crc32 of doc_id as text leaves 1 by 3; null ids are not held out)."""
    return df.withColumn("held_out", F.coalesce(F.pmod(long_crc("doc_id"), F.lit(3)) == 1, F.lit(False)))
