"""Faults found in earlier rounds: languages without spaces, samples of copies, clusters in blocks, texts with one id and one hash."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import public_tokenizers
from verdigris.llm import langid, lines, nearest, substrings

MODEL = public_tokenizers.path("piece_bpe_32k.model")


def told(spark, train, ask):
    langs, prob = langid.train(spark.createDataFrame(train, "text string, lang string").repartition(4), MODEL)
    rows = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(ask)], "doc_id long, text string")
    got = {x.doc_id: x.lang_pred for x in langid.predict(rows, langs, prob, MODEL).collect()}
    return sum(got[i] == lang for i, (_, lang) in enumerate(ask)) / len(ask)


def test_languages_without_spaces(spark):
    r = random.Random(2)
    letters = {"zh": "的一是不了人我在有他这中大来上国个到说们为子和你地出道也时年得就那要下以生会自着去之过家学对可她里后", "ja": "のにはをたがでてとしれさあるいるもするからなことしていまやよりへそこれ", "en": "e t a o i n s h r d l u "}

    def text(lang):
        return "".join(r.choice(letters[lang]) for _ in range(80))

    train = [(text(k), k) for k in letters for _ in range(100)]
    ask = [(text(k), k) for k in letters for _ in range(60)]
    assert told(spark, train, ask) >= 0.95


def test_language_of_copies(spark):
    german = "der schnelle braune fuchs springt über den faulen hund und das ist gut so"
    r = random.Random(3)
    english = ["the quick brown fox jumps over the lazy dog and that is " + r.choice(["fine", "good", "well"]) + " by " + "".join(r.choice("etaoinshrd") for _ in range(6)) for _ in range(50)]
    train = [(german, "de")] * 3000 + [(t, "en") for t in english]
    assert told(spark, train, [("das ist der hund und der fuchs", "de"), ("that is the dog and the fox", "en")]) == 1


def test_long_words_in_the_fit_are_the_sums_of_short_ones():
    trie = langid.pieces(MODEL)
    r = np.random.default_rng(1)
    prob = r.random(len(trie.pieces) + 1)
    prob /= prob.sum()
    words = ["".join(r.choice(list("abcdet"), n)) for n in (3, 9, 30)]
    codes, size = trie.codes(words)
    count = np.array([2.0, 1.0, 5.0])
    assert np.allclose(trie.expect(codes, size, prob, count), trie.log_expect(codes, size, np.log(prob), count))


@pytest.mark.parametrize("blocks", [1, 4])
def test_a_cluster_of_4000(spark, blocks):
    r = np.random.default_rng(6)
    center = r.normal(size=32)
    vecs = np.concatenate([center + 0.02 * r.normal(size=(4000, 32)), r.normal(size=(2000, 32))]).astype(np.float32)
    order = r.permutation(len(vecs))
    df = spark.createDataFrame([(int(i), vecs[j].tolist()) for i, j in enumerate(order)], "vec_id long, embedding array<float>")
    rows = nearest.usable(df)
    got = nearest.search(rows, rows.where(F.col("id") % 100 == 0), block_rows=6000 // blocks, block_queries=32)
    unit = vecs[order].astype(np.float64)
    unit /= np.linalg.norm(unit, axis=1)[:, None]
    want = {}
    for q in range(0, 6000, 100):
        score = unit @ unit[q]
        score[q] = -2
        want[q] = set(np.lexsort((np.arange(6000), -score))[:5].tolist())
    found = {}
    for x in got.collect():
        found.setdefault(x.query_id, set()).add(x.vec_id)
    assert sum(len(want[q] & found[q]) for q in want) == 5 * len(want)


@pytest.fixture(scope="module")
def twins(spark):
    """Two texts of one 32-bit hash that share a line and 25 words."""
    base = " ".join(f"word{i}" for i in range(25)) + "\n"
    same = spark.range(400_000).select(F.concat(F.lit(base), F.lit("ends with "), "id").alias("t")).groupBy(F.hash("t")).agg(F.collect_list("t").alias("ts")).where(F.size("ts") > 1).first()
    return sorted(same.ts)[:2]


@pytest.mark.parametrize("ids", [(7, 7), (None, None), (7, 8)])
def test_texts_of_one_id_and_one_hash(spark, twins, ids):
    rows = [(ids[0], twins[0], "s", 1), (ids[1], twins[1], "s", 1), (99, "quite another text", "s", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, k string, r long").repartition(2)
    got = sorted(x.n_removed for x in substrings.removed(df).collect())
    assert got == [0, 0, 27]  # the last words but one are shared too
    out = sorted(x.n_removed for x in lines.report(df).collect())
    assert out == [0, 0, 1]
    kept = sorted(x.text for x in lines.deduped(df).collect())
    assert len(kept) == 3 and sum("word3" in t for t in kept) == 1
    assert {x.kept_sha256 for x in lines.report(df).collect()} >= {hashlib.sha256(b"quite another text").hexdigest()}
