"""Tree concatenation against the tokenizers library."""

import hashlib
import random

import numpy as np
import pytest

import public_tokenizers
from verdigris.llm import bpe

PATH = public_tokenizers.path("byte_bpe_50k.json")
ALPHABETS = ["a", "ab", "etaoinshrdlu", "é漢字かな", "0123456789", "!'-.", " ", " \n", "'sdt ", "a1!", "漢1", "the cat's ", "😀é", "  x"]


@pytest.fixture(scope="module")
def code():
    return bpe.Coder(PATH)


def library(code, text):
    return code.tokenizer.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("alphabet", ALPHABETS)
def test_parts_give_the_librarys_ids(code, alphabet):
    r = random.Random(alphabet)
    for part in (20, 37, 111):
        for n in (0, 1, 30, 400, 1500):
            text = "".join(r.choice(alphabet) for _ in range(n))
            assert code.long(text, part).tolist() == library(code, text)


def test_special_tokens_stay_whole(code):
    r = random.Random(4)
    for part in (18, 25, 60):
        for _ in range(20):
            text = "".join(r.choice(["<|endoftext|>", "<|endof", "text|>", "abc", "  ", "<|", "'s", "x" * 40, "!" * 30, " " * 30]) for _ in range(40))
            assert code.long(text, part).tolist() == library(code, text)
    text = "<|endoftext|>" * 50
    assert code.long(text, 20).tolist() == library(code, text) == [50256] * 50


def test_windows_grow_until_both_sides_agree(code):
    """Words of the vocabulary cut anywhere: the halves' ids differ from the whole's around the join."""
    r = random.Random(9)
    words = [n for n in code.names if n.isascii() and n.isalpha() and len(n) > 6]
    grown = 0
    for _ in range(300):
        text = "".join(r.choice(words) for _ in range(8))
        cut = r.randrange(9, len(text) - 8)
        left, right = code.part(text[:cut], True), code.part(text[cut:], True)
        asked = []

        def again(ids):
            asked.append(len(ids))
            return code.again(ids)

        got = bpe.joined(left, right, True, again, 1)
        assert got.ids.tolist() == library(code, text)
        grown += len(asked) > 1
    assert grown > 20


def test_long_unbroken_text(code):
    text = "".join(random.Random(1).choice("abcdefgh") for _ in range(300_000))
    assert code.long(text).tolist() == library(code, text)


def test_documents(spark, code):
    """Short, long, null and empty texts, repeated and null ids, clashing columns; long ones by parts dealt out by Spark."""
    r = random.Random(3)
    texts = [None, "", " ", "plain words, and it's <|endoftext|> here", "z" * 5000, "ab" * 3000 + " end", "漢字" * 900, " ".join("word" for _ in range(700)), "a▁b\0c", "x" * 2100 + "<|endoftext|>" + " " * 90]
    texts += ["".join(r.choice("etaoin shrdlu'") for _ in range(4000)) for _ in range(3)]
    rows = [(i % 5 if i % 4 else None, t, i, i, "s") for i, t in enumerate(texts + texts[3:6])]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids long, _row long, source string").repartition(3)
    want = sorted((str(d), t or "", library(code, t or "")) for d, t, *_ in rows)
    for long_text in (1 << 16, 1000):
        got = bpe.decoded(bpe.encoded(df, PATH, long_text=long_text, part=200), PATH).collect()
        assert sorted((str(x.doc_id), x.decoded, list(x.ids)) for x in got) == want
    kept = bpe.encoded(df, PATH, keep=["source", "_row"], long_text=1000)
    assert kept.columns == ["source", "_row", "ids"] and kept.count() == len(rows)
    assert bpe.report(df.limit(0), PATH).collect() == []
    for x in bpe.report(df, PATH).collect():
        assert any(x.doc_id == d and x.n_tokens == len(library(code, t or "")) and x.ids_sha256 == hashlib.sha256(",".join(map(str, library(code, t or ""))).encode()).hexdigest() and x.decoded_sha256 == hashlib.sha256((t or "").encode()).hexdigest() for d, t, *_ in rows)


def test_decoding_of_broken_bytes(code):
    ids = np.array([code.tokenizer.token_to_id(c) for c in "ĠéðŁĺ"[:1]] + library(code, "😀")[:1])
    assert code.decode(ids, np.array([0, len(ids)])) == [code.tokenizer.decode(ids.tolist(), skip_special_tokens=False)]
