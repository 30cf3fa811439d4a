"""Alignment of two tokenizers against a plain loop with the libraries."""

import hashlib
from collections import Counter

import public_tokenizers
import sentencepiece
from tokenizers import Tokenizer

from tests.conftest import SF
from verdigris.llm import align

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def libraries():
    a = Tokenizer.from_file(A)
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=B)


def letters():
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


def brute(texts):
    a, b = libraries()
    code, names = letters(), {i: t for t, i in a.get_vocab().items()}
    docs, count = [], Counter()
    for text in texts:
        links, groups, na, nb = [], "", 0, 0
        if text:
            want = (" " + text).encode()
            ai, bi = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
            ab = [b"<|endoftext|>" if i == 50256 else bytes(code[c] for c in names[i]) for i in ai]
            bb = [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in bi]
            if b"".join(ab) == want == b"".join(bb):
                na, nb = len(ai), len(bi)
                over_a = [k for k, x in enumerate(ab) for _ in x]
                over_b = [k for k, x in enumerate(bb) for _ in x]
                links = [(ai[x], bi[y]) for x, y in sorted(set(zip(over_a, over_b, strict=True)))]
                ends_a, ends_b, at = set(), set(), 0
                for x in ab:
                    at += len(x)
                    ends_a.add(at)
                at = 0
                for x in bb:
                    at += len(x)
                    ends_b.add(at)
                parts, begin = [], 0
                for end in sorted(ends_a & ends_b):
                    one = [str(ai[k]) for k in dict.fromkeys(over_a[begin:end])]
                    two = [str(bi[k]) for k in dict.fromkeys(over_b[begin:end])]
                    parts.append(",".join(one) + "|" + ",".join(two))
                    begin = end
                groups = ";".join(parts)
        count.update(links)
        docs.append((na, nb, links, groups))
    top = {}
    for (_, y), n in count.items():
        top[y] = max(top.get(y, 0), n)
    return [(na, nb, g.count(";") + 1 if g else 0, len(links), sum(count[p] == top[p[1]] for p in links), sum(count[p] for p in links), hashlib.sha256(g.encode()).hexdigest() if g else "") for na, nb, links, g in docs]


TEXTS = [None, "", " ", "  two  spaces ", "plain words and more words", "Überraschung für 漢字 😀!", "a\nb\tc\r\n\n", "mark ▁ inside", "<s> <unk> <|endoftext|> <0x41>", "nul\0byte", "x" * 3000, "漢" * 900, "the the the", "internationalization 12345 3.14", "é" * 40, "ends with space "]


def run(spark, texts, **sizes):
    df = spark.createDataFrame([(i % 7 if i % 3 else None, t, i, "b", 5) for i, t in enumerate(texts)], "doc_id long, text string, n long, block string, pairs long").repartition(3)
    out = align.scored(align.settle(align.aligned(df, A, B, keep=["n"], **sizes))).collect()
    return [tuple(r)[1:] for r in sorted(out, key=lambda r: r.n)]


def test_small_texts(spark):
    texts = TEXTS + TEXTS[4:7]
    assert run(spark, texts) == run(spark, texts, chunk=30, block=60) == brute(texts)


def test_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").limit(60)
    texts = [r.text for r in docs.collect()]
    assert run(spark, texts, chunk=5000, block=20_000) == brute(texts)


def test_empty_table(spark):
    assert align.report(spark.createDataFrame([], "doc_id long, text string"), A, B).collect() == []
    none = align.report(spark.createDataFrame([(1, None), (None, "")], "doc_id long, text string"), A, B).collect()
    assert sorted(map(str, none)) == sorted(map(str, align.report(spark.createDataFrame([(None, None), (1, "▁")], "doc_id long, text string"), A, B).collect()))
    assert {tuple(r)[1:] for r in none} == {(0, 0, 0, 0, 0, 0, "")}
