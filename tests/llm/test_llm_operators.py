"""Small cases for each operator: brute force, round trips, nulls, empties, ties, repeats."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest

from verdigris.llm import jaccard, langid, lines, mixing, nearest, segmentations, simhash, substrings, tokenfile, toxicity

DOCS = "doc_id long, text string, lang string, source string, n_chars long, key string, class int"
BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")


def corpus(seed=0, n=60):
    """Rows with copies, near copies, nulls, blanks, shared passages and columns whose names operators use inside."""
    r = random.Random(seed)
    vocabulary = ["".join(r.choice("abcdeéßñ") for _ in range(r.randint(1, 7))) for _ in range(150)]
    passage = " ".join(r.choice(vocabulary) for _ in range(55))
    base = [" ".join(r.choice(vocabulary) for _ in range(r.randint(1, 120))) for _ in range(12)]
    out = []
    for i in range(n):
        kind = i % 6
        words = base[r.randrange(12)].split()
        if kind == 0:
            text = " ".join(words)
        elif kind == 1:
            words[r.randrange(len(words))] = "changed"
            text = " ".join(words)
        elif kind == 2:
            text = "\n".join([" ".join(r.choice(vocabulary) for _ in range(20)), passage, "short"])
        elif kind == 3:
            text = " ".join(r.choice(vocabulary) for _ in range(80))
        elif kind == 4:
            text = r.choice([None, "", " \t\n", "one", "two words", "123 ...", "x" * 5000])
        else:
            text = passage + "\n" + passage
        out.append((i * 3, text, r.choice(["en", "fr", None]), r.choice(["a", "b", "Z", None]), 0, "k", i))
    return out


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), DOCS).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="module")
def odd(spark):
    """Null and repeated ids, repeated rows."""
    rows = corpus(5, 30)
    return spark.createDataFrame([(None, *x[1:]) if i % 7 == 0 else x for i, x in enumerate(rows)] + rows[:8] + [(rows[0][0], "other text of the same id", None, None, None, None, None)], DOCS)


def words(text):
    return (text or "").encode().split()


def test_mix_meets_targets(docs, odd, empty):
    rows = mixing.mix(docs).collect()
    by = defaultdict(lambda: [0, 0.0, 0])
    source = {r.doc_id: r.source for r in docs.collect()}
    for r in rows:
        s = by[source[r.doc_id]]
        s[0] += r.size
        s[1], s[2] = r.target, s[2] + r.taken
        assert r.size == len(words(next(x.text for x in docs.where(f"doc_id = {r.doc_id}").collect()))) if r.doc_id < 9 else True
        assert 0 <= r.taken <= 2 * r.size
    for size, target, taken in by.values():
        assert target <= 2 * size + 1e-9 and abs(taken - target) <= 1
    assert abs(sum(x[1] for x in by.values()) - 1.5 * sum(x[0] for x in by.values())) < 1e-6
    assert sorted(map(tuple, rows)) == sorted(map(tuple, mixing.mix(docs).collect()))
    assert mixing.mix(odd).count() == odd.count() and mixing.mix(empty).count() == 0


def test_targets_refill(spark):
    sizes = spark.createDataFrame([("a", 10), ("b", 1000), ("c", 10), (None, 0)], "source string, source_size long")
    got = {r.source: r.target for r in mixing.targets(sizes, [3, 1, 2], 1.5, 2).collect()}
    assert got == {"a": 20.0, "c": 20.0, None: 0.0, "b": 1490.0}


def test_simhash_edited(docs, odd, empty):
    rows = sorted(docs.collect(), key=lambda r: -r.doc_id)
    got = {r.doc_id: r for r in simhash.edited_likeness(docs, per_range=7).collect()}
    whole = {r.doc_id: r for r in simhash.edited_likeness(docs).collect()}
    assert got == whole
    for i, r in enumerate(rows):
        text, after = r.text or "", rows[(i + 1) % len(rows)].text or ""
        half = len(text) // 2
        edited = text[: len(text) - half] + after[:half]
        assert got[r.doc_id].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        nxt = rows[(i + 1) % len(rows)].doc_id
        apart = (int(got[r.doc_id].fingerprint, 16) ^ int(got[nxt].fingerprint, 16)).bit_count()
        assert got[r.doc_id].near_next == 1 - apart / 128 and got[r.doc_id].n_chars == len(text)
    same = defaultdict(set)
    for r in rows:
        same[r.text].add(got[r.doc_id].fingerprint)
    assert all(len(x) == 1 for x in same.values())
    assert simhash.edited_likeness(odd).count() == odd.count() and simhash.edited_likeness(empty).count() == 0


def test_simhash_radius(spark, docs):
    r = random.Random(2)
    base = [r.getrandbits(128) for _ in range(6)]
    prints = {b ^ sum(1 << i for i in r.sample(range(128), r.randint(0, 6))) for b in base for _ in range(12)}

    def half(x):
        return x - (1 << 64) if x >> 63 else x

    rows = [(half(p >> 64), half(p & (2**64 - 1))) for p in prints]
    df = spark.createDataFrame(rows, "hi long, lo long")
    got = {(x.q_hi, x.q_lo, x.hi, x.lo) for x in simhash.within_radius(df, df, radius=3).collect()}
    want = {(*a, *b) for a in rows for b in rows if a != b and ((a[0] ^ b[0]) & (2**64 - 1)).bit_count() + ((a[1] ^ b[1]) & (2**64 - 1)).bit_count() <= 3}
    assert got == want and want
    assert simhash.fingerprints(docs).count() == docs.count()


def test_simhash_votes_are_spark_hashes(spark):
    import xxhash

    seed = 42
    for w in (b"ab", b"cd", b"ef"):
        seed = xxhash.xxh64_intdigest(w, seed)
    df = spark.createDataFrame([(1, "ab cd ef")], "doc_id long, text string")
    assert simhash.fingerprints(df).first().fingerprint[:16] == f"{seed:016x}"


def test_substrings(docs, odd, empty):
    seen, want = set(), {}
    for r in sorted(docs.collect(), key=lambda r: r.doc_id):
        w = words(r.text)
        gone = [False] * len(w)
        for i in range(len(w) - 19):
            g = tuple(w[i : i + 20])
            if g in seen:
                gone[i : i + 20] = [True] * 20
            seen.add(g)
        kept = [x for x, out in zip(w, gone, strict=True) if not out]
        want[r.doc_id] = (len(w), sum(gone), hashlib.sha256(b" ".join(kept)).hexdigest())
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in substrings.removed(docs).collect()}
    assert got == want and sum(x[1] for x in want.values())
    assert substrings.removed(odd).count() == odd.count() and substrings.removed(empty).count() == 0


def shingles(text):
    w = words((text or "").encode().lower().decode())
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def components(rows):
    sets = [(r.doc_id, shingles(r.text)) for r in rows]
    up = list(range(len(sets)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, (_, a) in enumerate(sets):
        for j, (_, b) in enumerate(sets[:i]):
            if a and b and 100 * len(a & b) >= 75 * len(a | b):
                up[find(i)] = find(j)
    least = {}
    for i, (k, _) in enumerate(sets):
        least[find(i)] = min(k, least.get(find(i), k))
    return {k: (len(s), least[find(i)]) for i, (k, s) in enumerate(sets)}


def test_jaccard(docs, odd, empty):
    want = components(docs.collect())
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.joined(docs).collect()}
    assert got == want and len({c for _, c in want.values()}) < len(want)
    assert jaccard.joined(odd).count() == odd.count() and jaccard.joined(empty).count() == 0


def test_jaccard_large_cells(spark, monkeypatch):
    """A cell cut into many leaves gives the same components."""
    r = random.Random(4)
    base = [str(r.random()) for _ in range(120)]
    rows = []
    for i in range(60):
        w = list(base)
        for _ in range(r.randint(0, 3) * (1 + i % 3)):
            w[r.randrange(120)] = str(r.random())
        rows.append((i, " ".join(w)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    monkeypatch.setattr(jaccard, "LEAF", 700)
    got = {x.doc_id: (x.n_shingles, x.component_id) for x in jaccard.joined(df).collect()}
    assert got == components(df.collect())


def test_signature_tree_finds_every_link():
    r = random.Random(1)
    sets = []
    for _ in range(60):
        own = {r.getrandbits(64) for _ in range(r.randint(1, 60))} if not sets or r.random() < 0.4 else {x for x in r.choice(sets) if r.random() > 0.1} | {r.getrandbits(64)}
        sets.append(own)
    arrays = [np.array(sorted(s), np.uint64) for s in sets]
    x, y = jaccard.SignatureTree(arrays, 256).pairs(jaccard.SignatureTree(arrays, 256))
    found = set(zip(x.tolist(), y.tolist(), strict=True))
    for i, a in enumerate(sets):
        for j, b in enumerate(sets):
            if jaccard.linked(len(a & b), len(a), len(b)):
                assert (i, j) in found


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def edits(r, text, n):
    out = list(text)
    for _ in range(n):
        at = r.randrange(len(out) + 1)
        out[at : at + r.randint(0, 1)] = r.choice(["", "x", "y"])
    return "".join(out)


def test_banded_distance():
    r = random.Random(0)
    for _ in range(4000):
        a = "".join(r.choice("ab") for _ in range(r.randint(1, 12)))
        b = edits(r, a, r.randint(0, 4))
        assert lines.within(a, b, 2) == (distance(a, b) <= 2)


@pytest.mark.parametrize("many", [48, 2])
def test_lines(spark, odd, empty, monkeypatch, many):
    monkeypatch.setattr(lines, "MANY", many)
    r = random.Random(3)
    base = ["".join(r.choice("abcdefgh ") for _ in range(r.randint(33, 60))).strip() + "." * 3 for _ in range(8)]
    texts = ["\n".join([edits(r, r.choice(base), r.randint(0, 3)) for _ in range(3)] + ["tiny", ""]) for _ in range(40)]
    df = spark.createDataFrame([(i, t, "s", len(t)) for i, t in enumerate(texts)], "doc_id long, text string, source string, n_chars long")
    where = [(d, i, line) for d, t in enumerate(texts) for i, line in lines.eligible(t.encode())]
    up = list(range(len(where)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(where)):
        for j in range(i):
            if distance(where[i][2], where[j][2]) <= 2 and find(i) != find(j):
                a, b = sorted((find(i), find(j)))
                up[b] = a
    gone = {(d, i) for n, (d, i, _) in enumerate(where) if find(n) != n}
    want = {}
    for d, t in enumerate(texts):
        kept = [x for i, x in enumerate(t.split("\n")) if (d, i) not in gone]
        want[d] = (5, 5 - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest())
    assert {x.doc_id: (x.n_lines, x.n_removed, x.kept_sha256) for x in lines.report(df).collect()} == want
    kept = lines.deduped(df).collect()
    assert lines.deduped(df).columns == df.columns and all(x.n_chars == len(x.text) for x in kept)
    if many == 48:
        assert lines.report(odd).count() == odd.count() and lines.report(empty).count() == 0


def test_token_file(docs, odd, empty):
    from tokenizers import Tokenizer

    tokenizer, start = Tokenizer.from_file(BYTE_BPE), 0
    got = {r.doc_id: r for r in tokenfile.read_documents(tokenfile.write_file(docs, BYTE_BPE)).collect()}
    for r in sorted(docs.collect(), key=lambda r: r.doc_id):
        ids = np.array(tokenizer.encode(r.text or "", add_special_tokens=False).ids + [2], "<u4")
        g = got[r.doc_id]
        assert (g.start, g.n_tokens, g.ids_crc32) == (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
    assert tokenfile.read_documents(tokenfile.write_file(odd, BYTE_BPE)).count() == odd.count()
    assert tokenfile.read_documents(tokenfile.write_file(empty, BYTE_BPE)).count() == 0


def test_token_blocks():
    r = np.random.default_rng(0)
    for n in (0, 1, 255, 256, 257, 3000):
        for ids in (r.integers(0, 50_000, n), np.minimum(r.pareto(1, n) * 9, 4e9), np.full(n, 7)):
            ids = ids.astype(np.uint32)
            assert (tokenfile.unpack(tokenfile.pack(ids)) == ids).all()


def test_cached_encoder_is_the_library():
    from tokenizers import Tokenizer

    tokenizer, encode, r = Tokenizer.from_file(BYTE_BPE), tokenfile.CachedEncoder(BYTE_BPE), random.Random(0)
    parts = [" ", " ", "\n", "\t", " ", "a", "Éb", "1", ".", ",", "'s", "<|endoftext|>", "　"]
    texts = ["".join(r.choice(parts) for _ in range(r.randint(0, 14))) for _ in range(3000)]
    for text, ids in zip(texts, encode([t.encode() for t in texts]), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == tokenizer.encode(text, add_special_tokens=False).ids, repr(text)


def test_language_id(spark, empty):
    from verdigris.llm.common import table

    docs = langid.held_out(table(spark, "/root/testdata/sf0.001", "documents"))
    langs, prob = langid.train(docs.where("not held_out"), PIECES)
    rows = langid.predict(docs, langs, prob, PIECES).where("held_out").collect()
    assert sum(r.lang == r.lang_pred for r in rows) >= 0.95 * len(rows)
    odd = spark.createDataFrame([(1, None), (2, "12 ..."), (3, ""), (4, "the " * 9)], "doc_id long, text string")
    assert [r.lang_pred == "und" for r in sorted(langid.predict(odd, langs, prob, PIECES).collect())] == [True, True, True, False]
    assert langid.train(empty, PIECES)[0] == []
    assert {r.lang_pred for r in langid.predict(odd, [], np.zeros((1, 0)), PIECES).collect()} == {"und"}


def test_forward_sums_all_segmentations():
    trie = langid.pieces(PIECES)
    r = np.random.default_rng(0)
    prob = r.random((len(trie.pieces) + 1, 2)) * 0.1
    number = {p: i for i, p in enumerate(trie.pieces, 1)}

    def ways(s):
        if not s:
            return np.ones(2)
        total = np.zeros(2)
        for n in range(1, len(s) + 1):
            i = number.get(s[:n], 0 if n == 1 else None)
            if i is not None:
                total += prob[i] * ways(s[n:])
        return total

    some = ["the", "anderer", "q", "漢字", "internationalization"]
    codes, size = trie.codes(some)
    got = trie.forward(codes, size, prob)[np.arange(len(some)), size]
    assert np.allclose(got, [ways(langid.START + w) for w in some])
    longer = ["the" * 30, "x" * 3000]
    scores = langid.word_scores(trie, [*some, "", *longer], prob)
    assert np.allclose(scores[: len(some), :-1], np.log(got)) and not scores[len(some)].any()
    assert np.isfinite(scores).all() and scores[-1, -1] == 3000
    codes, size = trie.codes(longer[:1])
    assert np.allclose(scores[-2, :-1], np.log(trie.forward(codes, size, prob)[0, size[0]]))


def test_equal_texts_get_equal_scores(spark):
    """Wherever a text stands; texts of one batch do not touch each other, and ties go to the first language."""
    from verdigris.llm.common import table

    docs = langid.held_out(table(spark, "/root/testdata/sf0.001", "documents"))
    text = docs.where("length(text) > 500").first().text
    langs, prob = langid.train(docs.where("not held_out"), PIECES)
    rows = spark.createDataFrame([(i, text if i % 3 == 1 else f"other {i} text. " * (i + 1), "mine", "yours", "k") for i in range(60)], "doc_id long, text string, score string, _text string, t string").repartition(4)
    told = langid.predict(rows, langs, prob, PIECES, names=("guess", "sure")).collect()
    assert len({(r.guess, r.sure) for r in told if r.doc_id % 3 == 1}) == 1 and len(told) == 60
    assert {(r.score, r._text, r.t) for r in told} == {("mine", "yours", "k")}
    even = np.repeat(prob[:, :1], 2, axis=1)
    assert {(r.lang_pred, r.score) for r in langid.predict(rows.select("doc_id", "text"), ["aa", "bb"], even, PIECES).collect()} == {("aa", 0.5)}
    folder = "/root/testdata/sf0.001"
    model = toxicity.train(table(spark, folder, "documents"), table(spark, folder, "labels"))
    assert len({r.score for r in toxicity.score(rows, model).collect() if r.doc_id % 3 == 1}) == 1
    assert toxicity.score(rows.where("false"), model).count() == 0


def test_toxicity(spark, empty):
    from verdigris.llm.common import table

    folder = "/root/testdata/sf0.01"
    docs, labels = table(spark, folder, "documents"), toxicity.held_out(table(spark, folder, "labels"))
    model = toxicity.train(docs, labels.where("not held_out"))
    got = {r.doc_id: r.score for r in toxicity.score(docs, model).collect()}
    test = [(got[r.doc_id], r.toxic) for r in labels.where("held_out").collect()]
    bad, good = ([s for s, t in test if t == x] for x in (1, 0))
    assert np.mean([[a > b for b in good] for a in bad]) > 0.8
    assert toxicity.train(empty, labels.where("false")) is None
    assert {r.score for r in toxicity.score(docs.limit(5), None).collect()} == {0.0}
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "x " * 100)], "doc_id long, text string")
    assert all(0 <= r.score <= 1 for r in toxicity.score(odd, model).collect())


def test_nearest(spark):
    r = np.random.default_rng(0)
    x = r.normal(size=(400, 16)).astype(np.float32)
    x[100:200] = x[7]
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(1000, None), (1001, [0.0] * 16), (1002, [float("nan")] * 16), (1003, [None] * 16), (1004, [1.0]), (None, x[0].tolist())]
    vectors = nearest.usable(spark.createDataFrame(rows, "vec_id long, embedding array<float>"))
    got = defaultdict(list)
    for g in nearest.search(vectors, vectors.where("id % 50 = 0"), block_rows=100, block_queries=3).orderBy("query_id", "rank").collect():
        got[g.query_id].append((g.vec_id, g.score))
    unit = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    hits = 0
    for q in range(0, 400, 50):
        score = unit @ unit[q]
        best = sorted((i for i in range(400) if i != q), key=lambda i: (-round(score[i], 12), i))[:5]
        hits += len({i for i, _ in got[q]} & set(best))
        assert all(abs(s - score[i]) < 1e-9 for i, s in got[q]) and len(got[q]) == 5
    assert set(got) == set(range(0, 400, 50)) and hits >= 0.9 * 40
    assert nearest.search(vectors.where("false"), vectors.where("false")).count() == 0


def test_segmentations_decode(docs, odd, empty):
    rows = segmentations.encoded(docs, PIECES, digest=True).collect()
    assert all(r.round_trip for r in rows) and len(rows) == docs.count()
    assert all(r.round_trip for r in segmentations.encoded(odd, PIECES, digest=True).collect())
    assert segmentations.encoded(empty, PIECES).count() == 0
    again = {r.doc_id: r.sample_crc32 for r in segmentations.encoded(docs, PIECES, digest=True).collect()}
    assert again == {r.doc_id: r.sample_crc32 for r in rows}


def test_pipeline(spark):
    import corpus_pipeline

    folder = "/root/testdata/sf0.001"
    docs = corpus_pipeline.table(spark, folder, "documents")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = corpus_pipeline.settle(stage(spark, docs, folder))
        assert out.columns == docs.columns and out.count(), name
        docs = out
    last = corpus_pipeline.STAGES[-1][1](spark, docs, folder)
    assert last.count() == docs.count() and "ids" in last.columns
