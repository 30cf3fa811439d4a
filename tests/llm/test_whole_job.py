"""Places where a bound once left out part of the job."""

import hashlib
import math
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import xxhash

from tests.llm.test_llm_operators import PIECES, shingles
from verdigris.llm import lines, nearest, segmentations
from verdigris.llm.common import Texts

DOCS = "doc_id long, text string, source string, n_chars long"


@pytest.fixture(scope="module")
def short_lines():
    """Short lines that repeat within and across texts, with white space, blank lines, null and repeated ids."""
    rows = [(3, "tiny\nbody of text three\n tiny \n\n"), (1, "All rights reserved.\n\ntinY"), (2, "tiny\nAll rights reserved.\n}\n}"), (None, "}\nfirst"), (2, "other text\nfirst"), (4, None), (5, "\n \n\t")]
    return [(d, t, "s", len(t or "")) for d, t in rows]


def test_short_lines_that_are_equal(spark, short_lines):
    order = sorted(range(len(short_lines)), key=lambda i: (short_lines[i][0] is not None, short_lines[i][0] or 0))
    # rows of one doc_id stand in the order of a hash; here they share no line, so any order gives the same result
    seen, want = set(), []
    for i in order:
        doc, text = short_lines[i][0], short_lines[i][1] or ""
        kept = []
        for line in text.split("\n") if text else []:
            bare = line.strip()
            if not bare or bare not in seen:
                kept.append(line)
            if bare:
                seen.add(bare)
        n = len(text.split("\n")) if text else 0
        want.append((doc, n, n - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    df = spark.createDataFrame(short_lines, DOCS)
    key = lambda x: str(x)
    got = [(x.doc_id, x.n_lines, x.n_removed, x.kept_sha256) for x in lines.report(df).collect()]
    assert sorted(got, key=key) == sorted(want, key=key) and sum(x[2] for x in want) == 6
    assert {x.text for x in lines.deduped(df).collect()} >= {"}\nfirst", "other text"}


def test_stages_with_null_and_repeated_ids(spark):
    """Near-duplicate removal and mixing row by row: exact copies of one id, copies without an id, an id shared with a clean text."""
    import corpus_pipeline

    r = random.Random(6)
    base = [" ".join(f"w{r.randrange(10**6)}" for _ in range(n)) for n in (60, 45, 30, 37, 21)]
    near = base[0].rsplit(" ", 1)[0] + " changed"
    rows = [(1, base[0]), (1, base[0]), (2, near), (2, base[1]), (None, base[0]), (None, base[2]), (None, base[2]), (None, base[3]), (7, base[4]), (7, "two words"), (8, "two words"), (9, " "), (None, " ")]
    df = spark.createDataFrame([(d, t, "en", "s", len(t)) for d, t in rows], "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    sets = [shingles(t) for _, t in rows]
    kept = []
    for i, (d, t) in enumerate(rows):  # here each group's members all link with each other
        group = [rows[j] for j in range(len(rows)) if j == i or sets[i] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j])]
        if (d, t) == min(group, key=lambda x: (x[0] is None, x[0] or 0)):
            kept.append((d, t))
    want = Counter({x: 1 if x[1].strip() else kept.count(x) for x in kept})
    got = Counter((x.doc_id, x.text) for x in corpus_pipeline.near_duplicates(spark, df, "").collect())
    assert got == want and want[2, base[1]] == 1 and want[None, base[2]] == 1 and (2, near) not in want

    def draw(d, t):
        n = len(t.split())
        weight = 1.0 if n >= 20 and 4 * n <= len(t) <= 11 * n else 0.5
        u = int(hashlib.md5(("" if d is None else str(d)).encode()).hexdigest()[:12], 16)
        return (-math.log((u + 1) / 281474976710657.0) / weight, d is not None, d or 0, n)

    size = sum(len(t.split()) for _, t in rows)
    left, want = size // 2, Counter()  # one source: every row once, then half of the words again
    for d, t in sorted(rows, key=lambda x: draw(*x)):
        n = len(t.split())
        if n:
            want[d, t] += 1
        extra = min(n, left)
        left -= extra
        if extra:
            want[d, t if extra == n else " ".join(t.split()[:extra])] += 1
    got = Counter((x.doc_id, x.text) for x in corpus_pipeline.source_mix(spark, df, "").collect())
    assert got == want and any(d is None for d, _ in want)


def lattice_rows(lat, texts):
    return lat.rows(Texts(pa.array(texts, pa.string())))


def run_paths(lat, row):
    """Every path of a run with its log-probability, by walking its edges."""
    out, done = [((), 0.0, int(lat.first.all[row]))], []
    while out:
        path, w, at = out.pop()
        if at < 0:
            done.append((path, w))
            continue
        edges = range(int(lat.edge_at.all[at]), int(lat.edge_at.all[at + 1]))
        out += [((*path, e), w + float(lat.log.all[e]), int(lat.to.all[e])) for e in edges]
    return done


def test_lattice_holds_every_segmentation():
    """A text's lattice against all ways to cut it into pieces, scored apart; spaces, stops and letters without a piece included."""
    lat = segmentations.Lattice(PIECES)
    pieces = {lat.sp.id_to_piece(i): i for i in range(lat.sp.get_piece_size()) if not (lat.sp.is_byte(i) or lat.sp.is_control(i) or lat.sp.is_unknown(i))}
    base = 1 + max(i for i in range(lat.sp.get_piece_size()) if lat.sp.is_byte(i))

    def ways(rest):
        if not rest:
            return {(): 0.0}
        out = {}
        for n in range(1, len(rest) + 1):
            if rest[:n] in pieces:
                i = pieces[rest[:n]]
                out.update(((i, *more), -0.5 * math.log(max(1, i - base + 2)) + w) for more, w in ways(rest[n:]).items())
        if rest[0] not in pieces:
            raw = rest[0].encode()
            out.update(((*(int(lat.byte_ids[x]) for x in raw), *more), lat.byte_score * len(raw) + w) for more, w in ways(rest[1:]).items())
        return out

    for text in ("there an", "a   b", "it's.", "x☃y", "  -- ", "né"):
        want = ways("▁" + text.replace(" ", "▁"))
        total = math.log(sum(math.exp(w) for w in want.values()))
        rows, _ = lattice_rows(lat, [text])
        got = {(): 0.0}
        for r in rows.tolist():
            got = {(*a, *lat.spelt(np.array(p))[0].tolist()): w + v for a, w in got.items() for p, v in run_paths(lat, r)}
        assert got.keys() == want.keys() and all(abs(got[x] - (want[x] - total)) < 1e-4 for x in want), text


def test_every_lattice_path_is_drawn():
    """All segmentations of a text come, each with its own probability, in the order of sampling without replacement."""
    lat = segmentations.Lattice(PIECES)
    rows, ends = lattice_rows(lat, ["there an"])
    every = {(): 0.0}
    for r in rows.tolist():
        every = {(*a, *lat.spelt(np.array(p))[0].tolist()): w + v for a, w in every.items() for p, v in run_paths(lat, r)}
    every = {x: math.exp(w) for x, w in every.items()}
    whole = lat.draw(rows, ends, [5], 10_000)[0]
    assert sorted(tuple(d[0].tolist()) for d in whole) == sorted(every)
    assert all(abs(math.exp(d[1]) - every[tuple(d[0].tolist())]) < 1e-6 for d in whole)
    assert [d[2] for d in whole] == sorted((d[2] for d in whole), reverse=True)
    n = 6000
    keys = [xxhash.xxh3_64_intdigest(str(i)) for i in range(n)]
    drawn = lat.draw(np.tile(rows, n), np.arange(n + 1) * len(rows), keys, 2)
    first, second = Counter(tuple(d[0][0].tolist()) for d in drawn), Counter(tuple(d[1][0].tolist()) for d in drawn)
    for x, p in every.items():
        later = sum(q * p / (1 - q) for y, q in every.items() if y != x)
        assert abs(first[x] / n - p) < 0.025 and abs(second[x] / n - later) < 0.025
    # weighting by inclusion probabilities gives unbiased counts: the sum of 1 / inclusion is the number of segmentations on average
    seen = np.mean([sum(math.exp(d[1] - d[3]) for d in own) for own in drawn])
    assert abs(seen - 1) < 0.05
    again = lat.draw(np.tile(rows, 3), np.arange(4) * len(rows), keys[7:10], 2)
    assert [[x[0].tolist() for x in d] for d in again] == [[x[0].tolist() for x in d] for d in drawn[7:10]]


def test_encoding_is_the_librarys():
    lat = segmentations.Lattice(PIECES)
    r = random.Random(0)
    parts = [" ", "  ", "\n", "\t", "word", "É", "1", ".", ",", "☃", "漢字", "the", "---", "a" * 90]
    texts = ["".join(r.choice(parts) for _ in range(r.randint(0, 12))) for _ in range(500)]
    rows, ends = lattice_rows(lat, texts)
    ids, many = lat.best(rows)
    edge = np.concatenate([[0], np.cumsum(many)])[ends]
    assert [ids[x:y].tolist() for x, y in zip(edge[:-1], edge[1:], strict=True)] == lat.sp.encode(texts)
    odd = ["▁", "a▁b ▁", "\0", "▁▁ ▁"]
    rows, ends = lattice_rows(lat, odd)
    for text, own in zip(odd, lat.draw(rows, ends, [1, 2, 3, 4], 3), strict=True):
        assert all(lat.decode(d[0]) == text.encode() for d in own)


def test_small_memory_gives_the_same_samples():
    """What is kept between portions does not matter."""
    r = random.Random(1)
    texts = [" ".join(r.choice("abcdefgh") * r.randint(1, 9) + "ing" for _ in range(20)) for _ in range(40)]
    big, small = segmentations.Lattice(PIECES), segmentations.Lattice(PIECES, edges=50)
    out = []
    for lat in (big, small):
        own = []
        for a in range(0, 40, 8):
            rows, ends = lattice_rows(lat, texts[a : a + 8])
            own += [[x[0].tolist() for x in d] for d in lat.draw(rows, ends, list(range(a, a + 8)), 3)]
        out.append(own)
    assert out[0] == out[1]


def test_stages_keep_other_columns(spark):
    """Columns called as the stages call theirs stay what they are; empty tables, null texts and repeated rows pass through every stage."""
    import corpus_pipeline

    names = ["score", "lang_pred", "_text", "_row", "_epochs", "_extra", "_size", "_whole", "doc", "k", "r", "c0", "t"]
    shape = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{n} string" for n in names)
    r = random.Random(8)
    vocabulary = ["the", "of", "and", "house", "water", "people", "light", "morning"]
    texts = [" ".join(r.choice(vocabulary) for _ in range(30)) for _ in range(9)] + [None, "", "12 34", "the same\nthe same\nthe end"]
    rows = [(None if i == 3 else i, t, "en", "s" if i % 2 else None, 0, *names) for i, t in enumerate(texts)]
    for docs in (spark.createDataFrame(rows + rows[:4], shape), spark.createDataFrame([], shape)):
        for name, stage in corpus_pipeline.STAGES[:-1]:
            docs = corpus_pipeline.settle(stage(spark, docs, ""))
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars", *names], name
            assert all(getattr(x, n) == n for x in docs.collect() for n in names), name
        assert corpus_pipeline.STAGES[-1][1](spark, docs, "").count() == docs.count()


def test_nearest_with_repeated_ids(spark):
    """Copies of a query's own row take no place of others, and a repeated query asks once."""
    x, far = [1.0, 0.0, 0.0], [0.0, 1.0, 0.5]
    rows = [(50, x)] * 7 + [(100, x), (3, far), (7, far), (7, far), (8, [0.5, 0.5, 0.0])]
    vectors = nearest.usable(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    got = nearest.search(vectors, vectors.where("id % 50 = 0")).orderBy("query_id", "rank").collect()
    assert [(g.query_id, g.rank, g.vec_id) for g in got] == [(50, 1, 100), (50, 2, 8), (50, 3, 3), (50, 4, 7), (100, 1, 50), (100, 2, 8), (100, 3, 3), (100, 4, 7)]
