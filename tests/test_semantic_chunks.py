"""Semantic chunks against a loop that keeps the open chunk as a list."""

import random

import numpy as np
import pytest

from verdigris.operators import semantic_chunks as C


def plain(text, embed, sizes):
    told = C.sentences(text)
    vectors = embed([s for _, s in told]) if told else []
    chunks, held, block = [], [], None
    for i, (p, s) in enumerate(told):
        head = s.startswith("# ") or s.startswith("## ") or s.startswith("### ")
        if held and head:
            chunks.append(" ".join(x for x, _ in held))
            held, block = [(s, i)], p
            continue
        if held:
            size = sum(len(x) + 1 for x, _ in held)
            mean = np.mean([vectors[j] for _, j in held], axis=0)
            norm = np.linalg.norm(mean) * np.linalg.norm(vectors[i])
            far = 1 - (mean @ vectors[i] / norm if norm > 0 else 0)
            if size + len(s) > sizes.large or (size >= sizes.target and (far > sizes.far or p != block)):
                chunks.append(" ".join(x for x, _ in held))
                held = held[-1:] if len(held) > 1 else []
        held.append((s, i))
        block = p
    if held:
        last = " ".join(x for x, _ in held)
        if len(last) >= sizes.small or not chunks:
            chunks.append(last)
        else:
            chunks[-1] += " " + last
    return chunks


@pytest.mark.parametrize("seed", range(4))
def test_against_a_loop(spark, seed):
    r = random.Random(seed)
    words = "gradient descent cat dog banana apple matrix vector sea ship e.g. Dr. U.S. fine".split()

    def text():
        out = ""
        for _ in range(r.choice([0, 1, 4, 40])):
            out += r.choice(["", "", "# Title here.", "## Part. "]) + " ".join(r.choice(words) for _ in range(r.choice([1, 6, 25]))) + r.choice([". ", "! ", "?\n", ".\n\n", "\n \n"])
        return out

    sizes = C.Sizes(100, 160, 40, 0.4)
    rows = [(i, text()) for i in range(25)] + [(90, None), (91, ""), (92, " \n\n "), (93, "x" * 5000), (94, "One. " * 3000)]
    got = {}
    for x in C.semantic_chunks(spark.createDataFrame(rows, "id long, text string").repartition(3), C.hashed_vectors, sizes=sizes).orderBy("id", "chunk_index").collect():
        got.setdefault(x.id, []).append(x.chunk_text)
    assert got == {i: plain(t, C.hashed_vectors, sizes) for i, t in rows if C.sentences(t)}
    assert any(len(v) > 3 for v in got.values())


def test_meaning_ends_a_chunk():
    told = [(0, f"cat cat cat {i:03d}.") for i in range(9)] + [(0, f"ship ship ship {i:03d}.") for i in range(9)]
    vectors = np.array([[1.0, 0.0]] * 9 + [[0.0, 1.0]] * 9)
    assert C.spans(told, vectors, C.Sizes(60, 10_000, 10, 0.6)) == [[(0, 9)], [(8, 18)]]  # the last cat is lent to the ships
    assert C.spans([], np.zeros((0, 2))) == []
