"""Segmentations: what a worker keeps stays small, and a text's branches are valued where its path is likely to be left."""

import random
import tracemalloc

import numpy as np
import public_tokenizers
import pyarrow as pa

from verdigris.llm import segmentations
from verdigris.llm.common import Texts

PIECES = public_tokenizers.path("piece_bpe_32k.model")


def test_many_words_stay_in_memory():
    """200,000 distinct words in small portions; before, their lattices took more than 200 MB."""
    r = random.Random(3)
    words = ["".join(r.choices("etaoinshrdlu", k=11)) for _ in range(200_000)]
    lat = segmentations.Lattice(PIECES)
    tracemalloc.start()
    for a in range(0, len(words), 10_000):
        rows, ends = lat.rows(Texts(pa.array([" ".join(words[a : a + 10_000])])))
    ids, _ = lat.best(rows)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert ids.tolist() == lat.sp.encode(" ".join(words[-10_000:]))
    assert peak < 180e6


def test_branches_of_the_first_runs_are_enough(monkeypatch):
    """The same samples as from all runs of long texts, from random numbers for few of them; runs of one path do not count."""
    lat = segmentations.Lattice(PIECES)
    r = random.Random(4)
    texts = [" ".join(r.choice(["there", "an", "internationalization", "it's", "☃"]) for _ in range(n)) for n in (0, 1, 3000, 500)] + ["☃" * 2000 + " there", "☃" * 300]
    rows, ends = lat.rows(Texts(pa.array(texts)))
    drawn = []
    monkeypatch.setattr(segmentations, "uniform", lambda x, old=segmentations.uniform: drawn.append(x.size) or old(x))
    monkeypatch.setattr(lat, "walk", lambda *a, old=lat.walk: (old(*a), drawn.append(-sum(drawn)))[0])  # numbers of walks aside
    some = lat.draw(rows[: ends[4]], ends[:5], [1, 2, 3, 4], 3)
    monkeypatch.undo()
    assert 0 < sum(drawn) < int(ends[4]) // 4
    some = lat.draw(rows, ends, list(range(6)), 3)
    monkeypatch.setattr(segmentations, "HEAD", 1 << 20)
    every = lat.draw(rows, ends, list(range(6)), 3)
    for a, b, text in zip(some, every, texts, strict=True):
        assert [x[0].tolist() for x in a] == [x[0].tolist() for x in b] and np.allclose([x[1:] for x in a], [x[1:] for x in b], atol=1e-9)
        assert all(lat.decode(x[0]) == text.encode() for x in a)
