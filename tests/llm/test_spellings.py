"""Characters without a piece: spelt once for each kind, the same as one at a time."""

import numpy as np
import public_tokenizers
import pyarrow as pa

from verdigris.llm import segmentations
from verdigris.llm.common import Texts

PIECES = public_tokenizers.path("piece_bpe_32k.model")


def test_a_character_is_spelt_once(monkeypatch):
    lat = segmentations.Lattice(PIECES)
    texts = ["𓀀 𓀁 ab " * 50, "", "▁ 𓀀▁x " * 30, "plain", None, "𓀁" * 90]
    rows, ends = lat.rows(Texts(pa.array(texts, pa.string())))
    calls = []
    monkeypatch.setattr(lat, "_raw", lambda c, old=lat._raw: calls.append(c) or old(c))
    drawn = lat.draw(rows, ends, list(range(1, 7)), 3)
    assert len(calls) == len(set(calls)) == 3  # two signs and the mark
    for text, own in zip(texts, drawn, strict=True):
        assert own and all(lat.decode(ids) == (text or "").encode() for ids, *_ in own)
        assert all(x[2] >= y[2] for x, y in zip(own, own[1:], strict=False))


def test_spelt_is_one_at_a_time():
    lat = segmentations.Lattice(PIECES)
    lat.rows(Texts(pa.array(["a𓀀b 𓀁𓀀 word ▁"])))
    edges = np.random.default_rng(0).integers(0, lat.piece.n, 200)
    ids, many = lat.spelt(edges)
    each = [lat.spelt(edges[i : i + 1])[0].tolist() for i in range(len(edges))]
    assert ids.tolist() == [x for xs in each for x in xs] and many.tolist() == [len(x) for x in each]
    assert lat.spelt(edges[:0])[0].tolist() == []
