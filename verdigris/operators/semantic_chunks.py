"""Documents into chunks by length and meaning; each document is independent, so no shuffle.

Sentences fill a chunk until one would make it too long, or until it is long enough and the next sentence
begins another paragraph or is far, by cosine, from the mean of the sentences in the chunk. A heading
always begins a chunk. A chunk that was ended by length or meaning and has several sentences lends its
last one to the next. A short rest goes to the chunk before it. A batch of documents has its sentences
embedded at once, by any function from texts to a matrix.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

# Lengths in characters, the distance, and where paragraphs and sentences end.
TARGET, LARGE, SMALL, FAR = 1000, 1500, 200, 0.40
PARAGRAPH = r"\n\s*\n|────────────────────────────────────────"
SENTENCE = r"(?<!\w\.\w.)(?<![A-Z][a-z]\.)(?<=\.|\?|!)\s"
HEADING = ("# ", "## ", "### ")

Embed = Callable[[list[str]], np.ndarray]
_PARAGRAPH, _SENTENCE = re.compile(PARAGRAPH), re.compile(SENTENCE)


@dataclass(frozen=True)
class Sizes:
    target: int = TARGET
    large: int = LARGE
    small: int = SMALL
    far: float = FAR


def sentences(text: str | None) -> list[tuple[int, str]]:
    """(paragraph, sentence) of a text, white space around them removed."""
    parts = enumerate(p.strip() for p in _PARAGRAPH.split(text or ""))
    return [(n, s) for n, part in parts if part for s in map(str.strip, _SENTENCE.split(part)) if s]


def spans(told: list[tuple[int, str]], vectors: np.ndarray, sizes: Sizes = Sizes()) -> list[list[tuple[int, int]]]:
    """The chunks of a document as ranges of its sentences; only a last one with a short rest has two."""
    ends = np.concatenate([[0], np.cumsum([len(s) + 1 for _, s in told])])
    sums = np.concatenate([np.zeros((1, vectors.shape[1] if len(told) else 1)), np.cumsum(vectors, 0, dtype=np.float64)]) if len(told) else None
    chunks: list[list[tuple[int, int]]] = []
    start = 0
    for i in range(1, len(told)):
        held = int(ends[i] - ends[start])
        if told[i][1].startswith(HEADING):
            chunks.append([(start, i)])
            start = i
        elif held + len(told[i][1]) > sizes.large or (held >= sizes.target and (told[i][0] != told[i - 1][0] or _distance(sums[i] - sums[start], vectors[i]) > sizes.far)):
            chunks.append([(start, i)])
            start = i - 1 if i - start > 1 else i
    if told:
        rest = int(ends[-1] - ends[start]) - 1
        if rest >= sizes.small or not chunks:
            chunks.append([(start, len(told))])
        else:
            chunks[-1].append((start, len(told)))
    return chunks


def _distance(a: np.ndarray, b: np.ndarray) -> float:
    """One minus the cosine; the sum of vectors points where their mean does."""
    size = float(np.sqrt(a @ a) * np.sqrt(b @ b))
    return 1.0 - float(a @ b) / size if size > 0 else 1.0


def hashed_vectors(texts: list[str], size: int = 256) -> np.ndarray:
    """A stand-in for an embedding model: counts of words, each in a place given by its hash."""
    from zlib import crc32

    out = np.zeros((len(texts), size))
    for row, text in zip(out, texts, strict=True):
        for word in re.findall(r"\w+", text.lower()):
            row[crc32(word.encode()) % size] += 1
    return out


def semantic_chunks(docs: DataFrame, embed: Embed, key: str = "id", text: str = "text", sizes: Sizes = Sizes()) -> DataFrame:
    """(key, chunk_index, chunk_text, n_sentences); null and empty texts have no chunk."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            told = [sentences(t) for t in b[text].to_pylist()]
            flat = [s for doc in told for _, s in doc]
            vectors = np.asarray(embed(flat)) if flat else np.zeros((0, 1))
            owner, index, chunk, many, at = [], [], [], [], 0
            for i, doc in enumerate(told):
                found = spans(doc, vectors[at : at + len(doc)], sizes)
                at += len(doc)
                owner += [i] * len(found)
                index += range(len(found))
                chunk += [" ".join(" ".join(s for _, s in doc[x:y]) for x, y in ranges) for ranges in found]
                many += [sum(y - x for x, y in ranges) for ranges in found]
            yield pa.RecordBatch.from_arrays([b[key].take(pa.array(owner, pa.int64())), pa.array(index, pa.int32()), pa.array(chunk, pa.string()), pa.array(many, pa.int32())], [key, "chunk_index", "chunk_text", "n_sentences"])

    return docs.select(key, text).mapInArrow(run, f"`{key}` {dict(docs.dtypes)[key]}, chunk_index int, chunk_text string, n_sentences int")
