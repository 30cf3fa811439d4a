"""Operator 2: SentencePiece encoding and decoding with segmentations sampled without replacement.

A text's ids are the model's own encoding. Its lattice holds every vocabulary piece at every place;
characters without a piece are spelt in bytes. Between two characters that no piece holds side
by side every segmentation has a cut, so there the lattice falls apart into runs, exactly: a run's
paths are kept once for all texts, with the backward sums of all of them. A piece is as likely as Zipf's law makes its
rank, raised to ``sharpness``.

Samples are drawn by Gumbel top-k. The search tree's levels are the runs, its leaves the text's
segmentations; what leaves a path at a run is one branch. The backward sums give each branch its whole
mass, and from that the largest perturbed value among its leaves, an exact bound: A-star, expanding the largest value first, reaches leaves in
the order of perturbed log-probability. So the first k leaves are k distinct segmentations drawn
without replacement, and the next value in the queue is the threshold that gives each its inclusion
probability. Random numbers are hashes of the row key and the place, so batches do not matter.

Null texts are encoded as empty: no ids, one empty segmentation, decoded as empty. Decoding gives
back every text exactly: a space mark that stands in a text itself is spelt in bytes. Rows with one doc_id and text draw
the same samples; a null doc_id is a key like others. A text with fewer than k segmentations gives all it has.
"""

from __future__ import annotations

import heapq
import math
import struct
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verdigris.llm.common import HashIndex, Hasher, Texts, WordRows, mix, small_batches
from verdigris.llm.trie import Trie

MARK = "▁"
#: Stands for a mark that is a character of the text; no text decodes to a lone surrogate.
LITERAL = "\ud800"
#: An edge that spells a character in bytes holds this bit and the character's number instead of a piece.
SPELT = 1 << 31
#: Runs of more characters are summed in logarithms, as products of their pieces leave the range of doubles.
LONG = 64
#: Bytes of texts that are worked on at once, edges that are kept for later ones, and characters of new runs at once.
PORTION, EDGES, CELLS = 1 << 19, 2_500_000, 100_000
#: Runs of a text where its path is left first; others are looked at where these cannot hold the largest values. The least exponential number.
HEAD, LEAST = 160, 2.0**-54
#: Paths are counted up to here, which 32-bit floats can hold.
MOST = 1e38
_STEP = np.uint64(0x9E3779B97F4A7C15)


def uniform(keys: np.ndarray) -> np.ndarray:
    """Numbers in (0, 1) from 64-bit keys."""
    return (mix(keys) >> np.uint64(11)).astype(np.float64) * 2.0**-53 + 2.0**-54


class Pool:
    """A growing array."""

    def __init__(self, dtype: type):
        self.all, self.n = np.zeros(1024, dtype), 0

    def add(self, values: np.ndarray) -> None:
        if self.n + len(values) > len(self.all):
            self.all = np.concatenate([self.all[: self.n], np.zeros(self.n // 2 + len(values), self.all.dtype)])
        self.all[self.n : self.n + len(values)] = values
        self.n += len(values)

    def cut(self, n: int) -> None:
        self.all, self.n = self.all[:n].copy(), n


class Lattice:
    """The runs met so far: a run has nodes (its places), a node has edges (the pieces from there)."""

    def __init__(self, model: str, sharpness: float = 0.5, edges: int = EDGES):
        import sentencepiece

        self.sp = sp = sentencepiece.SentencePieceProcessor(model_file=model)
        size = sp.get_piece_size()
        self.sharpness, self.bound = sharpness, edges
        self.bytes_of = [b""] * size
        self.byte_ids = np.zeros(256, np.uint32)
        base, pieces = 0, []
        for i in range(size):
            if sp.is_byte(i):
                value = int(sp.id_to_piece(i)[3:5], 16)
                self.byte_ids[value], self.bytes_of[i] = i, bytes([value])
                base = i + 1
        for i in range(size):
            if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i)):
                pieces.append((sp.id_to_piece(i), i))
                self.bytes_of[i] = pieces[-1][0].replace(MARK, " ").encode()
        if any(MARK in p.lstrip(MARK) for p, _ in pieces):
            raise ValueError("a piece holds a space after another character")
        self.beside = {p[i : i + 2] for p, _ in pieces for i in range(len(p) - 1)}
        # whether a piece may hold one byte after another; bytes beyond ASCII are one kind, within which nothing is cut here
        self.joined = np.zeros((129, 129), bool)
        self.joined[128, 128] = True
        for a, b in self.beside:
            self.joined[ord(" ") if a == MARK else min(ord(a), 128), ord(" ") if b == MARK else min(ord(b), 128)] = True
        self.trie = Trie([p for p, _ in pieces])
        self.numbers = np.array([0, *(i for _, i in pieces)], np.uint32)
        self.scores = np.array([0.0, *(-sharpness * math.log(max(1, i - base + 2)) for _, i in pieces)])
        self.byte_score = -sharpness * (math.log(size) + 5)
        self.lead = sp.encode("\n")  # before a run it keeps the library from adding a mark
        self.spellings = pa.array(self.bytes_of, pa.large_binary())
        self.stretches, self.hashes = WordRows(self._learn, 1 << 40), Hasher()  # bounded with the runs
        self._clear()

    def _clear(self) -> None:
        self.index, self.names = HashIndex(), Pool(np.uint64)
        self.parts = Pool(np.int32)  # the runs of the stretches
        self.first, self.ids_at = Pool(np.int32), Pool(np.int32)  # of each run: first node, first id of the encoding; a last entry ends the last run
        self.ids = Pool(np.uint32)
        self.edge_at, self.ways = Pool(np.int32), Pool(np.float32)  # of each node: first edge, paths from here
        self.to, self.piece, self.cum, self.log = Pool(np.int32), Pool(np.uint32), Pool(np.float32), Pool(np.float32)
        for p in (self.first, self.ids_at, self.edge_at):
            p.add(np.zeros(1, np.int64))

    def halve(self) -> None:
        """Forget the later half of the runs, and the stretches that need them: the first met are the most frequent."""
        half = self.index.many // 2
        nodes = int(self.first.all[half])
        edges, ids = int(self.edge_at.all[nodes]), int(self.ids_at.all[half])
        for pools, n in (((self.names,), half), ((self.first, self.ids_at), half + 1), ((self.ids,), ids), ((self.edge_at,), nodes + 1), ((self.ways,), nodes), ((self.to, self.piece, self.cum, self.log), edges)):
            for pool in pools:
                pool.cut(n)
        self.index = HashIndex(max(14, int(4 * half).bit_length()))
        self.index.add(self.names.all[:half], np.arange(half))
        late = np.flatnonzero(self.parts.all[: self.parts.n] >= half)
        self.parts.cut(int(late[0]) if len(late) else self.parts.n)
        stretches = self.stretches.rows[: self.stretches.index.many].sum(1)
        self.stretches.keep(int(np.searchsorted(stretches, self.parts.n, "right")))

    def _store(self, raw: list[bytes], names: np.ndarray) -> None:
        """Nodes, edges and encodings of new runs, as many at a time as have about ``CELLS`` characters."""
        text = b"".join(raw).decode("utf-8", "surrogatepass")
        chars = np.frombuffer(text.replace(" ", MARK).encode("utf-32-le", "surrogatepass"), np.uint32)
        data = np.frombuffer(b"".join(raw), np.uint8)
        stops = np.cumsum(np.array(list(map(len, raw)), np.int64))
        size = np.diff(np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)[stops - 1]]))
        order = np.argsort(size, kind="stable")
        at = np.cumsum(size) - size
        own = np.cumsum(size[order])
        a, short = 0, int(np.searchsorted(size[order], LONG, "right"))
        while a < len(order):
            b = max(a + 1, int(np.searchsorted(own, (own[a - 1] if a else 0) + CELLS, "right")))
            b = min(b, short) if a < short else b
            part = order[a:b]
            n = size[part]
            self._build(chars[np.repeat(at[part] - np.cumsum(n) + n, n) + np.arange(int(n.sum()))], n, a >= short)
            a = b
        have = self.index.many
        self.index.add(names[order], np.arange(have, have + len(order)))
        self.names.add(names[order])
        self._encode([raw[i] for i in order.tolist()], int(np.searchsorted(size[order], 1, "right")))

    def _encode(self, raw: list[bytes], single: int) -> None:
        """The model's encoding of runs, the first ``single`` of one character. No piece holds a line feed, so the others go many in a call with one before each."""
        cut, feed = len(self.lead), self.lead[-1]
        one = [r.decode("utf-8", "surrogatepass") for r in raw[:single]]
        ids = [self._raw(MARK) if r == LITERAL else self.sp.encode("\n" + r)[cut:] for r in one]
        out = [(np.array([x for own in ids for x in own], np.uint32), np.array(list(map(len, ids)), np.int64))]
        for a in range(single, len(raw), 1024):
            found = np.array(self.sp.encode(b"\n".join([b"", *raw[a : a + 1024]]).decode()), np.uint32)[cut - 1 :]
            between = found == feed
            out.append((found[~between], np.diff(np.append(np.flatnonzero(between), len(found))) - 1))
        for found, many in out:
            self.ids_at.add(self.ids.n + np.cumsum(many))
            self.ids.add(found)

    def _raw(self, character: str) -> list[int]:
        return [int(self.byte_ids[x]) for x in character.encode()]

    def _build(self, chars: np.ndarray, size: np.ndarray, long: bool) -> None:
        """Nodes and edges of runs in ascending size, whose characters stand in a row. A node has its longest piece first."""
        stop = np.cumsum(size + 1) - 1  # of each run the last node, which ends it
        nodes, runs = int(stop[-1]) + 1, len(size)
        inside = np.ones(nodes, bool)
        inside[stop] = False
        source, width, found, rank, many = self.trie.edges(chars, inside)
        ends = np.cumsum(many)
        at = ends[source] - 1 - rank
        order = np.empty_like(at)
        order[at] = np.arange(len(at))
        source, target, found = source[order], (source + width)[order], found[order]
        own = self.scores[found]
        piece = self.numbers[found]
        spelt = np.flatnonzero(found == 0)
        if len(spelt):
            owner = np.searchsorted(stop, source[spelt])
            codes = chars[source[spelt] - owner]
            codes = np.where(codes == ord(LITERAL), ord(MARK), codes)
            own[spelt] = self.byte_score * (1 + (codes > 0x7F) + (codes > 0x7FF) + (codes > 0xFFFF))
            piece[spelt] = SPELT | codes
        back, ways = np.zeros(nodes), np.zeros(nodes)
        back[stop], ways[stop] = 0 if long else 1, 1
        # places before the end, from the last: those of one distance have their edges summed together
        far = int(size[-1])
        distance = np.repeat(stop, size + 1) - np.arange(nodes)
        level = distance[source]
        by = np.argsort(level.astype(np.uint16) if far < 1 << 16 else level, kind="stable")
        edge_of = np.searchsorted(level[by], np.arange(1, far + 2)).tolist()
        with_them = np.searchsorted(size, np.arange(1, far + 1)).tolist()  # the first run that is so long
        run = np.repeat(np.arange(runs), size + 1)[source[by]]
        to, weight = target[by], own[by] if long else np.exp(own[by])
        with np.errstate(over="ignore"):
            for n, (a, b, first) in enumerate(zip(edge_of[:-1], edge_of[1:], with_them, strict=True), 1):
                which, place = run[a:b] - first, stop[first:] - n
                ways[place] = np.bincount(which, ways[to[a:b]])
                if long:
                    value = weight[a:b] + back[to[a:b]]
                    top = np.full(len(place), -np.inf)
                    np.maximum.at(top, which, value)
                    back[place] = top + np.log(np.bincount(which, np.exp(value - top[which])))
                else:
                    back[place] = np.bincount(which, weight[a:b] * back[to[a:b]])
        if not long:
            back = np.log(back)
        logs = np.minimum(own + back[target] - back[source], 0)
        share = np.cumsum(np.exp(logs))
        start = np.concatenate([[0.0], share])[ends - many]
        cum = share - np.repeat(start, many)
        cum[ends[many > 0] - 1] = 2  # no draw goes past a node's last edge
        self.to.add(np.where(inside[target], target + self.ways.n, -1))  # -1: the run's end
        self.edge_at.add(self.piece.n + ends)
        self.first.add(self.ways.n + stop + 1)
        self.piece.add(piece)
        self.cum.add(cum)
        self.log.add(logs)
        self.ways.add(np.minimum(ways, MOST))

    def _runs(self, stretch: bytes) -> list[str]:
        """The runs of a stretch of a text; short ones may as well be cut less often. A mark of the text is ``LITERAL``."""
        text = stretch.decode()
        if MARK in text or len(text) > LONG:
            text = text.replace(MARK, LITERAL).replace(" ", MARK)
            edge = [0, *(i for i in range(1, len(text)) if text[i - 1 : i + 1] not in self.beside), len(text)]
            text = text.replace(MARK, " ")
            return [text[x:y] for x, y in zip(edge[:-1], edge[1:], strict=True)]
        return [text]

    def _learn(self, stretches: list[bytes]) -> np.ndarray:
        """Where the runs of each stretch begin in ``parts``, and how many they are."""
        mark, many = MARK.encode(), np.ones(len(stretches), np.int64)
        raw, done = [], 0
        for k in [k for k, s in enumerate(stretches) if len(s) > LONG or mark in s]:  # others are one run
            runs = self._runs(stretches[k])
            many[k] = len(runs)
            raw += stretches[done:k]
            raw += [r.encode("utf-8", "surrogatepass") for r in runs]
            done = k + 1
        raw += stretches[done:]
        stops = np.cumsum(np.array(list(map(len, raw)), np.int64))
        names = self.hashes(np.frombuffer(b"".join(raw), np.uint8), np.append(0, stops[:-1]), stops) if raw else np.zeros(0, np.uint64)
        new = np.flatnonzero(self.index.find(names) < 0)
        if len(new):
            _, first = np.unique(names[new], return_index=True)
            new = new[np.sort(first)]
            self._store([raw[i] for i in new.tolist()], names[new])
        out = np.stack([self.parts.n + np.cumsum(many) - many, many], 1)
        self.parts.add(self.index.find(names))
        return out

    def rows(self, texts: Texts) -> tuple[np.ndarray, np.ndarray]:
        """The runs of all texts in a row, and where each text's begin and the last one's end."""
        if self.piece.n > self.bound:
            self.halve()
        lead = texts.ends[:-1] < texts.ends[1:]  # a mark goes before each text that is not empty
        data = np.insert(texts.data, texts.ends[:-1][lead], ord(" "))
        ends = texts.ends + np.concatenate([[0], np.cumsum(lead)])
        kind = np.minimum(data, 128)
        head = np.zeros(len(data) + 1, bool)
        head[1:-1] = ~self.joined[kind[:-1], kind[1:]]
        head[ends[:-1][lead]] = True
        starts = np.flatnonzero(head[:-1])
        if not len(starts):
            return starts, np.zeros(len(ends), np.int64)
        stops = np.append(starts[1:], len(data))
        at = self.stretches(data, starts, stops, self.hashes(data, starts, stops))
        where = self.stretches.rows[at]
        many = where[:, 1]
        total = np.cumsum(many)
        flat = self.parts.all[np.repeat(where[:, 0] - total + many, many) + np.arange(int(many.sum()))].astype(np.int64)
        return flat, np.concatenate([[0], total])[np.searchsorted(starts, ends)]

    def best(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the model's encoding of all ``rows``, and how many each has."""
        at, many = self.ids_at.all[rows].astype(np.int64), self.ids_at.all[rows + 1].astype(np.int64) - self.ids_at.all[rows]
        total = np.cumsum(many)
        return self.ids.all[np.repeat(at - total + many, many) + np.arange(int(many.sum()))], many

    def walk(self, rows: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """A path drawn for each of ``rows``: edges of all, how many each has, log-probabilities. ``keys`` seed the draws."""
        at = self.first.all[rows]
        alive, seeds = np.arange(len(rows)), keys
        taken, many = [], np.zeros(len(rows), np.int64)
        step = 0
        while len(alive):
            if step < 2:  # half of the key each
                draw = ((seeds >> np.uint64(32 * step)) & np.uint64(0xFFFFFFFF)).astype(np.float64) * 2.0**-32
            else:
                draw = uniform(seeds ^ mix(np.array([step], np.uint64)))
            edge = self.edge_at.all[at].astype(np.int64)
            on = np.flatnonzero(draw >= self.cum.all[edge])
            wanted = draw[on]
            while len(on):
                tried = edge[on] + 1
                edge[on] = tried
                more = np.flatnonzero(wanted >= self.cum.all[tried])
                on, wanted = on[more], wanted[more]
            taken.append((alive, edge))
            many[alive] = step + 1
            at = self.to.all[edge]
            more = np.flatnonzero(at >= 0)
            alive, at, seeds, step = alive[more], at[more], seeds[more], step + 1
        start = np.cumsum(many) - many
        out = np.empty(int(many.sum()), np.int64)
        for i, (alive, edge) in enumerate(taken):
            out[start[alive] + i] = edge
        logs = np.add.reduceat(self.log.all[out], start, dtype=np.float64) if len(rows) else np.zeros(0)
        return out, many, logs

    def other(self, row: int, barred: list[tuple[int, ...]], key: int) -> tuple[tuple[int, ...], float]:
        """A path of the run drawn from all but ``barred`` (edges), and its log-probability among all paths."""
        paths = [(p, math.exp(float(self.log.all[list(p)].sum(dtype=np.float64)))) for p in barred]
        at, path, logp = int(self.first.all[row]), (), 0.0
        while at >= 0:
            low, high = int(self.edge_at.all[at]), int(self.edge_at.all[at + 1])
            edges, logs, to = range(low, high), self.log.all[low:high].tolist(), self.to.all[low:high].tolist()
            mass = [max(math.exp(logp + x), 1e-300) for x in logs]
            for i in {p[len(path)] - low for p, _ in paths}:
                gone = [q for p, q in paths if p[len(path)] == edges[i]]
                if len(gone) >= (self.ways.all[to[i]] if to[i] >= 0 else 1):
                    mass[i] = 0.0
                else:
                    mass[i] = max(math.exp(logp + logs[i]) - sum(gone), 1e-300)
            pick = xxhash.xxh3_64_intdigest(struct.pack("<QI", key, len(path))) / 2.0**64 * sum(mass)
            chosen = max(i for i, m in enumerate(mass) if m > 0)
            for i, m in enumerate(mass):
                if m > 0 and pick < m:
                    chosen = i
                    break
                pick -= m
            e = edges[chosen]
            paths = [(p, q) for p, q in paths if p[len(path)] == e]
            path, logp, at = (*path, e), logp + logs[chosen], to[chosen]
        return path, logp

    def spelt(self, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of edges, and how many each has."""
        ids, many = self.piece.all[edges], np.ones(len(edges), np.int64)
        raw = np.flatnonzero(ids & np.uint32(SPELT))
        if len(raw):
            codes, which = np.unique(ids[raw] & np.uint32(~SPELT & 0xFFFFFFFF), return_inverse=True)
            spellings = [self._raw(chr(x)) for x in codes.tolist()]
            sizes = np.array([len(s) for s in spellings], np.int64)
            own = many[raw] = sizes[which]
            ids = np.repeat(ids, many)
            within = np.arange(int(own.sum())) - np.repeat(np.cumsum(own) - own, own)
            place = np.repeat(np.cumsum(many)[raw] - own, own) + within
            ids[place] = np.array([x for s in spellings for x in s], np.uint32)[np.repeat((np.cumsum(sizes) - sizes)[which], own) + within]
        return ids, many

    def _ways(self, rows: np.ndarray | int) -> np.ndarray:
        """How many paths runs have."""
        return self.ways.all[self.first.all[rows]]

    def _cuts(self, logs: np.ndarray, open_: np.ndarray, keys: np.ndarray, values: np.ndarray, before: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Texts x runs: the perturbed value, less its sign, of what leaves a text's path at a run (infinite where not ``open_``); and each path's log-probability up to the last run.

        ``logs`` are those of the path's runs, ``before`` is what comes before them, ``values`` the perturbed values of the paths.
        """
        total = np.cumsum(np.concatenate([before[:, None], logs], 1), 1)
        cuts = np.full(logs.shape, np.inf)
        own, run = np.nonzero(open_)
        loc = np.log(np.maximum(-np.expm1(logs[own, run]), 1e-12)) + total[own, run]
        noise = np.maximum(-np.log(uniform(keys[own, run] ^ _STEP)), LEAST)  # exponential numbers
        cuts[own, run] = np.logaddexp(-values[own], np.log(noise) - loc)
        return cuts, total[:, -1]

    def draw(self, rows: np.ndarray, ends: np.ndarray, keys: list[int], k: int) -> list[list[tuple[np.ndarray, float, float, float]]]:
        """For each text up to k distinct segmentations out of all: (ids, log-probability, perturbed value, log inclusion probability).

        What leaves a segmentation at a run is one branch, all other paths of that run with anything
        after it; when the search reaches it, it gives one of these paths and what is then left of it.
        Texts are searched together, a found segmentation each at a time.
        """
        n = len(keys)
        seeds = np.array(keys, np.uint64)
        tops = (-np.log(-np.log(uniform(seeds ^ np.uint64(1))))).tolist()
        queues: list[list[tuple]] = [[] for _ in range(n)]
        found: list[list[tuple]] = [[] for _ in range(n)]
        jobs = [(i, int(ends[i]), None, None, None) for i in range(n)]  # text, first run to draw, the leaf it continues, its path there, value
        for turn in range(k):
            texts, lows = np.array([j[0] for j in jobs], np.int64), np.array([j[1] for j in jobs], np.int64)
            many = ends[texts + 1] - lows
            stop = np.cumsum(many)
            flat = np.repeat(lows - stop + many, many) + np.arange(int(many.sum()))
            place = mix(np.repeat(seeds[texts] - ends[texts].astype(np.uint64) * _STEP + np.uint64(turn), many) + flat.astype(np.uint64) * _STEP)
            edges, sizes, logs = self.walk(rows[flat], place)
            edge_stop = np.concatenate([[0], np.cumsum(sizes)])[stop] if len(stop) else stop
            reach = k - turn  # of a text, no more can be reached
            leaves = []
            a = b = 0
            for job, x, y in zip(jobs, stop.tolist(), edge_stop.tolist(), strict=True):
                i, low, old, path, value = job
                t = low - int(ends[i])  # the first run that is new
                if old is None:
                    value = tops[i]
                    leaf = (edges[b:y], sizes[a:x], logs[a:x])
                else:
                    before = int(old[1][: t - 1].sum())
                    leaf = (np.concatenate([old[0][:before], path[0], edges[b:y]]), np.concatenate([old[1][: t - 1], [len(path[0])], sizes[a:x]]), np.concatenate([old[2][: t - 1], [path[1]], logs[a:x]]))
                leaves.append((i, t, leaf, value, float(leaf[2][:t].sum()), a, x))
                a, b = x, y
            near = np.minimum(np.arange(HEAD), np.maximum(many - 1, 0)[:, None]) + (stop - many)[:, None] if len(flat) else np.zeros((len(jobs), 0), np.int64)
            near = np.minimum(near, len(flat) - 1)
            heads = self._cuts(logs[near], (self._ways(rows[flat[near]]) > 1) & (np.arange(near.shape[1]) < many[:, None]), place[near], np.array([x[3] for x in leaves]), np.array([x[4] for x in leaves]))
            done = []
            for (i, first, leaf, value, before, a, x), cut, rest in zip(leaves, *heads, strict=True):
                found[i].append((leaf, float(leaf[2].sum()), value))
                done.append(i)
                if x == a:
                    continue
                cut = cut[: x - a]
                # what leaves the path later has no more mass than all from there, so a perturbed value below this
                if x - a > HEAD and (reach > HEAD or np.partition(cut, reach - 1)[reach - 1] >= np.logaddexp(-value, math.log(LEAST) - rest)):
                    cut = self._cuts(logs[None, a:x], self._ways(rows[None, flat[a:x]]) > 1, place[None, a:x], np.array([value]), np.array([before]))[0][0]
                top = [int(cut.argmin())] if reach == 1 else np.argpartition(cut, reach)[:reach].tolist() if len(cut) > reach else range(len(cut))
                for t in top:
                    if cut[t] < np.inf:
                        heapq.heappush(queues[i], (float(cut[t]), len(found[i]), first + t, leaf, None))
            jobs = []
            if turn == k - 1:
                break
            for i in done:
                if not queues[i]:
                    continue
                minus, _, t, old, barred = heapq.heappop(queues[i])
                row = int(rows[ends[i] + t])
                if barred is None:
                    at = int(old[1][:t].sum())
                    barred = [tuple(old[0][at : at + int(old[1][t])].tolist())]
                path, logp = self.other(row, barred, xxhash.xxh3_64_intdigest(struct.pack("<QQI", keys[i], t, turn)))
                barred = [*barred, path]
                if len(barred) < self._ways(row):
                    left = max(1.0 - sum(math.exp(float(self.log.all[list(p)].sum(dtype=np.float64))) for p in barred), 1e-12)
                    loc = float(old[2][:t].sum()) + math.log(left)
                    e = math.log(-math.log((xxhash.xxh3_64_intdigest(struct.pack("<QQQ", keys[i], t, turn)) + 0.5) / 2.0**64))
                    heapq.heappush(queues[i], (-float(loc - np.logaddexp(loc + minus, e)), len(found[i]) + 1000, t, old, barred))
                jobs.append((i, int(ends[i]) + t + 1, old, (np.array(path, np.int64), logp), -minus))
        flat, many = self.spelt(np.concatenate([leaf[0] for own in found for leaf, _, _ in own]) if n else np.zeros(0, np.int64))
        out, at, stop = [], 0, np.concatenate([[0], np.cumsum(many)])
        first = 0
        for i in range(n):
            edge = -queues[i][0][0] if queues[i] else -np.inf
            own = []
            for leaf, logp, value in found[i]:
                gap = min(logp - edge, 30.0)
                at, first = first, first + len(leaf[0])
                own.append((flat[stop[at] : stop[first]], logp, value, math.log(-math.expm1(-math.exp(gap))) if gap > -30 else gap))
            out.append(own)
        return out

    def decode(self, ids: np.ndarray) -> bytes:
        """The text that ids spell; the first mark is no space of it."""
        return self._bytes(ids)[0].tobytes()[1:]

    def _bytes(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        _, at, data = self.spellings.take(pa.array(ids.astype(np.int32, copy=False))).buffers()
        total = np.frombuffer(at, np.int64)[1 : len(ids) + 1]
        return np.frombuffer(data, np.uint8)[: total[-1]] if len(ids) else np.zeros(0, np.uint8), total

    def decodes_to(self, ids: list[np.ndarray], texts: list[bytes]) -> list[bool]:
        """Whether ids spell the text of the same number, for all at once."""
        data, total = self._bytes(np.concatenate(ids) if ids else np.zeros(0, np.uint32))
        stop = np.concatenate([[0], total])[np.cumsum([len(x) for x in ids])] if ids else []
        raw, out, a = data.tobytes(), [], 0
        for b, text in zip(stop, texts, strict=True):
            out.append(raw[a + 1 : b] == text)
            a = int(b)
        return out


_LATTICES: dict[tuple[str, float], Lattice] = {}


def lattice(model: str, sharpness: float) -> Lattice:
    """One for each Python worker; ``EDGES`` bounds what it keeps to about 100 MB."""
    if (model, sharpness) not in _LATTICES:
        _LATTICES[model, sharpness] = Lattice(model, sharpness)
    return _LATTICES[model, sharpness]


IDS = "ids array<int>, samples array<struct<ids:array<int>,log_prob:double,perturbed:double,log_inclusion:double>>"
DIGEST = "n_tokens long, ids_crc32 long, sample_tokens array<bigint>, sample_crc32 array<bigint>, log_prob array<double>, log_inclusion array<double>, round_trip boolean"


def portions(column: pa.Array) -> Iterator[tuple[int, Texts]]:
    """The texts of a batch, at most about ``PORTION`` bytes at a time, with the number of the first."""
    sizes = Texts(column).ends
    a = 0
    while a < len(column):
        b = max(a + 1, int(np.searchsorted(sizes, sizes[a] + PORTION, "right")) - 1)
        yield a, Texts(column.slice(a, b - a))
        a = b


def encoded(docs: DataFrame, model: str, k: int = 3, sharpness: float = 0.5, seed: int = 0, digest: bool = False) -> DataFrame:
    """doc_id with the ids and the samples of every row, or with their lengths, checksums and whether all decode to the text."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lat = lattice(model, sharpness)
        yield from told(lat, batches)
        while lat.piece.n > EDGES // 4:  # other tasks of this worker need memory too
            lat.halve()

    def told(lat: Lattice, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys = [xxhash.xxh3_64_intdigest(f"{seed}|{key}") for key in b["doc_id"].to_pylist()]
            out: list[tuple] = []
            for a, texts in portions(b["text"]):
                rows, ends = lat.rows(texts)
                flat, many = lat.best(rows)
                edge = np.concatenate([[0], np.cumsum(many)])[ends]
                every = lat.draw(rows, ends, keys[a : a + len(ends) - 1], k)
                ids = [[flat[edge[i] : edge[i + 1]], *(d[0] for d in drawn)] for i, drawn in enumerate(every)]
                if digest:
                    raw = texts.data.tobytes()
                    own = [raw[x:y] for x, y in zip(texts.ends[:-1].tolist(), texts.ends[1:].tolist(), strict=True)]
                    good = iter(lat.decodes_to([x for xs in ids for x in xs], [t for xs, t in zip(ids, own, strict=True) for _ in xs]))
                    for xs, drawn in zip(ids, every, strict=True):
                        crc = [zlib.crc32(x.astype("<u4", copy=False)) for x in xs]
                        out.append((len(xs[0]), crc[0], [len(x) for x in xs[1:]], crc[1:], [d[1] for d in drawn], [d[3] for d in drawn], all([next(good) for _ in xs])))
                else:
                    out += [(xs[0], [{"ids": x, "log_prob": d[1], "perturbed": d[2], "log_inclusion": d[3]} for x, d in zip(xs[1:], drawn, strict=True)]) for xs, drawn in zip(ids, every, strict=True)]
            columns = list(zip(*out, strict=True)) if out else [[] for _ in types]
            yield pa.RecordBatch.from_arrays([b["doc_id"], *(pa.array(list(c), t) for c, t in zip(columns, types, strict=True))], names=["doc_id", *names])

    real, whole, longs, reals = pa.float64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.float64())
    if digest:
        types = [whole, whole, longs, longs, reals, reals, pa.bool_()]
        names = ["n_tokens", "ids_crc32", "sample_tokens", "sample_crc32", "log_prob", "log_inclusion", "round_trip"]
    else:
        numbers = pa.list_(pa.int32())
        types = [numbers, pa.list_(pa.struct([("ids", numbers), ("log_prob", real), ("perturbed", real), ("log_inclusion", real)]))]
        names = ["ids", "samples"]
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, f"doc_id long, {DIGEST if digest else IDS}")
