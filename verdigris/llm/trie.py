"""A trie of short strings as a transition table, walked for many words at once."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np


class Trie:
    """Strings are numbered from 1 in the order given; letters that none of them has are number 0.

    Letters that are strings of their own and in no longer one need no transitions: they have numbers past the table's.
    """

    def __init__(self, strings: list[str]):
        inner = sorted({c for p in strings if len(p) > 1 for c in p})
        self.longest = max(map(len, strings), default=1)
        self.letters = {c: i + 1 for i, c in enumerate(inner)}
        self.inner = len(inner)
        alone = [(p, n) for n, p in enumerate(strings, 1) if len(p) == 1 and p not in self.letters]
        self.letters.update((p, self.inner + 1 + i) for i, (p, _) in enumerate(alone))
        self.alone = np.array([0, *(n for _, n in alone)], np.int32)
        self.number = np.zeros(0x110000, np.int16)
        for c, i in self.letters.items():
            self.number[ord(c)] = i
        nodes: list[dict[int, int]] = [{}, {}]  # 0 is dead, 1 the root
        ends = [0, 0]
        for n, p in enumerate(strings, 1):
            if self.letters[p[0]] > self.inner:
                continue
            at = 1
            for c in p:
                nxt = nodes[at].get(self.letters[c])
                if nxt is None:
                    nxt = nodes[at][self.letters[c]] = len(nodes)
                    nodes.append({})
                    ends.append(0)
                at = nxt
            ends[at] = n
        # nodes with a way on come first, so that the table needs no rows for the others
        order = [0, 1, *(i for i in range(2, len(nodes)) if nodes[i]), *(i for i in range(2, len(nodes)) if not nodes[i])]
        number = {old: new for new, old in enumerate(order)}
        self.ends = np.array([ends[i] for i in order], np.int32)
        self.open = 2 + sum(map(bool, nodes[2:]))
        self.next = np.zeros((self.open, self.inner + 1), np.int32)
        for i in order[1 : self.open]:
            for c, to in nodes[i].items():
                self.next[number[i], c] = number[to]

    def codes(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Letter numbers of the words, and their lengths."""
        size = np.array([len(w) for w in words], np.int64)
        out = np.zeros((len(words), int(size.max(initial=1)) + self.longest), np.int32)
        out[np.arange(out.shape[1]) < size[:, None]] = self.number[np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32)]
        return out, size

    def spans(self, codes: np.ndarray, size: np.ndarray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """(start, end, words, string numbers), by start, for every span that is a string, or one letter that is none (0)."""
        plain = np.where(codes <= self.inner, codes, 0)
        for i in range(int(size.max(initial=0))):
            live = np.flatnonzero(size > i)
            own = codes[live, i]
            state = self.next[1, plain[live, i]]
            yield i, i + 1, live, np.where(own > self.inner, self.alone[np.maximum(own - self.inner, 0)], self.ends[state])
            for j in range(i + 2, i + 1 + self.longest):
                keep = (state > 0) & (state < self.open)
                live, state = live[keep], state[keep]
                if not len(live):
                    break
                state = self.next[state, plain[live, j - 1]]
                found = self.ends[state]
                hit = found > 0
                yield i, j, live[hit], found[hit]

    def edges(self, chars: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """All spans as ``spans`` gives them, of many words in a row: place, length, string number, which of its place's by length, and each place's count.

        ``chars`` are the words' code points; places are theirs and one behind each word, where ``inside`` is false.
        """
        source = np.flatnonzero(inside)
        own = self.number[chars].astype(np.int64)
        plain = np.zeros(len(inside) + self.longest, np.int64)
        plain[source] = np.where(own <= self.inner, own, 0)
        flat, row = self.next.ravel(), self.inner + 1
        state = flat[row + plain[source]]
        found = [np.where(own > self.inner, self.alone[np.maximum(own - self.inner, 0)], self.ends[state])]
        starts, rank = [source], [np.zeros(len(source), np.int64)]
        many = inside.astype(np.int64)
        width = [1]
        for n in range(2, 1 + self.longest):
            on = np.flatnonzero((state > 0) & (state < self.open))
            if not len(on):
                break
            source = source[on]
            state = flat[state[on].astype(np.int64) * row + plain[source + (n - 1)]]
            ends = self.ends[state]
            hit = np.flatnonzero(ends)
            at = source[hit]
            starts.append(at)
            found.append(ends[hit])
            rank.append(many[at])
            many[at] += 1
            width.append(n)
        return np.concatenate(starts), np.repeat(width, list(map(len, starts))), np.concatenate(found), np.concatenate(rank), many
