"""Sorted runs of strings, front coding, and merging with a loser tree that never compares a known prefix again."""

from __future__ import annotations

import struct
from collections.abc import Iterable, Iterator

Entry = tuple[int, bytes, int]  # characters shared with the entry before, string, tag


def common(a: bytes, b: bytes, known: int = 0) -> int:
    """Length of the common prefix of a and b, of which ``known`` bytes need no look."""
    n = min(len(a), len(b))
    if a[known:n] == b[known:n]:
        return n
    step = 32
    while a[known : known + step] == b[known : known + step]:
        known += step
    while a[known] == b[known]:
        known += 1
    return known


def front_coded(strings: list[bytes], tags: list[int]) -> bytes:
    """A sorted run in which each string is written as what it does not share with the one before."""
    out, before = [], b""
    for s, tag in zip(strings, tags, strict=True):
        lcp = common(before, s)
        out += [struct.pack("<IIq", lcp, len(s) - lcp, tag), s[lcp:]]
        before = s
    return b"".join(out)


def decoded(run: bytes) -> Iterator[Entry]:
    """The entries of a front-coded run; the shared lengths come for nothing."""
    at, before = 0, b""
    while at < len(run):
        lcp, more, tag = struct.unpack_from("<IIq", run, at)
        at += 16
        before = before[:lcp] + run[at : at + more]
        at += more
        yield lcp, before, tag


class LoserTree:
    """Merges sorted runs. Every contender knows how much it shares with the last winner.

    Of two contenders the one that shares more with the last winner is the smaller one, without a look at either; only
    where both share as much are they compared, and only from there on. The loser then knows what it shares with the
    one that beat it, which is what it needs when that one has won.
    """

    def __init__(self, runs: Iterable[Iterator[Entry]]):
        self.runs = [iter(r) for r in runs]
        self.size = max(1, len(self.runs))
        self.heads: list = [next(r, None) for r in self.runs] + [None] * (self.size - len(self.runs))
        self.lcp = [0] * self.size  # with the last winner
        self.losers = [-1] * self.size
        self.winner = self._build(1)

    def _build(self, node: int) -> int:
        if node >= self.size:
            return node - self.size
        return self._play(node, self._build(2 * node), self._build(2 * node + 1))

    def _play(self, node: int, a: int, b: int) -> int:
        """The winner of a and b; the loser stays at the node."""
        ha, hb = self.heads[a], self.heads[b]
        if ha is None or hb is None:
            win, lose = (b, a) if ha is None else (a, b)
        elif self.lcp[a] != self.lcp[b]:
            win, lose = (a, b) if self.lcp[a] > self.lcp[b] else (b, a)
        else:
            x, y = ha[1], hb[1]
            shared = common(x, y, self.lcp[a])
            win, lose = (a, b) if (x[shared : shared + 1], a) <= (y[shared : shared + 1], b) else (b, a)
            self.lcp[lose] = shared
        self.losers[node] = lose
        return win

    def __iter__(self) -> Iterator[tuple[int, int, bytes, int]]:
        """(bytes shared with the entry before, run, string, tag) of all entries in order."""
        while (head := self.heads[w := self.winner]) is not None:
            yield self.lcp[w], w, head[1], head[2]
            following = next(self.runs[w], None)
            self.heads[w] = following
            self.lcp[w] = following[0] if following else 0
            node = (w + self.size) // 2
            while node:
                w = self._play(node, w, self.losers[node])
                node //= 2
            self.winner = w
