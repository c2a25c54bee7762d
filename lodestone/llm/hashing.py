"""Vectorised hashing of words and word shingles, for use within tasks."""

from __future__ import annotations

import numpy as np

_rng = np.random.default_rng(20240229)
_BYTE = _rng.integers(0, 2**64, 256, dtype=np.uint64)
_STEP = _rng.integers(0, 2**63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)  # a factor for each place in a shingle
_BASE = np.uint64(0x9E3779B97F4A7C15)

#: A-Z lower-cased, other bytes as they are; and which bytes are blanks (0x20, 0x09-0x0D).
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
BLANK = np.zeros(256, bool)
BLANK[[9, 10, 11, 12, 13, 32]] = True


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective mix of 64-bit values."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Words:
    """The words of a list of texts: hashes of all, and offsets[i]:offsets[i + 1] are those of text i."""

    def __init__(self, texts: list[bytes]):
        self.data = LOWER[np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)]
        solid = ~BLANK[self.data]
        edges = np.flatnonzero(np.diff(solid.view(np.int8), prepend=0))
        self.starts, self.ends = edges[0::2], edges[1::2]
        sizes = self.ends - self.starts
        first = np.cumsum(sizes) - sizes
        body = self.data[solid]
        powers = np.ones(int(sizes.max(initial=1)), np.uint64)
        np.cumprod(np.full(len(powers) - 1, _BASE), out=powers[1:])
        within = np.arange(len(body)) - np.repeat(first, sizes)
        sums = np.add.reduceat(_BYTE[body] * powers[within], first) if len(first) else np.zeros(0, np.uint64)
        self.hashes = mixed(sums + sizes.astype(np.uint64))
        lengths = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
        self.offsets = np.searchsorted(self.starts, np.concatenate(([0], np.cumsum(lengths))))

    def word(self, n: int) -> bytes:
        return self.data[self.starts[n] : self.ends[n]].tobytes()

    def shingles(self, k: int) -> np.ndarray:
        """Hash of the k words from each word on; the last k - 1 of all texts have none. May run over a text's end."""
        n = len(self.hashes) - k + 1
        if n <= 0:
            return np.zeros(0, np.uint64)
        out = np.zeros(n, np.uint64)
        for j in range(k):
            out += self.hashes[j : j + n] * _STEP[j]
        return mixed(out)


def pieces(rows: list, size_of, most: int = 4 << 20):
    """Runs of rows of about ``most`` bytes together: what a task holds at once stays bounded by that or one row."""
    part, total = [], 0
    for row in rows:
        part.append(row)
        total += size_of(row)
        if total >= most:
            yield part
            part, total = [], 0
    if part:
        yield part
