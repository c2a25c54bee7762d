"""Benchmark decontamination: SimHash of item-sized windows, multi-index Hamming blocks, exact verification.

Documents and benchmark items are words (A-Z lower-cased, parted by blanks); their shingles are K words, or all words
of an item that has fewer. For every number of words that an item has, windows of that many words slide over every
document. A window is the set of its numbered shingles: the second occurrence of a shingle is a feature of its own, so
that the similarity of such sets is the weighted one. Its 64-bit SimHash is the sign of the sum of the features' bits;
a sliding window takes in one feature and gives back one. A fingerprint within RADIUS of an item's agrees with it, in
one of BLOCKS blocks, but for RADIUS // BLOCKS bits, so looking up each block of a window among the items' blocks and
their neighbours proposes all items within the radius, and nothing else proposes any. What is proposed and lies within
the radius is verified by the exact weighted Jaccard similarity of the shingles themselves (weight: number of
occurrences), SIMILAR or more.

A window that has no shingle in common with any item is similar to none, and gets no fingerprint; without that saving
(``everywhere``) the result is the same. What the radius loses is measured in the tests: two sets of similarity 0.8
differ in 9.7 bits on average, with a standard error of 2.9.

The items are taken to the tasks in blocks of ITEMS and of BYTES of text at most, each of which is done and written
before the next is read, so neither the driver nor a task ever holds more than one block. A document's windows are
worked on where the document lies, so nothing is shuffled.

Defined results for odd input: a text or item that is null or has no words matches nothing; a document with fewer
words than an item has one window, the whole document; an item in several places is reported by its best window, the
first among equals; rows that repeat a doc_id are judged one by one; a null doc_id is reported as null; empty tables
give empty results; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import stored, table
from .hashing import Words, mixed, pieces

K = 5
SIMILAR = 0.8
RADIUS = 22
BLOCKS = 8
ITEMS = 50_000
BYTES = 16 << 20
SEGMENT = 1 << 12  # places of windows that are looked at together
PIECE = 1 << 20  # bytes of texts that are searched together, about
PAIRS = 1 << 18  # bits of proposed items that are looked at together
_BITS = 64 // BLOCKS
_ONES = np.array([bin(n).count("1") for n in range(1 << _BITS)], np.uint8)

FOUND = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("item_id", T.LongType()), T.StructField("start_word", T.LongType()), T.StructField("end_word", T.LongType()), T.StructField("distance", T.IntegerType()), T.StructField("similarity", T.DoubleType())])


def _bits(shingles: np.ndarray, numbers: np.ndarray) -> np.ndarray:
    """The bits, as 1 and -1, of shingles that occur for the given time."""
    features = mixed(shingles + numbers.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return (((features[:, None] >> np.arange(64, dtype=np.uint64)) & np.uint64(1)).astype(np.int32) << 1) - 1


def fingerprints(hashes: np.ndarray, count: int) -> np.ndarray:
    """SimHash of the count shingles from each place on."""
    n = len(hashes)
    _, name = np.unique(hashes, return_inverse=True)
    places = np.sort(name * (2 * n) + np.arange(n))  # by shingle and then by place
    rank = np.searchsorted(places, name * (2 * n) + np.arange(n))
    # how often a place's shingle occurs from the place on, or up to it, within one window
    ahead = np.searchsorted(places, name * (2 * n) + np.minimum(np.arange(n) + count, n)) - rank
    behind = rank - np.searchsorted(places, name * (2 * n) + np.maximum(np.arange(n) - count + 1, 0))
    first = name[:count] * (2 * n) + np.arange(count)
    start = _bits(hashes[:count], rank[:count] - np.searchsorted(places, first - np.arange(count))).sum(axis=0, dtype=np.int32)
    steps = _bits(hashes[count:], behind[count:]) - _bits(hashes[: n - count], ahead[: n - count] - 1)
    sums = np.concatenate([start[None], steps]).cumsum(axis=0, dtype=np.int32)
    return ((sums > 0).astype(np.uint64) << np.arange(64, dtype=np.uint64)).sum(axis=1, dtype=np.uint64)


def _blocks(prints: np.ndarray) -> np.ndarray:
    return ((prints[:, None] >> (np.arange(BLOCKS, dtype=np.uint64) * np.uint64(_BITS))) & np.uint64((1 << _BITS) - 1)).astype(np.int64)


class BlockIndex:
    """Items' fingerprints by the value of each block: near[b, value] has a bit for each item whose block b is close to value."""

    def __init__(self, prints: np.ndarray, radius: int = RADIUS):
        self.prints, self.radius = prints, radius
        values = np.arange(1 << _BITS)
        self.near = np.stack([np.packbits(_ONES[values[:, None] ^ block[None, :]] <= radius // BLOCKS, axis=1, bitorder="little") for block in _blocks(prints).T])

    def search(self, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, item, distance) of all prints and items that lie within the radius."""
        out, step = [], max(1, PAIRS // (8 * self.near.shape[2]))
        for a in range(0, len(prints), step):
            part = prints[a : a + step]
            proposed = self.near[0, _blocks(part)[:, 0]]
            for b in range(1, BLOCKS):
                proposed |= self.near[b, _blocks(part)[:, b]]
            query, item = np.nonzero(np.unpackbits(proposed, axis=1, count=len(self.prints), bitorder="little"))
            distance = np.bitwise_count(part[query] ^ self.prints[item]).astype(int)
            close = distance <= self.radius
            out.append((query[close] + a, item[close], distance[close]))
        return tuple(np.concatenate(x) for x in zip(*out, strict=True)) if out else (np.zeros(0, int),) * 3


def weighted_jaccard(a: Counter, b: Counter) -> float:
    shared = sum((a & b).values())
    return shared / (sum(a.values()) + sum(b.values()) - shared) if shared else 0.0


def _shingled(words: list[bytes], k: int) -> Counter:
    return Counter(tuple(words[i : i + k]) for i in range(len(words) - k + 1))


class Items:
    """A block of benchmark items, ready to be searched.

    Of each item its words are kept; of all items with as many words the fingerprints' index, and for each size of
    shingles the hashes of all that items have.
    """

    def __init__(self, rows: list[tuple[int, str | None]], k: int = K, similar: float = SIMILAR, everywhere: bool = False):
        words = Words([(text or "").encode() for _, text in rows])
        self.ids, self.texts, self.similar, self.everywhere = [i for i, _ in rows], {}, similar, everywhere
        sizes = np.diff(words.offsets)
        hashes = {size: words.shingles(size) for size in {min(k, int(n)) for n in sizes if n}}
        own = {n: hashes[min(k, int(sizes[n]))][a : a + max(1, int(sizes[n]) - k + 1)] for n, a in enumerate(words.offsets[:-1]) if sizes[n]}
        self.members: dict[int, list[int]] = {}
        for n in own:
            self.texts[n] = [words.word(i) for i in range(words.offsets[n], words.offsets[n + 1])]
            self.members.setdefault(int(sizes[n]), []).append(n)
        self.index = {length: BlockIndex(np.concatenate([fingerprints(own[n], len(own[n])) for n in of])) for length, of in self.members.items()}
        self.lengths: dict[int, list[int]] = {}
        for length in self.members:
            self.lengths.setdefault(min(k, length), []).append(length)
        self.known = {size: np.unique(np.concatenate([own[n] for length in of for n in self.members[length]])) for size, of in self.lengths.items()}

    def places(self, hashes: np.ndarray, size: int) -> np.ndarray:
        """Where a shingle stands that an item has too."""
        if self.everywhere:
            return np.arange(len(hashes))
        known = self.known[size]
        seen = np.zeros(1 << 20, bool)
        seen[(known >> np.uint64(44)).astype(np.int64)] = True
        rough = np.flatnonzero(seen[(hashes >> np.uint64(44)).astype(np.int64)])
        at = np.minimum(np.searchsorted(known, hashes[rough]), len(known) - 1)
        return rough[known[at] == hashes[rough]]

    def search(self, texts: list[bytes]) -> list[tuple[int, int, int, int, int, float]]:
        """(text, item id, first word, word after the last, distance, similarity): the best window for each text and item."""
        words, best = Words(texts), {}
        for size, lengths in self.lengths.items():
            hashes = words.shingles(size)
            place = self.places(hashes, size)
            text = np.searchsorted(words.offsets, place, side="right") - 1
            inside = place + size <= words.offsets[text + 1]
            place, text = place[inside], text[inside]
            begin, end = words.offsets[text], words.offsets[text + 1]
            for length in lengths:
                window = np.minimum(length, end - begin)
                # the starts of the windows that hold a place, each once: ranges in ascending order
                low, high = np.maximum(place - (window - size), begin), np.minimum(place, end - window)
                low = np.maximum(low, np.append(-1, np.maximum.accumulate(high)[:-1]) + 1) if len(high) else low
                for n in np.unique(window):
                    some = (window == n) & (high >= low)
                    self._windows(words, hashes, size, length, int(n), low[some], high[some], best)
        return [(*key, *value) for key, value in sorted(best.items())]

    def _windows(self, words: Words, hashes: np.ndarray, size: int, length: int, window: int, low: np.ndarray, high: np.ndarray, best: dict) -> None:
        """Look up windows that start from low to high among the items of one length."""
        count = window - size + 1
        starts = np.repeat(low, high - low + 1) + _within(high - low + 1)
        for part in np.array_split(starts, len(starts) // SEGMENT + 1):
            # runs of places that windows cover are put together; what lies across two runs is no window
            first = np.append(True, np.diff(part) > count)
            run = np.flatnonzero(first)
            reach = np.append(part[run[1:] - 1], part[-1:]) - part[run] + count
            covered = np.repeat(part[run], reach) + _within(reach)
            at = (np.cumsum(reach) - reach)[np.cumsum(first) - 1] + part - part[run][np.cumsum(first) - 1]
            if not len(part):
                continue
            q, item, distance = self.index[length].search(fingerprints(hashes[covered], count)[at])
            for s, i, d in zip(part[q].tolist(), item.tolist(), distance.tolist(), strict=True):
                n = self.members[length][i]
                doc = int(np.searchsorted(words.offsets, s, side="right")) - 1
                value = weighted_jaccard(_shingled([words.word(w) for w in range(s, s + window)], size), _shingled(self.texts[n], size))
                key, s = (doc, self.ids[n]), s - int(words.offsets[doc])
                if value >= self.similar and (key not in best or (value, -s) > (best[key][3], -best[key][0])):
                    best[key] = (s, s + window, d, value)


def _within(many: np.ndarray) -> np.ndarray:
    """0, 1, ... up to each number."""
    return np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)


def _blocks_of(items: DataFrame, at_once: int, most: int):
    """The items' rows in lists of at_once items and most bytes of text at most, but for a single longer item."""
    block, size = [], 0
    for row in items.select("item_id", "text").orderBy("item_id").toLocalIterator():
        n = len((row["text"] or "").encode())
        if block and (len(block) == at_once or size + n > most):
            yield block
            block, size = [], 0
        block.append((row["item_id"], row["text"]))
        size += n
    if block:
        yield block


def contaminated(docs: DataFrame, items: DataFrame, similar: float = SIMILAR, items_at_once: int = ITEMS) -> DataFrame:
    """(doc_id, item_id, start_word, end_word, distance, similarity) of every document that has an item in it."""
    out = None
    for block in _blocks_of(items, items_at_once, BYTES):
        found = stored(_against(docs, Items(block, similar=similar)), "found")
        out = found if out is None else out.union(found)
    return docs.sparkSession.createDataFrame([], FOUND) if out is None else out


def _against(docs: DataFrame, items: Items) -> DataFrame:
    def search(batches):
        for batch in batches:
            rows = list(zip(batch["doc_id"], batch["text"], strict=True))
            found = []
            for part in pieces(rows, lambda r: len(r[1]), PIECE):
                found += [(part[d][0], *rest) for d, *rest in items.search([t for _, t in part])]
            yield pd.DataFrame(found, columns=FOUND.names).astype({"doc_id": "Int64"})

    source = docs.where(F.col("text").isNotNull()).select("doc_id", F.col("text").cast("binary").alias("text"))
    return source.mapInPandas(search, FOUND)


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents that hold a benchmark item go."""
    found = contaminated(docs.select("doc_id", "text"), table(spark, sf_dir, "benchmark")).select(F.col("doc_id").alias("__found")).distinct()
    return docs.join(found, F.col("doc_id").eqNullSafe(F.col("__found")), "left_anti")
