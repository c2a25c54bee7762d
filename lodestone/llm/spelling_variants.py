"""Spelling variants: words that differ by one code point, found with bidirectional FM-indexes and search schemes.

Words of two documents' worth of text and more are counted; those of LEAST code points and TWICE occurrences make the
vocabulary. Two words of s and s or s + 1 code points that are one insertion, deletion or replacement apart agree either
in their first s // 2 code points or in the s - s // 2 last ones. So each word is dealt, for either half and for the part
of the shorter and of the longer word, to a bucket named by that half: near words always meet in one.

A bucket's words, each between delimiters, are indexed in both directions: rank tables of the Burrows-Wheeler transforms
of the text and of its reverse. A suffix-rank interval is kept in both indexes at once and can be extended either way.
The search schemes are two: match the delimiter and the first half exactly and extend to the right allowing one error;
match the second half and its delimiter exactly and extend to the left allowing one error. An error is taken at the last
of the places that give the same word, so each near word is found by one scheme at one place, and nothing is sorted out
afterwards. All queries of a bucket are searched together, an extension being a few array operations.

A bucket of more than WORDS words is dealt to (part of the index, part of the queries), so what a task holds is bounded
whatever half of a word is common; counts and best words of the parts are then merged.

Defined results for odd input: a null text has no words; a null doc_id is hashed as an empty one; rows that repeat a
doc_id are documents of their own; a word of equal counts is preferred by code points; very long runs are words like
others; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import shuffles, stored, table

LEAST = 7  # code points of a word
TWICE = 2  # occurrences of a word
TIMES = 10  # a form occurs so many times as often as its variant
EVERY = 31  # an occurrence whose hash this divides loses a code point
WORDS = 8192  # words of a bucket, about
HELD = 400_000  # distinct words that a task counts before it hands them on
RUN = re.compile("[A-Za-zÀ-ÿ]+")
SENTINEL, DELIMITER, LETTER = 0, 1, 2  # symbols; letters follow in order of code points


def counted(docs: DataFrame) -> DataFrame:
    """(word, n): all words as they are counted, of any length."""

    def of(batches):
        held: Counter = Counter()
        counts = lambda: pd.DataFrame({"word": pd.Series(list(held), dtype=object), "n": np.array(list(held.values()), np.int64)})
        for batch in batches:
            for doc, text in zip(batch["doc_id"], batch["text"], strict=True):
                start = zlib.crc32(f"{doc}:".encode())
                for run, n in Counter(RUN.findall(text.encode().lower().decode())).items():
                    h = zlib.crc32(run.encode(), start)
                    if h % EVERY == 0:
                        at = h % len(run)
                        run = run[:at] + run[at + 1 :]
                    held[run] += n
                if len(held) >= HELD:
                    yield counts()
                    held = Counter()
        yield counts()

    rows = docs.where("text IS NOT NULL").select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("doc_id"), "text")
    return rows.mapInPandas(of, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def suffix_array(text: np.ndarray) -> np.ndarray:
    """The order of the suffixes of a text, by doubling the prefixes that are told apart."""
    n, rank, step = len(text), text.astype(np.int64), 1
    while True:
        after = np.zeros(n, np.int64)
        after[: max(n - step, 0)] = rank[step:] + 1
        key = rank * (n + 300) + after
        order = np.argsort(key, kind="stable")
        new = np.append(0, np.cumsum(key[order][1:] != key[order][:-1]))
        rank = np.empty(n, np.int64)
        rank[order] = new
        step *= 2
        if new[-1] == n - 1:
            return order


class RankTable:
    """less[i, c]: how many of the first i symbols of the transform of a text are smaller than c."""

    def __init__(self, text: np.ndarray, symbols: int):
        self.order = suffix_array(text)
        transform = text[self.order - 1]
        self.less = np.zeros((len(text) + 1, symbols + 1), np.int32)
        self.less[np.arange(1, len(text) + 1), transform + 1] = 1
        np.cumsum(self.less, axis=0, out=self.less)
        np.cumsum(self.less, axis=1, out=self.less)
        self.first = self.less[-1, :-1].astype(np.int64)

    def extended(self, main, other, size, symbol):
        """The interval of a pattern with one more symbol in front of it (of its reverse, in the other index)."""
        low, high = self.less[main, symbol], self.less[main + size, symbol]
        before, up_to = self.less[main, symbol + 1] - low, self.less[main + size, symbol + 1] - high
        return self.first[symbol] + before, other + (high - low), (up_to - before).astype(np.int64)


class BidirectionalIndex:
    """Sorted words between delimiters, indexed in both directions."""

    def __init__(self, words: list[str]):
        points = np.frombuffer(("\n" + "\n".join(words) + "\n\0").encode("utf-32-le"), np.uint32)
        names, text = np.unique(points, return_inverse=True)
        self.text, self.symbols = text.astype(np.int64), len(names)
        self.sizes = np.fromiter(map(len, words), np.int64, len(words))
        self.starts = np.cumsum(self.sizes + 1) - self.sizes
        self.left = RankTable(self.text, self.symbols)
        self.right = RankTable(np.append(self.text[-2::-1], SENTINEL), self.symbols)
        # the place of each delimiter but the last names the word behind it
        self.word_at = np.cumsum(self.text == DELIMITER) - 1

    def near(self, queries: np.ndarray, suffix: bool, longer: bool) -> tuple[np.ndarray, np.ndarray]:
        """(query, word): words one error from the given ones, the error lying outside of the half that is matched.

        longer: the query is the longer one of the two; else it is the shorter one or as long as the other.
        """
        size = self.sizes[queries]
        half = (size - longer) // 2
        q, lo, back, found = np.arange(len(queries)), np.zeros(len(queries), np.int64), np.zeros(len(queries), np.int64), np.full(len(queries), len(self.text))
        begin = self.starts[queries]
        # the exact half, from left to right: its delimiter comes first or last, and is the text's own
        a, b = (begin + half, begin + size + 1) if suffix else (begin - 1, begin + half)
        for step in range(int((b - a).max(initial=0))):
            on = np.flatnonzero(a + step < b)
            back[on], lo[on], found[on] = self.right.extended(back[on], lo[on], found[on], self.text[a[on] + step])
        at = half.copy()
        if suffix:
            q, word = self._across(self.left, q, lo, back, found, at, begin, size, half, longer, True)
        else:
            q, word = self._across(self.right, q, back, lo, found, at, begin, size, half, longer, False)
        return queries[q], word

    def _across(self, index, q, main, other, found, at, begin, size, half, longer, left):
        """Extend to the word's end with one error; at is the place in the query before (left: behind) which all is matched."""
        end = np.zeros_like(size) if left else size
        step = -1 if left else 1
        clean, torn = (q, at, main, other, found), tuple(np.zeros(0, np.int64) for _ in range(5))
        hits = []
        while len(clean[0]) or len(torn[0]):
            grown = []
            if len(torn[0]):
                q, at, main, other, found = torn
                done = at == end[q]
                symbol = np.where(done, DELIMITER, self.text[begin[q] + np.minimum(at - left, size[q] - 1)])
                main, other, found = index.extended(main, other, found, symbol)
                hits.append(tuple(x[done & (found > 0)] for x in (q, main, other)))
                go = ~done & (found > 0)
                grown.append((q[go], at[go] + step, main[go], other[go], found[go]))
            q, at, main, other, found = clean
            inside = at != end[q]
            following = self.text[begin[q] + np.where(inside, at - left, 0)]
            if longer:
                place = at - left
                last = self.text[np.minimum(begin[q] + place + 1, len(self.text) - 1)] != following
                drop = inside & last
                grown.append((q[drop], at[drop] + step, main[drop], other[drop], found[drop]))
            elif len(q):
                many = np.diff(index.less[main + found] - index.less[main], axis=1)[:, LETTER:]
                row, symbol = np.nonzero(many)
                symbol += LETTER
                more = index.extended(main[row], other[row], found[row], symbol)
                replace = inside[row] & (symbol != following[row])
                # an inserted symbol stands before the query's symbol at this place, which must be another one
                behind = self.text[begin[q] + at]
                insert = (symbol != behind[row]) & ((at < half[q])[row] if left else True)
                for chosen, move in ((replace, step), (insert, 0)):
                    r = row[chosen]
                    grown.append((q[r], at[r] + move, *(x[chosen] for x in more)))
            main, other, found = index.extended(main[inside], other[inside], found[inside], following[inside])
            go = found > 0
            clean = (q[inside][go], at[inside][go] + step, main[go], other[go], found[go])
            torn = tuple(np.concatenate(x) for x in zip(*grown, strict=True)) if grown else torn
        if not hits:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        q, main, other = (np.concatenate(x) for x in zip(*hits, strict=True))
        return q, self.word_at[self.left.order[main if left else other]]


def near_words(vocabulary: DataFrame, words: int = WORDS) -> DataFrame:
    """(word, n_near, best): for words (word, n) that have near ones their number and (-n, form) of the most frequent."""
    total = vocabulary.count()
    buckets = -(-4 * total // words) or 1
    half = lambda s: F.floor(s / 2).cast("int")
    size = F.char_length("word")
    routes = []
    for longer in (0, 1):
        s = size - longer
        for suffix in (0, 1):
            part = F.substring("word", F.lit(1), half(s)) if not suffix else F.substring("word", size - (s - half(s)) + 1, s - half(s))
            routes.append(F.struct(F.lit(suffix).alias("suffix"), F.lit(longer).alias("longer"), F.pmod(F.xxhash64(F.lit(suffix), s, part), F.lit(buckets)).alias("bucket")))
    rows = vocabulary.select("word", "n", F.explode(F.array(*routes)).alias("r")).select("word", "n", "r.*")
    rows = stored(rows.where((F.col("longer") == 0) | (F.char_length("word") > LEAST)), "routes")
    held = rows.groupBy("bucket").agg(F.ceil(F.count("*") / (2 * words)).cast("int").alias("parts"))
    rows = rows.join(stored(held, "held"), "bucket").withColumn("own", F.pmod(F.xxhash64("word", F.lit(1)), "parts").cast("int"))
    # i: part of the index, j: part of the queries; use 0: index, 1: query, 2: both
    uses = F.expr("flatten(transform(sequence(0, parts - 1), x -> if(x = own, array(struct(own AS i, own AS j, 2 AS use)), array(struct(own AS i, x AS j, 0 AS use), struct(x AS i, own AS j, 1 AS use)))))")
    rows = rows.select("bucket", "word", "n", "suffix", "longer", F.explode(uses).alias("u")).select("bucket", "word", "n", "suffix", "longer", "u.*")

    def search(group: pd.DataFrame) -> pd.DataFrame:
        known = group[group["use"] != 1]
        asked = group[group["use"] != 0]
        # words that only ask are in the index too, but no answers
        words = sorted(set(group["word"]))
        place = {w: i for i, w in enumerate(words)}
        n = np.zeros(len(words), np.int64)
        n[known["word"].map(place).to_numpy(np.int64)] = known["n"].to_numpy(np.int64)
        index, out = BidirectionalIndex(words), []
        for (suffix, longer), part in asked.groupby(["suffix", "longer"]):
            q, w = index.near(part["word"].map(place).to_numpy(np.int64), bool(suffix), int(longer))
            out.append((q[n[w] > 0], w[n[w] > 0]))
        q, w = (np.concatenate([np.zeros(0, np.int64), *x]) for x in zip(*out, strict=True)) if out else (np.zeros(0, np.int64),) * 2
        order = np.lexsort((w, -n[w], q))
        q, w = q[order], w[order]
        first = np.flatnonzero(np.append(True, q[1:] != q[:-1])[: len(q)])
        many = np.diff(np.append(first, len(q)))
        named = lambda at: pd.Series([words[i] for i in at], dtype=object)
        return pd.DataFrame({"word": named(q[first]), "n_near": many, "n": n[w[first]], "form": named(w[first])})

    parts = max(shuffles(vocabulary.sparkSession), buckets)
    grouped = rows.repartition(parts, "bucket", "i", "j").groupBy("bucket", "i", "j")
    found = grouped.applyInPandas(search, T.StructType([T.StructField("word", T.StringType()), T.StructField("n_near", T.LongType()), T.StructField("n", T.LongType()), T.StructField("form", T.StringType())]))
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), F.min(F.struct((-F.col("n")).alias("n"), "form")).alias("best"))


def variants(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of every word of the vocabulary."""
    vocabulary = counted(docs).where((F.char_length("word") >= LEAST) & (F.col("n") >= TWICE))
    vocabulary = stored(vocabulary, "vocabulary")
    known = vocabulary.join(near_words(vocabulary, words), "word", "left")
    is_form = -F.col("best.n") >= TIMES * F.col("n")
    known = known.select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(is_form, F.col("best.form")).alias("form"), F.when(is_form, -F.col("best.n")).alias("form_n"))
    known = stored(known, "variants")
    # each step along forms is TIMES as frequent, so a few doublings reach every root
    roots = known.where("form IS NOT NULL").select("word", F.col("form").alias("root"))
    while True:
        step = roots.select(F.col("word").alias("via"), F.col("root").alias("beyond"))
        roots = stored(roots.join(step, roots["root"] == step["via"], "left").select("word", F.coalesce("beyond", "root").alias("root"), F.col("beyond").isNotNull().alias("moved")), "roots")
        if roots.where("moved").isEmpty():
            break
        roots = roots.select("word", "root")
    return known.join(roots.select("word", "root"), "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants(table(spark, sf_dir, "documents").select("doc_id", "text"))
