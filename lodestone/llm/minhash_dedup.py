"""Near-duplicate documents with HyperMinHash registers.

A document's set holds its distinct shingles of K words. Every bucket of its sketch has a permutation of its own, so
short texts fill all buckets too, and keeps the least hash in compressed form: the number of its leading zeros and the
MANTISSA bits after the first one. Bands of ROWS registers are the keys of candidate buckets. Two sets of similarity
0.8 miss each other in all bands with probability (1 - 0.8^5)^40, about 1e-7.

Documents with equal sets are one node, so copies are never paired. In a bucket, nodes are first paired with the
bucket's smallest node alone. Pairs are estimated from the registers, corrected for registers that agree by chance, and
those that may reach the threshold are verified on the full sets; links join nodes into components. ROUNDS times, each
node tries its best untested pair into another component; then the pairs of one bucket that still lie in
different components are tried, the smaller components of a bucket against all others, but for those that bitmaps of
their sets show to be too far apart, or that differ in more registers' last bits than similar sets do (by 4.5 standard
errors). Only sets of similar size are compared, and a bucket of many members is dealt to several tasks. A link between
different components is lost only where two sets share no band, or where their registers are 4.5 standard errors off;
members of one component are never paired again, and components are brought up to date by the new links alone.

Defined results for odd input: a text that is null or has no words has the empty set and is linked with nothing; a
text with fewer than K words has one shingle, all its words; a null doc_id is linked with nothing and kept; rows that
repeat a doc_id share one node's component; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bucketed, shuffles, small_batches, stored, table
from .components import Copies, components
from .hashing import Words, mixed, pieces

K = 5
SHINGLE = 2  # words, in the query and the pipeline
SIMILAR = 80  # per cent
ROWS, BANDS = 5, 40
BUCKETS = ROWS * BANDS
MANTISSA = 10
ROUNDS = 3
BITS = tuple(f"bits{n}" for n in range(-(-BUCKETS // 64)))  # columns with the last bit of every register
SPLIT = 512  # members of a bucket that a task compares others with
PIECE = 1 << 19  # bytes of texts whose sets a task makes together, about: their arrays are some thirty times as large
MAPS = 64  # words of 64 bits of a set's bitmap
MARGIN = 4.5  # standard errors by which an estimate may miss the threshold
_rng = np.random.default_rng(11)
_XOR = _rng.integers(0, 2**32, BUCKETS, dtype=np.uint32)
_TIMES = _rng.integers(0, 2**31, BUCKETS, dtype=np.uint32) * np.uint32(2) + np.uint32(1)

SKETCH = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("n", T.LongType()), T.StructField("f1", T.LongType()), T.StructField("f2", T.LongType()), T.StructField("keys", T.ArrayType(T.LongType())), T.StructField("registers", T.BinaryType()), *[T.StructField(b, T.LongType()) for b in BITS]])
SET = T.StructType([T.StructField("node", T.LongType()), T.StructField("n", T.LongType()), T.StructField("shingles", T.BinaryType())])


def shingle_sets(texts: list[bytes], k: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    words = Words(texts)
    hashes = words.shingles(k)
    out = []
    for a, b in zip(words.offsets, words.offsets[1:], strict=False):
        if b - a >= k or b == a:
            out.append(np.unique(hashes[a : max(a, b - k + 1)]))
        else:
            whole = Words([b" ".join(words.word(i) for i in range(a, b))])
            out.append(whole.shingles(int(b - a)) + np.uint64(b - a))
    return out


def registers(sets: list[np.ndarray]) -> np.ndarray:
    """A row of compressed registers for each set, none of which is empty."""
    sizes = np.fromiter(map(len, sets), np.int64, len(sets))
    first = np.cumsum(sizes) - sizes
    low = (np.concatenate(sets) >> np.uint64(32)).astype(np.uint32)
    least = np.empty((len(sets), BUCKETS), np.uint32)
    for j in range(BUCKETS):
        x = (low ^ _XOR[j]) * _TIMES[j]
        x ^= x >> np.uint32(15)
        x *= np.uint32(0x2C1B3C6D)
        x ^= x >> np.uint32(12)
        least[:, j] = np.minimum.reduceat(x, first)
    part, size = np.frexp(least.astype(np.float64))
    return (((32 - size) << MANTISSA) + np.maximum((2 * part - 1) * (1 << MANTISSA), 0).astype(np.int64)).astype("<u2")


def band_keys(regs: np.ndarray) -> np.ndarray:
    """A 64-bit key for each band of each row."""
    x = np.full((len(regs), BANDS), np.uint64(0)) + np.arange(1, BANDS + 1, dtype=np.uint64)
    bands = regs.reshape(len(regs), BANDS, ROWS).astype(np.uint64)
    for r in range(ROWS):
        x = mixed((x << np.uint64(16)) ^ (x >> np.uint64(48)) ^ bands[:, :, r])
    return x.view(np.int64)


def last_bits(regs: np.ndarray) -> np.ndarray:
    """The last bit of every register, 64 to a column."""
    packed = np.zeros((len(regs), 8 * len(BITS)), np.uint8)
    packed[:, : -(-BUCKETS // 8)] = np.packbits((regs & 1).astype(np.uint8), axis=1)
    return packed.view(np.int64)


def chance(n: int) -> float:
    """How often a register agrees by chance in two disjoint sets of n shingles each."""
    zeros = np.arange(1, 33)[:, None]
    low = 2.0**-zeros * (1 + np.arange(1 << MANTISSA) / (1 << MANTISSA))
    high = low + 2.0**-zeros / (1 << MANTISSA)
    return float((((1 - low) ** n - (1 - high) ** n) ** 2).sum())


_CHANCE: list = []


def estimated(a: np.ndarray, b: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Jaccard similarity from the registers of pairs of sets, n their mean size."""
    if not _CHANCE:
        _CHANCE.extend(chance(1 << i) for i in range(20))
    c = np.array(_CHANCE)[np.clip(np.log2(np.maximum(n, 1)).round().astype(int), 0, 19)]
    return ((a == b).mean(axis=1) - c) / (1 - c)


def sketches(docs: DataFrame, k: int) -> DataFrame:
    def of(batches):
        for batch in batches:
            for part in pieces(list(zip(batch["doc_id"], batch["text"], strict=True)), lambda r: len(r[1]) + 4 * BUCKETS, PIECE):
                sets = shingle_sets([t for _, t in part], k)
                full = [i for i, s in enumerate(sets) if len(s)]
                regs = registers([sets[i] for i in full]) if full else np.zeros((0, BUCKETS), "<u2")
                keys, bits = band_keys(regs), np.zeros((len(sets), len(BITS)), np.int64)
                bits[full] = last_bits(regs)
                at = {i: j for j, i in enumerate(full)}
                sums = [(mixed(s).sum(), mixed(s ^ np.uint64(0x5851F42D4C957F2D)).sum()) for s in sets]
                yield pd.DataFrame(
                    {
                        "doc_id": pd.array([i for i, _ in part], dtype="Int64"),
                        "n": [len(s) for s in sets],
                        "f1": np.array([a for a, _ in sums], np.uint64).view(np.int64),
                        "f2": np.array([b for _, b in sums], np.uint64).view(np.int64),
                        "keys": [keys[at[i]] if i in at else [] for i in range(len(sets))],
                        "registers": [regs[at[i]].tobytes() if i in at else b"" for i in range(len(sets))],
                        **{b: bits[:, n] for n, b in enumerate(BITS)},
                    }
                )

    return docs.select("doc_id", F.coalesce("text", F.lit("")).cast("binary").alias("text")).mapInPandas(of, SKETCH)


def texts_of(docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """(doc_id, packed): the compressed texts of the documents that nodes (node) names; a null text is an empty one."""

    def pack(batches):
        compress = zstandard.ZstdCompressor(level=1).compress
        for batch in batches:
            yield pd.DataFrame({"doc_id": batch["doc_id"], "packed": [compress(t) for t in batch["text"]]})

    texts = docs.where("doc_id IS NOT NULL").select("doc_id", F.coalesce("text", F.lit("")).cast("binary").alias("text"))
    return texts.mapInPandas(pack, "doc_id long, packed binary").join(nodes.select(F.col("node").alias("doc_id")), "doc_id", "left_semi")


def unpacked_pieces(batches, most: int = PIECE):
    """Lists of (doc_id, text) of about ``most`` bytes together, from batches of texts_of."""
    for batch in batches:
        expand = zstandard.ZstdDecompressor().decompress
        rows = ((i, expand(t)) for i, t in zip(batch["doc_id"], batch["packed"], strict=True))
        yield from pieces(rows, lambda r: len(r[1]), most)


def full_sets(docs: DataFrame, nodes: DataFrame, k: int) -> DataFrame:
    """The full shingle sets of the documents that nodes names."""

    def of(batches):
        for part in unpacked_pieces(batches):
            sets = shingle_sets([t for _, t in part], k)
            yield pd.DataFrame({"node": [i for i, _ in part], "n": [len(s) for s in sets], "shingles": [s.tobytes() for s in sets]})

    return texts_of(docs, nodes).mapInPandas(of, SET)


def once(udf):
    """udf as not deterministic: else a filter on its column is pushed below it, and two workers a task run it twice."""
    return udf.asNondeterministic()


@once
@F.pandas_udf(T.DoubleType())
def estimate(a: pd.Series, b: pd.Series, n: pd.Series) -> pd.Series:
    if not len(a):
        return pd.Series([], dtype="float64")
    both = (np.frombuffer(b"".join(x), "<u2").reshape(-1, BUCKETS) for x in (a, b))
    return pd.Series(estimated(*both, n.to_numpy()))


@F.pandas_udf(T.LongType())
def shared(a: pd.Series, b: pd.Series) -> pd.Series:
    one = lambda x, y: len(np.intersect1d(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), assume_unique=True))
    return pd.Series([one(x, y) for x, y in zip(a, b, strict=True)], dtype="int64")


class Linker:
    """Estimation and verification of pairs, and the components of what was linked so far."""

    def __init__(self, docs: DataFrame, nodes: DataFrame, members: DataFrame, k: int, similar: int, sketch: str = "registers"):
        self.similar, self.nodes = similar, nodes.select("node", "n", sketch)
        # in buckets, so that rounds of pairs come to the sets and the sets stay where they are
        self.sets = bucketed(full_sets(docs, members.select("node").distinct(), k), "sets", shuffles(docs.sparkSession), ["node"], compression="none")
        self.labels: DataFrame | None = None

    def _joined(self, pairs: DataFrame, side: DataFrame, column: str) -> DataFrame:
        a, b = (side.select(*[F.col(c).alias(f"{c}_{s}") for c in ("node", "n", column)]) for s in "ab")
        return pairs.join(a, F.col("a") == F.col("node_a")).join(b, F.col("b") == F.col("node_b"))

    def promising(self, pairs: DataFrame) -> DataFrame:
        """(a, b, estimate) of the pairs whose sizes and registers allow a link."""
        sizes = 100 * F.least("n_a", "n_b") >= self.similar * F.greatest("n_a", "n_b")
        least = self.similar / 100 - MARGIN * (self.similar / 100 * (1 - self.similar / 100) / BUCKETS) ** 0.5
        known = self._joined(pairs, self.nodes, "registers").where(sizes)
        known = known.withColumn("estimate", estimate("registers_a", "registers_b", (F.col("n_a") + F.col("n_b")) / 2))
        return stored(known.where(F.col("estimate") >= least).select("a", "b", "estimate"), "promising")

    def linked(self, pairs: DataFrame) -> DataFrame:
        """The pairs (a, b) whose full sets are similar."""
        both = self._joined(pairs.select("a", "b"), self.sets, "shingles").withColumn("i", shared("shingles_a", "shingles_b"))
        return both.where(100 * F.col("i") >= self.similar * (F.col("n_a") + F.col("n_b") - F.col("i"))).select("a", "b")

    def verify(self, pairs: DataFrame) -> None:
        """Add the links among pairs (a, b) and bring the components up to date."""
        new = stored(self.linked(pairs), "links")
        if self.labels is None:
            self.labels = components(new)
            return
        # components that the new links join, as a graph of their labels; the others stay as they are
        joined = self.labelled(self.labelled(new, "a", "la"), "b", "lb").where("la <> lb")
        merged = components(joined.select(F.col("la").alias("a"), F.col("lb").alias("b")))
        now = merged.select(F.col("node").alias("__n"), F.col("label").alias("__l"))
        old = self.labels.join(now, F.col("label") == F.col("__n"), "left").select("node", F.coalesce("__l", "label").alias("label"))
        self.labels = stored(old.union(merged.join(self.labels.select("node"), "node", "left_anti")), "labels")

    def labelled(self, rows: DataFrame, node: str, label: str) -> DataFrame:
        """rows with the component of a node; a node without links is its own."""
        of = self.labels.select(F.col("node").alias("__n"), F.col("label").alias("__l"))
        out = rows.join(of, F.col(node) == F.col("__n"), "left")
        return out.withColumn(label, F.coalesce("__l", F.col(node))).drop("__n", "__l")


def bitmaps(sets: DataFrame) -> DataFrame:
    """(node, more, map0, map1, ...): a bit for each shingle by its hash, and how many shingles met a bit already set."""

    def each(batches):
        for batch in batches:
            maps, more = np.zeros((len(batch), 8 * MAPS), np.uint8), np.zeros(len(batch), np.int64)
            for i, shingles in enumerate(batch["shingles"]):
                bits = np.zeros(64 * MAPS, np.uint8)
                s = np.frombuffer(shingles, np.uint64)
                bits[(s % np.uint64(64 * MAPS)).astype(np.int64)] = 1
                maps[i], more[i] = np.packbits(bits), len(s) - int(bits.sum())
            words = maps.view(np.int64)
            yield pd.DataFrame({"node": batch["node"], "more": more, **{f"map{n}": words[:, n] for n in range(MAPS)}})

    longs = ["node", "more", *[f"map{n}" for n in range(MAPS)]]
    return sets.select("node", "shingles").mapInPandas(each, T.StructType([T.StructField(n, T.LongType()) for n in longs]))


def most_apart(similar: int) -> int:
    """Last bits in which two sets may differ: those of unequal registers do so by half, with MARGIN standard errors."""
    p = (1 - similar / 100) / 2
    return int(BUCKETS * p + MARGIN * (BUCKETS * p * (1 - p)) ** 0.5 + 1)


def cross_pairs(members: DataFrame, linker: Linker) -> DataFrame:
    """(a, b), a < b: the pairs of one bucket that lie in different components and may be similar, each once.

    The join itself bounds the similarity by the registers' last bits and, exactly, by bitmaps of the sets: the
    intersection is at most the bits that two maps share and the shingles that met a set bit. So texts that merely share
    a passage, or are edited too far apart, make no rows. Only sets of similar size meet, and a bucket of more than SPLIT
    members is dealt to so many tasks.
    """
    rows = stored(linker.labelled(members.select("key", "node", "n", *BITS), "node", "label"), "labelled")
    mixed_keys = rows.groupBy("key").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo <> hi").select("key")
    rows = rows.join(stored(mixed_keys, "mixed"), "key")
    maps = stored(bitmaps(linker.sets.join(rows.select("node").distinct(), "node", "left_semi")), "bitmaps")
    rows = stored(rows, "in-mixed")
    sizes = rows.groupBy("key", "label").agg(F.count("*").alias("c"))
    most = sizes.groupBy("key").agg(F.max_by("label", F.struct("c", "label")).alias("most"), F.ceil(F.sum("c") / SPLIT).cast("int").alias("salts"))
    # sets of similar size lie in the same bin or next to it
    bin_ = F.floor(F.log("n") / math.log(100 / linker.similar * 1.001)).cast("int")
    rows = rows.join(maps, "node").join(stored(most, "most"), "key").withColumn("bin", bin_)
    minor = rows.where("label <> most").withColumn("bin", F.explode(F.sequence(F.col("bin") - 1, F.col("bin") + 1)))
    minor = minor.withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)))
    minor = minor.select("key", "bin", "salt", F.col("node").alias("x"), *[F.col(c).alias(f"x_{c}") for c in ("label", "n", "more", *BITS, *(f"map{n}" for n in range(MAPS)))])
    rows = rows.withColumn("salt", F.pmod(F.xxhash64("node"), "salts").cast("int"))
    apart = sum((F.bit_count(F.col(b).bitwiseXOR(F.col(f"x_{b}"))) for b in BITS), F.lit(0))
    together = sum((F.bit_count(F.col(f"map{n}").bitwiseAND(F.col(f"x_map{n}"))) for n in range(MAPS)), F.least("more", "x_more"))
    reachable = (100 + linker.similar) * together >= linker.similar * (F.col("n") + F.col("x_n"))
    pairs = minor.join(rows, ["key", "bin", "salt"]).where((F.col("label") != F.col("x_label")) & (apart <= most_apart(linker.similar)) & reachable)
    return pairs.select(F.least("x", "node").alias("a"), F.greatest("x", "node").alias("b")).distinct()


def near_duplicates(docs: DataFrame, k: int = K, similar: int = SIMILAR) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept), a row for each row of docs."""
    with small_batches(docs.sparkSession):
        sketch = stored(sketches(docs, k), "sketches")
        copies = Copies(sketch)
        # a set of n shingles can only be linked with another one if n / (n + 1) reaches the threshold
        firsts = copies.nodes().where(100 * F.col("n") >= similar * (F.col("n") + 1))
        nodes = stored(firsts.select("node", "n", "keys", "registers", *BITS), "nodes")
        rows = nodes.select(F.explode("keys").alias("key"), "node", "n", *BITS)
        heads = stored(rows.groupBy("key").agg(F.min("node").alias("head"), F.max("node").alias("last")).where("head <> last").select("key", "head"), "heads")
        members = stored(rows.join(heads, "key"), "members")
        linker = Linker(docs, nodes, members, k, similar)
        pairs = members.where("node <> head").select(F.col("head").alias("a"), F.col("node").alias("b")).distinct()
        open_pairs = linker.promising(pairs)
        best = Window.partitionBy("b").orderBy(F.col("estimate").desc(), "a")
        for n in range(ROUNDS):
            tried = stored(open_pairs.withColumn("r", F.row_number().over(best)).where("r = 1").select("a", "b"), "tried")
            if tried.isEmpty() and n:
                break
            linker.verify(tried)
            rest = open_pairs.join(tried, ["a", "b"], "left_anti")
            rest = linker.labelled(linker.labelled(rest, "a", "la"), "b", "lb").where("la <> lb")
            open_pairs = stored(rest.select("a", "b", "estimate"), "open")
        left = linker.promising(cross_pairs(members, linker))
        if not left.isEmpty():
            linker.verify(left)
        every = copies.carried(linker.labelled(copies.same.select("node").distinct(), "node", "label"))
        component = F.when(F.col("n") > 0, F.coalesce("label", "doc_id")).otherwise(F.col("doc_id"))
        component = F.when(F.col("doc_id").isNotNull(), component)
        return every.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def op3_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"), k=SHINGLE)


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: one document of each group of near duplicates stays."""
    gone = near_duplicates(docs.select("doc_id", "text"), k=SHINGLE).where("not kept").select(F.col("doc_id").alias("__gone")).distinct()
    return docs.join(gone, F.col("doc_id") == F.col("__gone"), "left_anti")
