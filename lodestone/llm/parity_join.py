"""Similarity join of documents by parity sketches.

A document's set holds its distinct shingles of K words. Every shingle flips bits of a sketch, so the sketches of two
sets differ in nothing but what the sets' symmetric difference flips, and their Hamming distance is at most its size.
The sketch that is joined has so many bits that a block of it is held as the XOR of 64-bit hashes of the shingles that
fall into it; the narrow one that pairs are compared by has 64 * WIDTH bits, and that of long texts grows with them.

Sets of similarity 0.8 with n and m shingles differ in at most (n + m) / 9. Sizes are parted into bands, and a set
joins the band of its own size and the next one, if sets similar to it reach into it. A band allows D differences and
parts the first sketch into D + 1 + S blocks, so that two similar sets agree in at least S + 1 of them (pigeonhole).
Empty blocks agree in all sets and make no keys: a set with at most S empty blocks is sure to agree with each similar
set in a block with shingles. A set with more emits the keys of another hash function too, and so on, till it has one
with few enough; two similar sets both have keys of the first one that suits either. After SEEDS of them empty blocks
make keys as well. So no link is lost, whatever the sizes.

Keys are not moved one by one: a task sorts those of some documents, keeps one holder of each key that several of them
share, and sends packed slices of the key range; so a key that a third of all documents have arrives a few times only.
Documents that share a key are paired with the first one that has it; the narrow sketches' distance bounds the
symmetric difference of pairs, and what passes is verified on the full sets. Links make components, each document tries
its ROUNDS best pairs, and members of one key that still lie in different components are compared by their narrow
sketches within the join itself, the smaller components against all others, in as many tasks as the key needs.

Defined results for odd input: a text that is null or has no words has the empty set and is linked with nothing; a text
with fewer than K words has one shingle, all its words; documents with equal sets are one node; a null doc_id is linked
with nothing and kept; rows that repeat a doc_id share one node's component; an empty table gives an empty result;
other columns, whatever their names, are ignored.
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
from .components import Copies
from .hashing import mixed, pieces
from .minhash_dedup import PIECE, Linker, once, shingle_sets, texts_of, unpacked_pieces

K = 5
SIMILAR = 80  # per cent
WIDTH = 16  # words of 64 bits of the narrow sketch
GROWTH = 1.4  # of the sizes of a band
SEEDS = 6
KEY = np.uint64(0xFFFFFFFFFFFF0000)  # the bits of a key that are kept: chance agreement makes a candidate at worst
HELD = 1 << 20  # keys that a task sorts together
PART = 1 << 20  # keys of one slice of the key range, about
SPLIT = 512  # members of a key that a task compares others with
ROUNDS = 3
BITS = tuple(f"bits{n}" for n in range(WIDTH))

_longs = lambda *names: T.StructType([T.StructField(n, T.LongType()) for n in names])
SKETCH = _longs("doc_id", "n", "f1", "f2", *BITS)
PACKED = T.StructType([T.StructField("part", T.LongType()), T.StructField("salt", T.LongType()), T.StructField("keys", T.BinaryType()), T.StructField("nodes", T.BinaryType())])


def differences(total, similar: int):
    """The largest symmetric difference of two similar sets that have this many shingles together."""
    return total * (100 - similar) // (100 + similar)


def band_edges(most: int) -> np.ndarray:
    """The least size of each band, up to the first one beyond most."""
    edges = [1]
    while edges[-1] <= most:
        edges.append(max(edges[-1] + 1, int(edges[-1] * GROWTH)))
    return np.array(edges, np.int64)


def block_keys(sets: list[np.ndarray], similar: int = SIMILAR) -> tuple[np.ndarray, np.ndarray]:
    """(keys, owners): the keys of the sets, each with the set it belongs to."""
    sizes = np.fromiter(map(len, sets), np.int64, len(sets))
    shingles, first = np.concatenate([*sets, np.zeros(0, np.uint64)]), np.cumsum(sizes) - sizes
    edges = band_edges(int(sizes.max(initial=1)) * 100 // similar + 1)
    own = np.searchsorted(edges, sizes, side="right") - 1
    reach = np.flatnonzero((sizes > 0) & (sizes * 100 // similar >= edges[np.minimum(own + 1, len(edges) - 1)]))
    entry, band = np.concatenate([np.flatnonzero(sizes > 0), reach]), np.concatenate([own[sizes > 0], own[reach] + 1])
    allowed = differences(2 * (edges[np.minimum(band + 1, len(edges) - 1)] - 1), similar)
    entry, band, allowed = entry[allowed > 0], band[allowed > 0], allowed[allowed > 0]  # else only equal sets are similar
    keys, owners = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    for seed in range(SEEDS):
        if not len(entry):
            break
        spare = allowed // 8
        blocks, n = allowed + 1 + spare, sizes[entry]
        base = np.cumsum(blocks) - blocks
        at = np.repeat(first[entry] - np.cumsum(n) + n, n) + np.arange(n.sum())
        h = mixed(shingles[at] + np.uint64(0x9E3779B97F4A7C15 * (seed + 1) & (1 << 64) - 1))
        slot = np.repeat(base, n) + ((h >> np.uint64(32)) * np.repeat(blocks, n).astype(np.uint64) >> np.uint64(32)).astype(np.int64)
        filled = np.bincount(slot, minlength=int(blocks.sum()))
        value = np.zeros(len(filled), np.uint64)
        np.bitwise_xor.at(value, slot, mixed(h))
        sure = np.add.reduceat(filled == 0, base) <= spare
        used = filled > 0
        if seed == SEEDS - 1:
            used |= np.repeat(~sure, blocks)
        of = np.repeat(np.arange(len(entry)), blocks)[used]
        name = (band[of] * SEEDS + seed << 32) + np.flatnonzero(used) - base[of]
        keys.append(mixed(value[used] ^ mixed(name.astype(np.uint64))) & KEY)
        owners.append(entry[of])
        entry, band, allowed = entry[~sure], band[~sure], allowed[~sure]
    return np.concatenate(keys), np.concatenate(owners)


def parity_bits(sets: list[np.ndarray]) -> np.ndarray:
    """The narrow sketch of each set: rows of WIDTH words."""
    wide = 64 * WIDTH
    sizes = np.fromiter(map(len, sets), np.int64, len(sets))
    bit = (mixed(np.concatenate([*sets, np.zeros(0, np.uint64)]) ^ np.uint64(0x2545F4914F6CDD1D)) >> np.uint64(40)).astype(np.int64) % wide
    flips = np.bincount(np.repeat(np.arange(len(sets)) * wide, sizes) + bit, minlength=len(sets) * wide)
    return np.packbits((flips & 1).astype(np.uint8).reshape(len(sets), wide), axis=1).view(np.int64)


def sketches(docs: DataFrame, k: int) -> DataFrame:
    """(doc_id, n, f1, f2, bits...): size, two hashes of the whole set and the narrow sketch."""

    def of(batches):
        for batch in batches:
            for part in pieces(list(zip(batch["doc_id"], batch["text"], strict=True)), lambda r: len(r[1]) + 64 * WIDTH, PIECE):
                sets = shingle_sets([t for _, t in part], k)
                bits = parity_bits(sets)
                sums = np.array([(mixed(s).sum(), mixed(s ^ np.uint64(0x5851F42D4C957F2D)).sum()) for s in sets], np.uint64).view(np.int64)
                frame = {"doc_id": pd.array([i for i, _ in part], dtype="Int64"), "n": [len(s) for s in sets], "f1": sums[:, 0], "f2": sums[:, 1]}
                yield pd.DataFrame(frame | {b: bits[:, n] for n, b in enumerate(BITS)})

    return docs.select("doc_id", F.coalesce("text", F.lit("")).cast("binary").alias("text")).mapInPandas(of, SKETCH)


def packed(values: np.ndarray) -> bytes:
    """64-bit values by planes of bytes, compressed: those of sorted keys and of near ids mostly vanish."""
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(values.view(np.uint8).reshape(-1, 8).T).tobytes())


def unpacked(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8).reshape(8, -1)
    return np.ascontiguousarray(planes.T).view(np.uint64).ravel()


def slices(keys: np.ndarray, nodes: np.ndarray, parts: int, salt: int):
    """Rows of PACKED for keys of some documents: one holder of each key by slice, and all holders of those that repeat."""
    order = np.lexsort((nodes, keys))
    keys, nodes = keys[order], nodes[order].view(np.uint64)
    new = np.append(True, keys[1:] != keys[:-1])
    repeats = ~new | np.append(~new[1:], False)
    k, n = keys[new], nodes[new]
    width = (1 << 64) // parts + 1
    cuts = np.searchsorted(k, np.array([p * width for p in range(parts)], np.uint64)).tolist() + [len(k)]
    for p, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
        if b > a:
            yield p, 0, packed(k[a:b]), packed(n[a:b])
    k, n = keys[repeats], nodes[repeats]
    for a in range(0, len(k), PART):
        yield -1, salt + a, packed(k[a : a + PART]), packed(n[a : a + PART])


def packed_keys(batches, k: int, similar: int, parts: int, held: int):
    """Batches of PACKED from those of texts_of, of about so many keys each."""
    keys, owners, count = [], [], 0

    def flush():
        rows = slices(np.concatenate(keys), np.concatenate(owners), parts, int(owners[0][0]) * 997 % (1 << 40))
        keys.clear()
        owners.clear()
        rows = list(rows)
        for a in range(0, len(rows), 64):
            yield pd.DataFrame(rows[a : a + 64], columns=PACKED.names)

    for part in unpacked_pieces(batches, PIECE):
        found, of = block_keys(shingle_sets([t for _, t in part], k), similar)
        if len(found):
            keys.append(found)
            owners.append(np.array([i for i, _ in part], np.int64)[of])
            count += len(found)
        if count >= held:
            yield from flush()
            count = 0
    if count:
        yield from flush()


def shared_keys(docs: DataFrame, nodes: DataFrame, k: int, similar: int) -> DataFrame:
    """(key, node): the nodes of keys that several nodes have; a row may come twice."""
    total = nodes.agg(F.sum("n")).first()[0] or 0
    parts, held = max(shuffles(docs.sparkSession), int(0.6 * total) // PART + 1), HELD
    keyed = lambda batches: packed_keys(batches, k, similar, parts, held)

    def met(group: pd.DataFrame) -> pd.DataFrame:
        keys, nodes = (np.concatenate([unpacked(x) for x in group[c]]) for c in ("keys", "nodes"))
        if group["part"].iloc[0] >= 0:
            order = np.argsort(keys)
            keys, nodes = keys[order], nodes[order]
            same = keys[1:] == keys[:-1]
            several = np.append(False, same) | np.append(same, False)
            keys, nodes = keys[several], nodes[several]
        return pd.DataFrame({"key": keys.view(np.int64), "node": nodes.view(np.int64)})

    return texts_of(docs, nodes).mapInPandas(keyed, PACKED).groupBy("part", "salt").applyInPandas(met, _longs("key", "node"))


def _apart(a, b):
    """The Hamming distance of two narrow sketches, named by a prefix each."""
    return sum((F.bit_count(F.col(f"{a}{c}").bitwiseXOR(F.col(f"{b}{c}"))) for c in BITS), F.lit(0))


def wide_bits(shingles: np.ndarray) -> bytes:
    """A sketch of four to eight bits for each shingle; a power of two, so that a longer one folds to a shorter one's size."""
    size = 64 << max(0, math.ceil(math.log2(max(len(shingles), 1) / 16)))
    flips = np.bincount((mixed(shingles ^ np.uint64(0x6C62272E07BB0142)) & np.uint64(size - 1)).astype(np.int64), minlength=size)
    return np.packbits((flips & 1).astype(np.uint8)).tobytes()


def _distance(a: bytes, b: bytes) -> int:
    x, y = sorted((np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)), key=len)
    return int(np.bitwise_count(x ^ np.bitwise_xor.reduce(y.reshape(-1, len(x)), axis=0)).sum())


@once
@F.pandas_udf(T.LongType())
def wide_distance(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([_distance(x, y) for x, y in zip(a, b, strict=True)], dtype="int64")


def shared_shingles(k: int):
    """How many shingles two compressed texts have in common."""

    @F.pandas_udf(T.LongType())
    def shared(a: pd.Series, b: pd.Series) -> pd.Series:
        expand, last = zstandard.ZstdDecompressor().decompress, (None, None)
        out = []
        for x, y in zip(a, b, strict=True):
            if x != last[0]:
                last = x, shingle_sets([expand(x)], k)[0]
            out.append(len(np.intersect1d(last[1], shingle_sets([expand(y)], k)[0], assume_unique=True)))
        return pd.Series(out, dtype="int64")

    return shared


class ParityLinker(Linker):
    """Pairs are judged by the distance of their sketches and verified on the full sets, which are made of the texts again.

    Texts are several times smaller than their sets; they and the sketches of long ones lie in buckets, to which rounds of pairs come.
    """

    def __init__(self, docs: DataFrame, nodes: DataFrame, members: DataFrame, k: int, similar: int):
        def of(batches):
            for batch in batches:
                for part in unpacked_pieces([batch], PIECE):
                    sets, compress = shingle_sets([t for _, t in part], k), zstandard.ZstdCompressor(level=3).compress
                    yield pd.DataFrame({"node": [i for i, _ in part], "n": [len(s) for s in sets], "packed": [compress(t) for _, t in part], "wide": [wide_bits(s) if len(s) > 64 * WIDTH else b"" for s in sets]})

        self.similar, self.k, self.labels = similar, k, None
        self.nodes = nodes.select("node", "n", F.struct(*BITS).alias("bits"))
        texts = texts_of(docs, members.select("node").distinct()).mapInPandas(of, "node long, n long, packed binary, wide binary")
        self.texts = bucketed(texts, "texts", shuffles(docs.sparkSession), ["node"], compression="none")

    def linked(self, pairs: DataFrame) -> DataFrame:
        both = self._joined(pairs.select("a", "b"), self.texts, "packed").withColumn("i", shared_shingles(self.k)("packed_a", "packed_b"))
        return both.where(100 * F.col("i") >= self.similar * (F.col("n_a") + F.col("n_b") - F.col("i"))).select("a", "b")

    def promising(self, pairs: DataFrame) -> DataFrame:
        both = self._joined(pairs, self.nodes, "bits").select("a", "b", "n_a", "n_b", *[F.col(f"bits_{s}.{c}").alias(f"{s}_{c}") for s in "ab" for c in BITS])
        total = F.col("n_a") + F.col("n_b")
        close = both.where(100 * F.least("n_a", "n_b") >= self.similar * F.greatest("n_a", "n_b")).withColumn("apart", _apart("a_", "b_"))
        allowed = (100 + self.similar) * F.col("apart") <= (100 - self.similar) * total
        close = stored(close.where(allowed).select("a", "b", "n_a", "n_b", (-F.col("apart") / total).alias("estimate")), "close")
        # the narrow sketches of long texts are full: what they say is asked again of wide ones
        long = F.least("n_a", "n_b") > 64 * WIDTH
        again = self._joined(close.where(long).select("a", "b"), self.texts, "wide").withColumn("apart", wide_distance("wide_a", "wide_b"))
        again = again.where(allowed).select("a", "b", (-F.col("apart") / total).alias("estimate"))
        return stored(close.where(~long).select("a", "b", "estimate").union(again), "promising")

    def cross_pairs(self, members: DataFrame) -> DataFrame:
        """(a, b), a < b: pairs of one key in different components whose narrow sketches allow a link, each once."""
        rows = stored(self.labelled(members, "node", "label"), "labelled")
        mixed_keys = rows.groupBy("key").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo <> hi").select("key")
        rows = stored(rows.join(stored(mixed_keys, "mixed"), "key"), "in-mixed")
        sizes = rows.groupBy("key", "label").agg(F.count("*").alias("c"))
        most = stored(sizes.groupBy("key").agg(F.max_by("label", F.struct("c", "label")).alias("most"), F.ceil(F.sum("c") / SPLIT).cast("int").alias("salts")), "most")
        sketched = rows.join(self.nodes.select("node", "n", *[F.col(f"bits.{c}").alias(c) for c in BITS]), "node").join(most, "key")
        # sets of similar size lie in the same bin or next to it
        sketched = sketched.withColumn("bin", F.floor(F.log("n") / math.log(100 / self.similar * 1.001)).cast("int"))
        minor = sketched.where("label <> most").withColumn("bin", F.explode(F.sequence(F.col("bin") - 1, F.col("bin") + 1)))
        minor = minor.withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)))
        minor = minor.select("key", "bin", "salt", F.col("node").alias("x"), *[F.col(c).alias(f"x_{c}") for c in ("label", "n", *BITS)])
        sketched = sketched.withColumn("salt", F.pmod(F.xxhash64("node"), "salts").cast("int"))
        close = (100 + self.similar) * _apart("", "x_") <= (100 - self.similar) * (F.col("n") + F.col("x_n"))
        pairs = minor.join(sketched, ["key", "bin", "salt"]).where((F.col("label") != F.col("x_label")) & close)
        return pairs.select(F.least("x", "node").alias("a"), F.greatest("x", "node").alias("b")).distinct()


def joined(docs: DataFrame, k: int = K, similar: int = SIMILAR) -> DataFrame:
    """(doc_id, n_shingles, component_id), a row for each row of docs."""
    with small_batches(docs.sparkSession):
        copies = Copies(stored(sketches(docs, k), "sketches"))
        # a set of n shingles can only be linked with another one if n / (n + 1) reaches the threshold
        nodes = copies.nodes().where(100 * F.col("n") >= similar * (F.col("n") + 1))
        nodes = stored(nodes.select("node", "n", *BITS), "nodes")
        members = stored(shared_keys(docs, nodes, k, similar), "members").distinct()
        heads = stored(members.groupBy("key").agg(F.min("node").alias("head")), "heads")
        linker = ParityLinker(docs, nodes, members, k, similar)
        pairs = members.join(heads, "key").where("node <> head").select(F.col("head").alias("a"), F.col("node").alias("b")).distinct()
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
        left = linker.promising(linker.cross_pairs(members))
        if not left.isEmpty():
            linker.verify(left)
        component = F.when(F.col("n") > 0, F.coalesce("label", "doc_id")).otherwise(F.col("doc_id"))
        component = F.when(F.col("doc_id").isNotNull(), component)
        every = copies.carried(linker.labelled(copies.same.select("node").distinct(), "node", "label"))
        return every.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"))


def op11_parity_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return joined(table(spark, sf_dir, "documents").select("doc_id", "text"))
