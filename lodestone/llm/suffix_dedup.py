"""Suffix-array dedup: every byte that lies in a 200-byte string which also starts somewhere else is removed.

A distributed merge sort of suffixes in which equal strings become neighbours. It is sparse: only suffixes that begin at
anchors are sorted, each with the bytes to its left.

1. Anchors. Every LENGTH-byte string has an anchor, the place of its least GRAM-byte hash. Neighbouring starts with the
   same anchor form a stretch; equal strings have anchors with equal grams at equal places. Stretches whose gram occurs
   once in the corpus hold no repeated string; only hashes are exchanged to find the others.
2. Pre-aggregation. Equal stretches (128 bits of hashes over gram and bytes) are counted as one. All strings of a stretch
   that occurs more than once are repeated; a gram with one stretch needs no more. Every stretch of all other grams
   becomes an entry: the bytes from its anchor on are the suffix, the bytes before it go along.
3. Runs. Entries are sorted where their texts lie, RUN bytes at a time, and written as front-coded blocks. The blocks are
   cut at splitters from a bounded sample and exchanged by range, and all runs of a range are combined by a loser tree
   that knows what each contender shares with the last winner and never compares those bytes again.
4. The merge gives each entry the length of the prefix that it shares with the next. Two entries have a string of LENGTH
   bytes in common that begins n bytes before the anchors if they share LENGTH - n bytes from the anchor on and n bytes
   before it. Entries that share the gram are neighbours, so classes of equal prefixes (from the merge) and of equal
   left sides (from a sort of these) tell for every n which entries repeat.
5. A gram that a splitter falls into may be too common for one range. Its entries are spread out as hashes of their
   strings, which Spark groups, so no task ever holds all entries of a common gram.
6. The repeated starts go back to their documents, whose bytes they cover are taken out.

Rows are keyed by two hashes of (doc_id, text). Texts are kept compressed, bucketed by this key, in the shared folder, so
that the joins that need them again shuffle only the other side.

Defined results for odd input: a text that is null, empty or shorter than LENGTH loses nothing by itself; rows that
repeat a doc_id or the whole row are documents of their own; matches may overlap themselves; kept bytes need not be
valid UTF-8 and are returned as binary; an empty table gives an empty result; other columns, whatever their names, are
ignored.
"""

from __future__ import annotations

import uuid

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bucketed, discard, salted_join, shuffles, stored, table
from .hashing import mixed
from .suffix_merge import LoserTree, common, decoded, front_coded

LENGTH = 200
GRAM = 100
RUN = 1 << 20  # bytes of entries that are sorted at once
RANGE = 1 << 20  # bytes of front-coded entries that a range should hold
AGAIN = 10  # bits of the number of a range within one that is cut again
SAMPLE = 16384  # heads of blocks at most from which the splitters are taken
BLOCK = 256  # entries of a front-coded block
MERGED = 1 << 14  # entries at least that are compared at once
PACKED = 9  # level at which texts are compressed
SEGMENT = 1 << 20  # starts of a document that are looked at together
_PLACE = np.uint64((1 << 24) - 1)
_BASE = 0x9E3779B97F4A7C15
_rng = np.random.default_rng(10)
_BYTE, _OTHER = _rng.integers(0, 2**64, (2, 256), dtype=np.uint64)
_POWERS: dict = {}

_long = lambda *names: [T.StructField(n, T.LongType()) for n in names]
STRETCHES = T.StructType([*_long("k1", "k2"), T.StructField("gram", T.ArrayType(T.LongType())), *[T.StructField(n, T.ArrayType(T.IntegerType())) for n in ("start", "end", "anchor")]])
TEXTS = T.StructType([*_long("k1", "k2"), T.StructField("packed", T.BinaryType()), *[T.StructField(n, T.ArrayType(T.IntegerType())) for n in ("start", "end", "anchor")]])
HASHED = T.StructType([*_long("h", "g", "k1", "k2"), *[T.StructField(n, T.IntegerType()) for n in ("start", "end", "anchor")]])
BLOCKS = T.StructType([T.StructField("run", T.StringType()), T.StructField("range", T.IntegerType()), T.StructField("head", T.BinaryType()), T.StructField("entries", T.BinaryType()), T.StructField("owners", T.BinaryType())])
REPEATED = T.StructType([*_long("h", "g"), T.StructField("starts", T.ArrayType(T.LongType()))])
STRINGS = T.StructType([*_long("h", "g", "c"), *[T.StructField(n, T.ArrayType(T.LongType())) for n in ("w1", "w2")]])
#: What goes with an entry: hashes and count of its stretch, least and most bytes before the anchor at which a string begins.
OWNER = np.dtype([("h", "<i8"), ("g", "<i8"), ("c", "<i8"), ("lo", "<i4"), ("hi", "<i4"), ("left", "<i4")])
CUT = T.StructType([*_long("k1", "k2", "n_removed", "n_spans"), T.StructField("kept", T.BinaryType())])


def _powers(n: int, inverse: bool = False) -> np.ndarray:
    """The base's powers (or their inverses modulo 2^64) from 0 to n - 1."""
    have = _POWERS.get(inverse)
    if have is None or len(have) < n:
        have = np.ones(max(n, SEGMENT + LENGTH), np.uint64)
        np.cumprod(np.full(len(have) - 1, pow(_BASE, -1, 2**64) if inverse else _BASE, np.uint64), out=have[1:])
        _POWERS[inverse] = have
    return have[:n]


def stretches(data: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash of the anchor's gram, first start, end of the last string, anchor) of each stretch."""
    n, width, out = len(data) - length + 1, length - gram + 1, []
    for at in range(0, n, SEGMENT):
        part = data[at : min(at + SEGMENT, n) + length - 1]
        sums = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(_BYTE[part] * _powers(len(part)), out=sums[1:])
        grams = mixed((sums[gram:] - sums[:-gram]) * _powers(len(part) - gram + 1, inverse=True))
        least, span = (grams & ~_PLACE) | np.arange(len(grams), dtype=np.uint64), 1
        while 2 * span <= width:
            least, span = np.minimum(least[:-span], least[span:]), 2 * span
        if span < width:
            least = np.minimum(least[: span - width], least[width - span :])
        anchor = (least & _PLACE).astype(np.int64)
        start = np.flatnonzero(np.diff(anchor, prepend=-1))
        end = np.append(start[1:], len(anchor)) - 1 + length
        out.append((grams[anchor[start]], start + at, end + at, anchor[start] + at))
    return tuple(map(np.concatenate, zip(*out, strict=True))) if out else tuple(np.zeros(0, t) for t in (np.uint64, np.int64, np.int64, np.int64))


def _hash_of(table_: np.ndarray, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of the bytes of each (start, end), none of which is empty."""
    sizes = end - start
    first = np.cumsum(sizes) - sizes
    within = np.arange(int(sizes.sum())) - np.repeat(first, sizes)
    sums = np.add.reduceat(table_[data[within + np.repeat(start, sizes)]] * _powers(int(sizes.max()))[within], first)
    return mixed(sums + sizes.astype(np.uint64) * np.uint64(_BASE))


def _bytes(packed: bytes) -> bytes:
    import zstandard

    return zstandard.ZstdDecompressor().decompress(packed)


def _find_stretches(length: int, gram: int):
    def find(batches):
        for batch in batches:
            rows = []
            for k1, k2, text in zip(batch["k1"], batch["k2"], batch["text"], strict=True):
                g, *rest = stretches(np.frombuffer(text, np.uint8), length, gram)
                rows.append((k1, k2, g.view(np.int64), *(x.astype(np.int32) for x in rest)))
            yield pd.DataFrame(rows, columns=STRETCHES.names)

    return find


def _pack(batches):
    import zstandard

    pack = zstandard.ZstdCompressor(PACKED).compress
    for batch in batches:
        yield pd.DataFrame({"k1": batch["k1"], "k2": batch["k2"], "packed": batch["text"].map(pack)})


def _hash_stretches(gram: int):
    def of(batches):
        for batch in batches:
            parts = []
            for row in batch.itertuples(index=False):
                data = np.frombuffer(_bytes(row.packed), np.uint8)
                start, end, anchor = (np.asarray(x, np.int64) for x in (row.start, row.end, row.anchor))
                parts.append((_hash_of(_BYTE, data, anchor, anchor + gram), _hash_of(_OTHER, data, start, end), start, end, anchor))
            if parts:
                h, g, start, end, anchor = map(np.concatenate, zip(*parts, strict=True))
                sizes = [len(x[0]) for x in parts]
                keys = {k: np.repeat(batch[k].to_numpy(), sizes) for k in ("k1", "k2")}
                yield pd.DataFrame({"h": h.view(np.int64), "g": g.view(np.int64), **keys, "start": start.astype(np.int32), "end": end.astype(np.int32), "anchor": anchor.astype(np.int32)})

    return of


def _block(run: str, part: int, entries: list[tuple[bytes, tuple]]) -> tuple:
    """A front-coded block of sorted entries (suffix, (h, g, c, lo, hi, bytes before the anchor))."""
    strings = [text for text, _ in entries]
    owners = np.array([(*owner[:5], len(owner[5])) for _, owner in entries], OWNER)
    return run, part, strings[0], front_coded(strings, range(len(strings))), owners.tobytes() + b"".join(owner[5] for _, owner in entries)


def _owners(data: bytes, count: int) -> list[tuple]:
    table_ = np.frombuffer(data, OWNER, count)
    ends = count * OWNER.itemsize + np.cumsum(table_["left"])
    return [(*o[:5], data[end - o[5] : end]) for o, end in zip(table_.tolist(), ends.tolist(), strict=True)]


def _entries(row) -> list[tuple[int, bytes, tuple]]:
    """(bytes shared with the entry before, suffix, owner) of a block."""
    coded = list(decoded(row.entries))
    return [(lcp, text, owner) for (lcp, text, _), owner in zip(coded, _owners(row.owners, len(coded)), strict=True)]


def _sort_runs(length: int, run_bytes: int):
    """Cut the wanted stretches out of their texts and sort them into front-coded runs."""

    def run_of(entries: list) -> list[tuple]:
        entries.sort(key=lambda e: e[0])
        run = uuid.uuid4().hex
        return [_block(run, 0, entries[a : a + BLOCK]) for a in range(0, len(entries), BLOCK)]

    def sort(batches):
        held, size = [], 0
        for batch in batches:
            out: list = []
            for row in batch.itertuples(index=False):
                data = _bytes(row.packed)
                for r in row.wanted:
                    start, end, anchor = r["start"], r["end"], r["anchor"]
                    held.append((data[anchor:end], (r["h"], r["g"], r["c"], anchor - end + length, anchor - start, data[start:anchor])))
                    size += end - start
                    if size >= run_bytes:
                        out += run_of(held)
                        held, size = [], 0
            yield pd.DataFrame(out, columns=BLOCKS.names)
        if held:
            yield pd.DataFrame(run_of(held), columns=BLOCKS.names)

    return sort


def _cut_at(splitters: list[bytes] | None, gram: int, inside: bool):
    """Cut the blocks at the splitters. Entries that share the gram with one are left out, or (inside) they alone are kept, whole.

    Without splitters each block brings those of its range, which is cut to ranges of its own.
    """
    from bisect import bisect_right

    def split(splitters: list[bytes], text: bytes, n: int) -> bool:
        return any(text[:gram] == splitters[i][:gram] for i in (n - 1, n) if 0 <= i < len(splitters))

    def cut(batches):
        for batch in batches:
            out = []
            for row in batch.itertuples(index=False):
                parts: dict[int, list] = {}
                known = splitters if splitters is not None else [bytes(x) for x in row.splitters]
                base = 0 if splitters is not None else row.range << AGAIN
                for _, text, owner in _entries(row):
                    n = bisect_right(known, text)
                    if split(known, text, n) == inside:
                        parts.setdefault(base + n, []).append((text, owner))
                out += [_block(row.run, n, entries) for n, entries in parts.items()]
            yield pd.DataFrame(out, columns=BLOCKS.names)

    return cut


def _spread(length: int):
    """Two hashes of every string of an entry, in the order of their starts."""

    def spread(batches):
        for batch in batches:
            rows = []
            for row in batch.itertuples(index=False):
                for _, text, (h, g, c, lo, hi, left) in _entries(row):
                    data = np.frombuffer(left + text, np.uint8)
                    at = np.arange(hi - lo + 1)
                    w1, w2 = (_hash_of(t, data, at, at + length) for t in (_BYTE, _OTHER))
                    rows.append((h, g, c, w1.view(np.int64), w2.view(np.int64)))
            yield pd.DataFrame(rows, columns=STRINGS.names)

    return spread


def _classes(shared: np.ndarray, depth: int) -> np.ndarray:
    """Numbers for entries in sorted order, equal where all between share depth bytes with the one before."""
    return np.cumsum(shared < depth)


def _repeats(shared: list[int], owners: list[tuple], length: int, gram: int) -> list[tuple]:
    """(h, g, starts) of merged entries: where strings begin that another entry of the same gram holds too."""
    shared_ = np.array(shared)
    group = _classes(shared_, gram)
    lo, hi, count = (np.array([o[n] for o in owners]) for n in (3, 4, 2))
    most = length - gram
    # the left sides, nearest byte first, filled up to equal size: what is beyond a side is never asked for
    sides = np.frombuffer(b"".join(o[5][::-1].ljust(most, b"\0") for o in owners), np.uint8).reshape(len(owners), most)
    order = np.lexsort((sides.view(f"S{most}").ravel(), group)) if most else np.arange(len(owners))
    same = np.zeros(len(order), np.int64)
    differ = sides[order[1:]] != sides[order[:-1]]
    same[1:] = np.where(differ.any(axis=1), differ.argmax(axis=1), most)
    same[1:][group[order[1:]] != group[order[:-1]]] = -1
    open_ = count == 1
    out: dict[int, list] = {}
    for n in range(most + 1):
        has = np.flatnonzero((lo <= n) & (n <= hi))
        if not len(has):
            continue
        left = np.empty(len(order), np.int64)
        left[order] = _classes(same, n)
        pair = _classes(shared_, length - n)[has] * np.int64(len(order) + 1) + left[has]
        _, back, times = np.unique(pair, return_inverse=True, return_counts=True)
        for i in has[(times[back] > 1) & open_[has]]:
            out.setdefault(int(i), []).append(int(hi[i]) - n)
    return [(owners[i][0], owners[i][1], starts) for i, starts in out.items()]


def _merge(length: int, gram: int):
    """Merge the runs of each range, whose blocks come one after the other."""

    def run_of(blocks: list):
        before = b""  # a block is coded anew; what its first entry shares with the block before is found here
        for row in sorted(blocks, key=lambda r: r.head):
            for n, (lcp, text, owner) in enumerate(_entries(row)):
                yield (lcp if n else common(before, text)), text, owner
                before = text

    def merged(blocks: list):
        runs: dict[str, list] = {}
        for row in blocks:
            runs.setdefault(row.run, []).append(row)
        shared, owners = [], []
        for lcp, _, _, owner in LoserTree(map(run_of, runs.values())):
            if lcp < gram and len(owners) >= MERGED:
                yield _repeats(shared, owners, length, gram)
                shared, owners = [], []
            shared.append(lcp)
            owners.append(owner)
        if owners:
            yield _repeats(shared, owners, length, gram)

    def merge(batches):
        held: list = []
        for batch in batches:
            for row in batch.itertuples(index=False):
                if held and row.range != held[0].range:
                    for found in merged(held):
                        yield pd.DataFrame(found, columns=REPEATED.names)
                    held = []
                held.append(row)
        for found in merged(held):
            yield pd.DataFrame(found, columns=REPEATED.names)

    return merge


def _remove(length: int):
    def remove(batches):
        for batch in batches:
            rows = []
            for row in batch.itertuples(index=False):
                data = np.frombuffer(_bytes(row.packed), np.uint8)
                edge = np.zeros(len(data) + 1, np.int32)
                for r in row.repeated:
                    # a whole stretch is one interval; else its repeated starts
                    starts = None if r["starts"] is None else np.asarray(r["starts"], np.int64) + r["start"]
                    if starts is None:
                        edge[r["start"]] += 1
                        edge[r["end"]] -= 1
                    else:
                        np.add.at(edge, starts, 1)
                        np.add.at(edge, starts + length, -1)
                gone = np.cumsum(edge[:-1]) > 0
                spans = int(np.count_nonzero(np.diff(gone.view(np.int8), prepend=0) == 1))
                rows.append((row.k1, row.k2, int(gone.sum()), spans, data[~gone].tobytes()))
            yield pd.DataFrame(rows, columns=CUT.names)

    return remove


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.withColumn("k1", F.xxhash64("doc_id", "text")).withColumn("k2", F.xxhash64(F.lit("row"), "text", "doc_id"))


def _bytes_of_blocks():
    return F.octet_length("entries") + F.octet_length("owners")


def _splitters(runs: DataFrame, sample: int, range_bytes: int) -> tuple[list[bytes], int]:
    """(where ranges begin, of how many bytes they are about): as many as the entries ask for and the sample allows."""
    total = runs.agg(F.sum(_bytes_of_blocks()).alias("n")).first()["n"] or 0
    wanted = total // range_bytes + 1
    # only the heads that are drawn come to the driver, and no more than sixty-four for each range
    heads = runs.select("head").orderBy(F.xxhash64("head", "run")).limit(min(sample, 64 * wanted))
    many = sorted({bytes(r["head"]) for r in heads.collect()})
    ranges = min(len(many) // 16 + 1 if 64 * wanted > sample else len(many), wanted)
    return [many[len(many) * n // ranges] for n in range(1, ranges)], total // max(ranges, 1)


def _splitters_of_ranges(cut: DataFrame, range_bytes: int) -> DataFrame:
    """(range, splitters) of ranges of more than range_bytes: where they are cut again, from a sample of their own blocks."""
    sizes = cut.groupBy("range").agg(F.sum(_bytes_of_blocks()).alias("bytes")).select("range", F.least(F.ceil(F.col("bytes") / range_bytes), F.lit(1 << AGAIN)).cast("int").alias("wanted"))
    drawn = cut.select("range", "head", F.row_number().over(Window.partitionBy("range").orderBy(F.xxhash64("head", "run"))).alias("r")).where(F.col("r") <= 16 << AGAIN)
    heads = drawn.join(sizes, "range").where((F.col("r") <= 16 * F.col("wanted")) & (F.col("wanted") > 1)).groupBy("range", "wanted").agg(F.array_sort(F.collect_set("head")).alias("heads"))
    places = F.transform(F.sequence(F.lit(1), F.least("wanted", F.size("heads")) - 1), lambda n: F.get("heads", (n * F.size("heads") / F.least("wanted", F.size("heads"))).cast("int")))
    return heads.where(F.size("heads") > 1).select("range", F.array_distinct(places).alias("splitters"))


def repeated_starts(runs: DataFrame, length: int = LENGTH, gram: int = GRAM, sample: int = SAMPLE, range_bytes: int = RANGE) -> DataFrame:
    """(h, g, starts): where strings begin, in stretches that occur once, that another stretch holds too.

    Where the driver's sample has too few heads for ranges of range_bytes, each range is cut again by a sample of its own.
    """
    splitters, each = _splitters(runs, sample, range_bytes)
    ranges = len(splitters) + 1
    cut = runs.mapInPandas(_cut_at(splitters, gram, inside=False), BLOCKS)
    inside = runs.mapInPandas(_cut_at(splitters, gram, inside=True), BLOCKS)
    if each > 2 * range_bytes:
        cut = stored(cut, "ranges")
        again = cut.join(stored(_splitters_of_ranges(cut, range_bytes), "splitters"), "range", "left").withColumn("splitters", F.coalesce("splitters", F.array().cast("array<binary>")))
        ranges *= each // range_bytes + 1
        cut, more = (again.mapInPandas(_cut_at(None, gram, inside=x), BLOCKS) for x in (False, True))
        inside = inside.union(more)
    parts = min(ranges, 4 * shuffles(runs.sparkSession))
    found = cut.repartition(parts, "range").sortWithinPartitions("range").mapInPandas(_merge(length, gram), REPEATED)
    if ranges == 1:
        return found
    spread = inside.mapInPandas(_spread(length), STRINGS)
    strings = spread.select("h", "g", "c", F.posexplode(F.arrays_zip("w1", "w2")).alias("at", "w")).select("h", "g", "c", "at", "w.w1", "w.w2")
    strings = stored(strings, "spread")
    many = strings.groupBy("w1", "w2").agg(F.count("*").alias("n")).where("n > 1").select("w1", "w2")
    more = strings.where("c = 1").join(many, ["w1", "w2"]).groupBy("h", "g").agg(F.collect_list(F.col("at").cast("long")).alias("starts"))
    return found.union(more)


def sorted_runs(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, run_bytes: int = RUN) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(texts, their stretches with hashes, equal stretches counted, front-coded runs); rows as _keyed names them."""
    spark, key = docs.sparkSession, ["k1", "k2"]
    texts = _keyed(docs.select("doc_id", "text")).select("k1", "k2", F.col("text").cast("binary").alias("text")).where(F.octet_length("text") >= length)
    found = stored(texts.mapInPandas(_find_stretches(length, gram), STRETCHES), "stretches")
    every = found.select("k1", "k2", F.explode(F.arrays_zip("gram", "start", "end", "anchor")).alias("s")).select("k1", "k2", "s.*")
    shared = stored(found.select(F.explode("gram").alias("gram")).groupBy("gram").agg(F.count("*").alias("n")).where("n > 1"), "shared")
    by_row = salted_join(every, shared.select("gram"), ["gram"], shared, ["k1", "k2", "start"]).groupBy(*key).agg(F.collect_set(F.struct("start", "end", "anchor")).alias("s"))
    lists = by_row.select("k1", "k2", *[F.col(f"s.{c}").alias(c) for c in ("start", "end", "anchor")])
    packed = texts.mapInPandas(_pack, T.StructType([*TEXTS.fields[:3]])).join(lists, key)
    held = bucketed(packed, "suffix-texts", shuffles(spark), key, compression="none")
    discard(found, shared)  # the texts are written with their shared stretches

    hashed = stored(held.mapInPandas(_hash_stretches(gram), HASHED), "hashed")
    groups = stored(hashed.groupBy("h", "g").agg(F.count("*").alias("c"), F.min(F.struct("k1", "k2", "start", "end", "anchor")).alias("first")), "groups")
    several = groups.groupBy("h").agg(F.count("*").alias("n")).where("n > 1").select("h")
    wanted = groups.join(several, "h").select("first.*", F.struct("h", "g", "c", "first.start", "first.end", "first.anchor").alias("w"))
    wanted = wanted.groupBy(*key).agg(F.collect_list("w").alias("wanted"))
    runs = held.select("k1", "k2", "packed").dropDuplicates(key).join(wanted, key).select("packed", "wanted").mapInPandas(_sort_runs(length, run_bytes), BLOCKS)
    return held, hashed, groups, stored(runs, "runs")


def repeated_spans(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, run_bytes: int = RUN, **merging) -> DataFrame:
    """(k1, k2, n_removed, n_spans, kept) of each row (doc_id, text) of docs that loses bytes; rows as _keyed names them."""
    held, hashed, groups, runs = sorted_runs(docs, length, gram, run_bytes)
    whole = groups.where("c > 1").select("h", "g", F.lit(None).cast("array<long>").alias("starts"))
    repeated = stored(whole.union(repeated_starts(runs, length, gram, **merging)), "repeated")
    by_row = salted_join(hashed, repeated, ["h", "g"], groups.select("h", "g", F.col("c").alias("n")), ["k1", "k2", "start"]).groupBy("k1", "k2").agg(F.collect_set(F.struct("start", "end", "starts")).alias("repeated"))
    return held.select("k1", "k2", "packed").join(by_row, ["k1", "k2"]).mapInPandas(_remove(length), CUT).dropDuplicates(["k1", "k2"])


def suffix_dedup(docs: DataFrame, **options) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept (null where nothing goes) for each row of docs."""
    rows = _keyed(docs.select("doc_id", "text"))
    cut = repeated_spans(docs, **options)
    out = rows.join(cut, ["k1", "k2"], "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c)
    return out.select("doc_id", "text", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), zero("n_removed"), zero("n_spans"), "kept")


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    cut = repeated_spans(docs).select("k1", "k2", "n_removed", "n_spans", F.sha2("kept", 256).alias("sha"))
    rows = _keyed(docs).select("k1", "k2", "doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("whole"))
    out = rows.join(cut, ["k1", "k2"], "left")
    return out.select("doc_id", "n_bytes", F.coalesce("n_removed", F.lit(0)).cast("long").alias("n_removed"), F.coalesce("n_spans", F.lit(0)).cast("long").alias("n_spans"), F.coalesce("sha", "whole").alias("kept_sha256"))
