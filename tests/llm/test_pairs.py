"""The similarity join by parity sketches, against all pairs."""

import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.llm import minhash_dedup, parity_join
from lodestone.llm.hashing import mixed

from .conftest import folder, prose
from .test_corpus import brute_components, edited, held_at_most, long_texts


def brute(rows, k):
    """(doc_id, n_shingles, component_id) by linking all pairs."""
    out = Counter()
    for (i, n, c, _), times in brute_components(rows, k).items():
        out[(i, n, None if i is None else c)] += times
    return out


@pytest.fixture(scope="module")
def families(odd_rows):
    """The odd rows, families of near copies around the threshold of every size, chains, and texts with a common passage."""
    rows = [(r[0], r[1]) for r in odd_rows]
    base, passage = prose(77, 90), prose(78, 60)
    rows += [(100 + i, edited(base, i % 5, i)) for i in range(60)]
    rows += [(200 + i, " ".join(base.split()[: 90 - 3 * i])) for i in range(12)]
    rows += [(300 + i, f"{prose(500 + i, 20 + i)} {passage} {prose(600 + i, 20)}") for i in range(30)]
    for n in (5, 6, 8, 9, 10, 13, 20, 40):
        short = prose(900 + n, n)
        rows += [(1000 + 20 * n + i, " ".join(short.split()[: n - i])) for i in range(4)]
        rows += [(1010 + 20 * n, f"{short} more"), (1011 + 20 * n, edited(short, 1, n))]
    long = prose(79, 6000)
    rows += [(3000 + i, edited(long, 60 * i, i)) for i in range(5)]
    return rows


def test_parity_join(spark, families):
    docs = spark.createDataFrame(families, "doc_id long, text string")
    got = Counter(tuple(r) for r in parity_join.joined(docs).collect())
    assert got == brute(families, 5)


def test_parity_join_in_small_parts(spark, families, monkeypatch):
    for name in ("SPLIT", "PART"):
        monkeypatch.setattr(parity_join, name, 3)
    monkeypatch.setattr(parity_join, "HELD", 500)
    docs = spark.createDataFrame(families[:120], "doc_id long, text string")
    assert Counter(tuple(r) for r in parity_join.joined(docs, 2).collect()) == brute(families[:120], 2)


def test_parity_join_odd(spark, none, clashing, odd_rows, tmp_path):
    assert parity_join.joined(none).count() == 0
    got = Counter(tuple(r) for r in parity_join.op11_parity_join(spark, folder(clashing, tmp_path)).collect())
    assert got == brute([(r[0], r[1]) for r in odd_rows], 5)


def test_wide_distances_are_made_once(spark, monkeypatch):
    for module in (minhash_dedup, parity_join):
        monkeypatch.setattr(module, "stored", lambda df, name: df)
        monkeypatch.setattr(module, "bucketed", lambda df, *_, **__: df)
    docs = spark.createDataFrame([(1, "a b c d e f"), (2, "a b c d e g")], "doc_id long, text string")
    nodes = parity_join.sketches(docs, 2).withColumn("node", F.col("doc_id"))
    linker = parity_join.ParityLinker(docs, nodes, nodes, 2, 80)
    plan = linker.promising(spark.createDataFrame([(1, 2)], "a long, b long"))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1


def test_parity_join_in_small_batches(spark, monkeypatch):
    held_at_most(parity_join, monkeypatch, 8 << 20, 1 << 20)
    assert parity_join.joined(long_texts(spark)).where("doc_id = component_id AND n_shingles = 1").count() == 3000


@pytest.mark.parametrize("size", [4, 5, 6, 7, 9, 10, 19, 50, 333, 2500])
def test_pigeonhole_loses_no_link(size):
    """Sets that differ as much as similarity 0.8 allows share a key, however many pairs are drawn."""
    r = np.random.default_rng(size)
    for _ in range(400 if size < 100 else 20):
        pool = r.integers(0, 2**63, 3 * size, dtype=np.uint64)
        other = int(r.integers(-(-80 * size // 100), size + 1))
        least = -(-80 * (size + other) // 180)
        a, b = pool[:size], np.concatenate([pool[:least], pool[size : size + other - least]])
        assert 100 * least >= 80 * (size + other - least)
        keys, owners = parity_join.block_keys([np.unique(a), np.unique(b)])
        same = set(np.unique(a).tolist()) == set(np.unique(b).tolist())
        assert same or set(keys[owners == 0].tolist()) & set(keys[owners == 1].tolist())


def test_narrow_sketch_bounds_the_difference():
    r = random.Random(5)
    for n in (3, 40, 2000):
        a = {r.getrandbits(64) for _ in range(n)}
        b = set(r.sample(sorted(a), n - n // 3)) | {r.getrandbits(64) for _ in range(n // 4)}
        x, y = parity_join.parity_bits([np.array(sorted(s), np.uint64) for s in (a, b)])
        apart = sum(int(v).bit_count() for v in (x ^ y).view(np.uint64))
        assert apart <= len(a ^ b)
        assert apart >= min(len(a ^ b), 100) // 2


def test_packing():
    values = mixed(np.arange(1000, dtype=np.uint64))
    assert (parity_join.unpacked(parity_join.packed(values)) == values).all()


def test_wide_sketches_fold():
    r = random.Random(6)
    for n, m in ((1100, 1300), (2000, 2100), (3000, 5000)):
        a = {r.getrandbits(64) for _ in range(n)}
        b = set(r.sample(sorted(a), n - n // 9)) | {r.getrandbits(64) for _ in range(m - n + n // 9)}
        x, y = (parity_join.wide_bits(np.array(sorted(s), np.uint64)) for s in (a, b))
        assert len(a ^ b) // 3 <= parity_join._distance(x, y) <= len(a ^ b)


def test_keys_are_made_in_small_pieces():
    import random
    import tracemalloc

    import pandas as pd
    import zstandard

    r, compress = random.Random(4), zstandard.ZstdCompressor(level=1).compress
    texts = [compress(" ".join(str(r.randrange(10**5)) for _ in range(9000)).encode()) for _ in range(170)]
    batch = pd.DataFrame({"doc_id": range(170), "packed": texts})
    tracemalloc.start()
    rows = sum(len(b) for b in parity_join.packed_keys([batch], 5, 80, 50, parity_join.HELD))
    peak = tracemalloc.get_traced_memory()[1] / 1e6
    tracemalloc.stop()
    assert rows >= 50 and peak < 80
