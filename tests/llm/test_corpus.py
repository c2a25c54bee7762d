"""Operators that compare documents, against brute force."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.llm import decontaminate, minhash_dedup, quality_classifier, suffix_dedup
from lodestone.llm.components import components
from lodestone.llm.suffix_merge import LoserTree, common, decoded, front_coded

from .conftest import DOCS, folder, prose

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def word_list(text):
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOW))


def shingle_set(text, k):
    w = word_list(text)
    return frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else [])


def brute_components(rows, k):
    """Component of each row by linking all pairs; rows (doc_id, text)."""
    sets = [(i, shingle_set(t, k)) for i, t in rows]
    parent = {i: i for i, _ in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for n, (i, a) in enumerate(sets):
        for j, b in sets[:n]:
            if i is not None and j is not None and a and 100 * len(a & b) >= 80 * len(a | b):
                x, y = find(i), find(j)
                parent[max(x, y)] = min(x, y)
    return Counter((i, len(s), find(i), i is None or find(i) == i) for i, s in sets)


def edited(text, n, seed):
    """text with n of its words changed."""
    r, w = random.Random(seed), text.split()
    for at in r.sample(range(len(w)), n):
        w[at] = prose(seed * 100 + at, 1)
    return " ".join(w)


@pytest.fixture(scope="module")
def group(odd_rows):
    """The odd rows, and a large group of near copies around the threshold with chains among them."""
    base = prose(77, 90)
    rows = [(r[0], r[1]) for r in odd_rows]
    rows += [(100 + i, edited(base, i % 9, i)) for i in range(60)]
    rows += [(200 + i, " ".join(base.split()[: 90 - 3 * i])) for i in range(12)]
    return rows


@pytest.mark.parametrize("k", [2, 5])
def test_near_duplicates(spark, group, k):
    docs = spark.createDataFrame(group, "doc_id long, text string")
    got = Counter(tuple(r) for r in minhash_dedup.near_duplicates(docs, k).collect())
    assert got == brute_components(group, k)


def test_buckets_are_split(spark, group, monkeypatch):
    monkeypatch.setattr(minhash_dedup, "SPLIT", 3)
    docs = spark.createDataFrame(group, "doc_id long, text string")
    assert Counter(tuple(r) for r in minhash_dedup.near_duplicates(docs, 2).collect()) == brute_components(group, 2)


def test_near_duplicates_empty(spark, none):
    assert minhash_dedup.near_duplicates(none).count() == 0
    assert minhash_dedup.stage(spark, none, "").columns == none.columns


def test_near_duplicates_stage(spark, clashing):
    out = minhash_dedup.stage(spark, clashing, "")
    assert out.columns == clashing.columns
    ids = Counter(r.doc_id for r in out.select("doc_id").collect())
    assert ids[1] == 1 and 2 not in ids and ids[4] == ids[5] == 1 and ids[None] == 2


def test_estimates_are_made_once(spark, monkeypatch):
    """A filter on them that is pushed below would run them twice, in two workers a task."""
    monkeypatch.setattr(minhash_dedup, "stored", lambda df, name: df)
    monkeypatch.setattr(minhash_dedup, "bucketed", lambda df, *_, **__: df)
    docs = spark.createDataFrame([(1, "a b c d e f"), (2, "a b c d e g")], "doc_id long, text string")
    nodes = minhash_dedup.sketches(docs, 2).withColumn("node", F.col("doc_id"))
    linker = minhash_dedup.Linker(docs, nodes, nodes, 2, 80)
    plan = linker.promising(spark.createDataFrame([(1, 2)], "a long, b long"))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1


def held_at_most(module, monkeypatch, batch, piece):
    """Let tasks of module fail that get more bytes of texts in one batch, or make sets of more together."""
    cut, made = module.pieces, module.shingle_sets

    def pieces(rows, size_of, *most):
        assert not isinstance(rows, list) or sum(len(r[1]) for r in rows) < batch
        return cut(rows, size_of, *most)

    def shingle_sets(texts, k):
        assert sum(map(len, texts)) < piece
        return made(texts, k)

    monkeypatch.setattr(module, "pieces", pieces)
    monkeypatch.setattr(module, "shingle_sets", shingle_sets)


def long_texts(spark):
    """15 MB in one partition."""
    return spark.range(0, 3000, 1, 1).select(F.col("id").alias("doc_id"), F.repeat(F.concat(F.lit("w"), F.col("id") + 1000, F.lit(" ")), 833).alias("text"))


def test_near_duplicates_in_small_batches(spark, monkeypatch):
    held_at_most(minhash_dedup, monkeypatch, 8 << 20, 1 << 20)
    before = spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch")
    assert minhash_dedup.near_duplicates(long_texts(spark), 2).where("kept AND n_shingles = 1").count() == 3000
    assert spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch") == before


def test_registers_estimate():
    r = np.random.default_rng(3)
    whole = r.integers(0, 2**64, 1000, dtype=np.uint64)
    a, b = whole[:900], whole[100:]
    regs = minhash_dedup.registers([a, b, r.integers(0, 2**64, 900, dtype=np.uint64)])
    est = minhash_dedup.estimated(regs[[0, 0]], regs[[1, 2]], np.array([900, 900]))
    assert abs(est[0] - 0.8) < 0.15 and abs(est[1]) < 0.1
    assert (regs[0] >> minhash_dedup.MANTISSA).min() >= 0 and 0 < minhash_dedup.chance(100) < 0.01


def test_components(spark):
    links = [(i, i + 1) for i in range(20)] + [(30, 31), (31, 32), (30, 32), (40, 40)]
    got = {r.node: r.label for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**dict.fromkeys(range(21), 0), 30: 30, 31: 30, 32: 30, 40: 40}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def brute_repeats(rows, length):
    data = [(i, (t or "").encode()) for i, t in rows]
    seen = Counter(b[s : s + length] for _, b in data for s in range(len(b) - length + 1))
    out = Counter()
    for i, b in data:
        gone = np.zeros(len(b) + 1, bool)
        for s in range(len(b) - length + 1):
            if seen[b[s : s + length]] > 1:
                gone[s : s + length] = True
        kept = bytes(x for x, g in zip(b, gone, strict=False) if not g)
        out[(i, len(b), int(gone.sum()), int(np.count_nonzero(np.diff(gone.view(np.int8), prepend=0) == 1)), hashlib.sha256(kept).hexdigest())] += 1
    return out


def spans(df):
    return Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, hashlib.sha256(bytes(r.kept) if r.kept is not None else (r.text or "").encode()).hexdigest()) for r in df.collect())


def test_suffix_dedup(spark, group, odd, odd_rows, tmp_path):
    got = Counter(tuple(r) for r in suffix_dedup.op10_suffix_dedup(spark, folder(odd, tmp_path)).collect())
    assert got == brute_repeats([r[:2] for r in odd_rows], 200)


@pytest.mark.parametrize("options", [{}, {"run_bytes": 500, "range_bytes": 4000, "sample": 50}, {"run_bytes": 1, "range_bytes": 1, "sample": 7}])
def test_suffix_dedup_merges_runs(spark, group, options):
    zeros = [(300 + i, ("x\0" * 30)[i:] + prose(3, 20) + "\0" * i) for i in range(4)]
    docs = spark.createDataFrame(group + zeros, "doc_id long, text string").withColumn("gram", F.lit(1)).withColumn("k1", F.lit("x"))
    assert spans(suffix_dedup.suffix_dedup(docs, length=40, gram=20, **options)) == brute_repeats(group + zeros, 40)


def test_the_merge_finds_what_no_run_holds_twice(spark, group, monkeypatch):
    """The entries of all tasks meet in the merge alone: without it the repeated strings of different stretches stay."""
    docs = spark.createDataFrame(group, "doc_id long, text string")
    *_, runs = suffix_dedup.sorted_runs(docs, 40, 20, 500)
    assert runs.select("run").distinct().count() > 5
    assert suffix_dedup.repeated_starts(runs, 40, 20).count() > 0
    monkeypatch.setattr(suffix_dedup, "repeated_starts", lambda *_, **__: spark.createDataFrame([], suffix_dedup.REPEATED))
    assert spans(suffix_dedup.suffix_dedup(docs, length=40, gram=20)) != brute_repeats(group, 40)


def test_suffix_dedup_empty(spark, none):
    assert suffix_dedup.suffix_dedup(none).count() == 0


def test_long_documents_are_cut_into_segments(monkeypatch):
    r = random.Random(5)
    data = np.frombuffer(bytes(r.choices(b"abcd ", k=5000)), np.uint8)
    gram, start, end, anchor = suffix_dedup.stretches(data, 40, 20)
    assert start[0] == 0 and (start[1:] == end[:-1] - 39).all() and end[-1] == len(data) and (anchor >= end - 40).all()
    monkeypatch.setattr(suffix_dedup, "SEGMENT", 700)
    cut = suffix_dedup.stretches(data, 40, 20)
    assert set(zip(gram, anchor, strict=True)) == set(zip(cut[0], cut[3], strict=True))


def test_loser_tree():
    r = random.Random(1)
    for _ in range(200):
        runs = [sorted({bytes(r.choices(b"ab", k=r.randint(0, 6))) for _ in range(r.randint(0, 8))}) for _ in range(r.randint(1, 7))]
        got = list(LoserTree(decoded(front_coded(run, [i] * len(run))) for i, run in enumerate(runs)))
        assert [g[2] for g in got] == sorted(s for run in runs for s in run)
        assert all(g[1] == g[3] for g in got)
        assert [g[0] for g in got[1:]] == [common(a[2], b[2]) for a, b in zip(got, got[1:], strict=False)]


def test_decontaminate(spark, odd_rows, none):
    items = [(1, prose(50, 40)), (2, prose(51, 25)), (3, None), (4, prose(54, 30)), (5, "one"), (6, prose(52, 4)), (7, prose(53, 60)), (8, ""), (9, "ha " * 20 + prose(55, 4))]
    plain = [prose(60 + i, 50) for i in range(8)]
    texts = [f"{plain[0]} {items[0][1]} {plain[1]}", f"{plain[2]}\n{items[1][1].upper()}", edited(items[6][1], 1, 9), items[5][1] + " " + plain[3], f"{plain[4]} {' '.join(items[6][1].split()[:20])}", f"{items[0][1]} {items[0][1]} {items[1][1]}", f"{plain[5]} {items[3][1]}", "ha " * 22 + prose(55, 4), "ha " * 16 + prose(55, 4) + " more words"]
    rows = [(r[0], r[1]) for r in odd_rows] + [(100 + i, t) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("item_id", F.lit(3))
    bench = spark.createDataFrame(items, "item_id long, text string")
    shingled = lambda w, k: Counter(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    expected = set()
    for doc, t in rows:
        w = word_list(t)
        for item, text in items:
            iw = word_list(text)
            k = min(5, len(iw))
            if iw and any(decontaminate.weighted_jaccard(shingled(w[s : s + len(iw)], k), shingled(iw, k)) >= 0.8 for s in range(max(1, len(w) - len(iw) + 1))):
                expected.add((doc, item))
    found = decontaminate.contaminated(docs, bench, items_at_once=3).collect()
    assert {(r.doc_id, r.item_id) for r in found} == expected and {(100, 1), (101, 2), (103, 6), (105, 1), (105, 2), (106, 4), (107, 9), (7, 5)} <= expected
    assert all(r.similarity >= 0.8 and r.end_word > r.start_word for r in found)
    assert decontaminate.contaminated(none, bench).count() == decontaminate.contaminated(docs, bench.limit(0)).count() == 0


def slow_fingerprint(hashes):
    """The sign sums of one window, a numbered shingle at a time."""
    seen, sums = Counter(), np.zeros(64, int)
    for h in hashes.tolist():
        sums += decontaminate._bits(np.array([h], np.uint64), np.array([seen[h]]))[0]
        seen[h] += 1
    return sum(1 << i for i, x in enumerate(sums) if x > 0)


def test_sliding_fingerprints():
    r = np.random.default_rng(8)
    for n, count, kinds in ((50, 7, 5), (40, 40, 3), (60, 1, 60), (200, 36, 1000), (90, 30, 1)):
        hashes = r.integers(0, 2**64, kinds, dtype=np.uint64)[r.integers(0, kinds, n)]
        assert decontaminate.fingerprints(hashes, count).tolist() == [slow_fingerprint(hashes[i : i + count]) for i in range(n - count + 1)]


def test_block_index_finds_all_within_radius():
    r = np.random.default_rng(4)
    items, queries = r.integers(0, 2**64, 50, dtype=np.uint64), r.integers(0, 2**64, 300, dtype=np.uint64)
    queries[:50] = items ^ (np.uint64(1) << r.integers(0, 64, 50).astype(np.uint64))
    distance = np.array([[bin(int(q) ^ int(i)).count("1") for i in items] for q in queries])
    every = (x.ravel() for x in np.meshgrid(np.arange(300), np.arange(50), indexing="ij"))
    got = set(zip(*map(list, decontaminate.BlockIndex(items).search(queries)), strict=True))
    assert got == {(q, i, distance[q, i]) for q, i in zip(*np.nonzero(distance <= decontaminate.RADIUS), strict=True)}


@pytest.mark.parametrize("shape", ["distinct", "repeated", "two"])
def test_recall_of_the_radius(shape):
    """Pairs of numbered shingle sets of similarity 0.8 to 0.85 are within the radius, whatever the items' shape."""
    r, missed, tried = np.random.default_rng(6), 0, 3000
    for _ in range(tried):
        n = int(r.integers(9, 60))
        kinds = {"distinct": n, "repeated": max(2, n // 4), "two": 2}[shape]
        hashes = r.integers(0, 2**64, kinds + n, dtype=np.uint64)
        item = hashes[np.arange(n) % kinds]
        changed = item.copy()
        changed[: n // 9] = hashes[kinds : kinds + n // 9]  # n - n // 9 of n + n // 9 numbered shingles are shared
        a, b = (int(decontaminate.fingerprints(x, n)[0]) for x in (item, changed))
        missed += bin(a ^ b).count("1") > decontaminate.RADIUS
    assert missed / tried < 0.002


def test_decontaminate_at_size():
    """Thousands of items with a common shingle, and a long text: only what stands in it is found, within small tables."""
    rows = [(i, f"the same five words here {prose(7000 + i, 30)}") for i in range(4000)]
    items = decontaminate.Items(rows)
    text = " ".join([prose(1, 30000), rows[17][1], prose(2, 30000), rows[3999][1].upper(), "ab " * 40000, "the same five words here"])
    assert {f[1] for f in items.search([text.encode(), b"", b"the same five words here"])} == {17, 3999}
    assert max(index.near.nbytes for index in items.index.values()) <= 8 * 256 * 501


def test_hamming_blocks_alone_propose():
    """Without shingles to skip windows by the same is found; with empty blocks nothing; and the radius loses next to nothing."""
    rows = [(i, prose(8000 + i, 20 + i % 12)) for i in range(40)] + [(50, "ha " * 20 + prose(55, 9)), (51, "ab cd " * 12)]
    texts = [f"{prose(i, 300)} {edited(rows[i][1], i % 2, i)} {prose(100 + i, 40)} {rows[i][1]}".encode() for i in range(40)]
    texts += [f"{prose(1, 30)} {'ha ' * 19 + prose(55, 9)} {prose(2, 30)} {'ab cd ' * 11}".encode(), rows[3][1].encode()[:60]]
    expected = decontaminate.Items(rows).search(texts)
    assert decontaminate.Items(rows, everywhere=True).search(texts) == expected
    assert {(i, i) for i in range(40)} | {(40, 50), (40, 51)} <= {f[:2] for f in expected}
    emptied = decontaminate.Items(rows)
    for index in emptied.index.values():
        index.near[:] = 0
    assert emptied.search(texts) == []


def test_items_come_in_bounded_blocks(spark):
    items = spark.createDataFrame([(i, "x" * (10 * i)) for i in range(12)] + [(20, None)], "item_id long, text string")
    blocks = list(decontaminate._blocks_of(items, 5, 150))
    assert [i for b in blocks for i, _ in b] == [*range(12), 20]
    assert all(len(b) <= 5 and (len(b) == 1 or sum(len(t or "") for _, t in b) <= 150) for b in blocks)


@pytest.fixture(scope="module")
def labelled(spark):
    """Good prose and junk, and their labels; some labels are wrong for no document, some null."""
    rows = [(i, prose(i, 60) if i % 3 else " ".join(w + "$$$" for w in prose(i, 60).split()), "en", "s", 1) for i in range(300)]
    docs = spark.createDataFrame(rows, DOCS)
    labels = spark.createDataFrame([(i, 1 if i % 3 else 0, 0) for i in range(300)] + [(5000, 1, 0), (None, 0, 0), (7000, None, None)], "doc_id long, quality int, toxic int")
    return docs, labels


def test_quality_classifier(spark, labelled, odd, tmp_path):
    docs, labels = labelled
    got = quality_classifier.op1_quality_classifier(spark, folder(docs.union(odd.where("doc_id is null or doc_id in (4, 5, 6)")), tmp_path, labels=labels)).collect()
    assert len(got) == 305
    held = [r for r in got if r.held_out and r.doc_id is not None and r.doc_id > 6]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got if r.doc_id is not None)
    assert sum(r.predicted == (1 if r.doc_id % 3 else 0) for r in held) / len(held) > 0.95
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got)


def test_quality_without_labels(spark, odd, none, labelled):
    _, labels = labelled
    assert quality_classifier.train(odd, labels.limit(0)) == 0.5
    assert quality_classifier.train(odd, labels.where("quality = 1")) == 1.0
    assert quality_classifier.scores(none, 0.5).count() == 0


def test_gradients():
    net = quality_classifier.Network(3)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    data = prose(5, 120).encode()
    loss = lambda: float(np.log1p(np.exp(-net._head(net.chunks(net.blocks(net.codes(data))[0]))[2])))
    g = {k: np.zeros_like(v) for k, v in net.p.items()}
    net.gradients(data, 1, g)
    for name in ("filters", "embed", "hidden", "shift", "out"):
        at = np.unravel_index(np.abs(g[name]).argmax(), g[name].shape)
        before = net.p[name][at]
        net.p[name][at] = before + 1e-3
        up = loss()
        net.p[name][at] = before - 1e-3
        down = loss()
        net.p[name][at] = before
        assert (up - down) / 2e-3 == pytest.approx(g[name][at], rel=0.1, abs=1e-4)


def test_pipeline(spark, labelled, odd, tmp_path):
    import corpus_pipeline

    docs, labels = labelled
    leak, copy = prose(900, 30), prose(1, 60)
    more = spark.createDataFrame([(900, f"{prose(901, 30)} {leak} {prose(902, 30)}", "en", "t", 1), (901, copy, "en", "t", 1)], DOCS)
    path = folder(docs.union(more).union(odd), tmp_path, labels=labels, benchmark=spark.createDataFrame([(1, leak)], "item_id long, text string"))
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality classifier", "line dedup", "minhash near-dedup", "benchmark decontamination", "source mix"]
    rows = {r.doc_id: r for r in corpus_pipeline.run(spark, path).collect()}
    assert 900 not in rows and 901 not in rows and 1 in rows
    assert not {i for i in rows if i is not None and 15 < i < 300 and i % 3 == 0} and len([i for i in rows if i is not None and 15 < i < 300]) == 190
    assert all(r.taken <= 2 * r.size for r in rows.values())


def test_pipeline_of_nothing(spark, none, tmp_path):
    import corpus_pipeline

    path = folder(none, tmp_path, labels=spark.createDataFrame([], "doc_id long, quality int, toxic int"), benchmark=spark.createDataFrame([], "item_id long, text string"))
    assert corpus_pipeline.run(spark, path).count() == 0


def test_long_texts_are_scored_whole(monkeypatch):
    net = quality_classifier.Network(4)
    data = prose(8, 60000).encode()
    whole = net.score(data)
    assert len(data) > 4 * quality_classifier.LONGEST and net.score(data[:-200000]) != whole
    monkeypatch.setattr(quality_classifier, "SEGMENT", 10**6)
    assert net.score(data) == pytest.approx(whole, abs=1e-6)


def brute_pipeline(rows, good, items):
    """The rows that all five stages leave, each with its copy number; good is the ids that the classifier has to keep."""
    rows = [r for r in rows if r[0] in good]
    key = lambda line: line.strip(" \t\n\x0b\f\r").translate(LOW)
    holders = {}
    for i, text, *_ in rows:
        for line in text.split("\n"):
            holders.setdefault(key(line), set()).add(i)
    gone = lambda i, line: len(key(line)) >= 20 and len(holders[key(line)]) >= 3 and i != max(holders[key(line)])
    rows = [(i, "\n".join(line for line in text.split("\n") if not gone(i, line)), source) for i, text, _, source, _ in rows]
    first = {i for i, _, _, kept in brute_components([r[:2] for r in rows], 2) if kept}
    shingled = lambda w, k: Counter(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    leaks = lambda w, iw: any(decontaminate.weighted_jaccard(shingled(w[s : s + len(iw)], 5), shingled(iw, 5)) >= 0.8 for s in range(max(1, len(w) - len(iw) + 1)))
    rows = [r for r in rows if r[0] in first and not any(leaks(word_list(r[1]), word_list(t)) for t in items)]
    sized = sorted(((s is None, s or "", len(word_list(t)), i, t, s) for i, t, s in rows))
    total = Counter()
    for *_, n, _, _, s in sized:
        total[s] += n
    weight = {s: (3, 1, 2)[n % 3] for n, s in enumerate(sorted(total, key=lambda s: (s is None, s or "")))}
    target, left, free = {}, 1.5 * sum(total.values()), set(total)
    while over := [s for s in free if left * weight[s] / sum(weight[x] for x in free) > 2 * total[s]]:
        target |= {s: 2.0 * total[s] for s in over}
        free, left = free - set(over), left - sum(2 * total[s] for s in over)
    target |= {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
    out, at = Counter(), Counter()
    for *_, i, t, s in sized:
        each, shift = target[s] / total[s], int(hashlib.md5(f"9:{'n' if s is None else 's' + s}".encode()).hexdigest()[:4], 16) / 65536
        copies = min(int(each * (at[s] + 1) + shift) - int(each * at[s] + shift), int(np.ceil(each)))
        at[s] += 1
        out.update((i, t, s, n) for n in range(1, copies + 1))
    return out, at, total, target


def test_pipeline_emits_the_mix(spark, tmp_path):
    import corpus_pipeline

    line = "A line that stands in many of the documents"
    source = lambda i: ("a", "a", "big", "big", None)[i % 5]
    rows = [(i, prose(i, 40 + i % 30) + (f"\n{line}" if i % 20 == 1 else ""), "en", source(i), 1) for i in range(300)]
    rows += [(1000 + i, " ".join(w + "$$$" for w in prose(1000 + i, 60).split()), "en", "big", 1) for i in range(150)]
    rows += [(2000 + i, edited(rows[5 * i][1], 1, i), "en", "big", 1) for i in range(20)]
    leak = prose(900, 30)
    rows += [(3000 + i, f"{prose(3100 + i, 30)} {leak} {prose(3200 + i, 30)}", "en", "a", 1) for i in range(5)]
    good = {r[0] for r in rows if not 1000 <= r[0] < 2000}
    labels = spark.createDataFrame([(r[0], int(r[0] in good), 0) for r in rows], "doc_id long, quality int, toxic int")
    path = folder(spark.createDataFrame(rows, DOCS), tmp_path, labels=labels, benchmark=spark.createDataFrame([(1, leak)], "item_id long, text string"))
    expected, left, total, target = brute_pipeline(rows, good, [leak])
    got = corpus_pipeline.run(spark, path).collect()
    assert Counter((r.doc_id, r.text, r.source, r.copy) for r in got) == expected
    assert len(got) == sum(expected.values())
    n = Counter(i for i, *_ in expected)
    assert max(n.values()) == 2 and len(n) < sum(left.values()) and target["big"] < total["big"]
    for s in total:
        words = sum(r.size for r in got if r.source == s)
        assert abs(words - target[s]) <= 2 * 100 and all(r.copies == n[r.doc_id] for r in got)
