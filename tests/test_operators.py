"""Operators by themselves, on small literal inputs with known answers."""

import datetime as dt
import os

import pytest
from pyspark.sql import functions as F

from lodestone.functions import scoring, text, vectors
from lodestone.operators import audit, graph, lexical, ranking, similarity, timeline
from lodestone.sources import blocks
from lodestone.streaming import ingest


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


@pytest.mark.parametrize("word, stem", [("went", "go"), ("running", "runn"), ("studies", "study"), ("happiness", "happi"), ("making", "mak"), ("nation", "nat"), ("classes", "class"), ("glass", "glass"), ("cats", "cat"), ("its", "its"), ("enabled", "enable"), ("bus", "bus"), ("government", "govern")])
def test_stem(spark, word, stem):
    frame = spark.createDataFrame([(word,)], "w string").select(text.lemma(F.col("w")).alias("b"))
    assert frame.select(text.without_suffix(F.col("b"), text.suffix_of(F.col("b"))).alias("s")).first().s == stem


def test_words_and_trigrams(spark):
    assert one(spark, text.words(F.lit("Café X1_y, ÉTÉ"))) == ["caf", "x1_y", "t"]
    assert sorted(one(spark, text.trigrams(F.lit(" HELLO ")))) == ["ell", "hel", "llo"]
    assert one(spark, text.trigrams(F.lit("hi"))) == ["hi"] and one(spark, text.trigrams(F.lit(""))) == []
    assert one(spark, text.without_invisible(F.lit("a​b‮c﻿"))) == "abc"
    assert one(spark, text.chunks(F.sequence(F.lit(1), F.lit(10)), 4, 1)) == [[1, 2, 3, 4], [4, 5, 6, 7], [7, 8, 9, 10]]


def test_bm25_by_hand(spark):
    score = scoring.bm25(F.lit(1.0), F.lit(5.0), F.lit(10.0), F.lit(1.5))
    assert one(spark, score) == pytest.approx(1.885714, abs=1e-6)


def test_ranking_counts_repeated_query_terms(spark):
    docs = spark.createDataFrame([(1, "alpha beta"), (2, "alpha alpha"), (3, "gamma"), (4, None)], "id long, t string")
    posts = lexical.postings([(lexical.terms(docs, "id", F.col("t")), 1.0)], "id")
    n = spark.createDataFrame([(4.0,)], "n double")
    ask = lambda *terms: spark.createDataFrame([(1, t) for t in terms], "qid long, term string")
    once = {r.id: r.score for r in lexical.bm25_scores(posts, n, ask("alpha"), "id").collect()}
    twice = {r.id: r.score for r in lexical.bm25_scores(posts, n, ask("alpha", "alpha"), "id").collect()}
    assert once.keys() == {1, 2} and once[2] > once[1] and twice[1] == pytest.approx(2 * once[1])
    assert lexical.bm25_scores(posts, n, ask("none"), "id").count() == 0


@pytest.mark.parametrize("votes, weight", [((10, 0, 0), 1.4167), ((0, 10, 0), 0.5833), ((5, 5, 0), 1.0), ((5, 0, 5), 1.2059), ((1, 1, 0), 1.0)])
def test_calibration(spark, votes, weight):
    assert one(spark, scoring.calibration(*map(F.lit, votes))) == pytest.approx(weight, abs=1e-4)


def test_scores_of_time(spark):
    at = lambda d: F.lit(d).cast("date")
    assert one(spark, scoring.date_score(at(None), "2026-01-01")) == 0.5 and one(spark, scoring.date_score(at("2026-02-01"), "2026-01-01")) == 1.0
    assert one(spark, scoring.half_life(at("2025-10-03"), "2026-01-01")) == pytest.approx(0.5)
    assert one(spark, scoring.truth(F.lit("verified"), at("2026-01-01"), F.lit(0), F.lit(None).cast("double"), "2026-01-01")) == 0.92


def test_vectors(spark):
    a = lambda *x: F.array(*map(F.lit, x))
    assert one(spark, vectors.cosine(a(1.0, 0.0), a(0.0, 2.0))) == 0 and one(spark, vectors.cosine(a(0.0), a(1.0))) == 0
    assert [one(spark, vectors.surprise(F.lit(x))) for x in (1.0, 0.0, -1.0)] == [0, 0.5, 1] and one(spark, vectors.surprise(F.lit(None).cast("double"))) == 0.5
    assert one(spark, vectors.quantized(a(0.0, 0.5, 1.0))) == [0, 4, 7] and one(spark, vectors.quantized(a(2.0, 2.0))) == [0, 0]


def test_rank_fusion(spark):
    arms = spark.createDataFrame([(1, "x", "A", 1, 1.0), (1, "x", "B", 2, 1.0), (1, "x", "C", 3, 1.0), (1, "y", "B", 1, 1.0), (1, "y", "C", 2, 1.0), (1, "y", "D", 3, 1.0)], "qid long, arm string, id string, rank int, weight double")
    got = {r.id: (r.score, r.arms) for r in ranking.reciprocal_ranks(arms, ["qid"], "id").collect()}
    assert got["B"] == (pytest.approx(1 / 62 + 1 / 61), "x,y") and got["D"] == (pytest.approx(1 / 63), "y")


def test_knee_and_caps(spark):
    rows = spark.createDataFrame([(1, i, s) for i, s in enumerate([10.0, 9.0, 3.0, 2.0])] + [(2, 1, 5.0), (2, 2, 4.0)], "g long, id long, score double")
    kept = {(r.g, r.id) for r in ranking.knee(rows, "g", "id", "score").collect()}
    assert kept == {(1, 0), (1, 1), (2, 1), (2, 2)}
    assert ranking.capped(rows, ["g"], [F.col("score").desc()], 1).count() == 2


def test_graph(spark):
    edges = graph.both_ways(spark.createDataFrame([("A", "B", 1.0), ("B", "C", 1.0)], "a string, b string, weight double"))
    seeds = spark.createDataFrame([("A", 10.0)], "node string, score double")
    got = {r.node: (r.score, r.hop) for r in graph.propagate(seeds, edges, [0.5, 0.5]).collect()}
    assert got == {"A": (10.0, 0), "B": (5.0, 1), "C": (2.5, 2)}
    assert graph.propagate(seeds.limit(0), edges, [0.5]).count() == 0
    assert {(r.node, r.hop) for r in graph.reach(edges, seeds, 9).collect()} == {("A", 0), ("B", 1), ("C", 2)}
    pairs = graph.co_occurrence(spark.createDataFrame([(1, 5), (1, 7), (1, 7), (2, 5)], "g long, i long"), "g", "i").collect()
    assert [tuple(r) for r in pairs] == [(5, 7, 0.5)]


def test_similarity_join_misses_nothing(spark):
    import random

    r = random.Random(3)
    sets = [(i, sorted({r.randrange(25) for _ in range(r.randint(0, 9))})) for i in range(80)]
    got = {(x.a, x.b): x.similarity for x in similarity.jaccard_pairs(spark.createDataFrame(sets, "id long, t array<long>"), "id", "t", 0.5).collect()}
    expected = {}
    for i, a in sets:
        for j, b in sets:
            if i < j and a and b and len(set(a) & set(b)) / len(set(a) | set(b)) >= 0.5:
                expected[(i, j)] = pytest.approx(len(set(a) & set(b)) / len(set(a) | set(b)))
    assert got == expected


def test_versions_as_of(spark):
    day = lambda m: dt.datetime(2026, m, 2)
    edits = spark.createDataFrame([("x", 1, day(1), "beta"), ("x", 2, day(3), "gamma"), ("y", 3, day(4), "z")], "k string, n long, at timestamp, v string")
    asked = lambda d: {r.k: (r.v, r.version) for r in timeline.as_of(edits, "k", d, "at", "n").collect()}
    assert asked("2026-01-01") == {} and asked("2026-02-01") == {"x": ("beta", 1)} and asked("2026-05-01") == {"x": ("gamma", 2), "y": ("z", 1)}
    facts = spark.createDataFrame([("x", day(2)), ("x", dt.datetime(2025, 1, 1)), ("q", day(2))], "k string, at timestamp")
    got = {(r.k, r.at.year): r.v for r in timeline.as_of_join(facts, edits, "k", "at", "at", "v").collect()}
    assert got == {("x", 2026): "beta", ("x", 2025): None, ("q", 2026): None}


def test_consensus(spark):
    votes = spark.createDataFrame([(1, "a", "x", 1.0), (1, "b", "x", 1.0), (1, "a", "x", 3.0), (2, "a", "x", 1.0), (3, "a", "x", 1.0), (3, "b", "y", 1.0)], "c long, who string, what string, trust double")
    got = {r.c: (r.winner, r.voters) for r in timeline.consensus(votes, "c", "who", "what", "trust").collect()}
    assert got == {1: ("x", 2), 2: (None, 1), 3: (None, 2)}


def test_ledger_and_snapshots(spark):
    entries = spark.createDataFrame([("c", n, f"h{n}") for n in range(4)], "chain string, seq long, digest string")
    good = audit.linked(entries, "chain", "seq", "digest")
    assert audit.broken_links(good, "chain", "seq", "digest", "previous").count() == 0
    bad = good.withColumn("digest", F.when(F.col("seq") == 1, "forged").otherwise(F.col("digest")))
    assert [r.seq for r in audit.broken_links(bad, "chain", "seq", "digest", "previous").collect()] == [2]
    old, new = spark.createDataFrame([(1, "a"), (2, "b"), (3, None)], "id long, v string"), spark.createDataFrame([(2, "c"), (3, None), (4, "d")], "id long, v string")
    assert {tuple(r) for r in audit.differences(old, new, "id").collect()} == {(1, "removed"), (2, "changed"), (4, "added")}


BLOCKS = """intro, no block
## [NOT-1]
[DEC-1]
Statement: Use Spark, see DEC-2 and DEC-9
Tags:
- one
- two
Priority: 5
[DEC-2]

Statement: first
  continued
"""


def test_blocks(spark):
    files = spark.createDataFrame([("f", BLOCKS), ("empty", ""), ("null", None)], "path string, content string")
    got = {r.block_id: (r.line, r.fields) for r in blocks.parse_blocks(files).collect()}
    assert got == {"DEC-1": (3, {"Statement": "Use Spark, see DEC-2 and DEC-9", "Tags": "one\ntwo", "Priority": "5"}), "DEC-2": (9, {"Statement": "first\ncontinued"})}
    refs = blocks.references(blocks.parse_blocks(files).withColumn("text", F.col("fields")["Statement"]))
    assert [tuple(r) for r in refs.collect()] == [("DEC-1", "DEC-2")]
    assert [one(spark, blocks.typed(F.lit(x))) for x in ("null", "True", "007", "1.50", "x")] == [None, "true", "7", "1.5", "x"]


def test_upsert_and_transcripts(spark, tmp_path):
    old, new = spark.createDataFrame([("a", 1), ("b", 2)], "block_id string, v long"), spark.createDataFrame([("b", 3), ("c", 4)], "block_id string, v long")
    assert {tuple(r) for r in blocks.upserted(old, new).collect()} == {("a", 1), ("b", 3), ("c", 4)}
    (tmp_path / "t.jsonl").write_text('{"role": "user", "content": "hi"}\nnot json\n{"role": "assistant", "content": "yes"}\n')
    assert {(r.role, r.content) for r in blocks.read_transcript(spark, str(tmp_path)).collect()} == {("user", "hi"), ("assistant", "yes")}


def test_read_blocks(spark, tmp_path):
    (tmp_path / "a.md").write_text("[T-1]\nStatus: active\n")
    (tmp_path / "b.md").write_text("")
    assert [(r.block_id, r.fields) for r in blocks.read_blocks(spark, str(tmp_path)).collect()] == [("T-1", {"Status": "active"})]


def run_stream(frame, name, mode="append"):
    query = frame.writeStream.outputMode(mode).format("memory").queryName(name).trigger(availableNow=True).start()
    query.awaitTermination(120)
    return frame.sparkSession.table(name)


def test_streams_agree_with_batches(spark, tmp_path):
    base = dt.datetime(2024, 1, 1)
    rows = [(i % 40, base + dt.timedelta(minutes=i), "u", 1.0) for i in range(60)]
    source = str(tmp_path / "in")
    spark.createDataFrame(rows, "id long, ts timestamp, user string, value double").coalesce(1).write.parquet(source)
    table = spark.read.parquet(source)
    stream = lambda: ingest.read_events(spark, source, table.schema)
    assert run_stream(ingest.deduplicated(stream(), "id", "ts"), "dedup").count() == 40
    window = {tuple(r) for r in run_stream(ingest.windowed(stream(), "ts", ["user"], "10 minutes"), "win", "complete").collect()}
    assert window == {tuple(r) for r in ingest.windowed(table, "ts", ["user"], "10 minutes", late=None).collect()} and len(window) == 6
    assert ingest.sessions(table, "ts", "user", "5 minutes", late=None).first().n == 60


def test_late_records_are_left_out(spark, tmp_path):
    base, source = dt.datetime(2024, 1, 1), str(tmp_path / "in")
    for n, minutes in enumerate([0, 300, 310, 5, 600, 610]):
        spark.createDataFrame([(n, base + dt.timedelta(minutes=minutes), "u", 1.0)], "id long, ts timestamp, user string, value double").coalesce(1).write.mode("append").parquet(source)
    # files are taken by their age, which must not tie
    ids = {f: spark.read.parquet(os.path.join(source, f)).first().id for f in os.listdir(source) if f.endswith(".parquet")}
    for f, n in ids.items():
        os.utime(os.path.join(source, f), (1_700_000_000 + 60 * n,) * 2)
    schema = spark.read.parquet(source).schema
    out = run_stream(ingest.windowed(ingest.read_events(spark, source, schema, 1), "ts", [], "10 minutes", late="30 minutes"), "late")
    assert {(r.start - base).total_seconds() / 60: r.n for r in out.collect()}.get(0.0, 1) == 1


def test_rate_limit(spark, tmp_path):
    rows = [("c", i, float(t)) for i, t in enumerate([0, 0, 0, 0, 1, 1, 5])] + [("d", 100, 3.0)]
    table = spark.createDataFrame(rows, "client string, id long, at double")
    got = {r.id: r.admitted for r in ingest.rate_limited_batch(table, 1.0, 2.0).collect()}
    assert got == {0: True, 1: True, 2: False, 3: False, 4: True, 5: False, 6: True, 100: True}
    source = str(tmp_path / "in")
    table.coalesce(1).write.parquet(source)
    stream = spark.readStream.schema(table.schema).parquet(source)
    assert {r.id: r.admitted for r in run_stream(ingest.rate_limited(stream, 1.0, 2.0), "limited").collect()} == got
    assert ingest.admit([0.0, 0.0], 0.0, None, 0.0, 5.0)[0] == [False, False]


def test_bundles(spark, tmp_path):
    from lodestone.sources import bundle

    df = spark.createDataFrame([(1, "a"), (2, None), (2, None)], "id long, v string")
    manifest = bundle.write_bundle(df, str(tmp_path / "b"), "core")
    assert manifest["rows"] == 3 and bundle.read_bundle(spark, str(tmp_path / "b")).count() == 3
    assert bundle.fingerprint(df.orderBy("v")) == bundle.fingerprint(df) != bundle.fingerprint(df.distinct())
    df.limit(1).write.mode("append").parquet(str(tmp_path / "b" / "data"))
    with pytest.raises(ValueError):
        bundle.read_bundle(spark, str(tmp_path / "b"))
    assert bundle.read_bundle(spark, str(tmp_path / "b"), verify=False).count() == 4
    bundle.write_jsonl(df, str(tmp_path / "j"))
    assert spark.read.json(str(tmp_path / "j")).count() == 3


def test_codebook(spark):
    import random

    from lodestone.operators.embedding import Codebook

    r = random.Random(2)
    rows = [(i, [r.choice([0.0, 5.0]) + r.random() / 100 for _ in range(8)]) for i in range(50)]
    frame = spark.createDataFrame(rows, "id long, embedding array<double>")
    book = Codebook.trained(frame, parts=4, size=4)
    got = frame.select("id", book.distance(rows[0][1], book.encode(F.col("embedding"))).alias("d")).collect()
    for x in got:
        assert x.d == pytest.approx(sum((a - b) ** 2 for a, b in zip(rows[0][1], rows[x.id][1], strict=True)), abs=0.5)
    assert frame.limit(0).select(book.encode(F.col("embedding"))).count() == 0


def test_quantized_search_recall(spark, tmp_path):
    import random

    from lodestone import registry

    r, schema = random.Random(3), "vec_id long, embedding array<float>, label int"
    rows = [(i, [r.gauss(0, 1) for _ in range(32)], 0) for i in range(1500)] + [(2000, None, 0), (2001, [0.0] * 32, 0)]
    spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/a/embeddings.parquet")
    spark.createDataFrame([], schema).write.parquet(f"{tmp_path}/b/embeddings.parquet")
    found = {name: {(x.qid, x.vec_id): (x.score, x.rank) for x in registry.queries()[name](spark, f"{tmp_path}/a").collect() if x.qid != 2000} for name in ("knn_cosine", "quantized_search")}
    exact, got = found["knn_cosine"], found["quantized_search"]
    assert len(exact) == len(got) == 75 * 10
    assert len(exact.keys() & got.keys()) / len(exact) >= 0.9
    assert all(got[x][0] == pytest.approx(exact[x][0], abs=2e-6) for x in exact.keys() & got.keys())
    assert registry.queries()["quantized_search"](spark, f"{tmp_path}/b").count() == 0


def test_lifecycle(spark):
    from lodestone.operators import lifecycle

    rows = spark.createDataFrame([(1, 1, 60), (1, 2, 50), (1, 3, 40), (2, 1, 200)], "g long, o long, c long")
    assert {tuple(r) for r in lifecycle.packed(rows, "g", F.col("o"), F.col("c"), 100).collect()} == {(1, 100, 2), (2, 0, 0)}
    seen = spark.createDataFrame([("k", 10.0)] * 4 + [("q", None)], "k string, v double")
    got = {r.k: (r.estimate, r.n) for r in lifecycle.beliefs(seen, "k", "v", 0.0, 1.0, 4.0).collect() if r.n}
    assert got == {"k": (pytest.approx(5.0), 4)}
    writes = spark.createDataFrame([("r", "a")] * 3 + [("r", "b"), ("s", "a"), ("t", "a"), ("t", "b")], "r string, a string")
    assert [tuple(x) for x in lifecycle.write_conflicts(writes, "r", "a").collect()] == [("r", "a", 2, 2)]


@pytest.mark.parametrize("question, kind", [("When did it happen last week?", "temporal"), ("It was never true, nor right", "adversarial"), ("compare both totals because", "multi-hop"), ("What is lodestone", "open-domain"), ("name of the river", "single-hop"), ("", "single-hop")])
def test_question_kind(spark, question, kind):
    from lodestone.functions.understanding import question_kind

    assert one(spark, question_kind(F.lit(question))) == kind


def test_changes_and_violations(spark):
    old, new = spark.createDataFrame([(1, "a", 5), (2, "b", None)], "id long, v string, n long"), spark.createDataFrame([(1, "a", 6), (2, None, None), (3, "x", 1)], "id long, v string, n long")
    assert {tuple(r) for r in audit.field_changes(old, new, "id").collect()} == {(1, "n", "5", "6"), (2, "v", "b", None)}
    assert [tuple(r) for r in audit.violations(new, "id", {"v": ["a"]}).collect()] == [(3, "v", "x")]


def test_nearest_in_blocks_is_exact(spark):
    import numpy as np

    from lodestone.operators.nearest import nearest

    r = np.random.default_rng(3)
    x = r.integers(-3, 4, (200, 5)).astype(float)  # many ties
    rows = [(i, x[i].tolist() if i % 17 else None, i % 3) for i in range(200)]
    df = spark.createDataFrame(rows, "id long, v array<double>, label int")
    v = np.array([np.zeros(5) if i % 17 == 0 else x[i] for i in range(200)])
    for label in (None, "label"):
        got = {(row.qid, row.id, row.score, row["rank"]) for row in nearest(df, "id", "v", F.col("id") % 5 == 0, 7, label, block=9, part=30).collect()}
        expected = set()
        for q in range(0, 200, 5):
            fit = sorted((-float(v[q] @ v[i]), i) for i in range(200) if i != q and (label is None or i % 3 == q % 3))[:7]
            expected |= {(q, i, -s + 0.0, n) for n, (s, i) in enumerate(fit, 1)}
        assert got == expected
    assert nearest(df.limit(0), "id", "v", F.col("id") % 5 == 0, 7).count() == 0


def test_coded_search_recall(spark):
    """The coded search finds nine in ten of the exact neighbours at least."""
    import numpy as np

    from lodestone.functions import vectors
    from lodestone.operators.embedding import searched
    from lodestone.operators.nearest import nearest

    r = np.random.default_rng(5)
    centres = r.standard_normal((12, 64))
    df = spark.createDataFrame([(i, (centres[i % 12] + r.standard_normal(64)).tolist()) for i in range(1500)], "id long, embedding array<double>")
    asked = F.col("id") % 20 == 0
    exact = {(x.qid, x.id) for x in nearest(df.select("id", vectors.unit(F.col("embedding")).alias("v")), "id", "v", asked, 10).collect()}
    found = {(x.qid, x.id) for x in searched(df, "id", asked, 10, candidates=150).collect()}
    assert len(exact) == len(found) == 750 and len(exact & found) / len(exact) >= 0.9


def test_strategies_by_name():
    from lodestone import extensions

    extensions.register("kernel", "plain", lambda: 1)
    assert extensions.get("kernel", "plain")() == 1 and extensions.names("kernel") == ["plain"]
    with pytest.raises(KeyError, match="plain"):
        extensions.get("kernel", "other")


def test_time_references(spark):
    import datetime as dt

    from lodestone.functions import understanding

    day, cases = dt.date(2024, 3, 15), {
        "what happened yesterday": ("2024-03-14", "2024-03-14"), "TODAY": ("2024-03-15", "2024-03-15"), "the last 7 days": ("2024-03-08", "2024-03-15"), "2 days ago": ("2024-03-13", "2024-03-13"),
        "2 weeks ago": ("2024-02-27", "2024-03-04"), "last week": ("2024-03-04", "2024-03-10"), "this week": ("2024-03-11", "2024-03-15"), "last month": ("2024-02-01", "2024-02-29"),
        "before 2023-01-05": (None, "2023-01-05"), "after 2023-01-05": ("2023-01-05", None), "in 2021": ("2021-01-01", "2021-12-31"), "no time at all": (None, None), "before 2023-13-45": (None, None),
    }
    df = spark.createDataFrame([(q,) for q in cases], "q string").select("q", *[c.cast("string").alias(n) for n, c in zip("ab", understanding.time_reference(F.col("q"), F.lit(day)))])
    assert {r.q: (r.a, r.b) for r in df.collect()} == cases


def test_irregular_forms_and_suffixes(spark):
    from lodestone.functions import text

    words = {"thrown": "throw", "flew": "fly", "hidden": "hide", "sold": "sell", "swam": "swim", "drank": "drink", "studies": "study", "dies": "die", "classes": "class", "kindness": "kind", "payment": "pay", "nation": "nat", "sized": "size", "creating": "create", "famous": "famous", "computing": "comput", "running": "runn", "tables": "table", "bus": "bus", "glass": "glass", "bigger": "bigg", "related": "relate", "red": "red"}
    df = spark.createDataFrame([(w,) for w in words], "w string").withColumn("b", text.lemma(F.col("w"))).withColumn("s", text.suffix_of(F.col("b")))
    assert {r.w: r.t for r in df.select("w", text.without_suffix(F.col("b"), F.col("s")).alias("t")).collect()} == words


def test_long_lists_fail_and_are_not_cut(spark):
    rows = spark.createDataFrame([("a", i) for i in range(4)] + [("b", i) for i in range(9)], "g string, i int")
    assert graph.co_occurrence(rows.where("g = 'a'"), "g", "i", longest=4).count() == 6
    with pytest.raises(Exception, match="more than 4 items: b"):
        graph.co_occurrence(rows, "g", "i", longest=4).count()
