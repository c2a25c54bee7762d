"""What a review of the fourth round found: kinds of questions beside accented letters, cut texts, and work that grew with the input."""

import hashlib
import os
import random

import duckdb
import pytest
from pyspark.sql import functions as F

from lodestone import registry
from lodestone.functions import vectors
from lodestone.operators import ledger, nearest, network


def same_as_sql(spark, path, query):
    con = duckdb.connect()
    for t in os.listdir(path):
        con.sql(f"CREATE VIEW {t.removesuffix('.parquet')} AS SELECT * FROM read_parquet('{path}/{t}/*.parquet')")
    found, expected = registry.queries()[query](spark, str(path)), con.sql(registry.oracle_sql()[query])
    rows = expected.fetchall()
    return len(rows) > 0 and sorted(map(repr, map(tuple, found.select(*expected.columns).collect()))) == sorted(map(repr, rows))


TURNS = ["wir eneverä en", "enever en", "Ist es neveré so", "éwhat is it", "Àever", "over everɐ it", "did they ñnot go", "did they go ×not", None, "", "when did ügo", "When did it go?", "both÷ all", "NİEVER ever"]


@pytest.mark.parametrize("query", ["kind_distribution", "question_kinds", "routed_questions"])
def test_kinds_of_questions_beside_accented_letters(spark, tmp_path, query):
    rows = [(i // 4, i % 4, ("user", "assistant")[i % 2], t) for i, t in enumerate(TURNS)]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").coalesce(1).write.parquet(f"{tmp_path}/conversations.parquet")
    spark.sql("SELECT id AS event_id, timestamp'2024-01-01' + make_interval(0, 0, 0, 0, id) AS ts, id % 3 AS user_id, 'view' AS event_type, 1.0d * id AS value, '' AS props FROM range(200)").write.parquet(f"{tmp_path}/events.parquet")
    assert same_as_sql(spark, tmp_path, query)


def test_hits_are_compared_by_their_whole_texts(spark, tmp_path):
    run = lambda letter, n: " ".join(f"{letter}{i}" for i in range(n)) + " "
    start, more = "red ring " + run("s", 450), run("w", 900)  # what texts begin with is 2100 characters
    texts = [start, start + more, start + run("v", 900), run("u", 450) + " red ring " + more * 9, "ring " + more * 9]
    spark.createDataFrame([(i, t, "a", "en", len(t)) for i, t in enumerate(texts)], "doc_id long, text string, source string, lang string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, "red ring"), (2, "ring w1 w2")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert same_as_sql(spark, tmp_path, "distinct_hits")
    assert {r.qid: len(r.kept.split(",")) for r in registry.queries()["distinct_hits"](spark, str(tmp_path)).collect()} == {1: 4, 2: 4}


def test_weighted_neighbours_meet_in_blocks_of_their_label(spark, tmp_path, monkeypatch):
    r, met, kept = random.Random(8), [], nearest.top_k
    rows = [(i, [float(r.randint(-2, 2)) for _ in range(3)] if i % 40 else [1.0, 0.0, 2.0], None if i % 50 == 7 else i % 2 * 5 if i < 300 else i) for i in range(400)]
    rows += [(400 + i, [float(r.randint(1, 3)) for _ in range(3)], 0) for i in range(3000)]
    rows = [(i, v if any(v) else [1.0, 1.0, 0.0], c) for i, v, c in rows]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    monkeypatch.setattr(nearest, "top_k", lambda df, *a: met.append(df.count()) or kept(df, *a))
    assert same_as_sql(spark, tmp_path, "boosted_neighbours")
    assert len(met) == 1 and met[0] <= 10 * 170  # the best ten of each query go on, not each pair
    df, x = spark.createDataFrame(rows, "i long, v array<double>, l int"), {i: (v, c) for i, v, c in rows}
    found = nearest.nearest(df.where("i < 400"), "i", "v", F.col("i") % 20 == 0, 4, "l", 9, 30, (F.col("i") % 7 + 1,)).collect()
    score = lambda q, i: float(sum(a * b for a, b in zip(x[q][0], x[i][0], strict=True)) * (i % 7 + 1))
    for q in range(0, 400, 20):
        fit = sorted((-score(q, i), i) for i in range(400) if i != q and x[i][1] is not None and x[i][1] == x[q][1])[:4]
        assert [(t.i, t.score) for t in sorted(found, key=lambda t: t["rank"]) if t.qid == q] == [(i, -s) for s, i in fit]


def test_a_unit_vector_is_scaled_by_one_length(spark):
    rows = spark.createDataFrame([([3.0, 4.0],), ([0.0, 0.0],), ([],), (None,), ([None, 2.0],)], "v array<float>")
    plan = rows.select(vectors.unit(F.col("v")).alias("u"))
    assert [r.u for r in plan.collect()] == [[0.6, 0.8], None, None, None, None]
    assert plan._jdf.queryExecution().optimizedPlan().toString().count("aggregate(") == 1


@pytest.mark.parametrize("height", [1, 2, 3, 12])
def test_proofs_go_up_in_subtrees(spark, height, monkeypatch):
    def root_of(level):
        while len(level) > 1:
            level = [sha(f"N:{level[i]}|{level[min(i + 1, len(level) - 1)]}") for i in range(0, len(level), 2)]
        return level[0]

    monkeypatch.setattr(ledger, "PART_ROWS", 7)
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    sizes = {f"t{n}": n for n in (1, 2, 3, 4, 5, 8, 9, 13, 16, 17, 29)}
    rows = [(t, i, n, 100 * n + i) for t, n in sizes.items() for i in range(n)]
    leaves = spark.createDataFrame(rows, "tree string, pos long, n long, id long")
    found = ledger.proven(leaves, "tree", "id", F.sha2(F.concat(F.lit("x"), F.col("id")), 256), F.col("id") % 3 > 0, height).collect()
    expected = {(k, (n - 1).bit_length(), root_of([sha(f"x{100 * n + i}") for i in range(n)]), True) for t, i, n, k in rows if k % 3 and n > 1}
    assert {tuple(r) for r in found} == expected and len(found) == len(expected)


def test_proofs_that_do_not_hold_are_told(spark, monkeypatch):
    one = ledger.node_hash
    rows = spark.createDataFrame([("t", i, 11, i) for i in range(11)], "tree string, pos long, n long, id long")
    asked = ("tree", "id", F.sha2(F.col("id").cast("string"), 256), F.lit(True), 2)
    assert {r.proven for r in ledger.proven(rows, *asked).collect()} == {True}
    monkeypatch.setattr(ledger, "node_hash", lambda a, b: one(F.concat(a, F.lit("!")), b))  # a tree built in another way
    assert {r.proven for r in ledger.proven(rows, *asked).collect()} == {False}


def test_leaves_are_shuffled_before_they_are_hashed(spark, tmp_path, monkeypatch):
    plans, kept = [], getattr(ledger, "kept", None)
    rows = [(i, i % 7, ("view", "click")[i % 5 == 0], i / 7) for i in range(700)]
    spark.createDataFrame(rows, "event_id long, user_id long, event_type string, value double").write.parquet(f"{tmp_path}/events.parquet")
    monkeypatch.setattr(ledger, "PART_ROWS", 100)
    monkeypatch.setattr(ledger, "kept", lambda df, name: plans.append((name, df._jdf.queryExecution().executedPlan().toString())) or kept(df, name))
    assert same_as_sql(spark, tmp_path, "merkle_proofs")
    plan = dict(plans)["subtrees"]
    assert plan.count("Exchange hashpartitioning") == 1 and "sha2" not in plan[plan.index("Exchange hashpartitioning"):]


@pytest.mark.parametrize("wide", [0, 1 << 20])
@pytest.mark.parametrize("flip", [False, True])
def test_cycles_are_found_by_bits(spark, monkeypatch, wide, flip):
    r = random.Random(4)
    monkeypatch.setattr(network, "WIDE", wide, raising=False)
    edges = [(f"n{r.randrange(160)}", f"n{r.randrange(160)}") for _ in range(190)] + [("n1", "n1"), ("n2", None)] * 2
    asked = [(f"n{r.randrange(170)}", f"n{r.randrange(90 if flip else 170)}") for _ in range(400)] + [("n3", "n3"), ("x", "x")]
    reach = {}
    for n in {t for e in edges + asked for t in e} - {None}:
        found, open_ = {n}, [n]
        while open_:
            at = open_.pop()
            more = {b for a, b in edges if a == at and b is not None} - found
            found, open_ = found | more, open_ + list(more)
        reach[n] = found
    df = lambda rows: spark.createDataFrame(rows, "src string, dst string")
    found = network.closes_cycle(df(edges), df(asked)).collect()
    assert sorted((x.src, x.dst, x.cyclic) for x in found) == sorted((a, b, a in reach[b]) for a, b in {*asked})


def test_cycle_checks_keep_a_row_for_each_node_and_not_for_each_way(spark, monkeypatch):
    kept, rows = network.stored, []
    monkeypatch.setattr(network, "stored", lambda df, name: rows.append((name, df.count())) or kept(df, name))
    edges = [(f"c{i}", f"p{j}") for i in range(50) for j in range(20)] + [(f"p{j}", "r0") for j in range(20)]
    found = network.closes_cycle(spark.createDataFrame(edges, "src string, dst string"), spark.createDataFrame([(f"r{i % 2}", f"c{i}") for i in range(50)], "src string, dst string")).collect()
    assert {(x.src, x.dst): x.cyclic for x in found} == {(f"r{i % 2}", f"c{i}"): i % 2 == 0 for i in range(50)}
    assert sum(n for name, n in rows if name == "reach") <= 50 + 20
