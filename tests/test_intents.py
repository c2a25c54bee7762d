"""Intents before and after feedback, and retrieval in several hops, case by case."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from lodestone.functions import intents as wants
from lodestone.operators import hops, intents, lexical

DAY = dt.date(2024, 1, 1)


@pytest.mark.parametrize("cases", [[
    ("Why did the build fail?", "WHY", 2 / 6, []),
    ("how come it broke", "WHY", 2 / 6, []),
    ("How do I install it, step by step", "HOW", 4 / 6, []),
    ("When was it, on 2024-01-02 or in 2023?", "WHEN", 6 / 8, []),
    ("what is the name of it", "ENTITY", 2 / 3, ["WHAT"]),
    ("Which one is better, this or that", "COMPARE", 4 / 8, []),
    ("the box", "WHAT", 0.1, []),
    (" \t", "WHAT", 0.0, []),
    ("", "WHAT", 0.0, []),
    (None, "WHAT", 0.0, []),
]])
def test_classify(spark, cases):
    rows = spark.createDataFrame([(i, c[0]) for i, c in enumerate(cases)], "i int, q string")
    for r in intents.classify(rows, "q").collect():
        _, intent, confidence, others = cases[r.i]
        assert (r.intent, r.sub_intents) == (intent, others) and r.confidence == pytest.approx(confidence), r.q


def test_feedback_changes_the_answer(spark):
    """A poor history halves confidence, so that the kind of question decides; what comes later does not count."""
    day = lambda n: DAY + dt.timedelta(n)
    outcomes = [("WHY", day(0), 0, 0.9)] * 3 + [("WHY", day(1), 5, 0.1)] * 2 + [("WHY", day(5), 5, 0.9)] * 5 + [("HOW", day(0), 3, 0.9)] * 4 + [("WHEN", day(0), None, None)] * 5
    weights = intents.learned(spark.createDataFrame(outcomes, "intent string, day date, results int, score double"))
    assert {(r.intent, r.day, r.weight) for r in weights.collect()} == {("WHY", day(1), 0.5), ("WHY", day(5), 0.75), ("WHEN", day(0), 0.5)}
    asked = intents.classify(spark.createDataFrame([(n, "why did it never work", day(n)) for n in (0, 1, 2, 6)] + [(9, "how to do it", day(9)), (10, "the month", None)], "n int, q string, day date"), "q")
    found = {r.n: (r.intent, r.confidence) for r in intents.adapted(asked, weights).collect()}
    assert found == {0: ("WHY", 0.333), 1: ("WHY", 0.333), 2: ("WHY", 0.167), 6: ("WHY", 0.25), 9: ("HOW", 0.333), 10: ("WHEN", 0.25)}
    after = intents.adapted(asked, weights).withColumn("r", wants.decided(F.col("q"), F.col("intent"), F.col("confidence"))).select("n", "r.*")
    routed = {r.n: (r.intent, r.confidence) for r in after.collect()}
    assert routed[0] == ("WHY", 0.333) and routed[2] == ("VERIFY", 0.5) and routed[10][1] == 0.5


@pytest.fixture(scope="module")
def library(spark):
    """Records that lead from one to the next by the names they speak of."""
    texts = ["storm damage harbour Lisbon Lisbon Lisbon Lisbon", "Lisbon museum painting Vermeer Vermeer Vermeer Vermeer", "Vermeer studio harbour Delft Delft Delft Delft", "Delft canal", "nothing of it", None]
    records = spark.createDataFrame(list(enumerate(texts)), "i long, text string")
    posts = lexical.postings([(lexical.term_counts(records, "i", F.col("text")), 1.0)], "i")
    query = spark.createDataFrame([(7, "storm harbour"), (8, "unheard of")], "qid long, text string")
    said = query.select("qid", F.explode(F.split("text", " ")).alias("word"))
    return records, posts, records.agg(F.count("*").cast("double").alias("n")), lexical.terms(query, "qid", F.col("text")), said


def test_bridges(spark, library):
    records, posts, n, asked, said = library
    hits = lexical.top_k(lexical.bm25_scores(posts, n, asked, "i"), "qid", "i", 1)
    bridges = hops.bridge_terms(hits, records, posts, asked, said, "i")
    assert [(r.qid, r.term, r.weight) for r in bridges.collect()] == [(7, "lisbon", 6.0)]
    # the museum has no word of the question, so a bridge alone does not bring it in
    assert hops.bridged(hits, bridges, posts, n, asked, "i", 5).count() == 0
    wider = spark.createDataFrame([(7, "delft")], "qid long, term string")
    found = hops.bridged(hits, wider, posts, n, asked, "i", 5).collect()
    assert hits.select("i").first()[0] in (0, 2) and [(r.i, r["rank"]) for r in found] == ([(2, 1)] if hits.select("i").first()[0] == 0 else [])


def test_rounds_ask_on_until_nothing_is_new(library):
    records, posts, n, asked, said = library
    found = {(r.qid, r.i): r["round"] for r in hops.iterated(records, posts, n, asked, said, "i", rounds=9, k=2, followups=1).collect()}
    assert found == {(7, 0): 0, (7, 2): 0, (7, 3): 1} or found == {(7, 0): 0, (7, 2): 0, (7, 1): 1, (7, 3): 2}
    two = hops.iterated(records, posts, n, asked, said, "i", rounds=1, k=2, followups=1)
    assert {r["round"] for r in two.collect()} == {0}
    assert hops.iterated(records, posts, n, asked, said, "i", rounds=9, k=2, followups=1, most=2).groupBy("qid").count().agg(F.max("count")).first()[0] == 2
