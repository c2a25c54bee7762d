"""Time references rule by rule, and operators beyond bounds that they once had."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from lodestone.functions import understanding
from lodestone.operators import graph, lexical, network

DAY = dt.date(2024, 3, 13)  # a Wednesday
d = dt.date

TIMES = [
    ("What happened yesterday?", d(2024, 3, 12), d(2024, 3, 12)),
    ("due TODAY", DAY, DAY),
    ("the last 10 days", d(2024, 3, 3), DAY),
    ("3 days ago", d(2024, 3, 10), d(2024, 3, 10)),
    ("1 day ago", d(2024, 3, 12), d(2024, 3, 12)),
    ("2 weeks ago", d(2024, 2, 25), d(2024, 3, 2)),
    ("2 months ago", d(2024, 1, 1), d(2024, 1, 31)),
    ("last  week", d(2024, 3, 4), d(2024, 3, 10)),
    ("this week", d(2024, 3, 11), DAY),
    ("last month", d(2024, 2, 1), d(2024, 2, 29)),
    ("this month", d(2024, 3, 1), DAY),
    ("last year", d(2023, 1, 1), d(2023, 12, 31)),
    ("this year", d(2024, 1, 1), DAY),
    ("before March 5, 2023", None, d(2023, 3, 5)),
    ("after 7 or after sept 7 2022", d(2022, 9, 7), None),
    ("before february 30, 2023", None, None),
    ("before 2023-02-30 and after 2023-02-28", d(2023, 2, 28), None),
    ("before 2023-02-28", None, d(2023, 2, 28)),
    ("in january 2025", d(2025, 1, 1), d(2025, 1, 31)),
    ("in Feb", d(2024, 2, 1), d(2024, 2, 29)),
    ("in 2021", d(2021, 1, 1), d(2021, 12, 31)),
    ("in 2101", None, None),
    ("in maybe 2021", None, None),
    ("", None, None),
    (None, None, None),
]


def test_time_references(spark):
    rows = spark.createDataFrame([(i, t, DAY) for i, (t, *_) in enumerate(TIMES)], "i int, t string, day date")
    first, last = understanding.time_reference(F.col("t"), F.col("day"))
    found = {r.i: (r.a, r.b) for r in rows.select("i", first.alias("a"), last.alias("b")).collect()}
    for i, (text, *expected) in enumerate(TIMES):
        assert found[i] == tuple(expected), text


@pytest.mark.parametrize("block", [256, 7])
def test_lists_of_any_length_are_paired(spark, block):
    rows = [(1, i % 1100) for i in range(1200)] + [(2, 5), (2, 3), (3, 9), (None, 4), (None, 6)]
    pairs = graph.co_occurrence(spark.createDataFrame(rows, "l long, i long"), "l", "i", block) if block > 100 else graph.co_occurrence(spark.createDataFrame(rows[:60] + rows[1200:], "l long, i long"), "l", "i", block)
    found = {(r.a, r.b): r.weight for r in pairs.collect()}
    n = 1100 if block > 100 else 60
    assert len(found) == n * (n - 1) // 2
    assert found[(3, 5)] == pytest.approx(1 / n + 1 / 2) and found[(0, n - 1)] == pytest.approx(1 / n)


def test_walks_go_on_to_the_end(spark):
    chain = spark.createDataFrame([(f"n{i:03d}", f"n{i + 1:03d}") for i in range(55)] + [("x", "y"), ("y", "x")], "src string, dst string")
    levels = {r.node: r.level for r in network.levels(chain).collect()}
    assert levels == {f"n{i:03d}": i for i in range(56)}


def test_long_cycles_are_found(spark):
    ring = spark.createDataFrame([(f"n{i:02d}", f"n{i + 1:02d}") for i in range(14)], "src string, dst string")
    asked = spark.createDataFrame([("n14", "n00"), ("n00", "n14"), ("n14", "n14"), ("z", "n00")], "src string, dst string")
    found = {(r.src, r.dst): r.cyclic for r in network.closes_cycle(ring, asked).collect()}
    assert found == {("n14", "n00"): True, ("n00", "n14"): False, ("n14", "n14"): True, ("z", "n00"): False}


def test_paths_tell_that_they_were_cut(spark):
    ring = spark.createDataFrame([(f"n{i}", f"n{i + 1}") for i in range(6)] + [("n0", "end")], "src string, dst string")
    found = {tuple(r.path): r.cut for r in network.paths_to_roots(ring, spark.createDataFrame([("n0",)], "start string"), depth=3).collect()}
    assert found == {("n0", "end"): False, ("n0", "n1", "n2", "n3"): True}


def test_counted_terms_are_the_terms(spark):
    docs = spark.createDataFrame([(1, "Running ran runs, the nations' NATION"), (2, None), (3, "x running"), (3, "ran")], "i long, text string")
    one = {(r.i, r.term): r.n for r in lexical.term_counts(docs, "i", F.col("text")).collect()}
    each = {(r.i, r.term): r.n for r in lexical.terms(docs, "i", F.col("text")).groupBy("i", "term").agg(F.count("*").alias("n")).collect()}
    assert one == each and one[(1, "run")] == 2
