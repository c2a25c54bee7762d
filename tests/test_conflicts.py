"""Overlaps, signature conflicts and conflict types, case by case."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from lodestone.operators import conflicts

SIGNATURE = "id long, axis string, exclusive boolean, modality string, predicate string, object string, relation string, linked array<long>, projects array<string>, channels array<string>, first_day int, last_day int"


def test_cover_is_the_interval(spark):
    r = random.Random(2)
    spans = [(a, min(a + r.choice((0, 1, 7, 100, 40000)), 65535)) for a in (r.randrange(65536) for _ in range(200))] + [(0, 65535), (5, 5)]
    rows = spark.createDataFrame(spans, "s int, e int").select("s", "e", conflicts.cover(F.col("s"), F.col("e")).alias("n")).collect()
    for row in rows:
        days = sorted(d for n in row.n for d in range(n.node << n.level, (n.node + 1) << n.level))
        assert days == list(range(row.s, row.e + 1)) and len(row.n) <= 34


@pytest.mark.parametrize("salts", [1, 4])
def test_overlapping_is_all_pairs(spark, salts):
    """A hot key, open ends, long and empty intervals, equal starts, nulls."""
    r = random.Random(4)
    rows = [(i, "hot" if i % 3 else f"k{i % 4}", r.choice((None, r.randrange(3000))), r.choice((None, r.randrange(3000)))) for i in range(240)]
    rows += [(500, None, 1, 5), (None, "hot", 1, 5), (501, "hot", 40, 40), (502, "hot", 40, 65535)]
    found = conflicts.overlapping(spark.createDataFrame(rows, "id long, k string, s int, e int"), "k", "id", "s", "e", salts).collect()
    spans = [(k, 0 if s is None else s, i, 65535 if e is None else e) for i, k, s, e in rows if k is not None and i is not None]
    spans = [x for x in spans if x[1] <= x[3]]
    expected = sorted((x[0], *((x[2], y[2]) if (x[1], x[2]) < (y[1], y[2]) else (y[2], x[2])), max(x[1], y[1]), min(x[3], y[3])) for x, y in itertools.combinations(spans, 2) if x[0] == y[0] and max(x[1], y[1]) <= min(x[3], y[3]))
    assert sorted(tuple(x) for x in found) == expected and len(expected) > 5000


def signature(i, modality="must", obj="x", **more):
    row = {"id": i, "axis": "a", "exclusive": True, "modality": modality, "predicate": "use", "object": obj, "relation": None, "linked": [], "projects": [], "channels": None, "first_day": None, "last_day": None} | more
    return tuple(row.values())


@pytest.mark.parametrize(
    "one, two, expected",
    [
        ({}, {"modality": "must_not"}, ("critical", "modality")),
        ({"modality": "may"}, {"modality": "must_not", "obj": ""}, ("low", "modality")),
        ({}, {"modality": "should_not", "obj": "y"}, None),
        ({}, {"obj": "y"}, ("critical", "competing")),
        ({"exclusive": False}, {"obj": "y"}, None),
        ({"modality": "should"}, {"modality": "should", "obj": "y"}, ("low", "competing")),
        ({"modality": "must_not"}, {"modality": "must_not", "obj": "y"}, None),
        ({"obj": "X"}, {}, None),
        ({"predicate": "Use"}, {"obj": "y"}, ("critical", "competing")),
        ({"predicate": "buy"}, {"obj": "y"}, None),
        ({"linked": [2]}, {"modality": "must_not"}, None),
        ({}, {"modality": "must_not", "linked": [1]}, None),
        ({"relation": "requires"}, {"modality": "must_not", "relation": "requires"}, None),
        ({"relation": "requires"}, {"modality": "must_not", "relation": "composes_with"}, ("critical", "modality")),
        ({"projects": ["p"]}, {"modality": "must_not", "projects": ["q"]}, None),
        ({"projects": ["p"]}, {"modality": "must_not", "projects": ["q", "p"]}, ("critical", "modality")),
        ({"channels": ["c"]}, {"modality": "must_not", "channels": None}, ("critical", "modality")),
        ({"last_day": 5}, {"modality": "must_not", "first_day": 6}, None),
        ({"last_day": 6}, {"modality": "must_not", "first_day": 6}, ("critical", "modality")),
        ({"axis": "b"}, {"modality": "must_not"}, None),
    ],
)
def test_signature_conflicts(spark, one, two, expected):
    rows = spark.createDataFrame([signature(1, **one), signature(2, **two)], SIGNATURE)
    found = [(r.severity, r.kind) for r in conflicts.signature_conflicts(rows).collect()]
    assert found == ([expected] if expected else [])


def test_conflict_types(spark):
    cases = [
        ("we enable the cache", "we disable the cache", 0.5, "contradiction"),
        ("we enable the cache", "we disable the cache", 0.4, "related"),
        ("we enable the cache", "we disable the cache", 0.95, "duplicate"),
        ("never, we cannot and do not", "we do", 0.6, "contradiction"),
        ("never, we cannot and do not", "we do", 0.5, "related"),
        ("we use it", "we use it now", 0.8, "refinement"),
        ("an activeness", "it is deprecated", 0.6, "related"),
        (None, "x", 0.5, "related"),
    ]
    rows = spark.createDataFrame(cases, "a string, b string, s double, expected string")
    for r in rows.withColumn("got", conflicts.conflict_type(F.col("a"), F.col("b"), F.col("s"))).collect():
        assert r.got == r.expected


def test_cosines(spark):
    texts = spark.createDataFrame([(1, "a b b don't größe"), (2, None), (3, "b")], "a long, text string")
    pairs = spark.createDataFrame([(1, 1), (1, 3), (2, 1)], "a long, b long")
    found = {(r.a, r.b): r.similarity for r in conflicts.cosines(pairs, texts, texts.withColumnRenamed("a", "b")).collect()}
    assert found == pytest.approx({(1, 1): 1.0, (1, 3): 2 / 6**0.5})
