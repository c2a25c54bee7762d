"""Products in blocks and exact quantiles in ranges, against plain numpy."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.operators import nearest
from lodestone.operators.quantiles import quantiles


@pytest.mark.parametrize("sizes", [{}, {"block": 3, "part": 7}])
def test_products_in_blocks(spark, sizes):
    """Ties, null vectors, labels with a single row, any cut into blocks."""
    r = random.Random(3)
    rows = [(i, None if i % 17 == 5 else [float(r.randint(-2, 2)) for _ in range(3)], i % 4 if i else 9) for i in range(60)]
    df, asks = spark.createDataFrame(rows, "i long, v array<double>, l int"), F.col("i") % 5 == 0
    x = np.array([v or [0, 0, 0] for _, v, _ in rows])
    scores, labels = x @ x.T, np.array([c for *_, c in rows])
    order = {q: sorted((j for j in range(60) if j != q), key=lambda j, q=q: (-scores[q, j], j)) for q in range(0, 60, 5)}
    got = {(g.qid, g["rank"]): (g.i, g.score) for g in nearest.nearest(df, "i", "v", asks, 4, **sizes).collect()}
    assert got == {(q, n + 1): (o[n], scores[q, o[n]]) for q, o in order.items() for n in range(4)}
    wrong = {q: [scores[q, j] for j in o if labels[j] != labels[q] and scores[q, j] > 1] for q, o in order.items()}
    assert {g.qid: (g.n, g.most) for g in nearest.rivals(df, "i", "v", asks, "l", 1.0, **sizes).collect()} == {q: (len(w), max(w)) for q, w in wrong.items() if w}
    named = [(q, o[(7 * q) % 59], float(scores[q, o[(7 * q) % 59]])) for q, o in order.items() if q != 10]
    found = nearest.places(df, "i", "v", asks, spark.createDataFrame(named, "qid long, found long, score double"), **sizes)
    assert {g.qid: g.place for g in found.collect()} == {q: o.index(j) + 1 for q, j, _ in named for o in [order[q]]}


def test_quantiles(spark):
    """A group of nearly all rows, groups of one value, of one row and of nulls only."""
    r = random.Random(2)
    rows = [("hot", round(r.gauss(0, 9), 1)) for _ in range(900)] + [("same", 4.0)] * 7 + [("one", -1.5), ("none", None), ("hot", None), (None, 2.0), (None, 4.0)]
    at = {"a": 0.0, "b": 0.25, "c": 0.5, "d": 0.99, "e": 1.0}
    found = {g.k: [g[c] for c in at] for g in quantiles(spark.createDataFrame(rows, "k string, v double").repartition(5), ["k"], "v", at).where("k IS NOT NULL").collect()}
    values = {k: [v for key, v in rows if key == k and v is not None] for k in ("hot", "same", "one")}
    assert found == {k: pytest.approx(np.quantile(v, list(at.values()))) for k, v in values.items()}
