"""Stored codebooks: loaded in another session, appended to, replaced on drift."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.operators import codebooks
from lodestone.operators.embedding import Codebook


def test_stored_codebooks(spark, tmp_path):
    r, folder = random.Random(5), str(tmp_path / "books")
    centres = [[r.gauss(0, 3) for _ in range(8)] for _ in range(12)]
    point = lambda i: [x + r.gauss(0, 0.3) for x in centres[i % 12]]
    rows = spark.createDataFrame([(i, point(i)) for i in range(600)] + [(999, None)], "i long, v array<double>")
    old = rows.where("i < 400")
    assert codebooks.latest(spark, folder) == 0
    book = Codebook.trained(old, "v", parts=4, size=32)
    assert codebooks.saved(spark, book, folder) == 1
    other = spark.newSession()
    again, version = codebooks.loaded(other, folder)
    assert version == 1 and (again.centroids == book.centroids).all()

    codes = codebooks.coded(old, "i", "v", again, 1)
    x = {row.i: np.array(row.v) for row in rows.where("v IS NOT NULL").collect()}
    for row in codes.withColumn("d", codebooks.decoded(again, F.col("code"))).collect():
        near = [((part[None] - c) ** 2).sum(1) for part, c in zip(x[row.i].reshape(4, -1), book.centroids, strict=True)]
        assert bytes(row.code) == bytes(int(n.argmin()) for n in near)
        assert row.lost == pytest.approx(sum(n.min() for n in near)) and row.lost == pytest.approx(((np.array(row.d) - x[row.i]) ** 2).sum())

    every = codebooks.appended(codes, rows, "i", "v", again, 1)
    assert every.count() == 600 == every.select("i").distinct().count()
    assert codebooks.appended(every, rows, "i", "v", again, 1).count() == 600
    asked = rows.where("i % 20 = 0 AND v IS NOT NULL").select(F.col("i").alias("qid"), F.col("v").alias("q"))
    found = codebooks.nearest_codes(every, "i", again, 1, asked, 60).groupBy("qid").agg(F.collect_set("i").alias("of")).collect()
    hits = [len({j for _, j in sorted((((x[f.qid] - x[j]) ** 2).sum(), j) for j in x if j != f.qid)[:10]} & set(f.of)) for f in found]
    assert len(found) == 30 and sum(hits) / 300 >= 0.9

    before = codes.agg(F.avg("lost")).first()[0]
    assert codebooks.drift(every, 1, before) < 1.5 and codebooks.drift(every, 7, before) == 0
    moved = spark.createDataFrame([(2000 + i, [x + 9 for x in point(i)]) for i in range(200)], "i long, v array<double>")
    wide = codebooks.appended(every, moved, "i", "v", again, 1)
    assert codebooks.drift(wide, 1, before) > 5
    newer = Codebook.trained(rows.union(moved), "v", parts=4, size=64)
    assert codebooks.saved(spark, newer, folder) == 2 and codebooks.loaded(spark, folder)[1] == 2 and codebooks.loaded(spark, folder, 1)[0].centroids.shape == book.centroids.shape
    fresh = codebooks.recoded(wide, rows.union(moved), "i", "v", newer, 2)
    assert fresh.count() == 800 and codebooks.drift(fresh, 2, before) < 2
    assert codebooks.nearest_codes(fresh.union(every), "i", newer, 2, asked, 1).count() == 30
