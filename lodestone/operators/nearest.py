"""Exact products of a stated set of query vectors with all rows, in blocks, and what is kept of them.

Queries are dealt to blocks and rows to parts; each pair of a block and a part is one matrix product in one task, which
keeps what is asked of it: the k best of each query, counts, or greatest values. What is shuffled grows with rows times
blocks and queries times parts, what a task holds is bounded by a block and a part, and only what is kept goes on.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .lexical import top_k

BLOCK = 2048  # queries of a block
PART = 8192  # rows of a part
CHUNK = 256  # queries multiplied at once


def _products(rows: DataFrame, id_col: str, vector: str, asks, label: str | None, keep: Callable, schema: str, block: int, part: int, bounds: DataFrame | None = None, within: bool = False, weights=()) -> DataFrame:
    """What keep(scores, ids, labels, queries) returns for each block and part: a dict of arrays by column.

    A vector that is null has products of 0. bounds (qid, ...) gives the queries further columns, and leaves out the others.
    within tells that only rows of a query's label matter: labels are dealt to as many sets as rows make parts, and blocks and
    parts of one set meet. Products are multiplied by a row's weights, one after the other, before they are rounded.
    """
    factors = [f"w{i}" for i in range(len(weights))]
    rows = rows.where(F.col(label).isNotNull()) if within else rows
    rows = rows.select(id_col, F.col(vector).alias("v"), (F.col(label) if label else F.lit(0)).alias("label"), F.coalesce(asks, F.lit(False)).alias("asks"), *[w.cast("double").alias(f) for w, f in zip(weights, factors, strict=True)])
    asking = F.count(F.when(F.col("asks"), 1)).alias("m")
    pieces = lambda n, size: F.floor(F.col(n) / size).cast("int") + 1
    if within:
        sets = rows.count() // part + 1
        rows = rows.withColumn("s", F.pmod(F.xxhash64("label"), F.lit(sets)).cast("int"))
        sizes = rows.groupBy("s").agg(F.count("*").alias("n"), asking)
        dealt = lambda df: df.join(sizes.select("s", pieces("m", block).alias("blocks"), pieces("n", part).alias("parts")), "s")
    else:
        sizes = rows.agg(F.count("*").alias("n"), asking).first()
        dealt = lambda df: df.withColumns({"s": F.lit(0), "blocks": F.lit(sizes["m"] // block + 1), "parts": F.lit(sizes["n"] // part + 1)})
    asked = rows.where("asks").select(*([F.col("s").alias("s")] if within else []), F.col(id_col).alias("qid"), F.col("v").alias("q"), F.col("label").alias("q_label"))
    asked = asked if bounds is None else asked.join(bounds, "qid")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = dealt(rows.drop("asks")).withColumn("p", F.pmod(F.xxhash64(id_col), "parts").cast("int")).withColumn("b", every("blocks")).drop("blocks", "parts")
    right = dealt(asked).withColumn("b", F.pmod(F.xxhash64("qid"), "blocks").cast("int")).withColumn("p", every("parts")).drop("blocks", "parts")
    names = [field.split()[0] for field in schema.split(", ")]

    def multiplied(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        out = []
        size = max((len(v) for v in [*a["v"], *b["q"]] if v is not None), default=1)
        stack = lambda vs: np.stack([np.zeros(size) if v is None else np.asarray(v, np.float64) for v in vs])
        if len(a) and len(b):
            x, ids, labels, ws = stack(a["v"]), a[id_col].to_numpy(), a["label"].to_numpy(), [a[f].to_numpy() for f in factors]
            for at in range(0, len(b), CHUNK):
                some = b.iloc[at : at + CHUNK]
                scores = stack(some["q"]) @ x.T
                for w in ws:
                    scores *= w
                scores = np.copysign(np.floor(np.abs(scores) * 1e6 + 0.5), scores) / 1e6 if ws else np.round(scores, 6)  # halves of weighted ones go up
                out.append(keep(scores + 0.0, ids, labels, some))
        return pd.DataFrame({c: np.concatenate([o[c] for o in out]) if out else np.zeros(0) for c in names})

    return left.groupBy("s", "b", "p").cogroup(right.groupBy("s", "b", "p")).applyInPandas(multiplied, schema)


def nearest(rows: DataFrame, id_col: str, vector: str, asks, k: int, label: str | None = None, block: int = BLOCK, part: int = PART, weights=()) -> DataFrame:
    """(qid, id, score, rank): the k rows nearest to each row that asks tells, by the product of their vectors and a row's weights.

    With a label only rows of the query's own are found, and looked at. Equal products are ranked by id; a row is never its own neighbour.
    """

    def best(scores, ids, labels, some):
        found = []
        for row, qid, own in zip(scores, some["qid"], some["q_label"], strict=True):
            fit = np.flatnonzero((labels == own) & (ids != qid))
            if len(fit) > k:
                least = np.partition(row[fit], len(fit) - k)[len(fit) - k]
                fit = fit[row[fit] >= least]
            found.append(fit[np.lexsort((ids[fit], -row[fit]))][:k])
        which = np.repeat(np.arange(len(some)), [len(f) for f in found])
        at = np.concatenate(found)
        return {"qid": some["qid"].to_numpy()[which], id_col: ids[at], "score": scores[which, at]}

    return top_k(_products(rows, id_col, vector, asks, label, best, f"qid long, {id_col} long, score double", block, part, within=label is not None, weights=weights), "qid", id_col, k)


def rivals(rows: DataFrame, id_col: str, vector: str, asks, label: str, least: float, block: int = BLOCK, part: int = PART) -> DataFrame:
    """(qid, n, most): how many rows of other labels have a product above `least` with a query, and the greatest; none: no row."""

    def above(scores, ids, labels, some):
        on = (labels[None] != some["q_label"].to_numpy()[:, None]) & (scores > least)
        has = on.any(axis=1)
        return {"qid": some["qid"].to_numpy()[has], "n": on.sum(axis=1)[has], "most": np.where(on, scores, -np.inf).max(axis=1)[has]}

    found = _products(rows, id_col, vector, asks, label, above, "qid long, n long, most double", block, part)
    return found.groupBy("qid").agg(F.sum("n").alias("n"), F.max("most").alias("most"))


def places(rows: DataFrame, id_col: str, vector: str, asks, bounds: DataFrame, block: int = BLOCK, part: int = PART) -> DataFrame:
    """(qid, place) of the neighbour that bounds (qid, found, score) names among all of a query's, the nearest being at 1."""

    def before(scores, ids, labels, some):
        bound, at = some["score"].to_numpy()[:, None], some["found"].to_numpy()[:, None]
        ahead = ((scores > bound) | ((scores == bound) & (ids[None] < at))) & (ids[None] != some["qid"].to_numpy()[:, None])
        return {"qid": some["qid"].to_numpy(), "n": ahead.sum(axis=1)}

    found = _products(rows, id_col, vector, asks, None, before, "qid long, n long", block, part, bounds)
    return found.groupBy("qid").agg((F.sum("n") + 1).alias("place"))
