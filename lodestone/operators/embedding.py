"""Embeddings without a model, and product quantisation of vectors."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import vectors as along
from ..functions.text import trigrams
from ..sources.scratch import stored
from .lexical import top_k

QUERIES = 512  # queries of a block
CODES = 131_072  # coded rows of a part


def hashed(records: DataFrame, id_col: str, text: Column, dim: int = 128) -> DataFrame:
    """(id, bucket, weight): each text's character trigrams hashed to buckets, log-weighted and of unit length."""
    grams = records.select(id_col, F.explode(trigrams(text)).alias("gram"))
    bucket = F.pmod(F.conv(F.substring(F.md5("gram"), 1, 8), 16, 10).cast("long"), F.lit(dim))
    counts = grams.groupBy(id_col, bucket.alias("bucket")).agg(F.count("*").alias("n")).withColumn("w", F.log(F.col("n") + 1.0))
    norms = counts.groupBy(id_col).agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    return counts.join(norms, id_col).select(id_col, "bucket", (F.col("w") / F.col("norm")).alias("weight"))


class Codebook:
    """Centroids of the parts of vectors: parts x centroids x numbers."""

    def __init__(self, centroids: np.ndarray):
        self.centroids = centroids

    @classmethod
    def trained(cls, vectors: DataFrame, column: str = "embedding", parts: int = 8, size: int = 16, sample: int = 4096, rounds: int = 12, seed: int = 42) -> Codebook:
        """k-means++ over each part of a bounded sample, drawn by hash so that reruns agree; fewer parts where they do not divide a vector."""
        rows = vectors.where(F.col(column).isNotNull()).select(column).orderBy(F.xxhash64(column)).limit(sample).collect()
        x = np.array([r[0] for r in rows], np.float64)
        if not len(x):
            raise ValueError("there are no vectors to train on")
        rng = np.random.default_rng(seed)
        return cls(np.stack([cls._kmeans(p, min(size, len(x)), rounds, rng) for p in np.split(x, math.gcd(parts, x.shape[1]), axis=1)]))

    @staticmethod
    def _kmeans(x: np.ndarray, k: int, rounds: int, rng) -> np.ndarray:
        c = x[[rng.integers(len(x))]]
        while len(c) < k:
            d = ((x[:, None] - c) ** 2).sum(-1).min(1)
            c = np.vstack([c, x[rng.choice(len(x), p=d / d.sum())] if d.sum() > 0 else x[rng.integers(len(x))]])
        for _ in range(rounds):
            near = ((x[:, None] - c) ** 2).sum(-1).argmin(1)
            for j in range(k):
                if (near == j).any():
                    c[j] = x[near == j].mean(0)
        return c

    def _parts(self, x: np.ndarray) -> np.ndarray:
        return x.reshape(len(x), len(self.centroids), -1)

    def encode(self, vectors: Column) -> Column:
        """The nearest centroid of each part, a byte each."""
        centroids = self.centroids

        @F.pandas_udf(T.BinaryType())
        def code(v: pd.Series) -> pd.Series:
            if not len(v):
                return pd.Series([], dtype=object)
            x = np.stack(v.to_list()).reshape(len(v), len(centroids), -1)
            near = ((x[:, :, None] - centroids[None]) ** 2).sum(-1).argmin(-1).astype(np.uint8)
            return pd.Series([r.tobytes() for r in near])

        return code(vectors)

    def distance(self, query: list[float], codes: Column) -> Column:
        """Squared distance of a whole query vector to coded ones: a table look-up for each part, in expressions."""
        table = ((self._parts(np.array([query]))[0][:, None] - self.centroids) ** 2).sum(-1)
        terms = [F.get(F.array(*map(F.lit, row.tolist())), F.conv(F.hex(F.substring(codes, n + 1, 1)), 16, 10).cast("int")) for n, row in enumerate(table)]
        return sum(terms[1:], terms[0])

    def distances(self, query: np.ndarray, places: np.ndarray) -> np.ndarray:
        """Squared distances of a whole query vector to coded ones, whose codes places has part by part, summed in the order of the parts."""
        table = ((np.asarray(query, np.float64).reshape(len(self.centroids), 1, -1) - self.centroids) ** 2).sum(-1)
        far = table[0].take(places[0])
        for row, at in zip(table[1:], places[1:], strict=True):
            far += row.take(at)
        return far


def nearest_codes(coded: DataFrame, queries: DataFrame, id_col: str, book: Codebook, k: int, block: int = QUERIES, part: int = CODES) -> DataFrame:
    """(qid, id, near): of the coded rows (id, code) those nearest to each of queries (qid, q), k of every part of them, not itself.

    Queries are dealt to blocks and codes to parts; each two meet in one task, which keeps the k best of each query, equal
    ones by id. So no pair is moved but those, and a task holds a block and a part, however many rows there are.
    """
    blocks, parts = queries.count() // block + 1, coded.count() // part + 1
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = coded.withColumn("p", F.pmod(F.xxhash64(id_col), F.lit(parts)).cast("int")).withColumn("b", every(blocks))
    right = queries.withColumn("b", F.pmod(F.xxhash64("qid"), F.lit(blocks)).cast("int")).withColumn("p", every(parts))

    def best(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if not len(a) or not len(b):
            return pd.DataFrame({"qid": [], id_col: [], "near": []})
        places = np.ascontiguousarray(np.frombuffer(b"".join(a["code"]), np.uint8).reshape(len(a), -1).T.astype(np.intp))
        ids, out = a[id_col].to_numpy(), []
        for qid, query in zip(b["qid"], b["q"], strict=True):
            far = book.distances(query, places)
            far[np.isnan(far)] = -np.inf  # Spark has what is no number for the greatest
            fit = np.flatnonzero(ids != qid)
            if len(fit) > k:
                fit = fit[far[fit] <= np.partition(far[fit], k - 1)[k - 1]]
            fit = fit[np.lexsort((ids[fit], far[fit]))][:k]
            out.append((np.repeat(np.asarray([qid], b["qid"].dtype), len(fit)), ids[fit], -far[fit]))
        return pd.DataFrame({c: np.concatenate(x) for c, x in zip(("qid", id_col, "near"), zip(*out, strict=True), strict=True)})

    kind = coded.schema[id_col].dataType.simpleString()
    return left.groupBy("b", "p").cogroup(right.groupBy("b", "p")).applyInPandas(best, f"qid {kind}, {id_col} {kind}, near double")


def searched(rows: DataFrame, id_col: str, asked: Column, k: int = 10, candidates: int = 400, column: str = "embedding") -> DataFrame:
    """(qid, id, score, rank): the k rows nearest to each row that asked tells, by cosine.

    All rows are ranked by their codes for each query, and so many candidates again in full. A vector without a
    direction, or null, neither asks nor is found.
    """
    units = rows.select(id_col, asked.alias("asks"), along.unit(F.col(column)).alias("v")).where(F.col("v").isNotNull() & F.col(id_col).isNotNull())
    units = stored(units, "units")
    if units.isEmpty():
        return units.select(F.col(id_col).alias("qid"), id_col, F.lit(0.0).alias("score"), F.lit(1).alias("rank"))
    book = Codebook.trained(units, "v", parts=32)
    queries = units.where("asks").select(F.col(id_col).alias("qid"), F.col("v").alias("q"))
    coded = units.select(id_col, book.encode(F.col("v")).alias("code"))
    near = top_k(nearest_codes(coded, queries, id_col, book, candidates), "qid", id_col, candidates, "near")
    full = near.select("qid", id_col).join(units.select(id_col, "v"), id_col).join(queries, "qid")
    return top_k(full.select("qid", id_col, F.round(along.dot(F.col("q"), F.col("v")), 6).alias("score")), "qid", id_col, k)
