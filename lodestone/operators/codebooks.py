"""Codebooks of product quantisation that are kept: versions in a folder, codes that say of which version they are.

A codebook is small at any size of the data (parts times centroids), so it is read by the driver; codes are tables. New
vectors are coded with the latest version; where what they lose by it grows, a new version is trained and what is coded
is coded again. Codes of several versions are never compared.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .embedding import Codebook
from .embedding import nearest_codes as in_blocks

ROWS = "part int, centroid int, numbers array<double>"


def saved(spark: SparkSession, book: Codebook, folder: str) -> int:
    """Write a codebook as the next version below folder, and return its number."""
    version = latest(spark, folder) + 1
    rows = [(p, c, [float(x) for x in numbers]) for p, part in enumerate(book.centroids) for c, numbers in enumerate(part)]
    spark.createDataFrame(rows, ROWS).coalesce(1).write.parquet(f"{folder}/version={version:06d}")
    return version


def latest(spark: SparkSession, folder: str) -> int:
    """The greatest version below folder; 0 if there is none."""
    try:
        return spark.read.parquet(folder).agg(F.max("version")).first()[0] or 0
    except AnalysisException:  # nothing there yet
        return 0


def loaded(spark: SparkSession, folder: str, version: int | None = None) -> tuple[Codebook, int]:
    """A version of a codebook, or the latest, with its number."""
    version = latest(spark, folder) if version is None else version
    rows = spark.read.schema(ROWS).parquet(f"{folder}/version={version:06d}").orderBy("part", "centroid").collect()
    parts = max(r.part for r in rows) + 1
    return Codebook(np.array([r.numbers for r in rows]).reshape(parts, len(rows) // parts, -1)), version


def decoded(book: Codebook, codes: Column) -> Column:
    """The vectors that codes stand for: the centroid of each part. A null code has none."""
    centroids = book.centroids

    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def vector(codes: pd.Series) -> pd.Series:
        out = [None if c is None else centroids[np.arange(len(centroids)), np.frombuffer(c, np.uint8)].ravel() for c in codes]
        return pd.Series(out, dtype=object)

    return vector(codes)


def coded(rows: DataFrame, id_col: str, vector: str, book: Codebook, version: int) -> DataFrame:
    """(id, version, code, lost): each vector's code and the squared distance to what it stands for. Null vectors are left out."""
    some = rows.where(F.col(vector).isNotNull()).select(id_col, F.col(vector).alias("v")).withColumn("code", book.encode(F.col("v")))
    lost = F.aggregate(F.zip_with("v", decoded(book, F.col("code")), lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)
    return some.select(id_col, F.lit(version).alias("version"), "code", lost.alias("lost"))


def appended(codes: DataFrame, rows: DataFrame, id_col: str, vector: str, book: Codebook, version: int) -> DataFrame:
    """codes with those of the rows that have none yet, by a codebook that was trained before they came."""
    fresh = rows.join(codes.select(id_col), id_col, "left_anti")
    return codes.union(coded(fresh, id_col, vector, book, version))


def drift(codes: DataFrame, version: int, before: float) -> float:
    """How much more the vectors coded by a version lose on average than `before`, the average when it was trained; 0 without any."""
    mean = codes.where(F.col("version") == version).agg(F.avg("lost")).first()[0]
    return 0.0 if mean is None else mean / before if before else float(mean > 0)


def recoded(codes: DataFrame, rows: DataFrame, id_col: str, vector: str, book: Codebook, version: int) -> DataFrame:
    """All rows under a new version; codes of rows that are gone are dropped."""
    return coded(rows.join(codes.select(id_col).distinct(), id_col, "left_semi"), id_col, vector, book, version)


def nearest_codes(codes: DataFrame, id_col: str, book: Codebook, version: int, queries: DataFrame, k: int) -> DataFrame:
    """(qid, id, distance, rank): the k codes of a version nearest to each whole query vector (qid, q), by distances to its parts.

    Codes meet the queries in blocks, which keep the k best of each query.
    """
    from .lexical import top_k

    mine = codes.where((F.col("version") == version) & F.col(id_col).isNotNull()).select(id_col, "code")
    ranked = top_k(in_blocks(mine, queries.select("qid", "q"), id_col, book, k), "qid", id_col, k, "near")
    return ranked.select("qid", id_col, (-F.col("near")).alias("distance"), "rank")
