"""Fusion, blending and thinning of ranked lists: windows over a group of ranked rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scoring import RRF_K


def reciprocal_ranks(arms: DataFrame, by: list[str], id_col: str, k: int = RRF_K) -> DataFrame:
    """(by, id, score, arms) from rows (by, id, arm, rank, weight): the sum of weight / (k + rank) over the arms."""
    return arms.groupBy(*by, id_col).agg(F.sum(F.col("weight") / (F.col("rank") + k)).alias("score"), F.array_join(F.array_sort(F.collect_set("arm")), ",").alias("arms"))


def borda(rows: DataFrame, by: str, id_col: str, scores: list[str]) -> DataFrame:
    """(by, id, points): for each score, how many rows of the group a row leaves behind it, summed."""
    size = F.count("*").over(Window.partitionBy(by))
    points = sum((size - F.row_number().over(Window.partitionBy(by).orderBy(F.col(s).desc(), F.col(id_col).asc())) for s in scores), F.lit(0))
    return rows.select(by, id_col, points.alias("points"))


def minmax(value: Column, by: Column) -> Column:
    """value scaled to [0, 1] within its group; 0 where all are equal."""
    low, high = F.min(value).over(Window.partitionBy(by)), F.max(value).over(Window.partitionBy(by))
    return F.when(high > low, (value - low) / (high - low)).otherwise(0.0)


def knee(rows: DataFrame, by: str, id_col: str, score: str, drop: float = 0.5) -> DataFrame:
    """The rows of each group above its steepest fall, where that is more than ``drop`` of the best score."""
    order = Window.partitionBy(by).orderBy(F.col(score).desc(), F.col(id_col).asc())
    whole = Window.partitionBy(by)
    falls = rows.withColumn("rank", F.row_number().over(order)).withColumn("fall", F.col(score) - F.lead(score).over(order)).withColumn("best", F.max(score).over(whole))
    cut = F.max(F.when((F.col("best") > 0) & (F.col("fall") / F.col("best") > drop), F.struct(F.col("fall"), (-F.col("rank")).alias("at")))).over(whole)
    return falls.withColumn("cut", -cut["at"]).where(F.col("cut").isNull() | (F.col("rank") <= F.col("cut"))).drop("fall", "best", "cut")


def capped(rows: DataFrame, by: list[str], order: list[Column], cap: int) -> DataFrame:
    """At most ``cap`` rows of each group, the first in the given order: a diversity cap."""
    return rows.withColumn("place", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("place") <= cap)


def session_boost(rows: DataFrame, by: str, session: str, id_col: str, score: str, seeds: int = 3, boost: float = 0.3) -> DataFrame:
    """Scores raised by ``boost`` in the sessions that hold one of the group's first ``seeds`` rows."""
    order = Window.partitionBy(by).orderBy(F.col(score).desc(), F.col(id_col).asc())
    ranked = rows.withColumn("seed", (F.row_number().over(order) <= seeds).cast("int"))
    active = F.max("seed").over(Window.partitionBy(by, session)) == 1
    return ranked.withColumn("boosted", F.when(active, F.col(score) * (1 + boost)).otherwise(F.col(score))).drop("seed")
