"""Ranked evidence: similarity within a list, greedy thinning, confidence, chains of boosts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import stored


def cosines(terms: DataFrame, group: str, place: str) -> DataFrame:
    """(group, ra, rb, cosine), ra < rb: term-count cosine of the pairs of a short list that share a term; terms has a row an occurrence."""
    tf = stored(terms.groupBy(group, place, "term").agg(F.count("*").cast("double").alias("tf")), "terms")
    norm = tf.groupBy(group, place).agg(F.sqrt(F.sum(F.col("tf") * F.col("tf"))).alias("norm"))
    side = lambda r, t: tf.select(group, F.col(place).alias(r), "term", F.col("tf").alias(t))
    dots = side("ra", "ta").join(side("rb", "tb"), [group, "term"]).where("ra < rb").groupBy(group, "ra", "rb").agg(F.sum(F.col("ta") * F.col("tb")).alias("dot"))
    of = lambda r, n: norm.select(group, F.col(place).alias(r), F.col("norm").alias(n))
    both = dots.join(of("ra", "na"), [group, "ra"]).join(of("rb", "nb"), [group, "rb"])
    return both.select(group, "ra", "rb", F.round(F.col("dot") / (F.col("na") * F.col("nb")), 6).alias("cosine"))


def greedy_distinct(pairs: DataFrame, places: DataFrame, threshold: float) -> DataFrame:
    """(group, kept): places in order, but for those that are too similar to one kept before. Lists must be short."""
    group, place = places.columns
    near = pairs.where(F.col("cosine") >= threshold).groupBy(group, F.col("rb").alias(place)).agg(F.collect_list("ra").alias("near"))
    rows = places.join(near, [group, place], "left").select(group, F.struct(F.col(place).cast("long").alias("at"), F.coalesce("near", F.array().cast("array<int>")).cast("array<long>").alias("near")).alias("s"))
    step = lambda kept, s: F.when(F.arrays_overlap(kept, s["near"]), kept).otherwise(F.array_append(kept, s["at"]))
    return rows.groupBy(group).agg(F.aggregate(F.array_sort(F.collect_list("s")), F.array().cast("array<bigint>"), step).alias("kept"))


def confidence(overlap: Column, top: Column, speaker: Column, dense: Column, against: Column) -> Column:
    """How sure an answer is, from 0 to 1. The weights."""
    raw = 0.35 * overlap + 0.20 * top + 0.15 * speaker + 0.20 * dense - 0.10 * against
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), raw))


def boosted(score: Column, factors: list[Column]) -> Column:
    for factor in factors:
        score = score * factor
    return score
