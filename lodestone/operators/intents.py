"""Intents of questions, with confidence that learns from outcomes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import intents


def classify(rows: DataFrame, text: str) -> DataFrame:
    """rows with intent, confidence and sub_intents, by patterns alone."""
    known = rows.withColumn("shares", intents.intent_shares(F.col(text)))
    known = known.withColumn("c", intents.classified(F.col(text), F.col("shares"))).drop("shares")
    return known.select(*[c for c in known.columns if c != "c"], "c.intent", "c.confidence", "c.sub_intents")


def learned(outcomes: DataFrame) -> DataFrame:
    """(intent, day, weight): what outcomes (intent, day, results, score) up to each day, that day's included, say of an intent.

    The weight is from 0.5 (all poor) to 1 (all good); an intent has none before SAMPLES outcomes. Outcomes are counted by day
    before they are summed up, so that the history of an intent is no longer than its days.
    """
    good = ((F.col("results") > 0) & (F.col("score") > intents.GOOD)).cast("long")
    days = outcomes.groupBy("intent", "day").agg(F.sum(F.coalesce(good, F.lit(0))).alias("good"), F.count("*").alias("n"))
    so_far = Window.partitionBy("intent").orderBy("day").rowsBetween(Window.unboundedPreceding, 0)
    sums = days.select("intent", "day", F.sum("good").over(so_far).alias("good"), F.sum("n").over(so_far).alias("n"))
    return sums.where(F.col("n") >= intents.SAMPLES).select("intent", "day", (0.5 + 0.5 * F.col("good") / F.col("n")).alias("weight"))


def adapted(classes: DataFrame, weights: DataFrame) -> DataFrame:
    """classes (intent, day, confidence, ...) with the confidence that the latest weights before the day leave them."""
    ends = weights.select(F.col("intent").alias("of"), F.col("day").alias("since"), "weight", F.lead("day").over(Window.partitionBy("intent").orderBy("day")).alias("until"))
    # an intent has one row a day at most, and of these one lies before the day
    on = (F.col("intent") == F.col("of")) & (F.col("since") < F.col("day")) & (F.col("until").isNull() | (F.col("until") >= F.col("day")))
    both = classes.join(ends, on, "left")
    return both.withColumn("confidence", F.round(F.col("confidence") * F.coalesce("weight", F.lit(1.0)), 3)).drop("of", "since", "until", "weight")
