"""Queues, switches and merges over ordered records: windows over a key, no state outside the table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def bounded_queue(rows: DataFrame, by: list, order: list[str], capacity: int, keep: str = "newest") -> DataFrame:
    """What is left of each queue that holds ``capacity`` records: the newest (the oldest are dropped) or the oldest (the newest are refused)."""
    cols = [F.col(c).desc() if keep == "newest" else F.col(c).asc() for c in order]
    return rows.withColumn("__r", F.row_number().over(Window.partitionBy(*by).orderBy(*cols))).where(F.col("__r") <= capacity).drop("__r")


def hysteresis(rows: DataFrame, by: str, order: list[str], depth: Column, high: float, low: float) -> DataFrame:
    """rows with ``paused``: on from the first depth of high or more until one of low or less."""
    signal = F.when(depth >= high, True).when(depth <= low, False)
    over = Window.partitionBy(by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("paused", F.coalesce(F.last(signal, ignorenulls=True).over(over), F.lit(False)))


def failure_runs(rows: DataFrame, by: str, order: list[str], failed: Column) -> DataFrame:
    """rows with ``failures``: how many in a row have failed up to each."""
    w = Window.partitionBy(by).orderBy(*order)
    marked = rows.withColumn("__f", failed.cast("int")).withColumn("__g", F.sum(F.when(failed, 0).otherwise(1)).over(w))
    return marked.withColumn("failures", F.sum("__f").over(Window.partitionBy(by, "__g").orderBy(*order))).drop("__f", "__g")


def folded_into_parents(parents: DataFrame, children: DataFrame, key: str, parent_score: str, child_score: str, share: float = 0.8) -> DataFrame:
    """(key, score): a parent's own score, or that of its best child with a fifth of its own, if that is more."""
    best = children.groupBy(key).agg(F.max(child_score).alias("__c"))
    mixed = share * F.col("__c") + (1 - share) * F.col(parent_score)
    return parents.join(best, key, "left").select(key, F.greatest(F.col(parent_score), mixed).alias("score"))


def detection_quality(rows: DataFrame, by: str, predicted: Column, actual: Column) -> DataFrame:
    """(by, precision, recall, f1) of a yes-or-no prediction; 0 where nothing was predicted or true."""
    n = lambda c, name: F.sum(c.cast("int")).alias(name)
    c = rows.groupBy(by).agg(n(predicted & actual, "tp"), n(predicted & ~actual, "fp"), n(~predicted & actual, "fn"))
    safe = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    tp, fp, fn = map(F.col, ("tp", "fp", "fn"))
    return c.select(by, safe(tp, tp + fp).alias("precision"), safe(tp, tp + fn).alias("recall"), safe(2 * tp, 2 * tp + fp + fn).alias("f1"))


def chain_confidence(rows: DataFrame, by: str, confidence: Column) -> DataFrame:
    """(by, confidence): the product of the confidences of a chain's hops; 0 if one of them is."""
    log = F.when(confidence > 0, F.log(confidence))
    return rows.groupBy(by).agg(F.when(F.min(confidence) > 0, F.exp(F.sum(log))).otherwise(0.0).alias("confidence"))
