"""Exact quantiles of groups of any size: values are counted, ranged, and ranked by offsets of their ranges."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import stored


def quantiles(rows: DataFrame, group: list[str], value: str, at: dict[str, float]) -> DataFrame:
    """(group, one column for each of at): interpolated quantiles of the values that are no nulls.

    Equal values are counted first. What is left is dealt by ranges of (group, value), so that a group of very many values is
    spread over tasks; a range's offset is the sum of those before it, of which there is one row for each range and group.
    """
    counts = rows.where(F.col(value).isNotNull()).groupBy(*group, F.col(value).alias("value")).agg(F.count("*").alias("n"))
    ranged = stored(counts.repartitionByRange(*group, "value").withColumn("range", F.spark_partition_id()), "ranged")
    sums = ranged.groupBy(*group, "range").agg(F.sum("n").alias("m"))
    whole = Window.partitionBy(*group)
    before = F.coalesce(F.sum("m").over(whole.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sums = sums.select(*group, "range", before.alias("before"), F.sum("m").over(whole).alias("total"))
    up_to = F.sum("n").over(Window.partitionBy(*group, "range").orderBy("value").rowsBetween(Window.unboundedPreceding, 0))
    placed = ranged.withColumn("up_to", up_to).join(sums, [*group, "range"]).withColumn("up_to", F.col("before") + F.col("up_to"))
    out = []
    for name, q in at.items():
        place = F.lit(q) * (F.col("total") - 1)
        here = lambda i: F.max(F.when((F.col("up_to") - F.col("n") <= i) & (i < F.col("up_to")), F.col("value")))
        low, high, share = here(F.floor(place)), here(F.ceil(place)), F.max(place - F.floor(place))
        out.append((low + share * (high - low)).alias(name))
    return placed.groupBy(*group).agg(*out)
