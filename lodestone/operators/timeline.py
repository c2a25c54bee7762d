"""Operators over time: versions as of a moment, filters after ranking, tiers, windows over logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def as_of(edits: DataFrame, key: str, at: str, moment: str, ties: str) -> DataFrame:
    """The latest edit of each key at or before ``at``: one aggregation, no join and no sort."""
    seen = edits.where(F.col(moment) <= F.lit(at).cast("timestamp"))
    rest = [c for c in edits.columns if c != key]
    latest = F.max_by(F.struct(*rest), F.struct(moment, ties))
    return seen.groupBy(key).agg(latest.alias("e"), F.count("*").alias("version")).select(key, "e.*", "version")


def as_of_join(facts: DataFrame, edits: DataFrame, key: str, at: str, moment: str, value: str) -> DataFrame:
    """facts with the value of the latest edit of the same key at or before each fact's own moment.

    Facts and edits are one stream, ordered within the key; the last value seen is carried forward. This is one
    exchange on the key, where a range join would compare every fact with every edit.
    """
    both = facts.withColumn("__v", F.lit(None).cast(edits.schema[value].dataType)).withColumn("__o", F.lit(1))
    edit = edits.select(F.col(key), F.col(moment).alias(at), F.col(value).alias("__v")).withColumn("__o", F.lit(0))
    both = both.unionByName(edit, allowMissingColumns=True)
    order = Window.partitionBy(key).orderBy(at, "__o", "__v").rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumn(value, F.last("__v", ignorenulls=True).over(order)).where("__o = 1").drop("__v", "__o")


def in_range(moment: Column, since: str, until: str) -> Column:
    """Whether a moment's day lies in a range of days, both included; records without a date do not."""
    day = F.date_format(moment, "yyyy-MM-dd")
    return F.coalesce((day >= since) & (day <= until), F.lit(False))


#: What each tier asks for (accesses, age in hours, confirmations) and how long it may lie idle, in hours.
TIERS = (("working", 0, 0.0, 0, 168.0), ("shared", 3, 1.0, 0, 336.0), ("long_term", 10, 24.0, 2, 1440.0), ("verified", 0, 0.0, 5, 4320.0))


def promoted(tier: Column, accesses: Column, age_hours: Column, confirmations: Column) -> Column:
    """A record's tier after one promotion: the next one, if what it asks for is met."""
    out = F.when(F.lit(False), tier)
    for (now, *_), (following, least, age, confirmed, _) in zip(TIERS, TIERS[1:], strict=False):
        out = out.when((tier == now) & (accesses >= least) & (age_hours >= age) & (confirmations >= confirmed), F.lit(following))
    return out.otherwise(tier)


def decayed(tier: Column, idle_hours: Column) -> Column:
    """A record's tier after lying idle: the one before, and evicted from the first."""
    out = F.when((tier == TIERS[0][0]) & (idle_hours > TIERS[0][4]), F.lit("evicted"))
    for (before, *_), (now, *_rest, idle) in zip(TIERS, TIERS[1:], strict=False):
        out = out.when((tier == now) & (idle_hours > idle), F.lit(before))
    return out.otherwise(tier)


def within_window(rows: DataFrame, by: str, moment: str, seconds: int) -> DataFrame:
    """rows with ``recent``: how many of the same key fall in the window that ends with each."""
    over = Window.partitionBy(by).orderBy(F.col(moment).cast("timestamp").cast("double")).rangeBetween(-seconds, 0)
    return rows.withColumn("recent", F.count("*").over(over))


def consensus(votes: DataFrame, by: str, voter: str, choice: str, trust: str, quorum: float = 0.66, least: int = 2) -> DataFrame:
    """(by, winner, share, voters): the choice with the quorum's share of trust; a voter counts once for each choice."""
    once = votes.groupBy(by, voter, choice).agg(F.max(trust).alias("trust"))
    tally = once.groupBy(by, choice).agg(F.sum("trust").alias("weight"))
    voters = votes.groupBy(by).agg(F.count_distinct(voter).alias("voters"))
    best = tally.groupBy(by).agg(F.max(F.struct(F.col("weight"), F.col(choice).alias("winner"))).alias("b"), F.sum("weight").alias("all"))
    share = F.round(F.col("b.weight") / F.col("all"), 6)
    won = (F.col("voters") >= least) & (F.col("b.weight") / F.col("all") >= quorum)
    return best.join(voters, by).select(by, F.when(won, F.col("b.winner")).alias("winner"), share.alias("share"), "voters")
