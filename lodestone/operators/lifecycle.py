"""What becomes of records: importance, beliefs, reliability, eviction, packing, conflicts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def importance(accesses: Column, idle_days: Column, connections: Column) -> Column:
    """By use, freshness and connections, in [0.8, 1.5]."""
    raw = 0.8 + 0.35 * (0.4 * F.log(accesses + 1.0) + 0.4 * F.exp(-idle_days / 30.0) + 0.2 * F.log(connections + 1.0))
    return F.greatest(F.lit(0.8), F.least(F.lit(1.5), raw))


def maturity(active: Column, durable: Column, edges: Column) -> Column:
    """By status, lifecycle and how many other records point here, in [0, 1]."""
    return 0.3 * active + 0.2 * durable + 0.5 * F.least(F.lit(1.0), edges / 5.0)


def validity(arms: Column, status: Column, contradicted: Column, staleness: Column) -> Column:
    """A quarter each for corroboration, status, no contradiction, and freshness."""
    return (arms + status + F.when(contradicted, 0.0).otherwise(1.0) + (1.0 - staleness)) / 4.0


def beliefs(observations: DataFrame, key: str, value: str, prior: float, variance: float, noise: float) -> DataFrame:
    """(key, estimate, variance, n): a belief after all observations of equal noise.

    The gain-by-gain update of such observations has a closed form, so it is one aggregation whose order does not matter.
    """
    precision = 1.0 / variance + F.count(value) / noise
    return observations.groupBy(key).agg(((prior / variance + F.sum(value) / noise) / precision).alias("estimate"), (1.0 / precision).alias("variance"), F.count(value).alias("n"))


def reliability(outcomes: DataFrame, key: str, order: list[str], good: Column, alpha: float = 0.1, start: float = 0.5) -> DataFrame:
    """(key, reliability): the exponential mean of outcomes in order, as weights by how many came later."""
    later = F.row_number().over(Window.partitionBy(key).orderBy(*[F.col(c).desc() for c in order])) - 1
    rows = outcomes.withColumn("w", alpha * F.pow(F.lit(1.0 - alpha), later)).withColumn("good", good.cast("double"))
    return rows.groupBy(key).agg((F.sum(F.col("w") * F.col("good")) + start * F.pow(F.lit(1.0 - alpha), F.count("*"))).alias("reliability"))


def eviction(rows: DataFrame, policies: list[tuple[str, Column]]) -> DataFrame:
    """rows that some policy evicts, with the first one that does."""
    out = F.when(F.lit(False), F.lit(""))
    for name, condition in policies:
        out = out.when(condition, F.lit(name))
    return rows.withColumn("policy", out).where("policy is not null")


def packed(rows: DataFrame, by: str, order: Column, cost: Column, budget: int) -> DataFrame:
    """(by, used, taken): a budget filled in order; what no longer fits is skipped, later rows may still fit.

    A fold over the rows of one request, which are few.
    """
    costs = F.transform(F.array_sort(F.collect_list(F.struct(order.alias("o"), cost.cast("long").alias("c")))), lambda s: s["c"])
    start = F.struct(F.lit(0).cast("long").alias("used"), F.lit(0).cast("long").alias("taken"))

    def step(s, c):
        fits = s["used"] + c <= budget
        return F.struct(F.when(fits, s["used"] + c).otherwise(s["used"]).alias("used"), F.when(fits, s["taken"] + 1).otherwise(s["taken"]).alias("taken"))

    return rows.groupBy(by).agg(F.aggregate(costs, start, step).alias("s")).select(by, "s.used", "s.taken")


def interleaved(rows: DataFrame, by: str, speaker: str, order: list[str]) -> DataFrame:
    """rows with their place when a group's speakers take turns, each in order."""
    turn = F.row_number().over(Window.partitionBy(by, speaker).orderBy(*order))
    return rows.withColumn("turn_no", turn).withColumn("place", F.row_number().over(Window.partitionBy(by).orderBy("turn_no", speaker, *order))).drop("turn_no")


def write_conflicts(writes: DataFrame, record: str, agent: str) -> DataFrame:
    """(record, leader, ahead, agents): records that two or more agents wrote, not equally often."""
    versions = writes.groupBy(record, agent).agg(F.count("*").alias("v"))
    lead = versions.groupBy(record).agg(F.max(F.struct("v", agent)).alias("top"), F.min("v").alias("least"), F.count("*").alias("agents"))
    return lead.where((F.col("agents") >= 2) & (F.col("top.v") > F.col("least"))).select(record, F.col(f"top.{agent}").alias("leader"), (F.col("top.v") - F.col("least")).alias("ahead"), "agents")


def composite_score(rows: DataFrame, by: str, indicators: list[tuple[Column, float | None, float]]) -> DataFrame:
    """(by, score): 0-100 over indicators (value, threshold or None, weight); beyond a threshold a weight fades to 0 at twice it."""
    total = sum(weight for *_, weight in indicators)
    kept = F.lit(0.0)
    for value, threshold, weight in indicators:
        penalty = F.lit(0.0) if threshold is None else F.least(F.lit(1.0), F.greatest(F.lit(0.0), (value - threshold) / threshold))
        kept = kept + weight * (1.0 - penalty)
    return rows.select(by, (100.0 * kept / total).alias("score"))
