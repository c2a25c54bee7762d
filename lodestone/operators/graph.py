"""Graph operators over edge lists: every hop is a join, and a node keeps its best score only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import stored


BLOCK = 256  # items of a list that one task pairs with as many others


def co_occurrence(rows: DataFrame, group: str, item: str, block: int = BLOCK) -> DataFrame:
    """(a, b, weight), a < b: items of one list; a list of n distinct items adds 1 / n to each of its pairs.

    Every pair of a list is an edge, so its rows grow with the square of a list's length. A list of any length is paired
    whole: its items are dealt by hash to blocks, and each two of its blocks meet in a group of their own.
    """
    once = rows.select(group, item).distinct()
    size = once.groupBy(group).agg(F.count("*").alias("n"))
    sized = once.join(size, group).withColumn("blocks", F.ceil(F.col("n") / block).cast("int"))
    sized = sized.withColumn("own", F.pmod(F.xxhash64(item), "blocks").cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    left = sized.select(group, "n", F.col("own").alias("i"), F.col("other").alias("j"), F.col(item).alias("a"))
    right = sized.select(group, F.col("other").alias("i"), F.col("own").alias("j"), F.col(item).alias("b"))
    return left.join(right, [group, "i", "j"]).where("a < b").groupBy("a", "b").agg(F.sum(1.0 / F.col("n")).alias("weight"))


def both_ways(edges: DataFrame) -> DataFrame:
    return edges.select("a", "b", "weight").union(edges.select(F.col("b"), F.col("a"), "weight"))


def propagate(seeds: DataFrame, edges: DataFrame, factors: list[float]) -> DataFrame:
    """(node, score, hop): the best score that reaches each node, times each hop's factor and the edge's weight.

    Only nodes whose score a hop improved go on to the next, so the frontier is never more than the nodes.
    """
    best = seeds.select("node", F.col("score").cast("double").alias("score"), F.lit(0).alias("hop"))
    frontier = best
    for hop, factor in enumerate(factors, 1):
        reached = frontier.join(edges, F.col("node") == F.col("a")).groupBy("b").agg(F.max(F.col("score") * factor * F.col("weight")).alias("got"))
        both = best.join(reached, F.col("node") == F.col("b"), "full_outer")
        better = F.col("got") > F.coalesce("score", F.lit(-1.0))
        merged = both.select(F.coalesce("node", "b").alias("node"), F.when(better, F.col("got")).otherwise(F.col("score")).alias("score"), F.when(better, hop).otherwise(F.col("hop")).alias("hop"))
        best = stored(merged, "propagated")
        frontier = best.where(F.col("hop") == hop)
    return best


def reach(edges: DataFrame, seeds: DataFrame, most_hops: int) -> DataFrame:
    """(node, hop): the nodes that directed edges (a, b) lead to from the seeds, and after how many hops at least."""
    seen = seeds.select("node", F.lit(0).alias("hop"))
    frontier = seen
    for hop in range(1, most_hops + 1):
        found = frontier.join(edges, F.col("node") == F.col("a")).select(F.col("b").alias("node")).distinct()
        frontier = stored(found.join(seen.select("node"), "node", "left_anti").select("node", F.lit(hop).alias("hop")), "frontier")
        if frontier.isEmpty():
            break
        seen = seen.union(frontier)
    return seen
