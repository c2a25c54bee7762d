"""Typed edges (src, predicate, dst, confidence) between records: walks, paths, orders, cycles.

Walks go one hop a round, each round a join on the frontier's node; what a walk has reached is kept at its best only,
so a hub costs each seed one row. Hops, and where given the records a seed may reach, are bounded by parameters.
"""

from __future__ import annotations

from itertools import count

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import stored

WIDE = 1 << 20  # nodes of a round beyond which they are not broadcast, however small they are on disk


def both_ways(edges: DataFrame) -> DataFrame:
    """(node, near): every edge seen from both ends, each once."""
    return edges.select(F.col("src").alias("node"), F.col("dst").alias("near")).union(edges.select("dst", "src")).distinct()


def expanded(edges: DataFrame, seeds: DataFrame, hops: int = 2, decay: float = 0.5, most: int = 50) -> DataFrame:
    """(seed, node, hop, score): what each seed reaches within hops, the nearest most of it; score is decay to the hop.

    edges are (node, near); seeds are (seed), nodes themselves. Equal scores are ranked by node.
    """
    reached = seeds.select("seed", F.col("seed").alias("node"), F.lit(0).alias("hop"))
    frontier = reached
    for hop in range(1, hops + 1):
        step = frontier.join(edges, "node").select("seed", F.col("near").alias("node")).distinct()
        frontier = stored(step.join(reached.select("seed", "node"), ["seed", "node"], "left_anti").select("seed", "node", F.lit(hop).alias("hop")), f"hop{hop}")
        reached = reached.union(frontier)
    order = Window.partitionBy("seed").orderBy("hop", "node")
    ranked = reached.where("hop > 0").withColumn("r", F.row_number().over(order)).where(F.col("r") <= most)
    return ranked.select("seed", "node", F.col("hop").cast("long").alias("hop"), F.pow(F.lit(decay), F.col("hop")).alias("score"))


def paths_to_roots(edges: DataFrame, starts: DataFrame, depth: int = 10) -> DataFrame:
    """(start, path, cut): all simple paths from each start to a node without outgoing edges, or of depth edges.

    cut tells that a path had depth edges and may lead on.
    """
    out = stored(edges.select(F.col("src").alias("end"), F.col("dst").alias("next")).distinct(), "out")
    open_ = starts.select("start", F.array("start").alias("path"), F.col("start").alias("end"))
    done = []
    for _ in range(depth):
        grown = open_.join(out, "end", "left").where(F.col("next").isNull() | ~F.array_contains("path", F.col("next")))
        grown = stored(grown, "paths")
        done.append(grown.where("next IS NULL").select("start", "path", F.lit(False).alias("cut")))
        open_ = grown.where("next IS NOT NULL").select("start", F.array_append("path", F.col("next")).alias("path"), F.col("next").alias("end"))
        if open_.isEmpty():
            break
    else:
        done.append(open_.select("start", "path", F.lit(True).alias("cut")))
    paths = done[0]
    for more in done[1:]:
        paths = paths.union(more)
    return paths


def levels(edges: DataFrame) -> DataFrame:
    """(node, level): a node's level is one above the highest level of what points to it; nothing points to level 0.

    A node in a cycle, or behind one, has no level: rounds go on, one for each level, until no node is placed.
    """
    edges = stored(edges.select("src", "dst").distinct(), "edges")
    into = edges.select(F.col("dst").alias("node"))
    fresh = stored(edges.select(F.col("src").alias("node")).distinct().join(into, "node", "left_anti"), "level0")
    wanted = stored(into.groupBy("node").agg(F.count("*").alias("n")), "wanted")
    placed = fresh.withColumn("level", F.lit(0))
    for level in count(1):
        # an edge is used up in the round after its source was placed, and is not looked at again
        met = stored(edges.join(fresh.select(F.col("node").alias("src"), F.lit(True).alias("used")), "src", "left"), "met")
        edges = met.where("used IS NULL").select("src", "dst")
        gone = met.where("used").groupBy(F.col("dst").alias("node")).agg(F.count("*").alias("gone"))
        open_ = stored(wanted.join(gone, "node", "left").select("node", (F.col("n") - F.coalesce("gone", F.lit(0))).alias("n")), "wanted")
        fresh, wanted = open_.where("n = 0").select("node"), open_.where("n > 0")
        if fresh.isEmpty():
            break
        placed = placed.union(fresh.withColumn("level", F.lit(level)))
    return placed.select("node", F.col("level").cast("long").alias("level"))


def reached_from(edges: DataFrame, starts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((start, word, mask), (node, word, mask)): a bit for each start, and the bits of those that a node can be reached from.

    edges are (node, near), repeated ones do no harm; starts are (start) and reach themselves. Rounds go on until no node gets a
    new bit, so as many as the longest of the shortest ways has edges. A round takes the nodes with new bits, and the edges
    between the least and the greatest of them: what moves is a word for each edge and 64 starts, however many ways there are.
    """
    numbered = starts.select("start").distinct().withColumn("id", F.monotonically_increasing_id())
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), (F.col("id") % 64).cast("int"))
    bits = stored(numbered.select("start", F.shiftright("id", 6).alias("word"), bit.alias("mask")), "bits")
    at = bits.withColumnRenamed("start", "node")
    seen = at
    while True:
        ends = at.agg(F.min("node").alias("low"), F.max("node").alias("high"), F.count("*").alias("n")).first()
        if not ends["n"]:
            break
        near = edges.where(F.col("node").between(ends["low"], ends["high"]))
        met = near.join(at if ends["n"] <= WIDE else at.hint("merge"), "node")
        step = met.groupBy(F.col("near").alias("node"), "word").agg(F.bit_or("mask").alias("mask"))
        before = seen.groupBy("node", "word").agg(F.bit_or("mask").alias("had"))
        new = F.col("mask").bitwiseAND(F.bitwise_not(F.coalesce("had", F.lit(0).cast("long"))))
        at = stored(step.join(before, ["node", "word"], "left").select("node", "word", new.alias("mask")).where("mask <> 0"), "reach")
        seen = seen.union(at)
    return bits, seen.groupBy("node", "word").agg(F.bit_or("mask").alias("mask"))


def closes_cycle(edges: DataFrame, candidates: DataFrame) -> DataFrame:
    """(src, dst, cyclic) for each candidate edge: whether its end leads back to its start, however long the way is.

    What reaches the starts is found against the edges, or, where there are fewer ends, what the ends reach along them.
    """
    asked = stored(candidates.select("src", "dst").distinct(), "candidates")
    many = asked.agg(F.countDistinct("src").alias("src"), F.countDistinct("dst").alias("dst")).first()
    start, end = ("src", "dst") if many["src"] <= many["dst"] else ("dst", "src")
    steps = edges.select(F.col("dst" if start == "src" else "src").alias("node"), F.col(start).alias("near"))
    bits, reached = reached_from(steps, asked.select(F.col(start).alias("start")))
    both = asked.join(bits.select(F.col("start").alias(start), "word", F.col("mask").alias("bit")), start)
    both = both.join(reached.withColumnRenamed("node", end), [end, "word"])
    back = both.where(F.col("mask").bitwiseAND(F.col("bit")) != 0).select("src", "dst", F.lit(True).alias("cyclic"))
    return asked.join(back, ["src", "dst"], "left").select("src", "dst", F.coalesce("cyclic", F.lit(False)).alias("cyclic"))
