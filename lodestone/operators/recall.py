"""Recall beyond the first ranking: mixed queries from feedback, rescoring, scores handed on over weighted edges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import stored


def _rarity(n: Column, df: Column) -> Column:
    return F.log((n - df + 0.5) / (df + 0.5) + 1)


def feedback_model(posts: DataFrame, best: DataFrame, n: Column, id_col: str, mu: float = 2000.0, least: float = 1.0, k: int = 10) -> DataFrame:
    """(qid, term, p): the k terms that the best records speak for on average, smoothed, among those rare enough."""
    whole = posts.agg(F.sum("tf")).scalar()
    own = stored(posts.join(best.select(id_col).distinct(), id_col, "left_semi"), "held")
    size = own.groupBy(id_col).agg(F.sum("tf").alias("length"))
    held = best.select("qid", id_col).join(own, id_col).join(size, id_col)
    wanted = posts.join(own.select("term").distinct(), "term", "left_semi").groupBy("term").agg((F.sum("tf") / whole).alias("p_term"), F.count("*").alias("df"))
    rare = wanted.where(_rarity(n, F.col("df")) >= least)
    model = held.join(rare, "term").groupBy("qid", "term").agg(F.avg((F.col("tf") + mu * F.col("p_term")) / (F.col("length") + mu)).alias("p"))
    order = Window.partitionBy("qid").orderBy(F.round("p", 12).desc(), "term")
    return model.withColumn("r", F.row_number().over(order)).where(F.col("r") <= k).drop("r")


def mixed_query(asked: DataFrame, more: DataFrame, alpha: float) -> DataFrame:
    """(qid, term, weight): the asked terms and the model's, each normalised, at alpha to the rest."""
    all_ = Window.partitionBy("qid")
    own = asked.groupBy("qid", "term").agg(F.count("*").alias("times")).select("qid", "term", (alpha * F.col("times") / F.sum("times").over(all_)).alias("w"))
    new = more.select("qid", "term", ((1 - alpha) * F.col("p") / F.sum("p").over(all_)).alias("w"))
    return own.union(new).groupBy("qid", "term").agg(F.sum("w").alias("weight"))


def rescored(ranked: DataFrame, posts: DataFrame, query: DataFrame, n: Column, id_col: str, share: float) -> DataFrame:
    """ranked with share of what a weighted query's terms add to each score."""
    held = posts.join(ranked.select(id_col).distinct(), id_col, "left_semi")
    df = posts.join(query.select("term").distinct(), "term", "left_semi").groupBy("term").agg(F.count("*").alias("df"))
    hits = ranked.select("qid", id_col).join(held, id_col).join(query, ["qid", "term"]).join(df, "term")
    more = hits.groupBy("qid", id_col).agg(F.sum(F.col("weight") * _rarity(n, F.col("df")) * F.col("tf") / (F.col("tf") + 1.2)).alias("more"))
    return ranked.join(more, ["qid", id_col], "left").withColumn("score", F.col("score") + share * F.coalesce("more", F.lit(0.0)))


def handed_on(seeds: DataFrame, edges: DataFrame, damping: list[float]) -> DataFrame:
    """(node, score): scores handed on once for each damping over edges (node, near, w), times min(w, 1); the best one counts."""
    scores = seeds
    for factor in damping:
        step = scores.join(edges, "node").select(F.col("near").alias("node"), (F.col("score") * factor * F.least("w", F.lit(1.0))).alias("score"))
        scores = stored(scores.union(step).groupBy("node").agg(F.max("score").alias("score")), "handed-on")
    return scores


def hops(seeds: DataFrame, edges: DataFrame, most: int) -> DataFrame:
    """(node, hop): the fewest edges from any seed, most at most."""
    found = seeds.select("node", F.lit(0).alias("hop"))
    front = found
    for hop in range(1, most + 1):
        step = front.join(edges, "node").select(F.col("near").alias("node")).distinct().join(found, "node", "left_anti")
        front = stored(step.withColumn("hop", F.lit(hop)), "hops")
        found = found.union(front)
    return found
