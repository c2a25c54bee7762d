"""Retrieval in several hops: bridge terms that first hits speak of, a second pass with them, and rounds that ask on.

All queries go through a round together. What a round needs of the ones before is held as tables: the pool of what was
found, and the terms that were asked; each round is written, so that the plan of the next one starts there.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text
from ..sources.scratch import stored
from . import lexical

#: A bridge term must weigh so much among the first hits, so many are kept, and hits that they lead to count so much.
BRIDGE_LEAST, BRIDGE_TERMS, BRIDGE_SHARE = 2.0, 12, 0.3


def bridge_terms(hits: DataFrame, records: DataFrame, posts: DataFrame, asked: DataFrame, said: DataFrame, id_col: str, k: int = BRIDGE_TERMS) -> DataFrame:
    """(qid, term, weight, rank): what the hits (qid, id) of a query speak of and the query does not.

    records has (id, text) and posts their stemmed terms; asked and said have the terms (qid, term) and plain words (qid, word)
    of the queries. A capitalised word counts 1 for each place, a term of more than three characters a half. Only terms of a
    weight of BRIDGE_LEAST are kept, k at most, equal ones in their order.
    """
    texts = hits.select("qid", id_col).join(records.select(id_col, "text"), id_col)
    names = texts.select("qid", F.explode(F.regexp_extract_all("text", F.lit(r"(?<![\p{L}\p{N}_])([A-Z][a-z]{2,})(?![\p{L}\p{N}_])"), F.lit(1))).alias("name"))
    names = names.select("qid", F.lower("name").alias("term")).where(text.is_term(F.col("term")))
    names = names.join(said.select("qid", F.col("word").alias("term")).distinct(), ["qid", "term"], "left_anti").select("qid", "term", F.lit(1.0).alias("w"))
    terms = hits.select("qid", id_col).join(posts, id_col).where(F.length("term") > 3).join(asked.select("qid", "term").distinct(), ["qid", "term"], "left_anti")
    every = names.union(terms.select("qid", "term", (0.5 * F.col("tf")).alias("w")))
    weighed = every.groupBy("qid", "term").agg(F.round(F.sum("w"), 6).alias("weight"))
    return lexical.top_k(weighed, "qid", "term", k, "weight").where(F.col("weight") >= BRIDGE_LEAST)


def bridged(hits: DataFrame, bridges: DataFrame, posts: DataFrame, n_records: DataFrame, asked: DataFrame, id_col: str, k: int) -> DataFrame:
    """(qid, id, score, rank): records not among the hits that the bridge terms find, and that share a term with the query.

    Bridge terms and asked ones multiply the shares together, where their records are: a pair has both or goes.
    """
    known = asked.select("qid", "term", F.lit(0).alias("times"), F.lit(True).alias("asked")).distinct()
    both = bridges.select("qid", "term", F.lit(1).alias("times"), F.lit(False).alias("asked")).union(known)
    both = stored(both.groupBy("qid", "term").agg(F.sum("times").alias("times"), F.max("asked").alias("asked")), "bridged")
    pairs = lexical.shares(posts, n_records, both, id_col).join(both, "term").groupBy("qid", id_col)
    scores = pairs.agg(F.sum(F.when(F.col("times") > 0, F.col("share") * F.col("times"))).alias("score"), F.max("asked").alias("asked"))
    fresh = scores.where("asked AND score IS NOT NULL").join(hits.select("qid", id_col), ["qid", id_col], "left_anti")
    return lexical.top_k(fresh.select("qid", id_col, F.round(BRIDGE_SHARE * F.col("score"), 4).alias("score")), "qid", id_col, k)


class Rounds:
    """Rounds of retrieval for many queries at once.

    pool: (qid, id, round, score), each record of a query in the round that found it first. asked_on: (qid, term, round), what was
    asked on. Queries leave when their last round found nothing new, or speaks of nothing that was not asked.
    """

    def __init__(self, records: DataFrame, posts: DataFrame, n_records: DataFrame, asked: DataFrame, said: DataFrame, id_col: str, k: int, followups: int):
        self.records, self.posts, self.n, self.said, self.id, self.k, self.followups = records, posts, n_records, said, id_col, k, followups
        self.known = asked.select("qid", "term").distinct()
        first = lexical.top_k(lexical.bm25_scores(posts, n_records, asked, id_col).withColumn("score", F.round("score", 6)), "qid", id_col, k)
        self.pool = stored(first.select("qid", id_col, F.lit(0).alias("round"), "score"), "round0")
        self.asked_on = None
        self.done = 0

    def again(self) -> bool:
        """One more round; False if no query had anything to ask or to find."""
        self.done += 1
        last = self.pool.where(F.col("round") == self.done - 1)
        found = bridge_terms(last, self.records, self.posts, self.known, self.said, self.id, self.followups)
        follow = stored(found.select("qid", "term", F.lit(self.done).alias("round")), "followups")
        # each followup is a query of its own, known by its number and term
        own = follow.select(F.struct("qid", "term").alias("qid"), "term")
        scores = lexical.bm25_scores(self.posts, self.n, own, self.id).withColumn("score", F.round("score", 6))
        hits = lexical.top_k(scores, "qid", self.id, self.k).select(F.col("qid.qid").alias("qid"), self.id, "score")
        best = hits.groupBy("qid", self.id).agg(F.max("score").alias("score"))
        fresh = stored(best.join(self.pool, ["qid", self.id], "left_anti").select("qid", self.id, F.lit(self.done).alias("round"), "score"), f"round{self.done}")
        self.known = self.known.union(follow.select("qid", "term"))
        self.asked_on = follow if self.asked_on is None else self.asked_on.union(follow)
        self.pool = self.pool.union(fresh)
        return not fresh.isEmpty()


def iterated(records: DataFrame, posts: DataFrame, n_records: DataFrame, asked: DataFrame, said: DataFrame, id_col: str, rounds: int = 2, k: int = 18, followups: int = 2, most: int = 60) -> DataFrame:
    """(qid, id, round, score, rank): what rounds of retrieval find, the earlier round first; at most `most` records a query."""
    state = Rounds(records, posts, n_records, asked, said, id_col, k, followups)
    for _ in range(rounds - 1):
        if not state.again():
            break
    order = Window.partitionBy("qid").orderBy("round", F.col("score").desc(), id_col)
    return state.pool.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most)
