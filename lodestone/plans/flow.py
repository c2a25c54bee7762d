"""Queries over queues, switches, merges and detection."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import flow, graph, lexical
from ..operators.nearest import rivals
from ..sources.tables import table
from .lexical import _BM25, _asked, _posts
from .ranking import _NEAR, QUERY_EACH, _units
from .registering import Plans

plans = Plans()


@plans.query("SELECT event_id FROM (SELECT event_id, row_number() OVER (PARTITION BY user_id, CAST(ts AS DATE) ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r <= 2")
def drop_oldest_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each user's queue of two still holds at the end of each day."""
    rows = table(spark, sf_dir, "events").withColumn("day", F.to_date("ts"))
    return flow.bounded_queue(rows, ["user_id", "day"], ["ts", "event_id"], 2).select("event_id")


@plans.query("SELECT event_id FROM (SELECT event_id, row_number() OVER (PARTITION BY user_id, CAST(ts AS DATE) ORDER BY ts, event_id) AS r FROM events) WHERE r <= 2")
def reject_newest_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each user's queue of two takes on each day before it refuses."""
    rows = table(spark, sf_dir, "events").withColumn("day", F.to_date("ts"))
    return flow.bounded_queue(rows, ["user_id", "day"], ["ts", "event_id"], 2, keep="oldest").select("event_id")


@plans.query("""
SELECT event_id, coalesce(last_value(s IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), false) AS paused FROM (SELECT *, CASE WHEN value >= 80 THEN true WHEN value <= 20 THEN false END AS s FROM events)
""")
def backpressure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether each user is held back: from a value of 80 until one of 20."""
    return flow.hysteresis(table(spark, sf_dir, "events"), "user_id", ["ts", "event_id"], F.col("value"), 80, 20).select("event_id", "paused")


@plans.query("""
WITH g AS (SELECT *, sum(CASE WHEN event_type = 'error' THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS g FROM events)
SELECT event_id, CAST(sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id, g ORDER BY ts, event_id) AS BIGINT) AS failures FROM g
""")
def failure_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many errors in a row each user has had: what a breaker counts."""
    return flow.failure_runs(table(spark, sf_dir, "events"), "user_id", ["ts", "event_id"], F.col("event_type") == "error").select("event_id", "failures")


@plans.query("""
SELECT o_orderkey, round(greatest(o_totalprice, coalesce(CAST(0.8 AS DOUBLE) * c + CAST(0.2 AS DOUBLE) * o_totalprice, o_totalprice)), 4) AS score FROM orders LEFT JOIN (SELECT l_orderkey, max(l_extendedprice) AS c FROM lineitem GROUP BY l_orderkey) ON l_orderkey = o_orderkey
""")
def facts_to_parents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders by price, raised by their best line."""
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_extendedprice")
    return flow.folded_into_parents(table(spark, sf_dir, "orders"), lines, "o_orderkey", "o_totalprice", "l_extendedprice").withColumn("score", F.round("score", 4))


@plans.query("""
SELECT event_type, round(CASE WHEN tp + fp > 0 THEN tp / CAST(tp + fp AS DOUBLE) ELSE 0 END, 6) AS precision, round(CASE WHEN tp + fn > 0 THEN tp / CAST(tp + fn AS DOUBLE) ELSE 0 END, 6) AS recall, round(CASE WHEN 2 * tp + fp + fn > 0 THEN 2 * tp / CAST(2 * tp + fp + fn AS DOUBLE) ELSE 0 END, 6) AS f1
FROM (SELECT event_type, sum(CASE WHEN value > 50 AND user_id % 2 = 0 THEN 1 ELSE 0 END) AS tp, sum(CASE WHEN value > 50 AND user_id % 2 = 1 THEN 1 ELSE 0 END) AS fp, sum(CASE WHEN value <= 50 AND user_id % 2 = 0 THEN 1 ELSE 0 END) AS fn FROM events GROUP BY event_type)
""")
def detection_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Precision, recall and F1 of taking high values for even users, by kind of event."""
    out = flow.detection_quality(table(spark, sf_dir, "events"), "event_type", F.col("value") > 50, F.col("user_id") % 2 == 0)
    return out.select("event_type", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")])


@plans.query("SELECT l_orderkey, round(exp(sum(ln(1 / (1 + l_discount)))), 6) AS confidence FROM lineitem GROUP BY l_orderkey")
def chain_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The confidence of each order as a chain of its lines, each the less certain the larger its discount."""
    out = flow.chain_confidence(table(spark, sf_dir, "lineitem"), "l_orderkey", 1 / (1 + F.col("l_discount")))
    return out.select("l_orderkey", F.round("confidence", 6).alias("confidence"))


@plans.query("""
SELECT o_custkey, l_partkey, n, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY n DESC, l_partkey) AS rank FROM (SELECT o_custkey, l_partkey, CAST(count(*) AS BIGINT) AS n FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY ALL)) WHERE rank <= 8
""")
def prefetch_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The eight parts that each customer is most likely to ask for next."""
    both = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    counts = both.groupBy("o_custkey", "l_partkey").agg(F.count("*").alias("n"))
    return lexical.top_k(counts, "o_custkey", "l_partkey", 8, "n")


@plans.query("""
WITH i AS (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem), n AS (SELECT l_orderkey, count(*) AS n FROM i GROUP BY l_orderkey),
e AS (SELECT a.l_partkey AS a, b.l_partkey AS b, round(sum(CAST(1 AS DOUBLE) / n), 6) AS weight FROM i a JOIN i b ON a.l_orderkey = b.l_orderkey AND a.l_partkey <> b.l_partkey JOIN n ON n.l_orderkey = a.l_orderkey GROUP BY ALL)
SELECT a, b, weight, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY weight DESC, b) AS rank FROM e) WHERE rank <= 5
""")
def co_occurring_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five parts most often ordered with each part."""
    edges = graph.both_ways(graph.co_occurrence(table(spark, sf_dir, "lineitem"), "l_orderkey", "l_partkey")).withColumn("weight", F.round("weight", 6))
    return lexical.top_k(edges, "a", "b", 5, "weight")


@plans.query(f"WITH {_BM25} SELECT doc_id, max(score) AS score, CAST(count(*) AS BIGINT) AS queries FROM s GROUP BY doc_id")
def merged_retrieval(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document that some item finds: its best score and how many items found it."""
    n = table(spark, sf_dir, "documents").agg(F.count("*").cast("double").alias("n"))
    scores = lexical.bm25_scores(_posts(spark, sf_dir), n, _asked(spark, sf_dir), "doc_id").withColumn("score", F.round("score", 6))
    return scores.groupBy("doc_id").agg(F.max("score").alias("score"), F.count("*").alias("queries"))


@plans.query(f"""
WITH {_BM25}, k AS (SELECT * FROM (SELECT qid, doc_id, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id) AS rank FROM s) WHERE rank <= 5),
c AS (SELECT qid, t.term, count(*) AS docs FROM k JOIN t USING (doc_id) GROUP BY qid, t.term),
d AS (SELECT term, count(*) AS df FROM t GROUP BY term)
SELECT qid, term, CAST(docs AS BIGINT) AS docs, CAST(rank AS INTEGER) AS rank FROM (
  SELECT qid, term, docs, row_number() OVER (PARTITION BY qid ORDER BY docs DESC, term) AS rank FROM c JOIN d USING (term) WHERE docs >= 2 AND df < CAST(0.3 AS DOUBLE) * (SELECT n FROM n) AND NOT EXISTS (SELECT 1 FROM q WHERE q.qid = c.qid AND q.term = c.term)) WHERE rank <= 8
""")
def expansion_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Terms that two or more of an item's five best documents share, that are not common and not in the item itself."""
    from ..sources.scratch import stored

    posts, asked = _posts(spark, sf_dir), _asked(spark, sf_dir)
    n = table(spark, sf_dir, "documents").agg(F.count("*").cast("double").alias("n"))
    scores = lexical.bm25_scores(posts, n, asked, "doc_id").withColumn("score", F.round("score", 6))
    top = stored(lexical.top_k(scores, "qid", "doc_id", 5), "top")
    shared = top.select("qid", "doc_id").join(posts.select("doc_id", "term"), "doc_id").groupBy("qid", "term").agg(F.count("*").alias("docs")).where("docs >= 2")
    total = n.select("n").scalar()
    rare = lexical.document_frequency(posts).where(F.col("df") < 0.3 * total).select("term")
    found = shared.join(rare, "term").join(asked.distinct(), ["qid", "term"], "left_anti")
    return lexical.top_k(found, "qid", "term", 8, "docs")


@plans.query(f"WITH {_NEAR} SELECT qid, CAST(count(*) AS BIGINT) AS negatives, round(max(score), 6) AS hardest FROM near WHERE label <> q_label AND score > CAST(0.1 AS DOUBLE) GROUP BY qid")
def hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many vectors of other labels each query vector is near to, and the nearest."""
    found = rivals(_units(spark, sf_dir), "vec_id", "v", F.col("vec_id") % QUERY_EACH == 0, "label", 0.1)
    return found.select("qid", F.col("n").alias("negatives"), F.round("most", 6).alias("hardest"))


@plans.query("""
WITH r AS (SELECT o_custkey, o_orderstatus = 'P' AS good, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS a, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey) AS b FROM orders)
SELECT o_custkey, round(coalesce(1 / CAST(min(CASE WHEN good THEN a END) AS DOUBLE), 0), 6) AS baseline, round(coalesce(1 / CAST(min(CASE WHEN good THEN b END) AS DOUBLE), 0), 6) AS candidate FROM r GROUP BY o_custkey
""")
def replayed_rankings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The reciprocal rank of each customer's first draft order, by price and by recency."""
    place = lambda c: F.row_number().over(Window.partitionBy("o_custkey").orderBy(F.col(c).desc(), F.col("o_orderkey").asc()))
    rows = table(spark, sf_dir, "orders").select("o_custkey", (F.col("o_orderstatus") == "P").alias("good"), place("o_totalprice").alias("a"), place("o_orderdate").alias("b"))
    first = lambda c, name: F.round(F.coalesce(1.0 / F.min(F.when(F.col("good"), F.col(c))), F.lit(0.0)), 6).alias(name)
    return rows.groupBy("o_custkey").agg(first("a", "baseline"), first("b", "candidate"))


QUERIES, SQL = plans.queries, plans.sql
