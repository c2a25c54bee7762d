"""Queries over fusion, blending, thinning and vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import vectors
from ..operators import lexical, ranking
from ..operators.nearest import nearest, places
from ..sources.scratch import stored
from ..sources.tables import table
from .registering import Plans

plans = Plans()
#: Of the searches, every vector whose id is divisible by so many is a query, against all vectors.
QUERY_EACH = 20

_NEAR = f"""
near AS (SELECT q.vec_id AS qid, v.vec_id AS vec_id, q.label AS q_label, v.label AS label, round(list_cosine_similarity(CAST(q.embedding AS DOUBLE[]), CAST(v.embedding AS DOUBLE[])), 6) AS score
         FROM embeddings q JOIN embeddings v ON q.vec_id % {QUERY_EACH} = 0 AND q.vec_id <> v.vec_id)
"""


def _units(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select("vec_id", "label", vectors.unit(F.col("embedding")).alias("v"))


@plans.query(f"WITH {_NEAR} SELECT qid, vec_id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, vec_id) AS rank FROM near) WHERE rank <= 10")
def knn_cosine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten nearest vectors of each query vector."""
    return nearest(_units(spark, sf_dir), "vec_id", "v", F.col("vec_id") % QUERY_EACH == 0, 10).select("qid", "vec_id", "score", "rank")


@plans.query(f"WITH {_NEAR} SELECT qid, vec_id, label, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, vec_id) AS rank FROM near WHERE label = q_label) WHERE rank <= 5")
def knn_by_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five nearest vectors of each query vector's own label."""
    rows = _units(spark, sf_dir)
    found = nearest(rows, "vec_id", "v", F.col("vec_id") % QUERY_EACH == 0, 5, label="label")
    return found.join(rows.select("vec_id", "label"), "vec_id").select("qid", "vec_id", "label", "score", "rank")


@plans.query("""
SELECT label, CAST(dim AS BIGINT) AS dim, round(avg(x), 6) AS mean, CAST(count(*) AS BIGINT) AS n
FROM (SELECT label, unnest(CAST(embedding AS DOUBLE[])) AS x, unnest(range(len(embedding))) AS dim FROM embeddings) GROUP BY label, dim
""")
def centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mean vector of each label, a row for each component."""
    rows = table(spark, sf_dir, "embeddings").select("label", F.posexplode("embedding").alias("dim", "x"))
    return rows.groupBy("label", F.col("dim").cast("long").alias("dim")).agg(F.round(F.avg(F.col("x").cast("double")), 6).alias("mean"), F.count("*").alias("n"))


@plans.query("""
WITH c AS (SELECT label, list(m ORDER BY dim) AS c FROM (SELECT label, dim, avg(x) AS m FROM (SELECT label, unnest(CAST(embedding AS DOUBLE[])) AS x, unnest(range(len(embedding))) AS dim FROM embeddings) GROUP BY label, dim) GROUP BY label)
SELECT vec_id, e.label, round((1 - list_cosine_similarity(CAST(embedding AS DOUBLE[]), c)) / 2, 6) AS surprise FROM embeddings e JOIN c ON e.label = c.label
""")
def surprise_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far each vector lies from the centroid of its label, from 0 to 1."""
    rows = table(spark, sf_dir, "embeddings")
    parts = rows.select("label", F.posexplode("embedding").alias("dim", "x")).groupBy("label", "dim").agg(F.avg(F.col("x").cast("double")).alias("m"))
    centre = parts.groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("dim", "m"))), lambda s: s["m"]).alias("c"))
    both = rows.join(centre, "label")
    return both.select("vec_id", "label", F.round(vectors.surprise(vectors.cosine(F.col("embedding"), F.col("c"))), 6).alias("surprise"))


@plans.query("""
SELECT vec_id, list_aggregate(list_transform(e, lambda x: CAST(CASE WHEN hi > lo THEN floor((x - lo) / (hi - lo) * CAST(7 AS DOUBLE) + CAST(0.5 AS DOUBLE)) ELSE 0 END AS INTEGER)), 'string_agg', '') AS codes
FROM (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e, CAST(list_min(embedding) AS DOUBLE) AS lo, CAST(list_max(embedding) AS DOUBLE) AS hi FROM embeddings)
""")
def quantized_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector in three bits a component."""
    wide = F.transform("embedding", lambda x: x.cast("double"))
    return table(spark, sf_dir, "embeddings").select("vec_id", F.array_join(vectors.quantized(wide), "").alias("codes"))


@plans.query("""
WITH a AS (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS r1, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey) AS r2 FROM orders)
SELECT o_custkey, o_orderkey, round(CAST(1 AS DOUBLE) / (60 + r1) + CAST(0.5 AS DOUBLE) / (60 + r2), 9) AS score, 'price,recency' AS arms FROM a
""")
def rank_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each customer's orders by price and, at half the weight, by recency, fused by reciprocal ranks."""
    orders = table(spark, sf_dir, "orders")

    def arm(name: str, column: str, weight: float) -> DataFrame:
        order = Window.partitionBy("o_custkey").orderBy(F.col(column).desc(), F.col("o_orderkey").asc())
        return orders.select("o_custkey", "o_orderkey", F.lit(name).alias("arm"), F.row_number().over(order).alias("rank"), F.lit(weight).alias("weight"))

    fused = ranking.reciprocal_ranks(arm("price", "o_totalprice", 1.0).unionByName(arm("recency", "o_orderdate", 0.5)), ["o_custkey"], "o_orderkey")
    return fused.withColumn("score", F.round("score", 9))


@plans.query("""
SELECT o_custkey, o_orderkey, CAST(2 * count(*) OVER (PARTITION BY o_custkey) - row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) - row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey) AS BIGINT) AS points FROM orders
""")
def borda_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each customer's orders by price and recency, fused by Borda points."""
    return ranking.borda(table(spark, sf_dir, "orders"), "o_custkey", "o_orderkey", ["o_totalprice", "o_orderdate"]).withColumn("points", F.col("points").cast("long"))


@plans.query("""
WITH r AS (SELECT c_nationkey, c_custkey, c_acctbal, row_number() OVER w AS rank, c_acctbal - lead(c_acctbal) OVER w AS fall, max(c_acctbal) OVER (PARTITION BY c_nationkey) AS best FROM customer WINDOW w AS (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey)),
k AS (SELECT c_nationkey, arg_max(rank, (fall, -rank)) AS cut FROM r WHERE best > 0 AND fall / best > 0.05 GROUP BY c_nationkey)
SELECT r.c_nationkey, r.c_custkey, CAST(r.rank AS INTEGER) AS rank FROM r LEFT JOIN k ON r.c_nationkey = k.c_nationkey WHERE k.cut IS NULL OR r.rank <= k.cut
""")
def knee_cutoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each nation's customers above the steepest fall of balances."""
    return ranking.knee(table(spark, sf_dir, "customer"), "c_nationkey", "c_custkey", "c_acctbal", 0.05).select("c_nationkey", "c_custkey", "rank")


@plans.query("""
SELECT doc_id, source, lang FROM (
  SELECT *, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS s FROM (
    SELECT *, row_number() OVER (PARTITION BY source, lang ORDER BY n_chars DESC, doc_id) AS k FROM documents) WHERE k <= 3) WHERE s <= 5
""")
def diversity_caps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """At most three documents of a language and five in all from each source, the longest first."""
    order = [F.col("n_chars").desc(), F.col("doc_id").asc()]
    kinds = ranking.capped(table(spark, sf_dir, "documents").select("doc_id", "source", "lang", "n_chars"), ["source", "lang"], order, 3).drop("place")
    return ranking.capped(kinds, ["source"], order, 5).select("doc_id", "source", "lang")


@plans.query("""
SELECT doc_id, md5(text) AS digest, CAST(n AS BIGINT) AS copies FROM (SELECT doc_id, text, row_number() OVER (PARTITION BY text ORDER BY doc_id) AS r, count(*) OVER (PARTITION BY text) AS n FROM documents) WHERE r = 1
""")
def best_per_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first document of each text, and how many have it; grouped, so that a text everyone has is no hot task."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.md5("text").alias("digest"))
    return docs.groupBy("digest").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies"))


@plans.query("""
SELECT o_orderkey, round(CAST(0.6 AS DOUBLE) * CASE WHEN h1 > l1 THEN (o_totalprice - l1) / (h1 - l1) ELSE 0 END + CAST(0.4 AS DOUBLE) * CASE WHEN h2 > l2 THEN CAST(o_orderkey - l2 AS DOUBLE) / (h2 - l2) ELSE 0 END, 6) AS blended
FROM (SELECT *, min(o_totalprice) OVER w AS l1, max(o_totalprice) OVER w AS h1, min(o_orderkey) OVER w AS l2, max(o_orderkey) OVER w AS h2 FROM orders WINDOW w AS (PARTITION BY o_custkey))
""")
def minmax_blend(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two scores of each customer's orders, scaled within the customer and blended."""
    by, price, key = F.col("o_custkey"), F.col("o_totalprice"), F.col("o_orderkey").cast("double")
    return table(spark, sf_dir, "orders").select("o_orderkey", F.round(0.6 * ranking.minmax(price, by) + 0.4 * ranking.minmax(key, by), 6).alias("blended"))


@plans.query("""
WITH r AS (SELECT user_id, event_id, value, strftime(ts, '%Y-%m-%d') AS day, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) <= 3 AS seed FROM events),
b AS (SELECT *, bool_or(seed) OVER (PARTITION BY user_id, day) AS active FROM r)
SELECT user_id, event_id, round(CASE WHEN active THEN value * CAST(1.3 AS DOUBLE) ELSE value END, 6) AS boosted FROM b
""")
def session_boost(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's events by value, raised on the days that hold one of the three best."""
    rows = table(spark, sf_dir, "events").select("user_id", "event_id", "value", F.date_format("ts", "yyyy-MM-dd").alias("day"))
    return ranking.session_boost(rows, "user_id", "day", "event_id", "value").select("user_id", "event_id", F.round("boosted", 6).alias("boosted"))


@plans.query("""
SELECT conv_id, turn, CAST(turn - lag(turn) OVER w AS BIGINT) AS gap, md5(coalesce(lag(text) OVER w, '') || '|' || text || '|' || coalesce(lead(text) OVER w, '')) AS context FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role, text)
""")
def turn_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every turn with the ones next to it."""
    w = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    near = F.concat(F.coalesce(F.lag("text").over(w), F.lit("")), F.lit("|"), F.col("text"), F.lit("|"), F.coalesce(F.lead("text").over(w), F.lit("")))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", (F.col("turn") - F.lag("turn").over(w)).alias("gap"), F.md5(near).alias("context"))


@plans.query(f"""
WITH {_NEAR}, r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, vec_id) AS rank, CAST(label = q_label AS INTEGER) AS good, sum(CAST(label = q_label AS INTEGER)) OVER (PARTITION BY qid) AS gold FROM near)
SELECT q_label AS label, CAST(count(DISTINCT qid) AS BIGINT) AS queries, round(avg(p10), 6) AS precision_10, round(avg(r10), 6) AS recall_10, round(avg(rr), 6) AS mrr
FROM (SELECT qid, q_label, sum(CASE WHEN rank <= 10 THEN good ELSE 0 END) / CAST(10 AS DOUBLE) AS p10, CASE WHEN max(gold) > 0 THEN sum(CASE WHEN rank <= 10 THEN good ELSE 0 END) / CAST(max(gold) AS DOUBLE) ELSE 0 END AS r10, coalesce(1 / CAST(min(CASE WHEN good = 1 THEN rank END) AS DOUBLE), 0) AS rr FROM r GROUP BY qid, q_label) GROUP BY q_label
""")
def retrieval_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Precision and recall at ten and the mean reciprocal rank by label: vectors of the same label are the right ones."""
    units, asks = stored(_units(spark, sf_dir), "units"), F.col("vec_id") % QUERY_EACH == 0
    labels = units.select("vec_id", "label")
    queries = labels.where(asks).select(F.col("vec_id").alias("qid"), F.col("label").alias("q_label"))
    ten = nearest(units, "vec_id", "v", asks, 10).join(labels, "vec_id").join(queries, "qid")
    hits = ten.where("label = q_label").groupBy("qid").agg(F.count("*").alias("hits"))
    gold = labels.groupBy(F.col("label").alias("q_label")).agg((F.count("*") - 1).alias("gold"))
    # the place of the nearest right one: how many of all labels come before it
    first = nearest(units, "vec_id", "v", asks, 1, label="label").select("qid", F.col("vec_id").alias("found"), "score")
    place = places(units, "vec_id", "v", asks, stored(first, "first"))
    each = queries.join(gold, "q_label").join(hits, "qid", "left").join(place, "qid", "left").withColumn("hits", F.coalesce("hits", F.lit(0)))
    each = each.select("q_label", (F.col("hits") / 10.0).alias("p10"), F.when(F.col("gold") > 0, F.col("hits") / F.col("gold")).otherwise(0.0).alias("r10"), F.coalesce(1.0 / F.col("place"), F.lit(0.0)).alias("rr"))
    return each.groupBy(F.col("q_label").alias("label")).agg(F.count("*").alias("queries"), F.round(F.avg("p10"), 6).alias("precision_10"), F.round(F.avg("r10"), 6).alias("recall_10"), F.round(F.avg("rr"), 6).alias("mrr"))


QUERIES, SQL = plans.queries, plans.sql
