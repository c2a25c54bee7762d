"""Queries over recall from end to end: weighted fields, boosted vectors, feedback, walks of scores, budgets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import scoring, text, vectors
from ..operators import lexical, recall
from ..operators.nearest import nearest
from ..sources.scratch import stored
from ..sources.tables import table
from . import lexical as ranking
from . import sql
from .network import edges
from .registering import Plans

plans = Plans()
D = "CAST({} AS DOUBLE)".format

_FIELDS = (("p_name", 3.0), ("p_type", 0.8), ("p_brand", 0.5))
_PART_TERMS = " UNION ALL ".join(f"SELECT p_partkey, term, {D(w)} AS w FROM ({sql.terms('part', 'p_partkey', c)})" for c, w in _FIELDS)


@plans.query(f"""
WITH t AS (SELECT p_partkey, term, sum(w) AS tf FROM ({_PART_TERMS}) GROUP BY ALL), q AS (SELECT p_partkey AS qid, term, count(*) AS times FROM ({sql.terms("(SELECT * FROM part WHERE p_partkey % 20 = 0)", "p_partkey", "p_name")}) GROUP BY ALL),
l AS (SELECT p_partkey, sum(tf) AS length FROM t GROUP BY p_partkey), n AS (SELECT {D("count(*)")} AS n FROM part), m AS (SELECT (SELECT sum(length) FROM l) / n AS mean_length, n FROM n),
r AS (SELECT term, ln((n - df + {D(0.5)}) / (df + {D(0.5)}) + {D(1)}) AS rarity, mean_length FROM (SELECT term, {D("count(*)")} AS df FROM t GROUP BY term), m),
s AS (SELECT qid, p_partkey, round(sum(times * rarity * tf * {D(2.2)} / (tf + {D(1.2)} * ({D(0.25)} + {D(0.75)} * length / mean_length))), 6) AS score FROM t JOIN r USING (term) JOIN l USING (p_partkey) JOIN q USING (term) GROUP BY qid, p_partkey)
SELECT qid, p_partkey, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, p_partkey) AS rank FROM s) WHERE rank <= 10
""")
def field_weighted_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten parts that each hundredth part's name speaks for, over name, type and brand at their weights."""
    part = table(spark, sf_dir, "part")
    posts = stored(lexical.postings([(lexical.terms(part, "p_partkey", F.col(c)), w) for c, w in _FIELDS], "p_partkey"), "part-postings")
    asked = lexical.terms(part.where("p_partkey % 20 = 0"), "p_partkey", F.col("p_name")).select(F.col("p_partkey").alias("qid"), "term")
    return lexical.ranked_by_class(posts, part.agg(F.count("*").cast("double").alias("n")), asked, "p_partkey", 10)


_NEAR = f"near AS (SELECT q.vec_id AS qid, v.vec_id, v.label, list_cosine_similarity(CAST(q.embedding AS DOUBLE[]), CAST(v.embedding AS DOUBLE[])) AS c FROM embeddings q JOIN embeddings v ON q.vec_id % 20 = 0 AND q.vec_id <> v.vec_id AND q.label = v.label)"


@plans.query(f"WITH {_NEAR} SELECT qid, vec_id, score, rank FROM (SELECT qid, vec_id, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, vec_id) AS rank FROM (SELECT *, round(c * ({D(1)} - {D(0.5)} * (vec_id % 100) / 100) * CASE label % 3 WHEN 0 THEN {D(1.2)} WHEN 1 THEN {D(1)} ELSE {D(0.8)} END, 6) AS score FROM near)) WHERE rank <= 10")
def boosted_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten nearest vectors of each query vector's label by cosine, recency and status together."""
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "label", vectors.unit(F.col("embedding")).alias("v"))
    recency = 1.0 - 0.5 * (F.col("vec_id") % 100) / 100
    status = F.when(F.col("label") % 3 == 0, 1.2).when(F.col("label") % 3 == 1, 1.0).otherwise(0.8)
    return nearest(rows, "vec_id", "v", F.col("vec_id") % 20 == 0, 10, "label", weights=(recency, status)).select("qid", "vec_id", "score", "rank")


_FEEDBACK = f"""
WITH {ranking._BM25}, k AS ({ranking._RANKED}), f AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY rank) AS top FROM k),
c AS (SELECT term, sum(tf) / (SELECT sum(tf) FROM t) AS p_term, {D("count(*)")} AS df FROM t GROUP BY term),
x AS (SELECT qid, term, avg(p) AS p FROM (SELECT f.qid, t.term, (tf + {D(2000)} * p_term) / (length + {D(2000)}) AS p, df FROM f JOIN l USING (doc_id) JOIN t USING (doc_id) JOIN c USING (term) WHERE top <= 5) z WHERE ln(((SELECT n FROM n) - df + {D(0.5)}) / (df + {D(0.5)}) + 1) >= 1 GROUP BY qid, term),
e AS (SELECT qid, term, p FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(p, 12) DESC, term) AS r FROM x) WHERE r <= 10),
w AS (SELECT qid, term, {D(0.6)} * times / sum(times) OVER (PARTITION BY qid) AS w FROM q UNION ALL SELECT qid, term, {D(0.4)} * p / sum(p) OVER (PARTITION BY qid) FROM e)
"""


@plans.query(f"{_FEEDBACK} SELECT qid, term, round(sum(w), 8) AS weight FROM w GROUP BY qid, term")
def rm3_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each item's query with the ten rare terms that its five best documents speak for, mixed at 0.6 to 0.4."""
    posts = ranking._posts(spark, sf_dir)
    ranked = stored(ranking.ranked_documents(spark, sf_dir, posts), "ranked")
    n = table(spark, sf_dir, "documents").agg(F.count("*").cast("double").alias("n")).scalar()
    more = recall.feedback_model(posts, ranked.where("rank <= 5"), n, "doc_id")
    return recall.mixed_query(ranking._asked(spark, sf_dir), more, 0.6).withColumn("weight", F.round("weight", 8))


@plans.query(f"""
{_FEEDBACK}, y AS (SELECT qid, term, sum(w) AS w FROM w GROUP BY qid, term), g AS (SELECT f.qid, f.doc_id, sum(y.w * rarity * tf / (tf + {D(1.2)})) AS more FROM f JOIN t USING (doc_id) JOIN y ON y.qid = f.qid AND y.term = t.term JOIN r ON r.term = t.term GROUP BY ALL)
SELECT k.qid, k.doc_id, round(k.score + {D(0.4)} * coalesce(more, 0), 4) AS score FROM k LEFT JOIN g ON g.qid = k.qid AND g.doc_id = k.doc_id
""".replace(f"JOIN r ON r.term = t.term", f"JOIN (SELECT term, ln(((SELECT n FROM n) - df + {D(0.5)}) / (df + {D(0.5)}) + 1) AS rarity FROM c) rr ON rr.term = t.term"))
def rm3_rescore(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits rescored by the mixed query's terms."""
    posts = ranking._posts(spark, sf_dir)
    ranked = stored(ranking.ranked_documents(spark, sf_dir, posts), "ranked")
    n = table(spark, sf_dir, "documents").agg(F.count("*").cast("double").alias("n")).scalar()
    query = stored(recall.mixed_query(ranking._asked(spark, sf_dir), recall.feedback_model(posts, ranked.where("rank <= 5"), n, "doc_id"), 0.6), "rm3")
    return recall.rescored(ranked, posts, query, n, "doc_id", 0.4).select("qid", "doc_id", F.round("score", 4).alias("score"))


_SEEDS = "SELECT 'c' || c_custkey AS node, {0} AS score FROM customer WHERE c_custkey % 20 = 0".format(D("0.5 + (c_custkey % 10) / 20.0"))


def _walk_sql(hops: int, factor: str, least: str) -> str:
    steps = [f"s0 AS ({_SEEDS})"]
    for h in range(1, hops + 1):
        steps.append(f"s{h} AS (SELECT node, max(score) AS score FROM (SELECT node, score FROM s{h - 1} UNION ALL SELECT b.near, s.score * {factor.format(h=h)} FROM s{h - 1} s JOIN b ON b.node = s.node WHERE b.w > {least}) GROUP BY node)")
    return ", ".join(steps)


_WEIGHTED = """
b AS (SELECT node, near, max(w) AS w FROM (SELECT 'c' || o_custkey AS node, 'o' || o_orderkey AS near, CAST(1.0 AS DOUBLE) AS w FROM orders UNION ALL SELECT 'o' || o_orderkey, 'c' || o_custkey, CAST(1.0 AS DOUBLE) FROM orders
  UNION ALL SELECT 'o' || l_orderkey, 'p' || l_partkey, l_quantity / 50 FROM lineitem UNION ALL SELECT 'p' || l_partkey, 'o' || l_orderkey, l_quantity / 50 FROM lineitem) GROUP BY node, near)
"""


def _weighted_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = edges(spark, sf_dir).where("predicate IN ('placed', 'contains')")
    both = rows.select(F.col("src").alias("node"), F.col("dst").alias("near"), F.col("confidence").alias("w"))
    return stored(both.union(both.select(F.col("near").alias("node"), F.col("node").alias("near"), "w")), "weighted-edges")


def _walk_seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").where("c_custkey % 20 = 0").select(F.concat(F.lit("c"), "c_custkey").alias("node"), (0.5 + (F.col("c_custkey") % 10) / 20.0).alias("score"))


@plans.query(f"WITH {_WEIGHTED}, {_walk_sql(3, D(0.3) + ' * least(b.w, 1)', '0.1')} SELECT node, round(score, 6) AS score FROM s3")
def three_rounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of customers handed on three times at 0.3 over edges that are not too weak; the best one counts."""
    rows = recall.handed_on(_walk_seeds(spark, sf_dir), _weighted_edges(spark, sf_dir).where("w > 0.1"), [0.3, 0.3, 0.3])
    return rows.select("node", F.round("score", 6).alias("score"))


_STALE = ", ".join(["h0 AS (SELECT node, 0 AS hop FROM (" + _SEEDS + "))"] + [f"h{h} AS (SELECT node, min(hop) AS hop FROM (SELECT node, hop FROM h{h - 1} UNION ALL SELECT b.near, {h} FROM h{h - 1} s JOIN b ON b.node = s.node WHERE s.hop = {h - 1} AND b.w > 0.5) GROUP BY node)" for h in (1, 2, 3)])


@plans.query(f"WITH {_WEIGHTED}, {_STALE} SELECT node, CAST(hop AS BIGINT) AS hop, CASE hop WHEN 0 THEN {D(1)} WHEN 1 THEN {D(0.9)} WHEN 2 THEN {D(0.5)} ELSE {D(0.2)} END AS staleness, hop <= 1 AS flagged FROM h3")
def staleness_by_hop(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How stale what customers reach becomes by the hop at which it is reached, and what is flagged for it."""
    seeds = _walk_seeds(spark, sf_dir).select("node")
    rows = recall.hops(seeds, _weighted_edges(spark, sf_dir).where("w > 0.5"), 3)
    staleness = F.when(F.col("hop") == 0, 1.0).when(F.col("hop") == 1, 0.9).when(F.col("hop") == 2, 0.5).otherwise(0.2)
    return rows.select("node", F.col("hop").cast("long").alias("hop"), staleness.alias("staleness"), (staleness >= 0.9).alias("flagged"))


_AXES = f"""
a AS (SELECT CAST(ts AS DATE) AS day, user_id, 'count' AS axis, {D("count(*)")} AS s FROM events GROUP BY 1, 2 UNION ALL SELECT CAST(ts AS DATE), user_id, 'value', sum(value) FROM events GROUP BY 1, 2 UNION ALL SELECT CAST(ts AS DATE), user_id, 'peak', max(value) FROM events GROUP BY 1, 2),
r AS (SELECT day, user_id, axis, row_number() OVER (PARTITION BY day, axis ORDER BY s DESC, user_id) AS rank FROM a),
f AS (SELECT day, user_id, sum((CASE axis WHEN 'count' THEN {D(0.5)} WHEN 'value' THEN {D(0.3)} ELSE {D(0.2)} END) / (60 + rank)) AS score, count(DISTINCT axis) AS axes FROM r WHERE rank <= 20 GROUP BY day, user_id),
o AS (SELECT *, row_number() OVER (PARTITION BY day ORDER BY round(score, 10) DESC, user_id) AS rank FROM f)
"""


@plans.query(f"WITH {_AXES} SELECT CAST(day AS VARCHAR) AS day, user_id, round(score, 8) AS score, axes, rank, max(CASE WHEN rank = 1 THEN score * 61 END) OVER (PARTITION BY day) < 0.9 AS rotated FROM o WHERE rank <= 10")
def axis_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each day's users fused from three axes at their weights, and whether the best one is sure enough not to rotate the axes."""
    daily = table(spark, sf_dir, "events").groupBy(F.to_date("ts").cast("string").alias("day"), "user_id").agg(F.count("*").cast("double").alias("count"), F.sum("value").alias("value"), F.max("value").alias("peak"))
    rows = daily.unpivot(["day", "user_id"], ["count", "value", "peak"], "axis", "s")
    rank = F.row_number().over(Window.partitionBy("day", "axis").orderBy(F.col("s").desc(), "user_id"))
    weight = F.when(F.col("axis") == "count", 0.5).when(F.col("axis") == "value", 0.3).otherwise(0.2)
    fused = rows.withColumn("rank", rank).where("rank <= 20").groupBy("day", "user_id").agg(F.sum(weight / (60 + F.col("rank"))).alias("score"), F.countDistinct("axis").alias("axes"))
    order = Window.partitionBy("day").orderBy(F.round("score", 10).desc(), "user_id")
    best = F.max(F.when(F.col("rank") == 1, F.col("score") * 61)).over(Window.partitionBy("day"))
    return fused.withColumn("rank", F.row_number().over(order)).withColumn("rotated", best < 0.9).where("rank <= 10").withColumn("score", F.round("score", 8))


@plans.query("""
WITH t AS (SELECT o_custkey, o_orderkey, CAST(10 + o_totalprice / 10000 AS BIGINT) AS tokens, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS r FROM orders),
u AS (SELECT *, sum(tokens) OVER (PARTITION BY o_custkey ORDER BY r) AS used FROM t)
SELECT o_custkey, count(CASE WHEN used <= 75 THEN 1 END) AS taken, CAST(max(CASE WHEN used <= 75 THEN used ELSE 0 END) AS BIGINT) AS used, CAST(75 - max(CASE WHEN used <= 75 THEN used ELSE 0 END) AS BIGINT) AS left_over FROM u GROUP BY o_custkey
""")
def reserved_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each customer's dearest orders until a budget of a hundred tokens is full, of which a quarter is kept in reserve."""
    tokens = F.round(10 + F.col("o_totalprice") / 10000).cast("long")
    order = Window.partitionBy("o_custkey").orderBy(F.col("o_totalprice").desc(), "o_orderkey").rowsBetween(Window.unboundedPreceding, 0)
    fits = F.when(F.col("used") <= scoring.budget(100), F.col("used"))
    rows = table(spark, sf_dir, "orders").select("o_custkey", F.sum(tokens).over(order).alias("used"))
    out = rows.groupBy("o_custkey").agg(F.count(fits).alias("taken"), F.coalesce(F.max(fits), F.lit(0)).alias("used"))
    return out.withColumn("left_over", scoring.budget(100) - F.col("used"))


@plans.query(f"""
WITH p AS (SELECT o_orderkey, o_orderdate, lag(o_orderdate) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS asked FROM orders),
d AS (SELECT o_orderkey, o_orderkey % 10 = 0 AS undated, asked, {D("date_diff('day', asked, o_orderdate)")} AS apart FROM p)
SELECT o_orderkey, round(CASE WHEN asked IS NULL THEN {D(1)} WHEN undated THEN {D(0.8)} ELSE {D(0.5)} + exp(-apart * apart / {D(1800)}) END, 6) AS factor FROM d
""")
def date_factors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How near each order's date is to the one asked for; without a question's date nothing changes, without its own it counts less."""
    by = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    rows = table(spark, sf_dir, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 10 != 0, F.col("o_orderdate")).alias("own"), F.lag("o_orderdate").over(by).alias("asked"))
    return rows.select("o_orderkey", F.round(scoring.date_proximity(F.col("asked"), F.col("own")), 6).alias("factor"))


@plans.query(f"""
WITH t AS (SELECT conv_id, turn, w, lag(w) OVER (PARTITION BY conv_id ORDER BY turn) AS before, text FROM (SELECT conv_id, turn, text, list_distinct(regexp_extract_all(lower(text), '[a-z0-9_]+')) AS w FROM conversations)),
j AS (SELECT *, CASE WHEN before IS NULL THEN NULL WHEN len(list_distinct(list_concat(w, before))) = 0 THEN {D(0)} ELSE len(list_intersect(w, before)) / CAST(len(list_distinct(list_concat(w, before))) AS DOUBLE) END AS s FROM t)
SELECT conv_id, turn, CASE WHEN s IS NULL THEN 'first' WHEN substr(lower(text), 1, 2) IN ('no', 'th') THEN 'correction' WHEN s >= 0.55 THEN 'requery' WHEN s >= 0.15 THEN 'refinement' ELSE 'new' END AS signal, count(*) OVER (PARTITION BY conv_id) AS turns FROM j
""")
def turn_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each turn signals about the one before: a correction by how it begins, else by how alike they are."""
    by = Window.partitionBy("conv_id").orderBy("turn")
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.lower("text").alias("low"), F.array_distinct(text.words(F.col("text"))).alias("w")).withColumn("before", F.lag("w").over(by))
    union = F.size(F.array_union("w", "before"))
    s = F.when(F.col("before").isNull(), None).when(union == 0, 0.0).otherwise(F.size(F.array_intersect("w", "before")) / union)
    signal = F.when(s.isNull(), "first").when(F.substring("low", 1, 2).isin("no", "th"), "correction").when(s >= 0.55, "requery").when(s >= 0.15, "refinement").otherwise("new")
    return rows.select("conv_id", "turn", signal.alias("signal"), F.count("*").over(Window.partitionBy("conv_id")).alias("turns"))


@plans.query(f"""
WITH h AS (SELECT user_id, event_type AS intent, least(value / 100, 1) AS informative, CASE WHEN event_type = 'error' THEN {D(0.5)} ELSE {D(1)} END AS valid, {D(1)} / count(*) OVER (PARTITION BY user_id, CAST(ts AS DATE)) AS fresh, CASE WHEN value >= 20 THEN {D(1)} ELSE {D(0.5)} END AS retained FROM events)
SELECT user_id, intent, round(least(sum(informative * valid * fresh * retained) / CASE intent WHEN 'purchase' THEN {D(3)} WHEN 'click' THEN {D(2)} ELSE {D(1)} END, 1), 9) AS sufficiency FROM h GROUP BY user_id, intent
""")
def recall_sufficiency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far what each user got covers what the intent asks for: informative, valid, not redundant and retained."""
    same_day = F.count("*").over(Window.partitionBy("user_id", F.to_date("ts")))
    credit = F.least(F.col("value") / 100, F.lit(1.0)) * F.when(F.col("event_type") == "error", 0.5).otherwise(1.0) / same_day * F.when(F.col("value") >= 20, 1.0).otherwise(0.5)
    demand = F.when(F.col("intent") == "purchase", 3.0).when(F.col("intent") == "click", 2.0).otherwise(1.0)
    rows = table(spark, sf_dir, "events").select("user_id", F.col("event_type").alias("intent"), credit.alias("credit")).groupBy("user_id", "intent").agg(F.sum("credit").alias("credit"))
    return rows.select("user_id", "intent", F.round(F.least(F.col("credit") / demand, F.lit(1.0)), 9).alias("sufficiency"))


QUERIES, SQL = plans.queries, plans.sql
