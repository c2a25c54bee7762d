"""Queries over scoring kernels, tiers, beliefs and forgetting."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import scoring, vectors
from ..sources.tables import table
from .registering import Plans

plans = Plans()
D = "CAST({} AS DOUBLE)".format

_LAST = "(SELECT max(ts) FROM events)"
_USERS = f"u AS (SELECT user_id, count(*) AS n, avg(value) / 100 AS mean, {D('date_diff(' + chr(39) + 'second' + chr(39) + ', max(ts), ' + _LAST + ')')} / 3600 AS hours FROM events GROUP BY user_id)"


def users(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events, mean value over 100 and hours since the last event of each user, counted from the last event of all."""
    events = table(spark, sf_dir, "events")
    last = events.agg(F.max(F.unix_timestamp("ts"))).scalar()
    rows = events.groupBy("user_id").agg(F.count("*").alias("n"), (F.avg("value") / 100).alias("mean"), F.max(F.unix_timestamp("ts")).alias("seen"))
    return rows.select("user_id", "n", "mean", ((last - F.col("seen")) / 3600.0).alias("hours"))


@plans.query(f"WITH {_USERS} SELECT user_id, round(least(greatest({D(0.5)} + {D(0.3)} * ln(1 + n) + {D(0.2)} * exp(-{D(0.05)} * hours / 24), {D(0.8)}), {D(1.5)}), 6) AS importance FROM u")
def importance_kernel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Importance of each user by accesses and days since the last, within fixed bounds."""
    return users(spark, sf_dir).select("user_id", F.round(scoring.importance(F.col("n"), F.col("hours") / 24), 6).alias("importance"))


@plans.query(f"""
SELECT event_id, round(weighted, 6) AS weighted, CASE WHEN r <= 3 THEN 1 ELSE 0 END AS in_top FROM (
  SELECT event_id, weighted, row_number() OVER (PARTITION BY day ORDER BY weighted DESC, event_id) AS r FROM (
    SELECT event_id, CAST(ts AS DATE) AS day, value * CASE event_type WHEN 'purchase' THEN {D(2)} WHEN 'click' THEN {D(1)} ELSE {D(0.5)} END AS weighted FROM events))
""")
def weighted_top_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events weighted by kind, with a mark for the three greatest of each day."""
    weight = F.when(F.col("event_type") == "purchase", 2.0).when(F.col("event_type") == "click", 1.0).otherwise(0.5)
    rows = table(spark, sf_dir, "events").select("event_id", F.to_date("ts").alias("day"), (F.col("value") * weight).alias("weighted"))
    order = Window.partitionBy("day").orderBy(F.col("weighted").desc(), "event_id")
    return rows.select("event_id", F.round("weighted", 6).alias("weighted"), F.when(F.row_number().over(order) <= 3, 1).otherwise(0).alias("in_top"))


@plans.query("""
SELECT event_id, printf('%08x', CASE WHEN q < 0 THEN q + 4294967296 ELSE q END) AS hex, CAST(q AS DOUBLE) / 65536 AS back FROM (SELECT event_id, CAST(round(value * 65536 - 3000000) AS BIGINT) AS q FROM events)
""")
def fixed_point_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values as 16.16 fixed-point numbers in hexadecimal, and back."""
    q = F.round(F.col("value") * 65536 - 3000000).cast("long")
    return table(spark, sf_dir, "events").select("event_id", scoring.fixed_hex(q).alias("hex"), scoring.from_fixed(q).alias("back"))


_TIER = "CASE WHEN n >= 80 THEN 3 WHEN n >= 70 THEN 2 WHEN n >= 60 THEN 1 ELSE 0 END"


@plans.query(f"WITH {_USERS} SELECT tier, count(*) AS n, round(sum(mean * CASE tier WHEN 0 THEN {D(0.7)} WHEN 1 THEN {D(1)} WHEN 2 THEN {D(1.5)} ELSE {D(2)} END), 6) AS boosted FROM (SELECT *, CAST({_TIER} AS BIGINT) AS tier FROM u) GROUP BY tier")
def tier_boosts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users of each tier, and their scores at the tier's boost."""
    tier = F.when(F.col("n") >= 80, 3).when(F.col("n") >= 70, 2).when(F.col("n") >= 60, 1).otherwise(0).cast("long")
    rows = users(spark, sf_dir).withColumn("tier", tier)
    return rows.groupBy("tier").agg(F.count("*").alias("n"), F.round(F.sum(F.col("mean") * scoring.tier_boost(F.col("tier"))), 6).alias("boosted"))


@plans.query(f"""
WITH s AS (SELECT user_id, CAST(ts AS DATE) AS day FROM events GROUP BY ALL), c AS (SELECT user_id, count(*) AS sessions FROM s GROUP BY user_id)
SELECT user_id, sessions, least(sessions // 3, 3) AS tier, CASE WHEN sessions % 3 = 0 AND sessions <= 9 THEN 'promoted' WHEN sessions < 3 THEN 'new' ELSE 'kept' END AS move FROM c
""")
def tier_moves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users' tiers by the days they came, one tier for three; who has just reached one is promoted."""
    days = table(spark, sf_dir, "events").select("user_id", F.to_date("ts").alias("day")).distinct().groupBy("user_id").agg(F.count("*").alias("sessions"))
    move = F.when((F.col("sessions") % 3 == 0) & (F.col("sessions") <= 9), "promoted").when(F.col("sessions") < 3, "new").otherwise("kept")
    return days.select("user_id", "sessions", F.least(F.floor(F.col("sessions") / 3), F.lit(3)).alias("tier"), move.alias("move"))


@plans.query(f"""
WITH {_USERS}, b AS (SELECT user_id, mean, least({D(1)} / (1 + n) + {D(0.01)} * hours, {D(1)}) AS variance FROM u)
SELECT user_id, round(variance, 6) AS variance, round(mean * (1 - variance), 6) AS confidence, mean * (1 - variance) < {D(0.3)} AS stale FROM b
""")
def decayed_beliefs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Beliefs about users: their variance grows by the hour, and those that are hardly sure are stale."""
    rows = users(spark, sf_dir).withColumn("variance", scoring.predicted_variance(1.0 / (1 + F.col("n")), F.col("hours")))
    sure = F.col("mean") * (1 - F.col("variance"))
    return rows.select("user_id", F.round("variance", 6).alias("variance"), F.round(sure, 6).alias("confidence"), (sure < 0.3).alias("stale"))


@plans.query("""
WITH o AS (SELECT o_orderkey, o_orderstatus AS s, o_totalprice, date_diff('day', o_orderdate, (SELECT max(o_orderdate) FROM orders)) AS age FROM orders)
SELECT CASE WHEN s = 'F' AND age > 2000 THEN 'forget' WHEN s = 'P' AND age > 365 THEN 'archive' WHEN o_totalprice < 50000 AND age > 180 THEN 'mark' ELSE 'keep' END AS step, count(*) AS n, min(age) AS least_age, max(age) AS most_age FROM o GROUP BY 1
""")
def forgetting_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What becomes of orders: forgotten past their grace, archived once merged and old, marked while slight and stale."""
    orders = table(spark, sf_dir, "orders")
    last = orders.agg(F.max("o_orderdate")).scalar()
    rows = orders.withColumn("age", F.datediff(last, "o_orderdate").cast("long"))
    step = scoring.forgetting_step(F.col("o_orderstatus"), F.col("o_totalprice"), F.col("age"))
    return rows.groupBy(step.alias("step")).agg(F.count("*").alias("n"), F.min("age").alias("least_age"), F.max("age").alias("most_age"))


@plans.query(f"""
WITH q AS (SELECT vec_id, e, m / 127 AS scale, list_transform(e, lambda x: CAST(round_even(x / (m / 127), 0) AS INTEGER)) AS c FROM (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e, list_max(list_transform(CAST(embedding AS DOUBLE[]), lambda x: abs(x))) AS m FROM embeddings) WHERE m > 0)
SELECT vec_id, md5(array_to_string(list_transform(c, lambda x: printf('%02x', x + 128)), '')) AS digest, CAST(list_sum(c) AS BIGINT) AS total,
  round(list_max(list_transform(list_zip(e, c), lambda z: abs(z[1] - z[2] * scale))) / scale, 4) <= 0.5 AS close FROM q
""")
def vector_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors as bytes of their own scale: the digest of the bytes, their sum, and whether what comes back is close."""
    rows = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("e"))
    rows = rows.withColumn("m", F.array_max(F.transform("e", F.abs))).where("m > 0").withColumn("scale", F.col("m") / 127)
    coded = rows.withColumn("hex", vectors.encoded(F.col("e"), F.col("scale"))).withColumn("c", vectors.decoded_steps(F.col("hex")))
    apart = F.array_max(F.zip_with("e", "c", lambda x, c: F.abs(x - c * F.col("scale")))) / F.col("scale")
    return coded.select("vec_id", F.md5("hex").alias("digest"), F.aggregate("c", F.lit(0), lambda a, x: a + x).cast("long").alias("total"), (F.round(apart, 4) <= 0.5).alias("close"))


@plans.query(f"""
WITH p AS (SELECT conv_id, turn, {D(1)} - {D(1)} / (2 + length(text) // 20) AS raw FROM conversations)
SELECT conv_id, turn, round(c, 6) AS confidence, c < {D(0.1)} AS cut FROM (SELECT conv_id, turn, exp(sum(ln(raw * {D(0.9)})) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING)) AS c FROM p)
""")
def hop_uncertainty(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How sure a chain of turns still is at each of them, and where it should be cut."""
    raw = 1.0 - 1.0 / (2 + F.floor(F.length("text") / 20))
    chain = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, 0)
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.exp(F.sum(F.log(raw * 0.9)).over(chain)).alias("c"))
    return rows.select("conv_id", "turn", F.round("c", 6).alias("confidence"), (F.col("c") < 0.1).alias("cut"))


@plans.query(f"""
WITH c AS (SELECT label, i, avg(CAST(x AS DOUBLE)) AS x FROM (SELECT label, unnest(embedding) AS x, unnest(range(len(embedding))) AS i FROM embeddings) GROUP BY label, i),
m AS (SELECT label, list(x ORDER BY i) AS mean FROM c GROUP BY label),
s AS (SELECT d.doc_id, (1 - list_cosine_similarity(CAST(e.embedding AS DOUBLE[]), m.mean)) / 2 AS near FROM documents d LEFT JOIN embeddings e ON e.vec_id = d.doc_id * 7 LEFT JOIN m ON m.label = e.label)
SELECT doc_id, round(coalesce(near, {D(0.5)}), 6) AS surprise, coalesce(near, {D(0.5)}) >= {D(0.48)} AS promoted FROM s
""")
def surprise_promotions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far each document's vector is from its label's mean; without a vector it is neither near nor far."""
    rows = table(spark, sf_dir, "embeddings")
    parts = rows.select("label", F.posexplode("embedding").alias("i", "x")).groupBy("label", "i").agg(F.avg(F.col("x").cast("double")).alias("x"))
    means = parts.groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]).alias("mean"))
    near = rows.join(means, "label").select("vec_id", vectors.cosine(F.col("embedding"), F.col("mean")).alias("cosine"))
    docs = table(spark, sf_dir, "documents").select("doc_id", (F.col("doc_id") * 7).alias("vec_id")).join(near, "vec_id", "left")
    surprise = F.coalesce((1 - F.col("cosine")) / 2, F.lit(0.5))
    return docs.select("doc_id", F.round(surprise, 6).alias("surprise"), (surprise >= 0.48).alias("promoted"))


@plans.query(f"""
WITH e AS (SELECT l_orderkey, count(DISTINCT l_partkey) AS n FROM lineitem GROUP BY l_orderkey),
m AS (SELECT o_orderkey, CASE WHEN o_orderpriority = '1-URGENT' THEN {D(1)} ELSE {D(0.3)} * (CASE o_orderstatus WHEN 'F' THEN {D(1)} WHEN 'P' THEN {D(0.5)} ELSE {D(0)} END) + {D(0.2)} * (CASE WHEN o_totalprice >= 100000 THEN {D(1)} ELSE {D(0)} END) + {D(0.5)} * least({D(1)}, coalesce(n, 0) / {D(5)}) END AS maturity FROM orders LEFT JOIN e ON l_orderkey = o_orderkey)
SELECT o_orderkey, round(maturity, 6) AS maturity FROM m WHERE maturity >= {D(0.5)}
""")
def mature_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders mature enough by status, price and what they hold; urgent ones always are."""
    held = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.countDistinct("l_partkey").alias("n"))
    status = F.when(F.col("o_orderstatus") == "F", 1.0).when(F.col("o_orderstatus") == "P", 0.5).otherwise(0.0)
    life = F.when(F.col("o_totalprice") >= 100000, 1.0).otherwise(0.0)
    score = 0.3 * status + 0.2 * life + 0.5 * F.least(F.lit(1.0), F.coalesce("n", F.lit(0)) / 5.0)
    rows = table(spark, sf_dir, "orders").join(held, "o_orderkey", "left").withColumn("maturity", F.when(F.col("o_orderpriority") == "1-URGENT", 1.0).otherwise(score))
    return rows.where("maturity >= 0.5").select("o_orderkey", F.round("maturity", 6).alias("maturity"))


@plans.query(f"""
WITH r AS (SELECT event_id, CAST(ts AS DATE) AS day, value, row_number() OVER (PARTITION BY CAST(ts AS DATE) ORDER BY ts DESC, event_id) AS r, count(*) OVER (PARTITION BY CAST(ts AS DATE)) AS n,
  value > lag(value) OVER (PARTITION BY user_id ORDER BY event_id) * 5 AS against FROM events)
SELECT event_id, round(value / 100 + 1 - CAST(r AS DOUBLE) / n, 6) AS recent_first, round(value / 100 + CASE WHEN coalesce(against, false) THEN 1 ELSE 0 END, 6) AS contradicts_first FROM r
""")
def kernel_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events scored by two kernels: the most recent of a day first, and those that contradict the one before first."""
    day = Window.partitionBy(F.to_date("ts"))
    r = F.row_number().over(day.orderBy(F.col("ts").desc(), "event_id"))
    before = F.lag("value").over(Window.partitionBy("user_id").orderBy("event_id"))
    score = F.col("value") / 100
    against = F.when(F.coalesce(F.col("value") > before * 5, F.lit(False)), 1).otherwise(0)
    return table(spark, sf_dir, "events").select("event_id", F.round(score + 1 - r / F.count("*").over(day), 6).alias("recent_first"), F.round(score + against, 6).alias("contradicts_first"))


QUERIES, SQL = plans.queries, plans.sql
