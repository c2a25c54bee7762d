"""Queries over feedback, service levels, baselines, changes and evaluation.

Events stand for feedback on retrievals: a value of 50 or more is a useful one, the kind is the kind of query, and the user
is the record it speaks of.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.quantiles import quantiles
from ..sources.tables import table
from .registering import Plans

plans = Plans()
D = "CAST({} AS DOUBLE)".format
USEFUL = 50


def _useful() -> Column:
    return F.when(F.col("value") >= USEFUL, 1).otherwise(0)


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events")


@plans.query("SELECT event_type, count(*) AS n, CAST(sum(CASE WHEN value >= 50 THEN 1 ELSE 0 END) AS BIGINT) AS useful, round(avg(CASE WHEN value >= 50 THEN 1.0 ELSE 0.0 END), 6) AS accuracy FROM events GROUP BY event_type")
def query_type_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each kind of query was of use."""
    return events(spark, sf_dir).groupBy("event_type").agg(F.count("*").alias("n"), F.sum(_useful()).alias("useful"), F.round(F.avg(_useful()), 6).alias("accuracy"))


_WEIGHTS = "w AS (SELECT user_id, CAST(sum(CASE WHEN value >= 50 THEN 1 ELSE 0 END) AS BIGINT) AS useful, count(*) AS n FROM events WHERE ts > (SELECT max(ts) FROM events) - INTERVAL 10 DAY GROUP BY user_id)"


def recent_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Useful events and all events of each user in the last ten days."""
    rows = events(spark, sf_dir)
    last = rows.agg(F.max("ts")).scalar()
    return rows.where(F.col("ts") > last - F.expr("INTERVAL 10 DAY")).groupBy("user_id").agg(F.sum(_useful()).alias("useful"), F.count("*").alias("n"))


@plans.query(f"WITH {_WEIGHTS} SELECT user_id, useful, n, round((useful + 1) / {D('n + 2')}, 6) AS weight FROM w")
def recent_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Laplace-smoothed weight of each user by the feedback of the last ten days."""
    return recent_counts(spark, sf_dir).withColumn("weight", F.round((F.col("useful") + 1) / (F.col("n") + 2), 6))


@plans.query(f"""
WITH {_WEIGHTS}, r AS (SELECT *, row_number() OVER (ORDER BY (useful + 1) / {D('n + 2')} DESC, user_id) AS best, row_number() OVER (ORDER BY (useful + 1) / {D('n + 2')}, user_id) AS worst FROM w)
SELECT CASE WHEN best <= 10 THEN 'best' ELSE 'worst' END AS side, user_id, CASE WHEN best <= 10 THEN best ELSE worst END AS rank, (SELECT count(*) FROM w) AS records, (SELECT CAST(sum(n) AS BIGINT) FROM w) AS feedback FROM r WHERE best <= 10 OR worst <= 10
""")
def calibration_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best and the ten worst users by recent feedback, and how much there is."""
    rows = recent_counts(spark, sf_dir)
    weight = (F.col("useful") + 1) / (F.col("n") + 2)
    best = rows.orderBy(weight.desc(), "user_id").limit(10).withColumn("side", F.lit("best")).withColumn("rank", F.row_number().over(Window.orderBy(weight.desc(), "user_id")))
    worst = rows.orderBy(weight, "user_id").limit(10).withColumn("side", F.lit("worst")).withColumn("rank", F.row_number().over(Window.orderBy(weight, "user_id")))
    worst = worst.join(best.select("user_id"), "user_id", "left_anti")
    totals = rows.agg(F.count("*").alias("records"), F.sum("n").alias("feedback"))
    return best.unionByName(worst).select("side", "user_id", "rank", *[totals.select(c).scalar().alias(c) for c in ("records", "feedback")])


_SLIS = f"""
d AS (SELECT CAST(ts AS DATE) AS day, count(*) AS n, {D("sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END)")} / count(*) AS error_rate, sum(value) / count(*) / 1000 AS cost, greatest({D(300)} - count(*), {D(0)}) AS deficit FROM events GROUP BY 1),
s AS (SELECT day, 'error_rate' AS name, error_rate AS value, {D(0.2)} AS threshold FROM d UNION ALL SELECT day, 'cost_per_query', cost, {D(0.1)} FROM d UNION ALL SELECT day, 'throughput_deficit', deficit, {D(0)} FROM d)
"""


def slis(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(day, name, value, threshold): rate of errors, cost for each query and what throughput is short of its floor."""
    errors = F.sum(F.when(F.col("event_type") == "error", 1).otherwise(0))
    days = events(spark, sf_dir).groupBy(F.to_date("ts").alias("day")).agg(
        (errors / F.count("*")).alias("error_rate"), (F.sum("value") / F.count("*") / 1000).alias("cost_per_query"), F.greatest(300.0 - F.count("*"), F.lit(0.0)).alias("throughput_deficit")
    )
    rows = days.unpivot("day", ["error_rate", "cost_per_query", "throughput_deficit"], "name", "value")
    return rows.withColumn("threshold", F.when(F.col("name") == "error_rate", 0.2).when(F.col("name") == "cost_per_query", 0.1).otherwise(0.0))


@plans.query(f"WITH {_SLIS} SELECT CAST(day AS VARCHAR) AS day, name, round(value, 6) AS value, value > threshold AS violated FROM s")
def service_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each day's service level indicators, and which of them are above their threshold."""
    return slis(spark, sf_dir).select(F.col("day").cast("string").alias("day"), "name", F.round("value", 6).alias("value"), (F.col("value") > F.col("threshold")).alias("violated"))


@plans.query(f"""
WITH {_SLIS}, p AS (SELECT *, CASE WHEN threshold <= 0 THEN least({D(1)}, value / greatest({D(0.000000001)}, threshold + 1)) ELSE least({D(1)}, greatest({D(0)}, (value - threshold) / threshold)) END AS penalty FROM s)
SELECT CAST(day AS VARCHAR) AS day, round(100 * avg(1 - penalty), 4) AS score, CAST(sum(CASE WHEN value > threshold THEN 1 ELSE 0 END) AS BIGINT) AS violations FROM p GROUP BY day
""")
def reliability_by_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each day's reliability score out of its indicators, all of equal weight."""
    over = F.when(F.col("threshold") <= 0, F.least(F.lit(1.0), F.col("value") / (F.col("threshold") + 1)))
    penalty = over.otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), (F.col("value") - F.col("threshold")) / F.col("threshold"))))
    violated = F.when(F.col("value") > F.col("threshold"), 1).otherwise(0)
    return slis(spark, sf_dir).groupBy(F.col("day").cast("string").alias("day")).agg(F.round(100 * F.avg(1 - penalty), 4).alias("score"), F.sum(violated).alias("violations"))


@plans.query(f"""
WITH b AS (SELECT user_id, avg(value) / 100 AS lexical, min(value) / 100 AS crossed FROM events WHERE ts > (SELECT max(ts) FROM events) - INTERVAL 20 DAY GROUP BY user_id),
h AS (SELECT user_id FROM b WHERE lexical > 0.45 AND crossed < 0.02)
SELECT b.user_id, h.user_id IS NOT NULL AS hard, round(lexical * CASE WHEN h.user_id IS NULL THEN {D(1)} ELSE {D(0.7)} END, 6) AS score FROM b LEFT JOIN h ON b.user_id = h.user_id
""")
def penalised_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users that one score ranks high and the other low are hard negatives of the window, and are scored down."""
    rows = events(spark, sf_dir)
    last = rows.agg(F.max("ts")).scalar()
    both = rows.where(F.col("ts") > last - F.expr("INTERVAL 20 DAY")).groupBy("user_id").agg((F.avg("value") / 100).alias("lexical"), (F.min("value") / 100).alias("crossed"))
    hard = (F.col("lexical") > 0.45) & (F.col("crossed") < 0.02)
    return both.select("user_id", hard.alias("hard"), F.round(F.col("lexical") * F.when(hard, 0.7).otherwise(1.0), 6).alias("score"))


@plans.query("""
SELECT event_type, CAST(CAST(ts AS DATE) AS VARCHAR) AS day, count(*) AS n, round(min(value), 6) AS least, round(avg(value), 6) AS mean, round(max(value), 6) AS most, round(quantile_cont(value, 0.25), 6) AS q1, round(quantile_cont(value, 0.5), 6) AS q2, round(quantile_cont(value, 0.75), 6) AS q3,
  round(sum(CASE WHEN value < 10 THEN 1.0 ELSE 0.0 END) / count(*), 6) AS starved FROM events GROUP BY 1, 2
""")
def stage_diagnostics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Least, mean, greatest and quartiles of each stage's values by day, and the share of starved ones."""
    rows = events(spark, sf_dir).withColumn("day", F.to_date("ts").cast("string"))
    at = quantiles(rows, ["event_type", "day"], "value", {"q1": 0.25, "q2": 0.5, "q3": 0.75})
    starved = F.when(F.col("value") < 10, 1.0).otherwise(0.0)
    whole = rows.groupBy("event_type", "day").agg(
        F.count("*").alias("n"), F.round(F.min("value"), 6).alias("least"), F.round(F.avg("value"), 6).alias("mean"), F.round(F.max("value"), 6).alias("most"), F.round(F.sum(starved) / F.count("*"), 6).alias("starved")
    )
    return whole.join(at, ["event_type", "day"], "left").select("event_type", "day", "n", "least", "mean", "most", *[F.round(c, 6).alias(c) for c in ("q1", "q2", "q3")], "starved")


@plans.query(f"""
WITH f AS (SELECT user_id, date_trunc('week', ts) AS week, event_id, value >= 90 AS hit, row_number() OVER (PARTITION BY user_id, date_trunc('week', ts) ORDER BY event_id) AS r FROM events),
m AS (SELECT week, avg(rr) AS mrr FROM (SELECT user_id, week, coalesce(max(CASE WHEN hit THEN {D(1)} / r END), {D(0)}) AS rr FROM f GROUP BY user_id, week) GROUP BY week)
SELECT CAST(CAST(week AS DATE) AS VARCHAR) AS week, round(mrr, 6) AS mrr, round(mrr - lag(mrr) OVER (ORDER BY week), 6) AS delta FROM m
""")
def mrr_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean reciprocal rank of the first hit by week, and how it changed; there is a row for each week only."""
    rows = events(spark, sf_dir).withColumn("week", F.to_date(F.date_trunc("week", "ts")))
    r = F.row_number().over(Window.partitionBy("user_id", "week").orderBy("event_id"))
    first = rows.withColumn("r", r).groupBy("user_id", "week").agg(F.coalesce(F.max(F.when(F.col("value") >= 90, 1.0 / F.col("r"))), F.lit(0.0)).alias("rr"))
    weeks = first.groupBy("week").agg(F.avg("rr").alias("mrr"))
    return weeks.select(F.col("week").cast("string").alias("week"), F.round("mrr", 6).alias("mrr"), F.round(F.col("mrr") - F.lag("mrr").over(Window.orderBy("week")), 6).alias("delta"))


_BASE = """
b AS (SELECT event_type, sum(CASE WHEN user_id % 2 = 0 THEN 1 ELSE 0 END) AS base, sum(CASE WHEN user_id % 2 = 1 THEN 1 ELSE 0 END) AS now FROM events GROUP BY event_type),
t AS (SELECT CAST(sum(base) AS DOUBLE) AS base_all, CAST(sum(now) AS DOUBLE) AS now_all FROM b)
"""


@plans.query(f"""
WITH {_BASE}, x AS (SELECT event_type, base / base_all AS base_share, now / now_all AS now_share, pow(now - base / base_all * now_all, 2) / (base / base_all * now_all) AS chi FROM b, t)
SELECT event_type, round(base_share, 6) AS base_share, round(now_share, 6) AS now_share, round(chi, 6) AS chi, (SELECT sum(chi) FROM x) > 9.488 AS drifted FROM x
""")
def baseline_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shares of kinds in one half against those in the other as a frozen baseline, and whether they have drifted."""
    half = lambda n: F.sum(F.when(F.col("user_id") % 2 == n, 1).otherwise(0))
    counts = events(spark, sf_dir).groupBy("event_type").agg(half(0).alias("base"), half(1).alias("now"))
    every = Window.partitionBy(F.lit(0))  # as many rows as there are kinds
    rows = counts.withColumn("base_share", F.col("base") / F.sum("base").over(every)).withColumn("now_all", F.sum("now").over(every))
    expected = F.col("base_share") * F.col("now_all")
    rows = rows.withColumn("chi", F.pow(F.col("now") - expected, 2) / expected)
    shares = [F.round("base_share", 6).alias("base_share"), F.round(F.col("now") / F.col("now_all"), 6).alias("now_share"), F.round("chi", 6).alias("chi")]
    return rows.select("event_type", *shares, (F.sum("chi").over(every) > 9.488).alias("drifted"))


@plans.query("SELECT o_orderpriority AS field, o_orderstatus AS status, count(*) AS changes, count(DISTINCT o_custkey) AS agents, max(o_orderdate) AS last_change FROM orders GROUP BY CUBE (o_orderpriority, o_orderstatus)")
def change_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Changes and who made them by field, by status, by both and in all."""
    rows = table(spark, sf_dir, "orders").cube(F.col("o_orderpriority").alias("field"), F.col("o_orderstatus").alias("status"))
    return rows.agg(F.count("*").alias("changes"), F.countDistinct("o_custkey").alias("agents"), F.max("o_orderdate").alias("last_change"))


@plans.query(f"""
WITH r AS (SELECT l_suppkey, sum(CASE WHEN l_returnflag = 'R' THEN 0 ELSE 1 END) AS good, count(*) AS n FROM lineitem GROUP BY l_suppkey),
s AS (SELECT n_regionkey AS domain, l_suppkey AS provider, (good + 1) / {D('n + 2')} AS reliability FROM r JOIN supplier ON s_suppkey = l_suppkey JOIN nation ON n_nationkey = s_nationkey)
SELECT domain, provider, round(reliability, 6) AS reliability, row_number() OVER (PARTITION BY domain ORDER BY reliability DESC, provider) AS rank FROM s
""")
def provider_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers of each region ranked by how reliable their deliveries were."""
    t = lambda name: table(spark, sf_dir, name)
    good = F.sum(F.when(F.col("l_returnflag") == "R", 0).otherwise(1))
    rates = t("lineitem").groupBy(F.col("l_suppkey").alias("provider")).agg(((good + 1) / (F.count("*") + 2)).alias("reliability"))
    rows = rates.join(t("supplier"), F.col("s_suppkey") == F.col("provider")).join(t("nation"), F.col("n_nationkey") == F.col("s_nationkey"))
    rank = F.row_number().over(Window.partitionBy("n_regionkey").orderBy(F.col("reliability").desc(), "provider"))
    return rows.select(F.col("n_regionkey").alias("domain"), "provider", F.round("reliability", 6).alias("reliability"), rank.alias("rank"))


@plans.query("""
SELECT source, lang, count(*) AS n, round(avg(CASE WHEN length(trim(text)) = 0 THEN 1.0 ELSE 0.0 END), 6) AS empty_rate, round(avg(length(text)), 4) AS mean_length, round(avg(CASE WHEN length(text) < 200 THEN 1.0 ELSE 0.0 END), 6) AS short_rate FROM documents GROUP BY source, lang
""")
def extraction_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of empty and of short texts by source and language, and how long they are."""
    share = lambda c: F.round(F.avg(F.when(c, 1.0).otherwise(0.0)), 6)
    return table(spark, sf_dir, "documents").groupBy("source", "lang").agg(
        F.count("*").alias("n"), share(F.length(F.trim("text")) == 0).alias("empty_rate"), F.round(F.avg(F.length("text")), 4).alias("mean_length"), share(F.length("text") < 200).alias("short_rate")
    )


_SCORES = f"""
q AS (SELECT a.vec_id AS qid, a.label AS q_label, b.vec_id, b.label, list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) AS s FROM embeddings a JOIN embeddings b ON a.vec_id % 20 = 0 AND a.vec_id <> b.vec_id),
k AS (SELECT qid, q_label, label = q_label AS hit, row_number() OVER (PARTITION BY qid ORDER BY round(s, 6) DESC, vec_id) AS r FROM q),
z AS (SELECT label, count(*) - 1 AS relevant FROM embeddings GROUP BY label),
c AS (SELECT qid, q_label, CAST(sum(CASE WHEN hit AND r <= 10 THEN 1 ELSE 0 END) AS DOUBLE) AS hits, coalesce(max(CASE WHEN hit AND r <= 10 THEN {D(1)} / r END), {D(0)}) AS rr FROM k GROUP BY qid, q_label)
"""


@plans.query(f"""
WITH {_SCORES} SELECT coalesce(CAST(q_label AS VARCHAR), 'all') AS kind, count(*) AS questions, round(avg(hits / 10), 6) AS precision, round(avg(hits / greatest(relevant, 1)), 6) AS recall, round(avg(CASE WHEN hits > 0 THEN 1.0 ELSE 0.0 END), 6) AS recall_any,
  round(avg(CASE WHEN hits >= relevant THEN 1.0 ELSE 0.0 END), 6) AS recall_all, round(avg(rr), 6) AS mrr FROM c JOIN z ON z.label = c.q_label GROUP BY ROLLUP (q_label)
""")
def retrieval_scorecard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Precision, recall, any, all and reciprocal rank at ten by label and over all, for the stated query vectors."""
    from .ranking import knn_cosine

    rows = table(spark, sf_dir, "embeddings").select("vec_id", "label")
    near = knn_cosine(spark, sf_dir)
    labelled = near.join(rows, "vec_id").join(rows.select(F.col("vec_id").alias("qid"), F.col("label").alias("q_label")), "qid")
    hit = F.col("label") == F.col("q_label")
    each = labelled.groupBy("qid", "q_label").agg(F.sum(F.when(hit, 1.0).otherwise(0.0)).alias("hits"), F.coalesce(F.max(F.when(hit, 1.0 / F.col("rank"))), F.lit(0.0)).alias("rr"))
    known = each.join(rows.groupBy(F.col("label").alias("q_label")).agg((F.count("*") - 1).alias("relevant")), "q_label")
    mean = lambda c: F.round(F.avg(c), 6)
    share = lambda c: mean(F.when(c, 1.0).otherwise(0.0))
    out = known.rollup("q_label").agg(
        F.count("*").alias("questions"),
        mean(F.col("hits") / 10).alias("precision"),
        mean(F.col("hits") / F.greatest("relevant", F.lit(1))).alias("recall"),
        share(F.col("hits") > 0).alias("recall_any"),
        share(F.col("hits") >= F.col("relevant")).alias("recall_all"),
        mean(F.col("rr")).alias("mrr"),
    )
    return out.select(F.coalesce(F.col("q_label").cast("string"), F.lit("all")).alias("kind"), *out.columns[1:])


@plans.query(f"""
WITH p AS (SELECT conv_id, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS r, length(text) // 4 AS tokens FROM conversations),
l AS (SELECT conv_id, list_distinct(regexp_extract_all(lower(text), '[a-z]{{4,}}')) AS words FROM p WHERE r = 1)
SELECT conv_id, round(sum(CASE WHEN list_has_any(regexp_extract_all(lower(text), '[a-z]{{4,}}'), words) THEN tokens ELSE 0 END) / {D('greatest(sum(tokens), 1)')}, 6) AS packing_quality FROM p JOIN l USING (conv_id) WHERE r > 1 GROUP BY conv_id
""")
def packing_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of a conversation's packed tokens that stand in turns its last turn takes words from."""
    turns = table(spark, sf_dir, "conversations").withColumn("r", F.row_number().over(Window.partitionBy("conv_id").orderBy(F.col("turn").desc())))
    said = F.regexp_extract_all(F.lower("text"), F.lit("[a-z]{4,}"), F.lit(0))
    rows = turns.select("conv_id", "r", said.alias("w"), F.floor(F.length("text") / 4).alias("tokens"))
    last = rows.where("r = 1").select("conv_id", F.array_distinct("w").alias("words"))
    used = F.sum(F.when(F.arrays_overlap("w", "words"), F.col("tokens")).otherwise(0))
    return rows.where("r > 1").join(last, "conv_id").groupBy("conv_id").agg(F.round(used / F.greatest(F.sum("tokens"), F.lit(1)), 6).alias("packing_quality"))


@plans.query(f"SELECT o_custkey, count(*) AS critiques, round(sum(o_totalprice * CAST(substr(o_orderpriority, 1, 1) AS INTEGER)) / sum(CAST(substr(o_orderpriority, 1, 1) AS INTEGER)), 1) AS weighted FROM orders GROUP BY o_custkey")
def weighted_critiques(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean of each customer's orders, weighted by their priority's number."""
    weight = F.substring("o_orderpriority", 1, 1).cast("int")
    return table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count("*").alias("critiques"), F.round(F.sum(F.col("o_totalprice") * weight) / F.sum(weight), 1).alias("weighted"))


@plans.query(f"""
WITH s AS (SELECT user_id, event_id, value, lag(value) OVER (PARTITION BY user_id ORDER BY event_id) AS before, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events),
a AS (SELECT user_id, {D(1)} / (1 + n % 10) AS baseline, {D(1)} / (1 + (n * 3) % 10) AS candidate FROM s WHERE before IS NOT NULL)
SELECT count(*) AS signals, round(avg(baseline), 6) AS baseline_mrr, round(avg(candidate), 6) AS candidate_mrr, round(avg(candidate) - avg(baseline), 6) AS gain, avg(candidate) - avg(baseline) >= 0.01 AS promoted FROM a
""")
def candidate_trial(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A candidate ranking replayed against the baseline's, and whether it gains enough to be promoted."""
    by_user = Window.partitionBy("user_id").orderBy("event_id")
    rows = events(spark, sf_dir).select(F.row_number().over(by_user).alias("n"), F.lag("value").over(by_user).alias("before")).where("before IS NOT NULL")
    baseline, candidate = F.avg(1.0 / (1 + F.col("n") % 10)), F.avg(1.0 / (1 + (F.col("n") * 3) % 10))
    gain = candidate - baseline
    return rows.agg(F.count("*").alias("signals"), F.round(baseline, 6).alias("baseline_mrr"), F.round(candidate, 6).alias("candidate_mrr"), F.round(gain, 6).alias("gain"), (gain >= 0.01).alias("promoted"))


QUERIES, SQL = plans.queries, plans.sql
