"""Queries over time: scores, versions, tiers, logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import scoring
from ..operators import timeline
from ..operators.quantiles import quantiles
from ..sources.tables import table
from .registering import Plans

plans = Plans()
AS_OF = "2001-08-02"
#: The status letters of orders, as statuses of records.
STATUS = {"F": "verified", "O": "active", "P": "draft"}
_STATUS_SQL = "CASE o_orderstatus WHEN 'F' THEN 'verified' WHEN 'O' THEN 'active' WHEN 'P' THEN 'draft' END"
_DAYS = f"date_diff('day', CAST(o_orderdate AS DATE), DATE '{AS_OF}')"
F1 = "CAST({} AS DOUBLE)".format


def _orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = F.lit(None).cast("string")
    for letter, name in STATUS.items():
        status = F.when(F.col("o_orderstatus") == letter, name).otherwise(status)
    return table(spark, sf_dir, "orders").withColumn("status", status)


@plans.query(f"""
SELECT o_orderkey, round(CASE WHEN d <= 0 THEN {F1(1)} ELSE greatest({F1(0.1)}, 1 - d / {F1(365)}) END, 6) AS recent,
       round(CASE WHEN d <= 0 THEN {F1(1)} ELSE greatest(pow({F1(0.5)}, d / {F1(90)}), {F1(0.000001)}) END, 6) AS half_life
FROM (SELECT o_orderkey, {_DAYS} AS d FROM orders)
""")
def date_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How recent each order is, on the straight scale of a year and by half-lives of 90 days."""
    day = F.col("o_orderdate")
    return table(spark, sf_dir, "orders").select("o_orderkey", F.round(scoring.date_score(day, AS_OF), 6).alias("recent"), F.round(scoring.half_life(day, AS_OF), 6).alias("half_life"))


@plans.query(f"""
WITH a AS (SELECT l_orderkey, count(*) AS n, sum(CASE WHEN l_returnflag = 'R' THEN {F1(0.5)} ELSE 0 END) AS against FROM lineitem GROUP BY l_orderkey),
b AS (SELECT o_orderkey, CASE {_STATUS_SQL} WHEN 'verified' THEN {F1(0.92)} WHEN 'active' THEN {F1(0.75)} WHEN 'draft' THEN {F1(0.55)} ELSE {F1(0.6)} END AS prior, greatest({_DAYS}, 0) AS d, coalesce(n, 0) AS n, coalesce(against, 0) AS against FROM orders LEFT JOIN a ON l_orderkey = o_orderkey)
SELECT o_orderkey, round(greatest({F1(0.01)}, least({F1(0.99)}, prior * pow({F1(0.5)}, d / {F1(180)}) - least(against * {F1(0.18)}, prior * {F1(0.9)}) + CASE WHEN n > 0 THEN least({F1(0.1)}, ln(1 + n) / {F1(30)}) ELSE 0 END)), 4) AS truth FROM b
""")
def truth_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far to trust each order: its status and age, its lines as uses, returned lines as contradictions."""
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("n"), F.sum(F.when(F.col("l_returnflag") == "R", 0.5).otherwise(0.0)).alias("against"))
    both = _orders(spark, sf_dir).join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    return both.select("o_orderkey", scoring.truth(F.col("status"), F.col("o_orderdate"), F.coalesce("n", F.lit(0)), F.col("against"), AS_OF).alias("truth"))


@plans.query("""
SELECT l_partkey, CAST(a AS BIGINT) AS accepted, CAST(r AS BIGINT) AS rejected, CAST(i AS BIGINT) AS ignored,
       round(CASE WHEN a + r + i < 3 THEN CAST(1 AS DOUBLE) ELSE greatest(CAST(0.5 AS DOUBLE), least(CAST(1.5 AS DOUBLE), CAST(0.5 AS DOUBLE) + (a + 1) / (a + r + i * CAST(0.3 AS DOUBLE) + 2))) END, 6) AS weight
FROM (SELECT l_partkey, sum(CASE WHEN l_returnflag = 'A' THEN 1 ELSE 0 END) AS a, sum(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) AS r, sum(CASE WHEN l_returnflag = 'N' THEN 1 ELSE 0 END) AS i FROM lineitem GROUP BY l_partkey)
""")
def calibration_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The weight of each part by what became of its lines: accepted, returned, or neither."""
    n = lambda flag, name: F.sum(F.when(F.col("l_returnflag") == flag, 1).otherwise(0)).alias(name)
    votes = table(spark, sf_dir, "lineitem").groupBy("l_partkey").agg(n("A", "accepted"), n("R", "rejected"), n("N", "ignored"))
    weight = scoring.calibration(F.col("accepted"), F.col("rejected"), F.col("ignored"))
    return votes.select("l_partkey", "accepted", "rejected", "ignored", F.round(weight, 6).alias("weight"))


@plans.query("""
SELECT o_custkey, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS o_orderkey, arg_max(o_orderpriority, (o_orderdate, o_orderkey)) AS o_orderpriority, CAST(count(*) AS BIGINT) AS version
FROM orders WHERE o_orderdate <= TIMESTAMP '1998-06-30' GROUP BY o_custkey
""")
def as_of_version(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each customer as of a day: their latest order until then, and how many there were."""
    edits = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderdate", "o_orderpriority")
    return timeline.as_of(edits, "o_custkey", "1998-06-30", "o_orderdate", "o_orderkey").select("o_custkey", "o_orderkey", "o_orderpriority", "version")


@plans.query("""
SELECT c.event_id, c.user_id, p.value AS last_purchase
FROM (SELECT event_id, user_id, ts FROM events WHERE event_type = 'click') c
ASOF LEFT JOIN (SELECT user_id, ts, max(value) AS value FROM events WHERE event_type = 'purchase' GROUP BY ALL) p ON c.user_id = p.user_id AND c.ts >= p.ts
""")
def as_of_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each click with the value of the user's last purchase at or before it."""
    events = table(spark, sf_dir, "events")
    clicks = events.where(F.col("event_type") == "click").select("event_id", "user_id", "ts")
    buys = events.where(F.col("event_type") == "purchase").groupBy("user_id", "ts").agg(F.max("value").alias("value"))
    return timeline.as_of_join(clicks, buys, "user_id", "ts", "ts", "value").select("event_id", "user_id", F.col("value").alias("last_purchase"))


@plans.query("""
SELECT o_orderkey, o_orderpriority FROM orders WHERE strftime(o_orderdate, '%Y-%m-%d') BETWEEN '1996-01-01' AND '1999-12-31' AND lower(o_orderpriority) IN ('1-urgent', '2-high') AND o_orderstatus <> 'P'
""")
def post_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders of a range of days, of high priority, that are not drafts."""
    keep = timeline.in_range(F.col("o_orderdate"), "1996-01-01", "1999-12-31") & F.lower("o_orderpriority").isin("1-urgent", "2-high") & (F.col("o_orderstatus") != "P")
    return table(spark, sf_dir, "orders").where(keep).select("o_orderkey", "o_orderpriority")


_USE = """
u AS (SELECT user_id, count(*) AS n, sum(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END) AS c, date_diff('second', min(ts), TIMESTAMP '2024-02-01') / CAST(3600 AS DOUBLE) AS age, date_diff('second', max(ts), TIMESTAMP '2024-02-01') / CAST(3600 AS DOUBLE) AS idle FROM events GROUP BY user_id),
t AS (SELECT *, CASE WHEN n >= 70 THEN 'long_term' WHEN n >= 60 THEN 'shared' ELSE 'working' END AS tier FROM u)
"""


def _use(spark: SparkSession, sf_dir: str) -> DataFrame:
    hours = lambda c: (F.lit("2024-02-01").cast("timestamp").cast("long") - F.date_trunc("second", c).cast("timestamp").cast("long")) / 3600.0
    use = table(spark, sf_dir, "events").groupBy("user_id").agg(F.count("*").alias("n"), F.sum(F.when(F.col("event_type") == "purchase", 1).otherwise(0)).alias("c"), F.min("ts").alias("first"), F.max("ts").alias("last"))
    tier = F.when(F.col("n") >= 70, "long_term").when(F.col("n") >= 60, "shared").otherwise("working")
    return use.withColumn("age", hours(F.col("first"))).withColumn("idle", hours(F.col("last"))).withColumn("tier", tier)


@plans.query(f"""WITH {_USE} SELECT user_id, tier, CASE WHEN tier = 'working' AND n >= 3 AND age >= 1 THEN 'shared' WHEN tier = 'shared' AND n >= 10 AND age >= 24 AND c >= 2 THEN 'long_term' WHEN tier = 'long_term' AND c >= 5 THEN 'verified' ELSE tier END AS next_tier FROM t""")
def tier_promotion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The users' tiers after a promotion: uses, age and purchases as confirmations."""
    return _use(spark, sf_dir).select("user_id", "tier", timeline.promoted(F.col("tier"), F.col("n"), F.col("age"), F.col("c")).alias("next_tier"))


@plans.query(f"""WITH {_USE} SELECT user_id, tier, CASE WHEN tier = 'working' AND idle > 168 THEN 'evicted' WHEN tier = 'shared' AND idle > 336 THEN 'working' WHEN tier = 'long_term' AND idle > 1440 THEN 'shared' WHEN tier = 'verified' AND idle > 4320 THEN 'long_term' ELSE tier END AS next_tier FROM t""")
def tier_decay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The users' tiers after lying idle."""
    return _use(spark, sf_dir).select("user_id", "tier", timeline.decayed(F.col("tier"), F.col("idle")).alias("next_tier"))


@plans.query("""
SELECT event_id, CAST(count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 1 HOUR PRECEDING AND CURRENT ROW) AS BIGINT) AS recent FROM events
""")
def rate_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many of its user's events fall in the hour that ends with each event."""
    return timeline.within_window(table(spark, sf_dir, "events"), "user_id", "ts", 3600).select("event_id", "recent")


@plans.query("""
SELECT CAST(isoyear(ts) AS INTEGER) AS year, CAST(week(ts) AS INTEGER) AS week, round(avg(rr), 6) AS mrr, CAST(count(*) AS BIGINT) AS sessions
FROM (SELECT user_id, CAST(ts AS DATE) AS day, min(ts) AS ts, coalesce(1 / CAST(min(CASE WHEN event_type = 'purchase' THEN place END) AS DOUBLE), 0) AS rr
      FROM (SELECT *, row_number() OVER (PARTITION BY user_id, CAST(ts AS DATE) ORDER BY ts, event_id) AS place FROM events) GROUP BY ALL)
GROUP BY ALL
""")
def weekly_mrr(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By ISO week, the mean reciprocal place of a user's first purchase of a day."""
    events = table(spark, sf_dir, "events").withColumn("day", F.to_date("ts"))
    placed = events.withColumn("place", F.row_number().over(Window.partitionBy("user_id", "day").orderBy("ts", "event_id")))
    days = placed.groupBy("user_id", "day").agg(F.coalesce(1.0 / F.min(F.when(F.col("event_type") == "purchase", F.col("place"))), F.lit(0.0)).alias("rr"))
    return days.groupBy(F.extract(F.lit("YEAROFWEEK"), "day").cast("int").alias("year"), F.weekofyear("day").alias("week")).agg(F.round(F.avg("rr"), 6).alias("mrr"), F.count("*").alias("sessions"))


@plans.query("""
SELECT event_type, CAST(count(*) AS BIGINT) AS n, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95, round(quantile_cont(value, 0.99), 6) AS p99, round(avg(value), 6) AS mean, min(value) AS least, max(value) AS most FROM events GROUP BY event_type
""")
def stage_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Percentiles of the values of each kind of event, exact and interpolated: equal values are counted first."""
    rows = table(spark, sf_dir, "events")
    at = quantiles(rows, ["event_type"], "value", {"p50": 0.5, "p95": 0.95, "p99": 0.99})
    whole = rows.groupBy("event_type").agg(F.count("*").alias("n"), F.round(F.avg("value"), 6).alias("mean"), F.min("value").alias("least"), F.max("value").alias("most"))
    return whole.join(at, "event_type", "left").select("event_type", "n", *[F.round(c, 6).alias(c) for c in ("p50", "p95", "p99")], "mean", "least", "most")


@plans.query("""
WITH b AS (SELECT event_type, sum(CASE WHEN ts < TIMESTAMP '2024-01-16' THEN 1 ELSE 0 END) AS base, sum(CASE WHEN ts >= TIMESTAMP '2024-01-16' THEN 1 ELSE 0 END) AS observed FROM events GROUP BY event_type),
e AS (SELECT *, base * CAST(sum(observed) OVER () AS DOUBLE) / sum(base) OVER () AS expected FROM b)
SELECT event_type, CAST(observed AS BIGINT) AS observed, round(expected, 6) AS expected, round((observed - expected) * (observed - expected) / expected, 6) AS part FROM e
""")
def intent_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each kind of event's part of chi-squared, the second half of the month against the first."""
    late = F.col("ts") >= F.lit("2024-01-16").cast("timestamp")
    counts = table(spark, sf_dir, "events").groupBy("event_type").agg(F.sum((~late).cast("int")).alias("base"), F.sum(late.cast("int")).alias("observed"))
    whole = Window.partitionBy(F.lit(0))  # a row for each kind of event
    expected = F.col("base") * F.sum("observed").over(whole).cast("double") / F.sum("base").over(whole)
    rows = counts.withColumn("expected", expected)
    gap = F.col("observed") - F.col("expected")
    return rows.select("event_type", "observed", F.round("expected", 6).alias("expected"), F.round(gap * gap / F.col("expected"), 6).alias("part"))


@plans.query("""
WITH v AS (SELECT l_partkey, l_suppkey, l_returnflag, max(l_quantity) AS trust FROM lineitem GROUP BY ALL),
t AS (SELECT l_partkey, l_returnflag, sum(trust) AS weight FROM v GROUP BY ALL),
n AS (SELECT l_partkey, count(DISTINCT l_suppkey) AS voters FROM lineitem GROUP BY l_partkey),
b AS (SELECT l_partkey, arg_max(l_returnflag, (weight, l_returnflag)) AS flag, max(weight) AS best, sum(weight) AS everything FROM t GROUP BY l_partkey)
SELECT b.l_partkey, CASE WHEN voters >= 2 AND best / everything >= CAST(0.66 AS DOUBLE) THEN flag END AS winner, round(best / everything, 6) AS share, CAST(voters AS BIGINT) AS voters FROM b JOIN n ON b.l_partkey = n.l_partkey
""")
def consensus_votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a part's suppliers agree on: their return flags, weighed by quantity."""
    return timeline.consensus(table(spark, sf_dir, "lineitem"), "l_partkey", "l_suppkey", "l_returnflag", "l_quantity")


@plans.query("""
SELECT conv_id, turn, CASE WHEN previous IS NULL THEN 'first' WHEN j >= CAST(0.55 AS DOUBLE) THEN 'requery' WHEN j >= CAST(0.2 AS DOUBLE) THEN 'refinement' ELSE 'new' END AS class, round(j, 6) AS similarity
FROM (SELECT conv_id, turn, previous, CASE WHEN len(list_distinct(list_concat(w, previous))) > 0 THEN len(list_intersect(w, previous)) / CAST(len(list_distinct(list_concat(w, previous))) AS DOUBLE) ELSE 0 END AS j
  FROM (SELECT conv_id, turn, w, lag(w) OVER (PARTITION BY conv_id ORDER BY turn, w) AS previous FROM (SELECT conv_id, turn, list_distinct(regexp_extract_all(lower(text), '[a-z0-9_]+')) AS w FROM (SELECT conv_id, turn, min(text) AS text FROM conversations WHERE role = 'user' GROUP BY ALL))))
""")
def next_query_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether each user turn asks again, refines or starts anew, by its words and those of the turn before."""
    from ..functions.text import words

    turns = table(spark, sf_dir, "conversations").where(F.col("role") == "user").groupBy("conv_id", "turn").agg(F.min("text").alias("text"))
    rows = turns.select("conv_id", "turn", F.array_distinct(words(F.col("text"))).alias("w"))
    rows = rows.withColumn("previous", F.lag("w").over(Window.partitionBy("conv_id").orderBy("turn")))
    union = F.size(F.array_union("w", "previous"))
    j = F.when(union > 0, F.size(F.array_intersect("w", "previous")) / union).otherwise(0.0)
    kind = F.when(F.col("previous").isNull(), "first").when(j >= 0.55, "requery").when(j >= 0.2, "refinement").otherwise("new")
    return rows.select("conv_id", "turn", kind.alias("class"), F.round(j, 6).alias("similarity"))


@plans.query("""
SELECT user_id, strftime(ts, '%Y-%m-%d') AS day, CAST(count(*) AS BIGINT) AS events, round(sum(value), 4) AS value, CAST(sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) AS BIGINT) AS errors FROM events GROUP BY ALL
""")
def daily_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events, their value and errors by user and day."""
    return table(spark, sf_dir, "events").groupBy("user_id", F.date_format("ts", "yyyy-MM-dd").alias("day")).agg(F.count("*").alias("events"), F.round(F.sum("value"), 4).alias("value"), F.sum((F.col("event_type") == "error").cast("int")).alias("errors"))


QUERIES, SQL = plans.queries, plans.sql
