"""Queries over questions, the life of records, packing and conflicts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import understanding
from ..functions.text import STOPWORDS, words
from ..operators import lifecycle, similarity
from ..sources.tables import table
from . import sql
from .registering import Plans

plans = Plans()
D = "CAST({} AS DOUBLE)".format


def _count(pattern: str) -> str:
    return f"len(regexp_extract_all(low, '{pattern}'))"


def _has(pattern: str) -> str:
    return f"regexp_matches(low, '{pattern}')"


_KINDS = f"""
m AS (SELECT *, regexp_replace(lower(text), '[\\x{{C0}}-\\x{{24F}}]', 'x', 'g') AS low, len(list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '')) AS n_words FROM conversations),
n AS (SELECT *, {_count(understanding.TEMPORAL)} AS t, {_count(understanding.MULTIHOP)} AS h FROM m),
k AS (SELECT *, t * {D(2)} AS a,
        {_count(understanding.ADVERSARIAL)} * {D(2.5)} + CASE WHEN {_has(understanding.DENIED)} THEN 3 ELSE 0 END + CASE WHEN {_has(r"\bever\b")} THEN 2 ELSE 0 END + CASE WHEN {_has(understanding.VERIFYING)} THEN {D(1.5)} ELSE 0 END AS b,
        h * {D(1.5)} + CASE WHEN length(text) - length(replace(text, '?', '')) > 1 THEN 1 ELSE 0 END + CASE WHEN t > 0 AND {_has(understanding.DATED_ACTION)} THEN {D(1.5)} ELSE 0 END + CASE WHEN n_words > 15 AND h > 0 THEN 2 ELSE 0 END AS c
      FROM n),
q AS (SELECT *, CASE WHEN greatest(a, b, c) < {D(1.5)} THEN CASE WHEN n_words <= 10 AND {_has(understanding.OPEN)} THEN 'open-domain' ELSE 'single-hop' END WHEN a >= b AND a >= c THEN 'temporal' WHEN b >= c THEN 'adversarial' ELSE 'multi-hop' END AS kind FROM k)
"""


@plans.query(f"WITH {_KINDS} SELECT conv_id, turn, role, kind, md5(text) AS digest FROM q")
def question_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What kind of question each turn asks."""
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", understanding.question_kind(F.col("text")).alias("kind"), F.md5("text").alias("digest"))


@plans.query(f"WITH {_KINDS} SELECT role, kind, CAST(count(*) AS BIGINT) AS n, round(count(*) / CAST(sum(count(*)) OVER (PARTITION BY role) AS DOUBLE), 6) AS share FROM q GROUP BY role, kind")
def kind_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How the kinds of questions are spread, by role."""
    turns = table(spark, sf_dir, "conversations").select("role", understanding.question_kind(F.col("text")).alias("kind"))
    counts = turns.groupBy("role", "kind").agg(F.count("*").alias("n"))
    return counts.withColumn("share", F.round(F.col("n") / F.sum("n").over(Window.partitionBy("role")), 6))


_USERS = f"""
u AS (SELECT user_id, count(*) AS n, date_diff('day', CAST(max(ts) AS DATE), DATE '2024-02-01') AS idle, count(DISTINCT event_type) AS kinds, sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) AS errors, avg(value) AS mean FROM events GROUP BY user_id)
"""


def _users(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (
        table(spark, sf_dir, "events")
        .groupBy("user_id")
        .agg(
            F.count("*").alias("n"),
            F.datediff(F.lit("2024-02-01").cast("date"), F.max("ts").cast("date")).alias("idle"),
            F.count_distinct("event_type").alias("kinds"),
            F.sum((F.col("event_type") == "error").cast("int")).alias("errors"),
            F.avg("value").alias("mean"),
        )
    )


@plans.query(f"WITH {_USERS} SELECT user_id, round(greatest({D(0.8)}, least({D(1.5)}, {D(0.8)} + {D(0.35)} * ({D(0.4)} * ln(n + {D(1)}) + {D(0.4)} * exp(-idle / {D(30)}) + {D(0.2)} * ln(kinds + {D(1)})))), 6) AS importance FROM u")
def importance_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The importance of each user by use, freshness and kinds of events."""
    return _users(spark, sf_dir).select("user_id", F.round(lifecycle.importance(F.col("n"), F.col("idle"), F.col("kinds")), 6).alias("importance"))


@plans.query(f"""
SELECT o_orderkey, round({D(0.3)} * CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'P' THEN {D(0.5)} ELSE 0 END + {D(0.2)} * CASE WHEN o_orderpriority = '5-LOW' THEN 0 ELSE 1 END + {D(0.5)} * least({D(1)}, coalesce(n, 0) / {D(5)}), 6) AS maturity
FROM orders LEFT JOIN (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY l_orderkey) ON l_orderkey = o_orderkey
""")
def maturity_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How consolidated each order is: its status, its priority as lifecycle, its lines as edges."""
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("n"))
    both = table(spark, sf_dir, "orders").join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    active = F.when(F.col("o_orderstatus") == "F", 1.0).when(F.col("o_orderstatus") == "P", 0.5).otherwise(0.0)
    durable = F.when(F.col("o_orderpriority") == "5-LOW", 0.0).otherwise(1.0)
    return both.select("o_orderkey", F.round(lifecycle.maturity(active, durable, F.coalesce("n", F.lit(0))), 6).alias("maturity"))


@plans.query(f"""
WITH l AS (SELECT l_orderkey, count(DISTINCT l_suppkey) AS arms, sum(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) AS bad, count(*) AS n FROM lineitem GROUP BY l_orderkey),
v AS (SELECT o_orderkey, (CASE WHEN arms >= 2 THEN 1 ELSE {D(0.5)} END + CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'O' THEN {D(0.5)} ELSE 0 END + CASE WHEN bad > 0 THEN 0 ELSE 1 END + (1 - bad / CAST(n AS DOUBLE))) / {D(4)} AS validity, o_totalprice FROM orders JOIN l ON l_orderkey = o_orderkey)
SELECT o_orderkey, round(validity, 6) AS validity, round(o_totalprice * CASE WHEN validity < {D(0.8)} THEN {D(0.5)} ELSE 1 END, 4) AS gated FROM v
""")
def validity_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders scored by price, halved where corroboration, status, returns and freshness leave too much doubt."""
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count_distinct("l_suppkey").alias("arms"), F.sum((F.col("l_returnflag") == "R").cast("int")).alias("bad"), F.count("*").alias("n"))
    both = table(spark, sf_dir, "orders").join(lines, F.col("o_orderkey") == F.col("l_orderkey"))
    status = F.when(F.col("o_orderstatus") == "F", 1.0).when(F.col("o_orderstatus") == "O", 0.5).otherwise(0.0)
    value = lifecycle.validity(F.when(F.col("arms") >= 2, 1.0).otherwise(0.5), status, F.col("bad") > 0, F.col("bad") / F.col("n"))
    return both.withColumn("v", value).select("o_orderkey", F.round("v", 6).alias("validity"), F.round(F.col("o_totalprice") * F.when(F.col("v") < 0.8, 0.5).otherwise(1.0), 4).alias("gated"))


@plans.query(f"SELECT user_id, round(({D(50)} / {D(100)} + sum(value) / {D(25)}) / (1 / {D(100)} + count(value) / {D(25)}), 6) AS estimate, round(1 / (1 / {D(100)} + count(value) / {D(25)}), 9) AS variance, CAST(count(value) AS BIGINT) AS n FROM events GROUP BY user_id")
def belief_updates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What to believe of each user's value after all events, from a prior of 50."""
    out = lifecycle.beliefs(table(spark, sf_dir, "events"), "user_id", "value", 50.0, 100.0, 25.0)
    return out.select("user_id", F.round("estimate", 6).alias("estimate"), F.round("variance", 9).alias("variance"), "n")


@plans.query(f"""
SELECT user_id, round(sum({D(0.1)} * pow({D(0.9)}, r - 1) * good) + {D(0.5)} * pow({D(0.9)}, count(*)), 6) AS reliability
FROM (SELECT user_id, CASE WHEN event_type = 'error' THEN 0 ELSE 1 END AS good, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events) GROUP BY user_id
""")
def reliability_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How reliable each user's events were: an exponential mean, errors count against it."""
    out = lifecycle.reliability(table(spark, sf_dir, "events"), "user_id", ["ts", "event_id"], F.col("event_type") != "error")
    return out.select("user_id", F.round("reliability", 6).alias("reliability"))


@plans.query(f"WITH {_USERS} SELECT user_id, CASE WHEN idle > 3 THEN 'age' WHEN errors >= 15 THEN 'errors' WHEN n < 55 THEN 'unused' END AS policy FROM u WHERE idle > 3 OR errors >= 15 OR n < 55")
def eviction_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users that a policy evicts, and the first that does: idle, failing, or little used."""
    return lifecycle.eviction(_users(spark, sf_dir), [("age", F.col("idle") > 3), ("errors", F.col("errors") >= 15), ("unused", F.col("n") < 55)]).select("user_id", "policy")


@plans.query(f"""
WITH {_USERS} SELECT user_id, round({D(100)} * ({D(1)} * (1 - least({D(1)}, greatest({D(0)}, (errors - {D(10)}) / {D(10)}))) + {D(2)} * (1 - least({D(1)}, greatest({D(0)}, (mean - {D(50)}) / {D(50)}))) + 1) / {D(4)}, 6) AS score FROM u
""")
def reliability_composite(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A 0-100 score of each user: errors and mean value against thresholds."""
    out = lifecycle.composite_score(_users(spark, sf_dir), "user_id", [(F.col("errors"), 10.0, 1.0), (F.col("mean"), 50.0, 2.0), (F.col("n"), None, 1.0)])
    return out.select("user_id", F.round("score", 6).alias("score"))


@plans.query("""
SELECT l_orderkey, s // 1000 AS used, s % 1000 AS taken FROM (
  SELECT l_orderkey, list_reduce(costs, lambda s, c: CASE WHEN s // 1000 + c <= 100 THEN s + c * 1000 + 1 ELSE s END, CAST(0 AS BIGINT)) AS s
  FROM (SELECT l_orderkey, list(CAST(l_quantity AS BIGINT) ORDER BY l_linenumber, CAST(l_quantity AS BIGINT)) AS costs FROM lineitem GROUP BY l_orderkey))
""")
def budget_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each order's lines packed into a budget of 100 in order; lines that no longer fit are skipped."""
    return lifecycle.packed(table(spark, sf_dir, "lineitem"), "l_orderkey", F.col("l_linenumber"), F.col("l_quantity"), 100)


@plans.query("""
SELECT conv_id, turn, role, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY t, role, turn, text) AS INTEGER) AS place FROM (SELECT *, row_number() OVER (PARTITION BY conv_id, role ORDER BY turn, text) AS t FROM conversations)
""")
def interleaved_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each conversation with its roles taking turns."""
    return lifecycle.interleaved(table(spark, sf_dir, "conversations"), "conv_id", "role", ["turn", "text"]).select("conv_id", "turn", "role", "place")


@plans.query("""
WITH v AS (SELECT json_extract_string(props, '$.k') AS record, user_id, count(*) AS v FROM events GROUP BY ALL)
SELECT record, arg_max(user_id, (v, user_id)) AS leader, CAST(max(v) - min(v) AS BIGINT) AS ahead, CAST(count(*) AS BIGINT) AS agents FROM v GROUP BY record HAVING count(*) >= 2 AND max(v) > min(v)
""")
def write_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Properties that several users wrote, not equally often: who leads and by how much."""
    writes = table(spark, sf_dir, "events").select(F.get_json_object("props", "$.k").alias("record"), "user_id")
    return lifecycle.write_conflicts(writes, "record", "user_id")


@plans.query("SELECT event_id, CAST(round_even(greatest(least(value, CAST(32767 AS DOUBLE)), CAST(-32768 AS DOUBLE)) * 65536, 0) AS BIGINT) AS fixed FROM events")
def fixed_point(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values as 16.16 fixed-point numbers, ties to even."""
    held = F.greatest(F.least(F.col("value"), F.lit(32767.0)), F.lit(-32768.0))
    return table(spark, sf_dir, "events").select("event_id", F.rint(held * 65536).cast("long").alias("fixed"))


@plans.query("SELECT doc_id, CASE WHEN length(text) = 0 THEN 0 ELSE CAST(ceil(length(text) / CAST(4 AS DOUBLE)) AS BIGINT) END AS tokens FROM documents")
def token_estimates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A rough count of tokens: a quarter of the characters, rounded up."""
    return table(spark, sf_dir, "documents").select("doc_id", F.ceil(F.char_length("text") / 4.0).cast("long").alias("tokens"))


@plans.query(f"""
SELECT signature, CAST(count(*) AS BIGINT) AS asked, CAST(count(DISTINCT conv_id) AS BIGINT) AS conversations FROM (
  SELECT conv_id, substr(sha256(array_to_string(list_sort(list_distinct(list_filter(regexp_extract_all(lower(text), '[a-z0-9_]+'), lambda x: length(x) > 1 AND x NOT IN ({sql.quoted(STOPWORDS)})))), ' ')), 1, 16) AS signature FROM conversations WHERE role = 'user') GROUP BY signature
""")
def query_signatures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """User turns by the signature of their terms, whatever their order."""
    terms = F.array_sort(F.array_distinct(F.filter(words(F.col("text")), lambda w: (F.length(w) > 1) & ~w.isin(*STOPWORDS))))
    turns = table(spark, sf_dir, "conversations").where("role = 'user'").select("conv_id", F.substring(F.sha2(F.array_join(terms, " "), 256), 1, 16).alias("signature"))
    return turns.groupBy("signature").agg(F.count("*").alias("asked"), F.count_distinct("conv_id").alias("conversations"))


@plans.query(f"""
WITH t AS (SELECT text, min(conv_id * 1000 + turn) AS id, list_distinct(regexp_extract_all(lower(text), '[a-z0-9_]+')) AS w FROM conversations GROUP BY text)
SELECT a.id AS a, b.id AS b, round(len(list_intersect(a.w, b.w)) / CAST(len(list_distinct(list_concat(a.w, b.w))) AS DOUBLE), 6) AS similarity FROM t a JOIN t b ON a.id < b.id AND len(a.w) > 0 AND len(b.w) > 0
WHERE len(list_intersect(a.w, b.w)) / CAST(len(list_distinct(list_concat(a.w, b.w))) AS DOUBLE) >= {D(0.75)}
""")
def similar_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of different turns that share three in four of their words; the first turn stands for each text."""
    turns = table(spark, sf_dir, "conversations").groupBy("text").agg(F.min(F.col("conv_id") * 1000 + F.col("turn")).alias("id"))
    pairs = similarity.jaccard_pairs(turns.select("id", words(F.col("text")).alias("w")), "id", "w", 0.75)
    return pairs.withColumn("similarity", F.round("similarity", 6))


@plans.query(f"""
SELECT o_orderkey, round({D(0.5)} + exp(-(d * d) / (2 * {D(30)} * {D(30)})), 6) AS proximity FROM (SELECT o_orderkey, CAST(date_diff('day', CAST(o_orderdate AS DATE), DATE '1998-06-30') AS DOUBLE) AS d FROM orders)
""")
def date_proximity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How near each order is to a day that was asked for."""
    days = F.datediff(F.lit("1998-06-30").cast("date"), F.col("o_orderdate").cast("date")).cast("double")
    return table(spark, sf_dir, "orders").select("o_orderkey", F.round(0.5 + F.exp(-(days * days) / (2 * 30.0 * 30.0)), 6).alias("proximity"))


@plans.query("SELECT date_trunc('hour', ts) AS start, event_type, CAST(count(*) AS BIGINT) AS n, round(sum(value), 4) AS value FROM events GROUP BY ALL")
def hourly_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events in windows of an hour: the batch twin of the stream."""
    from ..streaming.ingest import windowed

    return windowed(table(spark, sf_dir, "events"), "ts", ["event_type"], "1 hour", late=None).withColumn("value", F.round("value", 4))


@plans.query("""
SELECT c_mktsegment, n_name, CAST(count(*) AS BIGINT) AS customers, round(sum(spent), 2) AS spent FROM customer JOIN nation ON c_nationkey = n_nationkey
LEFT JOIN (SELECT o_custkey, sum(o_totalprice) AS spent FROM orders GROUP BY o_custkey) ON o_custkey = c_custkey GROUP BY c_mktsegment, n_name
""")
def entity_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers and what they spent by segment and nation; orders are summed before they are joined."""
    t = lambda n: table(spark, sf_dir, n)
    spent = t("orders").groupBy("o_custkey").agg(F.sum("o_totalprice").alias("spent"))
    both = t("customer").join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(spent, F.col("o_custkey") == F.col("c_custkey"), "left")
    return both.groupBy("c_mktsegment", "n_name").agg(F.count("*").alias("customers"), F.round(F.sum("spent"), 2).alias("spent"))


QUERIES, SQL = plans.queries, plans.sql
