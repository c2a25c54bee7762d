"""Queries over logs and sealed records: events stand for log lines, nations' names for keys."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import edits, journal, sealed
from ..sources.scratch import stored
from ..sources.tables import table
from .registering import Plans

plans = Plans()

_LOG = """
e AS (SELECT event_type AS store, event_id AS seq, event_id // 5 AS tx, event_id % 5 AS step, 'u' || user_id AS target, CASE WHEN event_id % 9 = 0 THEN NULL ELSE CAST(value AS VARCHAR) END AS content FROM events),
g AS (SELECT *, CASE WHEN step < 4 THEN 'write' WHEN tx % 7 = 0 THEN 'begin' WHEN tx % 3 = 0 THEN 'rollback' ELSE 'commit' END AS kind FROM (SELECT 'all' AS store, seq, tx, step, target, content FROM e)),
o AS (SELECT tx, CASE WHEN bool_or(kind = 'commit') THEN 'committed' WHEN bool_or(kind = 'rollback') THEN 'rolled back' ELSE 'pending' END AS outcome, max(CASE WHEN kind IN ('commit', 'rollback') THEN seq END) AS ended FROM g GROUP BY tx)
"""


def log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five events a transaction: four writes and what ends it; each seventh is left open and each third is rolled back."""
    k, tx = F.col("event_id"), F.floor(F.col("event_id") / 5)
    kind = F.when(k % 5 < 4, "write").when(tx % 7 == 0, "begin").when(tx % 3 == 0, "rollback").otherwise("commit")
    entry = F.struct(k.alias("seq"), tx.cast("string").alias("tx"), kind.alias("kind"), F.concat(F.lit("u"), "user_id").alias("target"), F.when(k % 9 != 0, F.col("value").cast("string")).alias("content"))
    lines = table(spark, sf_dir, "events").select(F.lit("all").alias("store"), k.alias("at"), F.to_json(entry).alias("line"))
    torn = lines.where("at % 50 = 7").select("store", "at", F.left("line", F.lit(20)).alias("line"))
    # parts of lines are torn, whole ones may come twice
    return stored(journal.parsed(lines.union(torn).union(lines.where("at % 10 = 3"))), "log")


@plans.query(f"WITH {_LOG} SELECT outcome, count(*) AS n, max(ended) AS last_end FROM o GROUP BY outcome")
def transaction_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many transactions were committed, rolled back or left open."""
    return journal.outcomes(log(spark, sf_dir)).groupBy("outcome").agg(F.count("*").alias("n"), F.max("ended").alias("last_end"))


@plans.query(f"""
WITH {_LOG}, w AS (SELECT target, content, row_number() OVER (PARTITION BY target ORDER BY ended DESC, seq DESC) AS r FROM g JOIN o USING (tx) WHERE kind = 'write' AND outcome = 'committed' AND seq < ended),
l AS (SELECT target, content FROM w WHERE r = 1)
SELECT target, content FROM l WHERE content IS NOT NULL UNION ALL SELECT 'u' || c_custkey, c_mktsegment FROM customer WHERE 'u' || c_custkey NOT IN (SELECT target FROM l) AND c_mktsegment IS NOT NULL
""")
def replayed_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What customers' records are after a log was replayed, twice over."""
    base = table(spark, sf_dir, "customer").select(F.lit("all").alias("store"), F.concat(F.lit("u"), "c_custkey").alias("target"), F.col("c_mktsegment").alias("content"))
    lines = log(spark, sf_dir)
    return journal.replayed(journal.replayed(base, lines), lines).select("target", "content")


@plans.query("""
WITH s AS (SELECT o_orderkey AS id, o_orderkey % 5 AS k, CAST(o_totalprice AS VARCHAR) AS content,
             CASE WHEN o_orderkey % 11 = 0 THEN 'broken' WHEN o_orderkey % 13 = 0 THEN 'unknown key' ELSE 'open' END AS state FROM orders)
SELECT state, count(*) AS n, count(CASE WHEN state = 'open' THEN 1 END) AS same, count(CASE WHEN state <> 'unknown key' AND (state = 'open' OR k = 3) THEN 1 END) AS under_one FROM s GROUP BY state
""")
def sealed_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders sealed under the keys of nations; some are put in another's place or lose their key; the rest go to one key and open."""
    keys = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("string").alias("key_id"), F.unhex(F.md5("n_name")).alias("key"))
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_totalprice").cast("string").alias("content"), (F.col("o_orderkey") % 5).cast("string").alias("key_id"))
    held = sealed.seal(rows, keys, "key_id")
    swapped = F.when(F.col("id") % 11 == 0, -F.col("id") - 1).otherwise(F.col("id"))  # what was sealed for one id stands under another
    held = stored(held.select(swapped.alias("id"), F.when((F.col("id") % 13 == 0) & (F.col("id") % 11 != 0), "lost").otherwise(F.col("key_id")).alias("key_id"), "sealed"), "sealed")
    back = sealed.opened(stored(sealed.rotated(held, keys, "3"), "rotated"), keys)
    same = rows.select(F.col("id").alias("i"), F.col("content").alias("c"))
    both = back.join(same, (F.col("id") == F.col("i")) & (F.col("content") == F.col("c")), "left")
    return both.groupBy("state").agg(F.count("*").alias("n"), F.count("i").alias("same"), F.count(F.when(F.col("key_id") == "3", 1)).alias("under_one"))


_EDITS = """
p AS (SELECT event_id AS edit_id, user_id AS record_id, props AS new_content, CASE WHEN event_id % 7 = 0 THEN ' ' ELSE event_type END AS reason, ts AS asked FROM events WHERE event_id % 3 = 0),
d AS (SELECT event_id - event_id % 3 AS edit_id, ts + INTERVAL 5 DAY AS done, 'u' || user_id AS approver, value >= 50 AS approved FROM events WHERE event_id % 3 > 0 AND event_id % 5 > 0),
f AS (SELECT p.edit_id, d.done AS decided_at, approver, approved, row_number() OVER (PARTITION BY p.edit_id ORDER BY d.done, approver, approved) AS r FROM p JOIN d ON d.edit_id = p.edit_id AND d.done >= p.asked WHERE trim(reason) <> ''),
e AS (SELECT p.*, CASE WHEN trim(reason) = '' THEN 'refused' WHEN f.edit_id IS NULL THEN 'pending' WHEN approved THEN 'applied' ELSE 'rejected' END AS status, decided_at, approver FROM p LEFT JOIN f ON f.edit_id = p.edit_id AND r = 1)
"""


def _edits(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    rows, k = table(spark, sf_dir, "events"), F.col("event_id")
    proposals = rows.where("event_id % 3 = 0").select(k.alias("edit_id"), F.col("user_id").alias("record_id"), F.col("props").alias("new_content"), F.when(k % 7 == 0, " ").otherwise(F.col("event_type")).alias("reason"), F.col("ts").alias("at"))
    decisions = rows.where("event_id % 3 > 0 AND event_id % 5 > 0").select((k - k % 3).alias("edit_id"), (F.col("ts") + F.expr("INTERVAL 5 DAYS")).alias("at"), F.concat(F.lit("u"), "user_id").alias("approver"), (F.col("value") >= 50).alias("approved"))
    records = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("record_id"), F.col("c_name").alias("content"))
    return stored(edits.edits(proposals, decisions, records), "edits"), records


@plans.query(f"""
WITH {_EDITS} SELECT edit_id, e.record_id, c_name AS old_content, status, approver, row_number() OVER (PARTITION BY e.record_id ORDER BY asked, edit_id) AS number
FROM e LEFT JOIN customer ON c_custkey = e.record_id WHERE status <> 'refused'
""")
def edit_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every edit that was proposed with a reason, in the order of its record, and what became of it."""
    return edits.history(_edits(spark, sf_dir)[0]).select("edit_id", "record_id", "old_content", "status", "approver", "number")


@plans.query(f"WITH {_EDITS} SELECT edit_id, record_id, reason FROM e WHERE status = 'pending' ORDER BY asked, edit_id LIMIT 100")
def pending_edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The hundred oldest edits that nobody decided."""
    return edits.pending(_edits(spark, sf_dir)[0]).select("edit_id", "record_id", "reason")


@plans.query(f"""
WITH {_EDITS}, a AS (SELECT *, row_number() OVER (PARTITION BY record_id ORDER BY decided_at DESC, edit_id DESC) AS r FROM e WHERE status = 'applied'),
l AS (SELECT * FROM a WHERE r = 1)
SELECT c_custkey AS record_id, coalesce(new_content, c_name) AS content, EXISTS (SELECT 1 FROM a WHERE a.record_id = l.record_id AND a.edit_id <> l.edit_id AND a.decided_at > l.asked AND a.decided_at <= l.decided_at) AS stale
FROM customer LEFT JOIN l ON l.record_id = c_custkey
""")
def edited_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers' records as the last approved edit leaves them, and whether it was made for what another one changed meanwhile."""
    return edits.after_edits(*_edits(spark, sf_dir))


QUERIES, SQL = plans.queries, plans.sql
