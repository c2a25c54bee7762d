"""Queries over records as a store: look-ups, upserts, deletions, snapshots, shards, views, staged changes and findings.

Orders stand for records: the key, a status, a date, a priority and a price; documents for texts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import store
from ..sources.scratch import stored
from ..sources.tables import table
from .registering import Plans

plans = Plans()
D = "CAST({} AS DOUBLE)".format


def orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders")


@plans.query("SELECT i.item_id, d.doc_id IS NOT NULL AS found, d.source, md5(d.text) AS digest FROM benchmark i LEFT JOIN documents d ON d.doc_id = i.item_id * 30")
def looked_up(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The record that each item asks for, if there is one."""
    asked = table(spark, sf_dir, "benchmark").select("item_id", (F.col("item_id") * 30).alias("doc_id"))
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", F.md5("text").alias("digest"), F.lit(True).alias("found"))
    return asked.join(docs, "doc_id", "left").select("item_id", F.coalesce("found", F.lit(False)).alias("found"), "source", "digest")


_PHRASE = "lower(array_to_string(list_slice(string_split(text, ' '), 2, 3), ' '))"


@plans.query(f"""
WITH p AS (SELECT item_id, {_PHRASE} AS phrase FROM benchmark), d AS (SELECT doc_id, lower(text) AS low FROM documents)
SELECT item_id, doc_id, rank FROM (SELECT item_id, doc_id, row_number() OVER (PARTITION BY item_id ORDER BY doc_id) AS rank FROM p JOIN d ON contains(low, phrase) AND length(phrase) > 3) WHERE rank <= 10
""")
def phrase_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first ten documents that hold each item's second and third word side by side."""
    phrase = F.lower(F.array_join(F.slice(F.split("text", " "), 2, 2), " "))
    asked = table(spark, sf_dir, "benchmark").select("item_id", phrase.alias("phrase")).where("length(phrase) > 3")
    found = store.holding(table(spark, sf_dir, "documents").select("doc_id", F.lower("text").alias("low")), asked, "doc_id", "low", "phrase")
    order = Window.partitionBy("item_id").orderBy("doc_id")
    return found.withColumn("rank", F.row_number().over(order)).where("rank <= 10").select("item_id", "doc_id", "rank")


_NEWER = "n AS (SELECT o_orderkey + CASE WHEN o_orderkey % 9 = 0 THEN 100000000 ELSE 0 END AS o_orderkey, o_custkey, 'U' AS o_orderstatus, o_totalprice * 2 AS o_totalprice, o_orderdate + INTERVAL 1 DAY AS o_orderdate FROM orders WHERE o_orderkey % 3 = 0)"


def newer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A later batch: a third of the orders anew, some of them under keys never seen."""
    key = F.col("o_orderkey") + F.when(F.col("o_orderkey") % 9 == 0, 100000000).otherwise(0)
    rows = orders(spark, sf_dir).where("o_orderkey % 3 = 0")
    return rows.select(key.alias("o_orderkey"), "o_custkey", F.lit("U").alias("o_orderstatus"), (F.col("o_totalprice") * 2).alias("o_totalprice"), (F.col("o_orderdate") + F.expr("INTERVAL 1 DAY")).alias("o_orderdate"))


@plans.query(f"""
WITH {_NEWER}, a AS (SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate, 0 AS b FROM orders UNION ALL SELECT *, 1 FROM n)
SELECT o_orderstatus AS status, count(*) AS n, round(sum(o_totalprice), 2) AS total, max(o_orderkey) AS last_key FROM (SELECT *, row_number() OVER (PARTITION BY o_orderkey ORDER BY o_orderdate DESC, b DESC) AS r FROM a) WHERE r = 1 GROUP BY 1
""")
def upserted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders once a later batch is merged into them: the latest of each key stays."""
    new = newer(spark, sf_dir)
    rows = store.upsert(orders(spark, sf_dir).select(new.columns), new, ["o_orderkey"], "o_orderdate")
    return rows.groupBy(F.col("o_orderstatus").alias("status")).agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"), F.max("o_orderkey").alias("last_key"))


@plans.query("SELECT doc_id, source, sha256(text) AS receipt, (SELECT count(*) FROM documents WHERE doc_id % 7 <> 0) AS left_over FROM documents WHERE doc_id % 7 = 0")
def deletion_receipts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A receipt for each document that is deleted, with how many are left."""
    docs = table(spark, sf_dir, "documents")
    gone = docs.where("doc_id % 7 = 0").select("doc_id")
    left, receipts = store.deleted(docs, gone, "doc_id", F.sha2("text", 256))
    return receipts.select("doc_id", "source", "receipt", left.agg(F.count("*")).scalar().alias("left_over"))


@plans.query("SELECT source, count(*) AS n, min(doc_id) AS first_id, max(doc_id) AS last_id, CAST(sum(length(text)) AS BIGINT) AS chars, bit_xor(CAST('0x' || substr(md5(doc_id || chr(0) || text), 1, 15) AS BIGINT)) AS manifest, true AS restored FROM documents GROUP BY source")
def snapshot_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a snapshot of the documents holds for each source, and whether what comes back from it is the same."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    back = stored(docs, "snapshot")
    return store.manifest(docs, "source").join(store.manifest(back, "source").select("source", F.col("manifest").alias("back")), "source").select(
        "source", "n", "first_id", "last_id", "chars", "manifest", (F.col("manifest") == F.col("back")).alias("restored")
    )


@plans.query("""
WITH t AS (SELECT term, count(*) AS n, count(DISTINCT doc_id) AS df FROM (SELECT doc_id, unnest(regexp_extract_all(lower(CASE WHEN doc_id % 11 = 0 THEN text || ' appended words' ELSE text END), '[a-z0-9_]+')) AS term FROM documents WHERE doc_id % 13 <> 0) GROUP BY term)
SELECT term, n, df FROM t
""")
def incremental_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Term counts of an index brought up to date: only changed and deleted documents are read again."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    later = docs.where("doc_id % 13 <> 0").withColumn("text", F.when(F.col("doc_id") % 11 == 0, F.concat("text", F.lit(" appended words"))).otherwise(F.col("text")))
    index = stored(store.indexed(docs, "doc_id", "text"), "index")
    fresh = store.reindexed(index, docs, later, "doc_id", "text")
    return fresh.groupBy("term").agg(F.sum("n").alias("n"), F.count("*").alias("df"))


@plans.query(f"""
WITH c AS (SELECT DISTINCT c_custkey, CAST(CAST('0x' || substr(md5(CAST(c_custkey AS VARCHAR)), 1, 8) AS BIGINT) % 8 AS BIGINT) AS shard FROM customer)
SELECT shard, o_orderkey, o_totalprice, rank FROM (SELECT shard, o_orderkey, o_totalprice, row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) AS rank FROM orders JOIN c ON o_custkey = c_custkey) WHERE rank <= 20
""")
def sharded_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The twenty dearest orders, found as the twenty of each shard and then of all these; a customer's shard is its hash."""
    customers = table(spark, sf_dir, "customer").select("c_custkey", store.shard_of(F.col("c_custkey").cast("string"), 8).alias("shard")).distinct()
    rows = orders(spark, sf_dir).join(customers, F.col("o_custkey") == F.col("c_custkey"))
    best = [F.col("o_totalprice").desc(), F.col("o_orderkey")]
    each = rows.withColumn("r", F.row_number().over(Window.partitionBy("shard").orderBy(*best))).where("r <= 20")
    return each.withColumn("rank", F.row_number().over(Window.orderBy(*best))).where("rank <= 20").select("shard", "o_orderkey", "o_totalprice", "rank")


@plans.query("SELECT tag, event_id, user_id, rank FROM (SELECT CAST(json_extract(props, '$.k') AS BIGINT) AS tag, event_id, user_id, row_number() OVER (PARTITION BY CAST(json_extract(props, '$.k') AS BIGINT) ORDER BY ts DESC, event_id) AS rank FROM events) WHERE rank <= 5")
def records_by_tag(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five latest events of each tag."""
    rows = table(spark, sf_dir, "events").withColumn("tag", F.get_json_object("props", "$.k").cast("long"))
    order = Window.partitionBy("tag").orderBy(F.col("ts").desc(), "event_id")
    return rows.withColumn("rank", F.row_number().over(order)).where("rank <= 5").select("tag", "event_id", "user_id", "rank")


@plans.query("""
SELECT doc_id, 'brief' AS persona, substr(text, 1, 80) AS body, NULL AS source, NULL AS n_chars FROM documents WHERE doc_id % 4 = 0
UNION ALL SELECT doc_id, 'detailed', substr(text, 1, 300), source, n_chars FROM documents WHERE doc_id % 4 = 1
UNION ALL SELECT doc_id, 'technical', md5(text), source, n_chars FROM documents WHERE doc_id % 4 >= 2
""")
def persona_views(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as three kinds of reader see them."""
    persona = F.when(F.col("doc_id") % 4 == 0, "brief").when(F.col("doc_id") % 4 == 1, "detailed").otherwise("technical")
    rows = table(spark, sf_dir, "documents").withColumn("persona", persona)
    return rows.select("doc_id", "persona", *store.persona_columns(F.col("persona"), F.col("text"), F.col("source"), F.col("n_chars")))


@plans.query("""
WITH a AS (SELECT s_suppkey AS agent, n_regionkey AS scope FROM supplier JOIN nation ON n_nationkey = s_nationkey),
r AS (SELECT c_custkey, n_regionkey AS scope FROM customer JOIN nation ON n_nationkey = c_nationkey)
SELECT agent, count(c_custkey) AS readable, count(CASE WHEN c_custkey % 10 = agent % 10 THEN 1 END) AS writable FROM a JOIN r USING (scope) GROUP BY agent
""")
def visible_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many customers each supplier may read (its region's) and write (those of its own last digit)."""
    t = lambda name: table(spark, sf_dir, name)
    last = F.col("c_custkey") % 10
    held = t("customer").join(t("nation"), F.col("n_nationkey") == F.col("c_nationkey")).groupBy(F.col("n_regionkey").alias("scope"), last.alias("digit")).agg(F.count("*").alias("n"))
    agents = t("supplier").join(t("nation"), F.col("n_nationkey") == F.col("s_nationkey")).select(F.col("s_suppkey").alias("agent"), F.col("n_regionkey").alias("scope"))
    both = agents.join(held, "scope")
    return both.groupBy("agent").agg(F.sum("n").alias("readable"), F.coalesce(F.sum(F.when(F.col("digit") == F.col("agent") % 10, F.col("n"))), F.lit(0)).alias("writable"))


@plans.query("""
SELECT kind, count(*) AS n, min(id) AS least, max(id) AS most FROM (SELECT 'customer' AS kind, c_custkey AS id FROM customer UNION SELECT 'customer', o_custkey FROM orders UNION SELECT 'part', p_partkey FROM part UNION SELECT 'part', l_partkey FROM lineitem) GROUP BY kind
""")
def tracked_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ids that any table knows, by kind."""
    ids = lambda name, c, kind: table(spark, sf_dir, name).select(F.lit(kind).alias("kind"), F.col(c).alias("id"))
    rows = ids("customer", "c_custkey", "customer").union(ids("orders", "o_custkey", "customer")).union(ids("part", "p_partkey", "part")).union(ids("lineitem", "l_partkey", "part"))
    return rows.distinct().groupBy("kind").agg(F.count("*").alias("n"), F.min("id").alias("least"), F.max("id").alias("most"))


_STAGED = """
p AS (SELECT o_orderkey AS target, CASE o_orderkey % 5 WHEN 0 THEN 'set_status' WHEN 1 THEN 'update_field' WHEN 2 THEN 'append' WHEN 3 THEN 'supersede' ELSE 'unknown' END AS op,
        CASE WHEN o_orderkey % 17 = 0 THEN '' ELSE 'value ' || (o_orderkey % 3) END AS payload, o_orderdate AS at FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH')),
v AS (SELECT *, sha256(op || chr(0) || target || chr(0) || payload) AS fingerprint, op <> 'unknown' AND payload <> '' AS valid FROM p)
"""


def proposals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Staged changes to orders of high priority, each with its fingerprint and whether it is well formed."""
    k = F.col("o_orderkey")
    op = F.when(k % 5 == 0, "set_status").when(k % 5 == 1, "update_field").when(k % 5 == 2, "append").when(k % 5 == 3, "supersede").otherwise("unknown")
    payload = F.when(k % 17 == 0, "").otherwise(F.concat(F.lit("value "), k % 3))
    rows = orders(spark, sf_dir).where(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH")).select(k.alias("target"), op.alias("op"), payload.alias("payload"), F.col("o_orderdate").alias("at"))
    return rows.select("*", store.fingerprint("op", "target", "payload").alias("fingerprint"), ((F.col("op") != "unknown") & (F.col("payload") != "")).alias("valid"))


@plans.query(f"WITH {_STAGED} SELECT op, valid, count(*) AS n, count(DISTINCT fingerprint) AS fingerprints, count(*) > 1000 AS over_limit FROM v GROUP BY op, valid")
def staged_proposals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Staged changes by operation, those that are malformed apart, and whether the backlog is full."""
    rows = proposals(spark, sf_dir).groupBy("op", "valid")
    return rows.agg(F.count("*").alias("n"), F.countDistinct("fingerprint").alias("fingerprints"), (F.count("*") > 1000).alias("over_limit"))


@plans.query(f"""
WITH {_STAGED} SELECT o_orderkey, CASE WHEN op = 'set_status' THEN 'X' WHEN op = 'supersede' THEN 'superseded' ELSE o_orderstatus END AS status, CASE WHEN op = 'update_field' THEN payload ELSE o_orderpriority END AS priority,
  CASE WHEN op = 'append' THEN 'note;' || payload ELSE 'note' END AS notes, fingerprint AS receipt FROM orders LEFT JOIN v ON target = o_orderkey AND valid WHERE o_orderkey % 2 = 0
""")
def applied_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders with their well-formed changes applied, each with the receipt of what changed it."""
    rows = orders(spark, sf_dir).where("o_orderkey % 2 = 0")
    return store.applied(rows, proposals(spark, sf_dir).where("valid"))


@plans.query(f"WITH {_STAGED}, a AS (SELECT o_orderstatus, CASE WHEN op = 'set_status' THEN 'X' ELSE o_orderstatus END AS changed FROM orders LEFT JOIN v ON target = o_orderkey AND valid) SELECT o_orderstatus AS status, count(*) AS n, count(CASE WHEN changed <> o_orderstatus THEN 1 END) AS rolled_back FROM a GROUP BY o_orderstatus")
def rolled_back(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders put back from their snapshot after a change, and how many of them that touched."""
    before = orders(spark, sf_dir).select("o_orderkey", "o_orderstatus")
    staged = proposals(spark, sf_dir).where("valid AND op = 'set_status'").select(F.col("target").alias("o_orderkey"), F.lit("X").alias("new"))
    after = before.join(staged, "o_orderkey", "left").select("o_orderkey", F.coalesce("new", "o_orderstatus").alias("changed"))
    both = before.join(after, "o_orderkey")
    return both.groupBy(F.col("o_orderstatus").alias("status")).agg(F.count("*").alias("n"), F.count(F.when(F.col("changed") != F.col("o_orderstatus"), 1)).alias("rolled_back"))


@plans.query("""
WITH a AS (SELECT *, date_diff('day', o_orderdate, (SELECT max(o_orderdate) FROM orders)) AS age FROM orders)
SELECT o_orderpriority, CAST(year(o_orderdate) AS BIGINT) AS archive, count(*) AS n, count(CASE WHEN o_orderstatus = 'O' AND age > 300 THEN 1 END) AS stalled FROM a WHERE age > 90 AND o_orderstatus <> 'P' GROUP BY 1, 2
""")
def archived_by_year(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Finished orders older than ninety days by the year whose archive they go to, and those that stalled."""
    rows = orders(spark, sf_dir)
    rows = rows.withColumn("age", F.datediff(rows.agg(F.max("o_orderdate")).scalar(), "o_orderdate")).where("age > 90 AND o_orderstatus <> 'P'")
    stalled = F.count(F.when((F.col("o_orderstatus") == "O") & (F.col("age") > 300), 1))
    return rows.groupBy("o_orderpriority", F.year("o_orderdate").cast("long").alias("archive")).agg(F.count("*").alias("n"), stalled.alias("stalled"))


_PAIRS = """
x AS (SELECT o_custkey, o_orderkey, o_orderstatus, CAST(substr(o_orderpriority, 1, 1) AS INTEGER) AS p, o_orderdate, CAST(o_totalprice / 100000 AS INTEGER) AS s FROM orders),
r AS (SELECT a.o_orderkey AS a, b.o_orderkey AS b, a.p AS pa, b.p AS pb, a.s AS sa, b.s AS sb, a.o_orderdate AS da, b.o_orderdate AS db FROM (SELECT *, lead(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS next FROM x) a JOIN x b ON b.o_orderkey = a.next WHERE a.o_orderstatus <> b.o_orderstatus)
"""


@plans.query(f"WITH {_PAIRS} SELECT a, b, CASE WHEN abs(pa - pb) >= 2 THEN CASE WHEN pa < pb THEN 'a by priority' ELSE 'b by priority' END WHEN abs(sa - sb) >= 2 THEN CASE WHEN sa > sb THEN 'a by scope' ELSE 'b by scope' END WHEN da <> db THEN CASE WHEN da > db THEN 'a by date' ELSE 'b by date' END ELSE 'manual' END AS winner FROM r")
def conflict_winners(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which of two orders that follow each other and disagree in their status holds, and by what rule."""
    side = lambda: F.struct("o_orderkey", "o_orderstatus", F.substring("o_orderpriority", 1, 1).cast("int").alias("p"), F.round(F.col("o_totalprice") / 100000).cast("int").alias("s"), "o_orderdate")
    rows = orders(spark, sf_dir).select("o_custkey", side().alias("a"))
    rows = rows.withColumn("b", F.lead("a").over(Window.partitionBy("o_custkey").orderBy("a.o_orderkey"))).where("a.o_orderstatus <> b.o_orderstatus")
    return rows.select(F.col("a.o_orderkey").alias("a"), F.col("b.o_orderkey").alias("b"), store.winner(F.col("a"), F.col("b")).alias("winner"))


@plans.query("""
WITH v AS (SELECT user_id % 200 AS block, event_type AS agent, count(*) AS version, max(ts) AS last FROM events GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY block ORDER BY version DESC, last DESC, agent) AS r FROM v)
SELECT block, max(CASE WHEN r = 1 THEN agent END) AS leader, max(CASE WHEN r = 2 THEN agent END) AS runner_up, max(version) - max(CASE WHEN r = 2 THEN version END) AS lead, count(*) - 2 AS laggards, arg_max(agent, last) AS last_writer FROM r GROUP BY block HAVING count(DISTINCT version) > 1
""")
def version_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records whose writers have seen unequal versions: who leads, who is next, who wrote last."""
    rows = table(spark, sf_dir, "events").groupBy((F.col("user_id") % 200).alias("block"), F.col("event_type").alias("agent")).agg(F.count("*").alias("version"), F.max("ts").alias("last"))
    r = F.row_number().over(Window.partitionBy("block").orderBy(F.col("version").desc(), F.col("last").desc(), "agent"))
    at = lambda n, c: F.max(F.when(F.col("r") == n, F.col(c)))
    out = rows.withColumn("r", r).groupBy("block").agg(
        F.countDistinct("version").alias("versions"), at(1, "agent").alias("leader"), at(2, "agent").alias("runner_up"), (F.max("version") - at(2, "version")).alias("lead"), (F.count("*") - 2).alias("laggards"), F.max_by("agent", "last").alias("last_writer")
    )
    return out.where("versions > 1").drop("versions")


@plans.query(f"""
WITH d AS (SELECT doc_id, text, length(trim(text)) AS n, len(regexp_extract_all(lower(text), '[a-z0-9_]+')) AS w, len(list_distinct(regexp_extract_all(lower(text), '[a-z0-9_]+'))) AS u FROM documents)
SELECT doc_id, CASE WHEN n = 0 THEN 'empty' WHEN n < 40 THEN 'short' WHEN n > 50000 THEN 'long' WHEN w > 0 AND {D('u')} / w < 0.2 THEN 'repetitive' WHEN regexp_matches(text, 'AKIA[A-Z0-9]{{12,}}') THEN 'secret' WHEN len(regexp_extract_all(text, '[$#@%&*]')) * 5 > n THEN 'noise' ELSE 'admitted' END AS verdict FROM d
""")
def admission_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first rule that keeps each document out, if any does."""
    return table(spark, sf_dir, "documents").select("doc_id", store.verdict(F.col("text")).alias("verdict"))


@plans.query("""
SELECT doc_id, substr(regexp_replace(source || '/' || lang, '[\\r\\n]+', ' ', 'g'), 1, 256) AS origin, sha256('block' || chr(0) || doc_id || chr(0) || coalesce(source, '') || chr(0) || n_chars) AS transform_hash, n_chars <> length(text) AS dirty FROM documents
""")
def provenance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where each document is from on one line, the hash of what it was made of, and whether it was made of something else."""
    preimage = store.fingerprint(F.lit("block"), "doc_id", F.coalesce("source", F.lit("")), "n_chars")
    origin = F.substring(F.regexp_replace(F.concat_ws("/", "source", "lang"), r"[\r\n]+", " "), 1, 256)
    return table(spark, sf_dir, "documents").select("doc_id", origin.alias("origin"), preimage.alias("transform_hash"), (F.col("n_chars") != F.char_length("text")).alias("dirty"))


@plans.query("""
SELECT 'documents' AS part, count(*) AS n, count(DISTINCT text) AS distinct_n, CAST(sum(CASE WHEN length(trim(text)) = 0 THEN 1 ELSE 0 END) AS BIGINT) AS findings FROM documents
UNION ALL SELECT 'orders', count(*), count(DISTINCT o_custkey), CAST(sum(CASE WHEN o_totalprice <= 0 THEN 1 ELSE 0 END) AS BIGINT) FROM orders
UNION ALL SELECT 'events', count(*), count(DISTINCT user_id), CAST(sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) AS BIGINT) FROM events
UNION ALL SELECT 'turns', count(*), count(DISTINCT conv_id), CAST(sum(CASE WHEN length(text) < 20 THEN 1 ELSE 0 END) AS BIGINT) FROM conversations
""")
def briefing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and findings of every part of the collection."""
    def part(name: str, label: str, key: str, finding: Column) -> DataFrame:
        return table(spark, sf_dir, name).agg(F.lit(label).alias("part"), F.count("*").alias("n"), F.countDistinct(key).alias("distinct_n"), F.sum(F.when(finding, 1).otherwise(0)).alias("findings"))

    out = part("documents", "documents", "text", F.length(F.trim("text")) == 0).union(part("orders", "orders", "o_custkey", F.col("o_totalprice") <= 0))
    return out.union(part("events", "events", "user_id", F.col("event_type") == "error")).union(part("conversations", "turns", "conv_id", F.length("text") < 20))


QUERIES, SQL = plans.queries, plans.sql
