"""Queries over graphs, similarity, ledgers, references and page text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text
from ..operators import audit, graph, similarity
from ..sources.scratch import stored
from ..sources.tables import table
from .registering import Plans

plans = Plans()

_EDGES = """
i AS (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem), n AS (SELECT l_orderkey, count(*) AS n FROM i GROUP BY l_orderkey),
e AS (SELECT a.l_partkey AS a, b.l_partkey AS b, sum(CAST(1 AS DOUBLE) / n) AS weight FROM i a JOIN i b ON a.l_orderkey = b.l_orderkey AND a.l_partkey < b.l_partkey JOIN n ON n.l_orderkey = a.l_orderkey GROUP BY ALL)
"""
_BOTH = f"{_EDGES}, d AS (SELECT a, b, least(weight, CAST(1 AS DOUBLE)) AS weight FROM (SELECT a, b, weight FROM e UNION ALL SELECT b, a, weight FROM e))"


def _edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.co_occurrence(table(spark, sf_dir, "lineitem"), "l_orderkey", "l_partkey")


def _both(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stored(graph.both_ways(_edges(spark, sf_dir)).withColumn("weight", F.least("weight", F.lit(1.0))), "co-edges")


@plans.query(f"WITH {_EDGES} SELECT a, b, round(weight, 6) AS weight FROM e")
def co_retrieval_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts that are ordered together: each order of n parts adds 1 / n to each pair."""
    return _edges(spark, sf_dir).withColumn("weight", F.round("weight", 6))


@plans.query(f"""
WITH {_BOTH}, s0 AS (SELECT p_partkey AS node, CAST(1 AS DOUBLE) AS score FROM part WHERE p_size = 1),
r1 AS (SELECT b AS node, max(score * CAST(0.5 AS DOUBLE) * weight) AS score FROM s0 JOIN d ON a = node GROUP BY b),
s1 AS (SELECT node, max(score) AS score FROM (SELECT * FROM s0 UNION ALL SELECT * FROM r1) GROUP BY node),
r2 AS (SELECT b AS node, max(score * CAST(0.5 AS DOUBLE) * weight) AS score FROM s1 JOIN d ON a = node GROUP BY b)
SELECT node, round(max(score), 6) AS score FROM (SELECT * FROM s1 UNION ALL SELECT * FROM r2) GROUP BY node
""")
def propagated_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of the smallest parts, handed on twice over the edges of parts ordered together; the best one counts."""
    seeds = table(spark, sf_dir, "part").where("p_size = 1").select(F.col("p_partkey").alias("node"), F.lit(1.0).alias("score"))
    return graph.propagate(seeds, _both(spark, sf_dir), [0.5, 0.5]).select("node", F.round("score", 6).alias("score"))


@plans.query(f"""
WITH {_BOTH}, w AS (SELECT a, b FROM d WHERE weight >= CAST(0.3 AS DOUBLE)), s AS (SELECT DISTINCT l_partkey AS node FROM lineitem WHERE l_returnflag = 'R' AND l_quantity >= 49),
h1 AS (SELECT DISTINCT b AS node FROM s JOIN w ON a = node), h2 AS (SELECT DISTINCT b AS node FROM h1 JOIN w ON a = node)
SELECT node, round(max(score), 6) AS staleness FROM (SELECT node, CAST(1 AS DOUBLE) AS score FROM s UNION ALL SELECT node, CAST(0.9 AS DOUBLE) FROM h1 UNION ALL SELECT node, CAST(0.45 AS DOUBLE) FROM h2) GROUP BY node
""")
def staleness_diffusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Staleness of parts of which many were returned, handed on over strong edges: 0.9 at one hop, half of it at two."""
    bad = table(spark, sf_dir, "lineitem").where("l_returnflag = 'R' and l_quantity >= 49").select(F.col("l_partkey").alias("node")).distinct().withColumn("score", F.lit(1.0))
    strong = _both(spark, sf_dir).where("weight >= 0.3").withColumn("weight", F.lit(1.0))
    return graph.propagate(bad, strong, [0.9, 0.5]).select("node", F.round("score", 6).alias("staleness"))


@plans.query("""
SELECT kind, CAST(id AS BIGINT) AS id, CAST(hop AS INTEGER) AS hop FROM (
  SELECT 'region' AS kind, r_regionkey AS id, 0 AS hop FROM region UNION ALL SELECT 'nation', n_nationkey, 1 FROM nation WHERE n_regionkey IN (SELECT r_regionkey FROM region)
  UNION ALL SELECT 'customer', c_custkey, 2 FROM customer WHERE c_nationkey IN (SELECT n_nationkey FROM nation)
  UNION ALL SELECT 'order', o_orderkey, 3 FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_nationkey IN (SELECT n_nationkey FROM nation)))
""")
def lineage_hops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What hangs on each region, over typed edges: nations, their customers, their orders, and after how many hops."""
    name = lambda kind, c: F.concat(F.lit(f"{kind}:"), F.col(c))
    part = lambda t, a, b: table(spark, sf_dir, t).select(a.alias("a"), b.alias("b"))
    edges = part("nation", name("region", "n_regionkey"), name("nation", "n_nationkey"))
    edges = edges.union(part("customer", name("nation", "c_nationkey"), name("customer", "c_custkey"))).union(part("orders", name("customer", "o_custkey"), name("order", "o_orderkey")))
    seen = graph.reach(edges, table(spark, sf_dir, "region").select(name("region", "r_regionkey").alias("node")), 4)
    return seen.select(F.substring_index("node", ":", 1).alias("kind"), F.substring_index("node", ":", -1).cast("long").alias("id"), "hop")


@plans.query("""
WITH s AS (SELECT name, list_distinct(list_transform(range(1, length(name) - 1), lambda i: substr(name, i, 3))) AS t FROM (SELECT DISTINCT trim(lower(p_name)) AS name FROM part WHERE length(trim(p_name)) >= 3)),
k AS (SELECT p.p_partkey AS id, s.name, s.t FROM (SELECT trim(lower(p_name)) AS name, min(p_partkey) AS p_partkey FROM part GROUP BY 1) p JOIN s ON s.name = p.name)
SELECT a.id AS a, b.id AS b, round(len(list_intersect(a.t, b.t)) / CAST(len(list_distinct(list_concat(a.t, b.t))) AS DOUBLE), 6) AS similarity
FROM k a JOIN k b ON a.id < b.id WHERE len(list_intersect(a.t, b.t)) / CAST(len(list_distinct(list_concat(a.t, b.t))) AS DOUBLE) >= CAST(0.6 AS DOUBLE)
""")
def similar_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of different part names that share six in ten of their trigrams; the first part stands for each name."""
    names = table(spark, sf_dir, "part").where(F.length(F.trim("p_name")) >= 3).groupBy(F.trim(F.lower("p_name")).alias("name")).agg(F.min("p_partkey").alias("id"))
    pairs = similarity.jaccard_pairs(names.select("id", text.trigrams(F.col("name")).alias("t")), "id", "t", 0.6)
    return pairs.withColumn("similarity", F.round("similarity", 6))


@plans.query("""
SELECT md5(line) AS line, CAST(count(DISTINCT source) AS BIGINT) AS sources, CAST(count(*) AS BIGINT) AS places FROM (SELECT source, trim(unnest(string_split(text, chr(10)))) AS line FROM documents) WHERE length(line) >= 10 GROUP BY line HAVING count(DISTINCT source) >= 3
""")
def repeated_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of ten characters or more that stand in three sources or more."""
    lines = table(spark, sf_dir, "documents").select("source", F.explode(F.split("text", "\n")).alias("line")).withColumn("line", F.trim("line")).where(F.length("line") >= 10)
    found = lines.groupBy(F.md5("line").alias("line")).agg(F.count_distinct("source").alias("sources"), F.count("*").alias("places"))
    return found.where("sources >= 3")


@plans.query("""
SELECT name, CAST(count(DISTINCT doc_id) AS BIGINT) AS mentions FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Z][a-z][a-z]+')) AS name FROM documents) GROUP BY name HAVING count(DISTINCT doc_id) >= 3
""")
def entity_discovery(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Capitalised words that three documents or more mention."""
    names = table(spark, sf_dir, "documents").select("doc_id", F.explode(text.entities(F.col("text"))).alias("name"))
    return names.groupBy("name").agg(F.count_distinct("doc_id").alias("mentions")).where("mentions >= 3")


@plans.query("""
SELECT a.o_custkey, strftime(a.o_orderdate, '%Y-%m') AS month, a.o_orderkey AS urgent, b.o_orderkey AS low FROM orders a JOIN orders b ON a.o_custkey = b.o_custkey AND strftime(a.o_orderdate, '%Y-%m') = strftime(b.o_orderdate, '%Y-%m') AND a.o_orderpriority = '1-URGENT' AND b.o_orderpriority = '5-LOW'
""")
def contradicting_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders of one customer and month that ask for opposite priorities."""
    orders = table(spark, sf_dir, "orders").select("o_custkey", F.date_format("o_orderdate", "yyyy-MM").alias("month"), "o_orderkey", "o_orderpriority")
    side = lambda p, name: orders.where(F.col("o_orderpriority") == p).select("o_custkey", "month", F.col("o_orderkey").alias(name))
    return side("1-URGENT", "urgent").join(side("5-LOW", "low"), ["o_custkey", "month"])


@plans.query("SELECT 'customer' AS kind, c_custkey AS id FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey) UNION ALL SELECT 'part', p_partkey FROM part WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p_partkey)")
def orphans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers without an order and parts without a line."""
    t = lambda n: table(spark, sf_dir, n)
    customers = t("customer").join(t("orders"), F.col("c_custkey") == F.col("o_custkey"), "left_anti").select(F.lit("customer").alias("kind"), F.col("c_custkey").alias("id"))
    return customers.union(t("part").join(t("lineitem"), F.col("p_partkey") == F.col("l_partkey"), "left_anti").select(F.lit("part"), "p_partkey"))


@plans.query(f"""
SELECT event_id, digest, coalesce(lag(digest) OVER (PARTITION BY user_id ORDER BY event_id), '{audit.GENESIS}') AS previous FROM (SELECT event_id, user_id, sha256(CAST(event_id AS VARCHAR) || '|' || CAST(user_id AS VARCHAR) || '|' || event_type || '|' || props) AS digest FROM events)
""")
def ledger_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's events as a ledger: every entry's digest and that of the one before."""
    entries = table(spark, sf_dir, "events").select("event_id", "user_id", audit.content_hash(*map(F.col, ("event_id", "user_id", "event_type", "props"))).alias("digest"))
    return audit.linked(entries, "user_id", "event_id", "digest").select("event_id", "digest", "previous")


@plans.query("""
WITH a AS (SELECT o_custkey, count(*) AS n, max(o_orderkey) AS last FROM orders WHERE o_orderdate < TIMESTAMP '1997-01-01' GROUP BY o_custkey), b AS (SELECT o_custkey, count(*) AS n, max(o_orderkey) AS last FROM orders WHERE o_orderdate >= TIMESTAMP '1996-01-01' AND o_orderdate < TIMESTAMP '1998-01-01' GROUP BY o_custkey)
SELECT coalesce(a.o_custkey, b.o_custkey) AS o_custkey, CASE WHEN a.o_custkey IS NULL THEN 'added' WHEN b.o_custkey IS NULL THEN 'removed' ELSE 'changed' END AS change FROM a FULL OUTER JOIN b ON a.o_custkey = b.o_custkey WHERE a.o_custkey IS NULL OR b.o_custkey IS NULL OR a.n <> b.n OR a.last <> b.last
""")
def snapshot_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers whose orders differ between two snapshots: added, removed or changed."""
    orders, day = table(spark, sf_dir, "orders"), F.col("o_orderdate")
    state = lambda where: orders.where(where).groupBy("o_custkey").agg(F.count("*").alias("n"), F.max("o_orderkey").alias("last"))
    at = lambda d: F.lit(d).cast("timestamp")
    return audit.differences(state(day < at("1997-01-01")), state((day >= at("1996-01-01")) & (day < at("1998-01-01"))), "o_custkey")


@plans.query("""
SELECT page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title, CAST(len(regexp_extract_all(html, '<a ')) AS BIGINT) AS links, md5(trim(regexp_replace(regexp_replace(html, '<[^>]*>', ' ', 'g'), '[ \\t\\r\\n]+', ' ', 'g'))) AS digest, regexp_extract(url, '^[a-z]+://([^/]+)', 1) AS host FROM pages
""")
def page_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Title, links, host and the digest of the visible text of each page."""
    plain = F.trim(F.regexp_replace(F.regexp_replace("html", "<[^>]*>", " "), "[ \\t\\r\\n]+", " "))
    return table(spark, sf_dir, "pages").select("page_id", F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"), F.size(F.regexp_extract_all("html", F.lit("(<a )"), F.lit(1))).cast("long").alias("links"), F.md5(plain).alias("digest"), F.regexp_extract("url", "^[a-z]+://([^/]+)", 1).alias("host"))


@plans.query("SELECT CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, CAST(count(*) AS BIGINT) AS n, round(sum(value), 4) AS value FROM events GROUP BY 1")
def property_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events and their value by a property inside their JSON."""
    return table(spark, sf_dir, "events").groupBy(F.get_json_object("props", "$.k").cast("long").alias("k")).agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("value"))


@plans.query("""
SELECT source, lang, CAST(count(*) AS BIGINT) AS docs, CAST(sum(n_chars) AS BIGINT) AS chars, CAST(GROUPING(source) * 2 + GROUPING(lang) AS BIGINT) AS level FROM documents GROUP BY GROUPING SETS ((source, lang), (source), (lang), ())
""")
def corpus_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents and characters by source and language, and their totals, in one pass."""
    docs = table(spark, sf_dir, "documents").select("source", "lang", "n_chars")
    return docs.cube("source", "lang").agg(F.count("*").alias("docs"), F.sum("n_chars").alias("chars"), F.grouping_id().cast("long").alias("level"))


@plans.query("""
SELECT o_orderkey, o_custkey, CAST(g AS BIGINT) AS streak FROM (SELECT *, sum(brk) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS g FROM (SELECT *, CASE WHEN date_diff('day', CAST(lag(o_orderdate) OVER w AS DATE), CAST(o_orderdate AS DATE)) <= 90 THEN 0 ELSE 1 END AS brk FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)))
""")
def order_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each customer's orders in sessions that end where 90 days pass without one."""
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    apart = F.coalesce(F.datediff(F.col("o_orderdate").cast("date"), F.lag("o_orderdate").over(w).cast("date")) > 90, F.lit(True))
    rows = table(spark, sf_dir, "orders").withColumn("apart", apart.cast("int"))
    return rows.select("o_orderkey", "o_custkey", F.sum("apart").over(w).alias("streak"))


QUERIES, SQL = plans.queries, plans.sql
