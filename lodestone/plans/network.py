"""Queries over ledgers and over the network of orders, parts, suppliers and places."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import ledger, network
from ..sources.scratch import stored
from ..sources.tables import table
from .registering import Plans

plans = Plans()

_ENTRIES = """
e AS (SELECT user_id, strftime(ts, '%Y-%m-%d') AS day, event_id, event_type, CAST(CAST(round(value * 100) AS BIGINT) AS VARCHAR) AS amount,
        row_number() OVER (PARTITION BY user_id, strftime(ts, '%Y-%m-%d') ORDER BY event_id) AS seq, CAST(event_id AS VARCHAR) AS id FROM events),
c AS (SELECT user_id, day, event_id, seq, sha256(repeat('0', 64) || chr(0) || id || chr(0) || event_type || chr(0) || amount) AS entry_hash FROM e WHERE seq = 1
      UNION ALL SELECT e.user_id, e.day, e.event_id, e.seq, sha256(c.entry_hash || chr(0) || e.id || chr(0) || e.event_type || chr(0) || e.amount) FROM c JOIN e ON e.user_id = c.user_id AND e.day = c.day AND e.seq = c.seq + 1)
"""
_CHAIN, _FIELDS = ["user_id", "day"], ["id", "event_type", "amount"]


def entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as ledger entries: a chain for each user and day."""
    cents = F.round(F.col("value") * 100).cast("long").cast("string")
    return table(spark, sf_dir, "events").select("user_id", F.date_format("ts", "yyyy-MM-dd").alias("day"), "event_id", F.col("event_id").cast("string").alias("id"), "event_type", cents.alias("amount"))


@plans.query(f"WITH RECURSIVE {_ENTRIES} SELECT user_id, day, event_id, seq, entry_hash FROM c")
def chained_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each entry's hash, which contains the hash of the entry before it in its chain."""
    return ledger.chained(entries(spark, sf_dir), _CHAIN, "event_id", _FIELDS)


@plans.query(f"WITH RECURSIVE {_ENTRIES} SELECT user_id, day, count(*) AS n, min(CASE WHEN event_id % 97 = 0 THEN seq END) AS broken_at FROM c GROUP BY user_id, day")
def tampered_chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where each chain breaks once the amounts of some entries are changed behind its back."""
    rows = entries(spark, sf_dir)
    held = stored(ledger.chained(rows, _CHAIN, "event_id", _FIELDS), "ledger")
    changed = rows.withColumn("amount", F.when(F.col("event_id") % 97 == 0, F.concat("amount", F.lit("0"))).otherwise(F.col("amount")))
    return ledger.broken_at(held, changed, _CHAIN, "event_id", _FIELDS)


@plans.query(f"WITH RECURSIVE {_ENTRIES} SELECT user_id, day, event_id, seq, entry_hash FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS r FROM c) WHERE r <= 3")
def latest_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last three ledger entries of each user."""
    last = Window.partitionBy("user_id").orderBy(F.col("event_id").desc())
    return chained_entries(spark, sf_dir).withColumn("r", F.row_number().over(last)).where("r <= 3").drop("r")


_TREE = """
l AS (SELECT event_type AS tree, row_number() OVER (PARTITION BY event_type ORDER BY event_id) - 1 AS pos, count(*) OVER (PARTITION BY event_type) AS n,
        sha256('L:' || event_id || '|' || sha256(event_type || chr(0) || CAST(CAST(round(value * 100) AS BIGINT) AS VARCHAR))) AS hash, event_id FROM events),
v AS (SELECT tree, 0 AS level, CAST(pos AS BIGINT) AS pos, hash, CAST(n AS BIGINT) AS n FROM l
      UNION ALL SELECT tree, level + 1, pos // 2, sha256('N:' || max(CASE WHEN pos % 2 = 0 THEN hash END) || '|' || coalesce(max(CASE WHEN pos % 2 = 1 THEN hash END), max(CASE WHEN pos % 2 = 0 THEN hash END))), (n + 1) // 2
      FROM v WHERE n > 1 GROUP BY tree, level, pos // 2, n)
"""


def leaves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as leaves, a tree for each kind; places come from ranges of ids and how many leaves are in earlier ones."""
    cents = F.round(F.col("value") * 100).cast("long").alias("cents")
    rows = table(spark, sf_dir, "events").select(F.col("event_type").alias("tree"), "event_id", cents)
    ranged = rows.repartitionByRange(rows.count() // ledger.PART_ROWS + 1, "tree", "event_id").sortWithinPartitions("tree", "event_id")
    placed = stored(ranged.withColumn("at", F.monotonically_increasing_id()), "leaves")
    part = F.shiftright("at", 33)
    parts = placed.groupBy(part.alias("part"), "tree").agg(F.count("*").alias("c"), F.min("at").alias("first"))
    before = Window.partitionBy("tree").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("part", "tree", "first", F.coalesce(F.sum("c").over(before), F.lit(0)).alias("before"), F.sum("c").over(Window.partitionBy("tree")).alias("n"))
    out = placed.withColumn("part", part).join(stored(parts, "leaf-parts"), ["part", "tree"])  # written, so that its size is known
    return out.select("tree", "event_id", (F.col("at") - F.col("first") + F.col("before")).alias("pos"), "cents", "n")


def _leaf_hash() -> Column:
    content = F.sha2(F.concat_ws("\0", "tree", F.col("cents").cast("string")), 256)
    return F.sha2(F.concat(F.lit("L:"), F.col("event_id"), F.lit("|"), content), 256)


def _levels(rows: DataFrame) -> DataFrame:
    most = rows.agg(F.max("n").alias("n")).first()["n"] or 1
    return ledger.merkle_levels(rows, "tree", most)


@plans.query(f"WITH RECURSIVE {_TREE} SELECT tree, level AS height, hash AS root FROM v WHERE n = 1")
def merkle_roots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The root of the tree over each kind's events, and how high it stands."""
    return _levels(leaves(spark, sf_dir).withColumn("hash", _leaf_hash())).where("n = 1").select("tree", F.col("level").alias("height"), F.col("hash").alias("root"))


@plans.query(f"WITH RECURSIVE {_TREE} SELECT l.event_id, v.level AS steps, v.hash AS root, true AS proven FROM l JOIN v ON l.tree = v.tree AND v.n = 1 WHERE l.event_id % 20 = 0 AND v.level > 0")
def merkle_proofs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For every fiftieth event the length of its proof, the root it leads to, and whether that is the tree's."""
    return ledger.proven(leaves(spark, sf_dir), "tree", "event_id", _leaf_hash(), F.col("event_id") % 20 == 0)


_EDGES = """
edges AS (
  SELECT 'c' || o_custkey AS src, 'placed' AS predicate, 'o' || o_orderkey AS dst, CAST(1.0 AS DOUBLE) AS confidence FROM orders
  UNION ALL SELECT 'o' || l_orderkey, 'contains', 'p' || l_partkey, max(l_quantity) / 50 FROM lineitem GROUP BY l_orderkey, l_partkey
  UNION ALL SELECT 'p' || l_partkey, 'supplied', 's' || l_suppkey, max(l_quantity) / 50 FROM lineitem GROUP BY l_partkey, l_suppkey
  UNION ALL SELECT 's' || s_suppkey, 'in', 'n' || s_nationkey, CAST(1.0 AS DOUBLE) FROM supplier
  UNION ALL SELECT 'n' || n_nationkey, 'in', 'r' || n_regionkey, CAST(1.0 AS DOUBLE) FROM nation)
"""


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Typed edges of the tables, one for each pair and predicate, at its greatest confidence."""
    t = lambda name: table(spark, sf_dir, name)
    node = lambda letter, c: F.concat(F.lit(letter), F.col(c))
    lines = lambda a, b: t("lineitem").groupBy(a, b).agg((F.max("l_quantity") / 50).alias("confidence"))
    edge = lambda df, a, predicate, b, c: df.select(a.alias("src"), F.lit(predicate).alias("predicate"), b.alias("dst"), c.alias("confidence"))
    out = edge(t("orders"), node("c", "o_custkey"), "placed", node("o", "o_orderkey"), F.lit(1.0))
    out = out.union(edge(lines("l_orderkey", "l_partkey"), node("o", "l_orderkey"), "contains", node("p", "l_partkey"), F.col("confidence")))
    out = out.union(edge(lines("l_partkey", "l_suppkey"), node("p", "l_partkey"), "supplied", node("s", "l_suppkey"), F.col("confidence")))
    out = out.union(edge(t("supplier"), node("s", "s_suppkey"), "in", node("n", "s_nationkey"), F.lit(1.0)))
    return out.union(edge(t("nation"), node("n", "n_nationkey"), "in", node("r", "n_regionkey"), F.lit(1.0)))


def links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(src, dst) of the edges, as often as the tables have them."""
    node = lambda letter, c: F.concat(F.lit(letter), F.col(c))
    link = lambda name, a, b: table(spark, sf_dir, name).select(node(*a).alias("src"), node(*b).alias("dst"))
    out = link("orders", ("c", "o_custkey"), ("o", "o_orderkey")).union(link("lineitem", ("o", "l_orderkey"), ("p", "l_partkey")))
    out = out.union(link("lineitem", ("p", "l_partkey"), ("s", "l_suppkey"))).union(link("supplier", ("s", "s_suppkey"), ("n", "s_nationkey")))
    return out.union(link("nation", ("n", "n_nationkey"), ("r", "n_regionkey")))


@plans.query(f"WITH {_EDGES} SELECT predicate, count(*) AS n, count(DISTINCT src) AS sources, count(DISTINCT dst) AS targets, round(avg(confidence), 6) AS confidence FROM edges GROUP BY predicate")
def edge_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges, sources and targets of each predicate."""
    rows = edges(spark, sf_dir).groupBy("predicate")
    return rows.agg(F.count("*").alias("n"), F.countDistinct("src").alias("sources"), F.countDistinct("dst").alias("targets"), F.round(F.avg("confidence"), 6).alias("confidence"))


@plans.query(f"WITH {_EDGES} SELECT src, predicate, dst, round(confidence, 6) AS confidence, rank FROM (SELECT *, row_number() OVER (PARTITION BY src, predicate ORDER BY confidence DESC, dst) AS rank FROM edges WHERE predicate IN ('contains', 'supplied') AND confidence >= 0.5) WHERE rank <= 2")
def strongest_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The two surest edges of each node and of two predicates, among those that are sure enough."""
    order = Window.partitionBy("src", "predicate").orderBy(F.col("confidence").desc(), "dst")
    rows = edges(spark, sf_dir).where(F.col("predicate").isin("contains", "supplied") & (F.col("confidence") >= 0.5))
    return rows.withColumn("rank", F.row_number().over(order)).where("rank <= 2").withColumn("confidence", F.round("confidence", 6))


@plans.query(f"WITH {_EDGES} SELECT dst AS node, predicate, count(*) AS incoming, round(sum(CASE predicate WHEN 'contains' THEN 0.5 WHEN 'supplied' THEN 0.8 ELSE 0.2 END * confidence), 6) AS boost FROM edges GROUP BY dst, predicate")
def incoming_boost(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a node's incoming edges add to it, each predicate at its weight."""
    weight = F.when(F.col("predicate") == "contains", 0.5).when(F.col("predicate") == "supplied", 0.8).otherwise(0.2)
    return edges(spark, sf_dir).groupBy(F.col("dst").alias("node"), "predicate").agg(F.count("*").alias("incoming"), F.round(F.sum(weight * F.col("confidence")), 6).alias("boost"))


@plans.query(f"""
WITH RECURSIVE {_EDGES}, b AS (SELECT src AS node, dst AS near FROM edges UNION SELECT dst, src FROM edges),
w AS (SELECT 'c' || c_custkey AS seed, 'c' || c_custkey AS node, 0 AS hop FROM customer WHERE c_custkey % 20 = 0
      UNION SELECT w.seed, b.near, w.hop + 1 FROM w JOIN b ON w.node = b.node WHERE w.hop < 3),
m AS (SELECT seed, node, min(hop) AS hop FROM w GROUP BY seed, node)
SELECT seed, node, CAST(hop AS BIGINT) AS hop, round(pow(0.5, hop), 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY seed ORDER BY hop, node) AS r FROM m WHERE hop > 0) WHERE r <= 50
""")
def expanded_seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What every hundredth customer reaches in three hops, at most fifty records each, halved at each hop."""
    seeds = table(spark, sf_dir, "customer").where("c_custkey % 20 = 0").select(F.concat(F.lit("c"), "c_custkey").alias("seed"))
    both = stored(network.both_ways(edges(spark, sf_dir)), "both-ways")
    return network.expanded(both, seeds, 3).withColumn("score", F.round("score", 6))


@plans.query(f"""
WITH RECURSIVE {_EDGES}, d AS (SELECT DISTINCT src, dst FROM edges),
w AS (SELECT 'o' || o_orderkey AS start, ['o' || o_orderkey] AS path, 'o' || o_orderkey AS last FROM orders WHERE o_orderkey % 20 = 0
      UNION ALL SELECT w.start, list_append(w.path, d.dst), d.dst FROM w JOIN d ON d.src = w.last WHERE NOT list_contains(w.path, d.dst))
SELECT start, count(*) AS n, min(array_to_string(path, '>')) AS first_path, max(array_to_string(path, '>')) AS last_path FROM w WHERE last NOT IN (SELECT src FROM d) GROUP BY start
""")
def causal_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All paths from every twentieth order to what depends on nothing."""
    starts = table(spark, sf_dir, "orders").where("o_orderkey % 20 = 0").select(F.concat(F.lit("o"), "o_orderkey").alias("start"))
    paths = network.paths_to_roots(edges(spark, sf_dir), starts).withColumn("path", F.array_join("path", ">"))
    return paths.groupBy("start").agg(F.count("*").alias("n"), F.min("path").alias("first_path"), F.max("path").alias("last_path"))


@plans.query(f"""
WITH RECURSIVE {_EDGES}, d AS (SELECT DISTINCT src, dst FROM edges),
w AS (SELECT src AS node, 0 AS level FROM d WHERE src NOT IN (SELECT dst FROM d) UNION SELECT d.dst, w.level + 1 FROM w JOIN d ON d.src = w.node)
SELECT level, count(*) AS nodes, min(node) AS first_node FROM (SELECT node, CAST(max(level) AS BIGINT) AS level FROM w GROUP BY node) GROUP BY level
""")
def dependency_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many records stand on each level of the order of dependencies."""
    found = network.levels(edges(spark, sf_dir))
    return found.groupBy("level").agg(F.count("*").alias("nodes"), F.min("node").alias("first_node"))


@plans.query(f"""
WITH RECURSIVE {_EDGES}, d AS (SELECT DISTINCT src, dst FROM edges),
k AS (SELECT DISTINCT 'r' || (c_custkey % 5) AS src, 'c' || c_custkey AS dst FROM customer WHERE c_custkey % 20 = 0),
w AS (SELECT src, dst, dst AS node FROM k UNION SELECT w.src, w.dst, d.dst FROM w JOIN d ON d.src = w.node)
SELECT src, dst, bool_or(node = src) AS cyclic FROM w GROUP BY src, dst
""")
def cycle_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether an edge from a region to a customer would close a cycle."""
    candidates = table(spark, sf_dir, "customer").where("c_custkey % 20 = 0").select(F.concat(F.lit("r"), F.col("c_custkey") % 5).alias("src"), F.concat(F.lit("c"), "c_custkey").alias("dst"))
    return network.closes_cycle(links(spark, sf_dir), candidates)


_ALIAS = "SELECT alias, min(item_id) AS entity FROM (SELECT item_id, unnest(regexp_extract_all(lower(text), '[a-z]{6,}')) AS alias FROM benchmark) GROUP BY alias"


@plans.query(f"""
WITH a AS ({_ALIAS}), t AS (SELECT conv_id, turn, unnest(w) AS word, unnest(range(len(w))) AS pos FROM (SELECT conv_id, turn, regexp_extract_all(lower(text), '[a-z]{{6,}}') AS w FROM conversations)),
f AS (SELECT conv_id, turn, entity, min(pos) AS pos, count(*) AS mentions FROM t JOIN a ON t.word = a.alias GROUP BY conv_id, turn, entity)
SELECT conv_id, turn, entity, mentions, rank FROM (SELECT *, row_number() OVER (PARTITION BY conv_id, turn ORDER BY pos, entity) AS rank FROM f) WHERE rank <= 3
""")
def resolved_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first three entities that each turn names by one of their aliases; an alias belongs to its first entity."""
    said = lambda c: F.regexp_extract_all(F.lower(F.col(c)), F.lit("[a-z]{6,}"), F.lit(0))
    aliases = table(spark, sf_dir, "benchmark").select("item_id", F.explode(said("text")).alias("word")).groupBy("word").agg(F.min("item_id").alias("entity"))
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.posexplode(said("text")).alias("pos", "word"))
    found = turns.join(aliases, "word").groupBy("conv_id", "turn", "entity").agg(F.min("pos").alias("pos"), F.count("*").alias("mentions"))
    order = Window.partitionBy("conv_id", "turn").orderBy("pos", "entity")
    return found.withColumn("rank", F.row_number().over(order)).where("rank <= 3").drop("pos")


@plans.query(f"WITH a AS ({_ALIAS}) SELECT entity, count(*) AS aliases, min(alias) AS first_alias, max(alias) AS last_alias FROM a GROUP BY entity")
def entity_aliases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The aliases of each entity."""
    words = F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]{6,}"), F.lit(0))).alias("alias")
    owned = table(spark, sf_dir, "benchmark").select("item_id", words).groupBy("alias").agg(F.min("item_id").alias("entity"))
    return owned.groupBy("entity").agg(F.count("*").alias("aliases"), F.min("alias").alias("first_alias"), F.max("alias").alias("last_alias"))


@plans.query(f"""
WITH {_EDGES}, p AS (SELECT src, predicate, dst, confidence, CASE WHEN confidence >= 0.8 THEN 'approved' WHEN confidence < 0.2 THEN 'rejected' ELSE 'pending' END AS status FROM edges WHERE predicate = 'supplied')
SELECT status, count(*) AS n, round(min(confidence), 6) AS least, round(max(confidence), 6) AS most, count(CASE WHEN status = 'approved' AND EXISTS (SELECT 1 FROM edges e WHERE e.src = p.dst) THEN 1 END) AS linked FROM p GROUP BY status
""")
def edge_proposals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Staged edges by what becomes of them, and how many approved ones lead on."""
    rows = edges(spark, sf_dir)
    status = F.when(F.col("confidence") >= 0.8, "approved").when(F.col("confidence") < 0.2, "rejected").otherwise("pending")
    staged = rows.where("predicate = 'supplied'").withColumn("status", status)
    leading = rows.select(F.col("src").alias("dst")).distinct().withColumn("leads", F.lit(1))
    out = staged.join(leading, "dst", "left").groupBy("status")
    linked = F.count(F.when((F.col("status") == "approved") & F.col("leads").isNotNull(), 1))
    return out.agg(F.count("*").alias("n"), F.round(F.min("confidence"), 6).alias("least"), F.round(F.max("confidence"), 6).alias("most"), linked.alias("linked"))


QUERIES, SQL = plans.queries, plans.sql
