"""Queries over conflicting records: orders stand for signatures, benchmark items for proposals."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import conflicts, lexical
from ..sources.scratch import stored
from ..sources.tables import table
from .lexical import _BM25, TOP, ranked_documents
from .registering import Plans

plans = Plans()
ORIGIN = "1990-01-01"

_SIGNATURES = """
l AS MATERIALIZED (SELECT l_orderkey, CAST(max(l_shipdate) AS DATE) AS shipped, list_distinct(list(l_suppkey)) AS projects, list_distinct(list(l_returnflag)) AS channels FROM lineitem GROUP BY l_orderkey),
s AS MATERIALIZED (
  SELECT o_orderkey AS id, o_custkey AS axis, o_custkey % 3 <> 0 AS exclusive,
         CASE left(o_orderpriority, 1) WHEN '1' THEN 'must' WHEN '2' THEN 'should' WHEN '3' THEN 'may' WHEN '4' THEN 'should_not' ELSE 'must_not' END AS modality,
         CASE WHEN o_orderkey % 2 = 0 THEN 'ship' ELSE 'hold' END AS predicate,
         CASE o_orderstatus WHEN 'P' THEN '' ELSE o_orderstatus END AS object,
         CASE o_orderkey % 5 WHEN 0 THEN 'composes_with' WHEN 1 THEN 'requires' ELSE 'standalone' END AS relation,
         o_orderkey - 1 AS linked, projects, channels,
         CAST(o_orderdate AS DATE) AS first_day, CASE WHEN o_orderstatus = 'P' THEN NULL ELSE shipped END AS last_day
  FROM orders LEFT JOIN l ON l_orderkey = o_orderkey),
p AS MATERIALIZED (
  SELECT a.axis, a.id AS a, b.id AS b, b.first_day AS from_day, least(a.last_day, b.last_day) AS to_day
  FROM s a JOIN s b ON a.axis = b.axis AND (a.first_day < b.first_day OR a.first_day = b.first_day AND a.id < b.id)
  WHERE b.first_day <= coalesce(a.last_day, DATE '2099-01-01') AND a.first_day <= coalesce(a.last_day, DATE '2099-01-01') AND b.first_day <= coalesce(b.last_day, DATE '2099-01-01'))
"""


def signatures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An order as a signature: its customer the axis, its priority the modality, its lines' suppliers and flags the scope."""
    lines = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey"))
    lines = lines.agg(F.max("l_shipdate").alias("shipped"), F.collect_set("l_suppkey").alias("projects"), F.collect_set("l_returnflag").alias("channels"))
    rows = table(spark, sf_dir, "orders").join(lines, "o_orderkey", "left")
    first = F.substring("o_orderpriority", 1, 1)
    modality = F.when(first == "1", "must").when(first == "2", "should").when(first == "3", "may").when(first == "4", "should_not").otherwise("must_not")
    k, day = F.col("o_orderkey"), lambda c: F.date_diff(F.to_date(c), F.lit(ORIGIN).cast("date"))
    relation = F.when(k % 5 == 0, "composes_with").when(k % 5 == 1, "requires").otherwise("standalone")
    return rows.select(
        k.alias("id"), F.col("o_custkey").alias("axis"), (F.col("o_custkey") % 3 != 0).alias("exclusive"), modality.alias("modality"),
        F.when(k % 2 == 0, "ship").otherwise("hold").alias("predicate"), F.when(F.col("o_orderstatus") == "P", "").otherwise(F.col("o_orderstatus")).alias("object"),
        relation.alias("relation"), F.array(k - 1).alias("linked"), "projects", "channels",
        day("o_orderdate").alias("first_day"), F.when(F.col("o_orderstatus") != "P", day("shipped")).alias("last_day"),
    )


@plans.query(f"WITH {_SIGNATURES} SELECT axis, a, b, CAST(from_day AS VARCHAR) AS from_day, CAST(to_day AS VARCHAR) AS to_day FROM p")
def scope_overlaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders of one customer that are open on the same days, and from when to when."""
    far = (1 << (conflicts.LEVELS - 1)) - 1
    found = conflicts.overlapping(signatures(spark, sf_dir), "axis", "id", "first_day", "last_day")
    day = lambda c: F.date_add(F.lit(ORIGIN).cast("date"), F.col(c)).cast("string")
    return found.select("axis", "a", "b", day("from_day").alias("from_day"), F.when(F.col("to_day") < far, day("to_day")).alias("to_day"))


@plans.query(f"""
WITH {_SIGNATURES},
h AS MATERIALIZED (SELECT p.axis, p.b, i.* FROM p JOIN s i ON p.a = i.id),
j AS MATERIALIZED (
  SELECT h.axis, h.id AS a, b.id AS b, h.exclusive, h.modality AS m1, b.modality AS m2, lower(h.object) AS o1, lower(b.object) AS o2, h.predicate = b.predicate AS same,
         h.linked AS l1, b.linked AS l2, h.relation AS r1, b.relation AS r2, h.projects AS p1, b.projects AS p2, h.channels AS c1, b.channels AS c2
  FROM h JOIN s b ON h.b = b.id),
q AS (
  SELECT * FROM j WHERE l1 <> b AND l2 <> a AND NOT (r1 = r2 AND r1 <> 'standalone')
    AND (p1 IS NULL OR p2 IS NULL OR len(list_intersect(p1, p2)) > 0) AND (c1 IS NULL OR c2 IS NULL OR len(list_intersect(c1, c2)) > 0)),
g AS (
  SELECT *, CASE least(m1, m2) || ' ' || greatest(m1, m2) WHEN 'must must_not' THEN 'critical' WHEN 'must_not should' THEN 'medium' WHEN 'should should_not' THEN 'medium'
    WHEN 'must should_not' THEN 'medium' WHEN 'may must_not' THEN 'low' END AS grave FROM q)
SELECT axis, a, b,
  CASE WHEN grave IS NOT NULL AND (o1 = o2 OR o1 = '' OR o2 = '') THEN grave WHEN m1 = 'must' THEN 'critical' ELSE 'low' END AS severity,
  CASE WHEN grave IS NOT NULL AND (o1 = o2 OR o1 = '' OR o2 = '') THEN 'modality' ELSE 'competing' END AS kind
FROM g WHERE grave IS NOT NULL AND (o1 = o2 OR o1 = '' OR o2 = '') OR m1 = m2 AND same AND o1 <> o2 AND (m1 = 'must' AND exclusive OR m1 = 'should')
""")
def signature_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders of one customer, open on the same days and with a supplier and a flag in common, whose demands conflict."""
    return conflicts.signature_conflicts(stored(signatures(spark, sf_dir), "signatures"))


_NEGATIVE = " + ".join(f"CAST(regexp_matches({{0}}, '{p.replace(chr(39), chr(39) * 2)}') AS INTEGER)" for p in (
    r"\bnot\b", r"\bnever\b", r"\bdon't\b", r"\bdoesn't\b", r"\bshouldn't\b", r"\bwon't\b", r"\bcannot\b", r"\bcan't\b", r"\bdisable\b", r"\bremove\b",
    r"\bdelete\b", r"\bdeprecate\b", r"\brevert\b", r"\bundo\b", r"\broll\s*back\b", r"\binstead\b", r"\breplace\b",
))
_TURNED = " OR ".join(
    rf"regexp_matches(x, '\b{a}\b') AND regexp_matches(y, '\b{b}\b') OR regexp_matches(x, '\b{b}\b') AND regexp_matches(y, '\b{a}\b')"
    for a, b in (("active", "deprecated"), ("enable", "disable"), ("allow", "deny"), ("accept", "reject"), ("start", "stop"), ("add", "remove"), ("increase", "decrease"), ("true", "false"))
)


def _words(rows: str) -> str:
    return f"SELECT i, w, count(*) AS n FROM (SELECT i, unnest(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]+(?:''[a-z]+)?')) AS w FROM {rows}) WHERE regexp_matches(w, '^[a-z0-9]+(''[a-z]+)?$') GROUP BY ALL"


@plans.query(f"""
WITH {_BM25}, k AS (SELECT qid, doc_id, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id) AS rank FROM s),
c AS (SELECT qid AS a, doc_id AS b FROM k WHERE rank <= {TOP}),
wa AS ({_words("(SELECT item_id AS i, text FROM benchmark)")}), wb AS ({_words("(SELECT doc_id AS i, text FROM documents)")}),
d AS (SELECT a, b, sum(wa.n * wb.n) AS dot FROM c JOIN wa ON wa.i = a JOIN wb ON wb.i = b AND wb.w = wa.w GROUP BY ALL),
z AS (SELECT a, b, dot / (sqrt((SELECT sum(n * n) FROM wa WHERE i = a)) * sqrt((SELECT sum(n * n) FROM wb WHERE i = b))) AS similarity FROM d),
f AS (SELECT a, b, similarity, lower(p.text) AS x, lower(o.text) AS y FROM z JOIN benchmark p ON item_id = a JOIN documents o ON doc_id = b WHERE similarity >= 0.3),
ty AS (SELECT a, b, similarity, CASE WHEN similarity > 0.9 THEN 'duplicate'
  WHEN abs({_NEGATIVE.format("x")} - ({_NEGATIVE.format("y")})) >= 3 AND similarity > 0.5 OR similarity > 0.4 AND ({_TURNED}) THEN 'contradiction'
  WHEN similarity > 0.7 THEN 'refinement' ELSE 'related' END AS conflict_type FROM f)
SELECT * FROM (SELECT a AS item_id, b AS doc_id, round(similarity, 6) AS similarity, conflict_type, row_number() OVER (PARTITION BY a ORDER BY round(similarity, 6) DESC, b) AS rank FROM ty) WHERE rank <= 5
""")
def proposal_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each item as a proposal the five likest of the documents it ranks first, and what it is to each of them."""
    pairs = stored(ranked_documents(spark, sf_dir).select(F.col("qid").alias("a"), F.col("doc_id").alias("b")), "candidates")
    new = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("a"), "text")
    old = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("b"), "text")
    near = conflicts.cosines(pairs, new, old).where("similarity >= 0.3")
    both = near.join(new.withColumnRenamed("text", "x"), "a").join(old.withColumnRenamed("text", "y"), "b")
    typed = both.select(F.col("a").alias("item_id"), F.col("b").alias("doc_id"), F.round("similarity", 6).alias("similarity"), conflicts.conflict_type(F.col("x"), F.col("y"), F.col("similarity")).alias("conflict_type"))
    return lexical.top_k(typed, "item_id", "doc_id", 5, "similarity")


QUERIES, SQL = plans.queries, plans.sql
