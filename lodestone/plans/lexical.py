"""Queries over the lexical operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text
from ..operators import lexical
from ..sources.scratch import stored
from ..sources.tables import table
from . import sql
from .registering import Plans

plans = Plans()
TOP = 10
DOC_TERMS, ITEM_TERMS = sql.terms("documents", "doc_id", "text"), sql.terms("benchmark", "item_id", "text")

_BM25 = f"""
t AS (SELECT doc_id, term, CAST(count(*) AS DOUBLE) AS tf FROM ({DOC_TERMS}) GROUP BY ALL),
q AS (SELECT item_id AS qid, term, count(*) AS times FROM ({ITEM_TERMS}) GROUP BY ALL),
l AS (SELECT doc_id, sum(tf) AS length FROM t GROUP BY doc_id),
n AS (SELECT CAST(count(*) AS DOUBLE) AS n FROM documents),
m AS (SELECT (SELECT sum(length) FROM l) / n AS mean_length, n FROM n),
r AS (SELECT term, ln((n - df + CAST(0.5 AS DOUBLE)) / (df + CAST(0.5 AS DOUBLE)) + CAST(1 AS DOUBLE)) AS rarity, mean_length FROM (SELECT term, CAST(count(*) AS DOUBLE) AS df FROM t GROUP BY term), m),
s AS (SELECT qid, doc_id, round(sum(times * rarity * tf * CAST(2.2 AS DOUBLE) / (tf + CAST(1.2 AS DOUBLE) * (CAST(0.25 AS DOUBLE) + CAST(0.75 AS DOUBLE) * length / mean_length))), 6) AS score
      FROM t JOIN r USING (term) JOIN l USING (doc_id) JOIN q USING (term) GROUP BY qid, doc_id)
"""
_RANKED = f"SELECT * FROM (SELECT qid, doc_id, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id) AS rank FROM s) WHERE rank <= {TOP}"


def _posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = lexical.term_counts(table(spark, sf_dir, "documents"), "doc_id", F.col("text"))
    return stored(counts.select("doc_id", "term", F.col("n").cast("double").alias("tf")), "postings")


def _asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.terms(table(spark, sf_dir, "benchmark"), "item_id", F.col("text")).select(F.col("item_id").alias("qid"), "term")


def ranked_documents(spark: SparkSession, sf_dir: str, posts: DataFrame | None = None) -> DataFrame:
    """(qid, doc_id, score, rank): the best documents for each benchmark item as a query."""
    posts = posts or _posts(spark, sf_dir)
    n = table(spark, sf_dir, "documents").agg(F.count("*").cast("double").alias("n"))
    scores = lexical.bm25_scores(posts, n, _asked(spark, sf_dir), "doc_id").withColumn("score", F.round("score", 6))
    return lexical.top_k(scores, "qid", "doc_id", TOP)


@plans.query(f"WITH {_BM25} {_RANKED}")
def bm25_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best documents for each benchmark item."""
    return ranked_documents(spark, sf_dir)


@plans.query(f"""
WITH f AS (
  SELECT p_partkey, term, sum(w) AS tf FROM (
    SELECT p_partkey, term, CAST(3.0 AS DOUBLE) AS w FROM ({sql.terms("part", "p_partkey", "p_name")})
    UNION ALL SELECT p_partkey, term, CAST(0.8 AS DOUBLE) FROM ({sql.terms("part", "p_partkey", "p_type")})
    UNION ALL SELECT p_partkey, term, CAST(0.5 AS DOUBLE) FROM ({sql.terms("part", "p_partkey", "p_brand")})
  ) GROUP BY ALL
)
SELECT term, CAST(count(*) AS BIGINT) AS df, round(sum(tf), 6) AS weight, round(max(tf), 6) AS most FROM f GROUP BY term
""")
def field_weighted_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Field-weighted term frequencies of parts: name, type and brand count differently."""
    part = table(spark, sf_dir, "part")
    fields = [(lexical.terms(part, "p_partkey", F.col(c)), w) for c, w in (("p_name", 3.0), ("p_type", 0.8), ("p_brand", 0.5))]
    posts = lexical.postings(fields, "p_partkey")
    return posts.groupBy("term").agg(F.count("*").alias("df"), F.round(F.sum("tf"), 6).alias("weight"), F.round(F.max("tf"), 6).alias("most"))


@plans.query(f"SELECT term, CAST(count(*) AS BIGINT) AS occurrences, CAST(count(DISTINCT doc_id) AS BIGINT) AS df FROM ({DOC_TERMS}) GROUP BY term")
def term_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Occurrences and document frequency of every stemmed term."""
    posts = _posts(spark, sf_dir)
    return posts.groupBy("term").agg(F.sum("tf").cast("long").alias("occurrences"), F.count("*").alias("df"))


@plans.query(f"""
WITH {_BM25}, k AS ({_RANKED}), w AS (SELECT qid, doc_id, score / sum(score) OVER (PARTITION BY qid) AS weight FROM k),
c AS (SELECT term, sum(tf) / (SELECT sum(tf) FROM t) AS p_term FROM t GROUP BY term),
p AS (SELECT qid, term, round(sum(weight * (tf + CAST(2000 AS DOUBLE) * p_term) / (length + CAST(2000 AS DOUBLE))), 9) AS p FROM w JOIN l USING (doc_id) JOIN t USING (doc_id) JOIN c USING (term) GROUP BY qid, term)
SELECT * FROM (SELECT qid, term, p, row_number() OVER (PARTITION BY qid ORDER BY p DESC, term) AS rank FROM p) WHERE rank <= 5
""")
def feedback_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five terms that speak most for the documents each item ranks first."""
    posts = _posts(spark, sf_dir)
    return lexical.feedback_terms(posts, stored(ranked_documents(spark, sf_dir, posts), "ranked"), "doc_id")


@plans.query(f"""
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(list_distinct(w)) AS BIGINT) AS n_distinct
FROM (SELECT doc_id, regexp_extract_all(lower(text), '[a-z0-9_]+') AS w FROM documents)
""")
def token_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words and distinct words of each document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", text.words(F.col("text")).alias("w"))
    return docs.select("doc_id", F.size("w").cast("long").alias("n_words"), F.size(F.array_distinct("w")).cast("long").alias("n_distinct"))


@plans.query("""
SELECT doc_id, CAST(i AS BIGINT) AS chunk, CAST(len(list_slice(w, i * 48 + 1, i * 48 + 64)) AS BIGINT) AS n_words, md5(list_aggregate(list_slice(w, i * 48 + 1, i * 48 + 64), 'string_agg', ' ')) AS digest
FROM (SELECT doc_id, w, unnest(range(greatest(1, CAST(ceil((len(w) - 16) / 48.0) AS BIGINT)))) AS i FROM (SELECT doc_id, regexp_extract_all(lower(text), '[a-z0-9_]+') AS w FROM documents) WHERE len(w) > 0)
""")
def chunk_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents cut to windows of 64 words that share 16 with the one before."""
    docs = table(spark, sf_dir, "documents").select("doc_id", text.words(F.col("text")).alias("w")).where(F.size("w") > 0)
    rows = docs.select("doc_id", F.posexplode(text.chunks(F.col("w"), 64, 16)).alias("chunk", "c"))
    return rows.where((F.col("chunk") == 0) | (F.size("c") > 16)).select("doc_id", F.col("chunk").cast("long").alias("chunk"), F.size("c").cast("long").alias("n_words"), F.md5(F.array_join("c", " ")).alias("digest"))


QUERIES, SQL = plans.queries, plans.sql
