"""Queries over embeddings without a model, field changes, vocabularies and context."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import without_invisible
from ..operators import audit, codebooks, embedding
from ..sources.scratch import scratch_path, stored
from ..sources.tables import table
from .ranking import QUERY_EACH
from .registering import Plans

plans = Plans()


@plans.query("""
WITH g AS (SELECT p_partkey, unnest(CASE WHEN length(n) >= 3 THEN list_distinct(list_transform(range(1, length(n) - 1), lambda i: substr(n, i, 3))) WHEN length(n) > 0 THEN [n] ELSE [] END) AS gram FROM (SELECT p_partkey, trim(lower(p_name)) AS n FROM part)),
c AS (SELECT p_partkey, CAST('0x' || substr(md5(gram), 1, 8) AS BIGINT) % 128 AS bucket, ln(count(*) + CAST(1 AS DOUBLE)) AS w FROM g GROUP BY ALL)
SELECT p_partkey, bucket, round(w / sqrt(sum(w * w) OVER (PARTITION BY p_partkey)), 6) AS weight FROM c
""")
def hashed_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Part names as vectors of 128 hashed trigram buckets, a row for each that is not 0."""
    return embedding.hashed(table(spark, sf_dir, "part"), "p_partkey", F.col("p_name")).withColumn("weight", F.round("weight", 6))


@plans.query()
def appended_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What vectors lose by the codes of a stored codebook, those it was trained on and those that came later, by label."""
    rows, folder = table(spark, sf_dir, "embeddings"), scratch_path(spark, "codebooks")
    first = rows.where("vec_id % 2 = 0")
    codebooks.saved(spark, embedding.Codebook.trained(first, parts=32), folder)
    book, version = codebooks.loaded(spark, folder)
    codes = codebooks.appended(stored(codebooks.coded(first, "vec_id", "embedding", book, version), "codes"), rows, "vec_id", "embedding", book, version)
    late = (F.col("vec_id") % 2 == 1).alias("late")
    by = codes.join(rows.select("vec_id", "label"), "vec_id").groupBy("label", late)
    return by.agg(F.count("*").alias("n"), F.round(F.avg("lost"), 4).alias("lost"), F.max("version").alias("version"))


@plans.query()
def quantized_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten nearest vectors of each query vector, as knn_cosine has them: from codes, the best candidates again in full."""
    return embedding.searched(table(spark, sf_dir, "embeddings"), "vec_id", F.col("vec_id") % QUERY_EACH == 0)


@plans.query("""
WITH a AS (SELECT o_custkey, CAST(count(*) AS VARCHAR) AS orders, max(o_orderpriority) AS priority, max(o_orderstatus) AS status FROM orders WHERE o_orderdate < TIMESTAMP '1998-01-01' GROUP BY o_custkey),
b AS (SELECT o_custkey, CAST(count(*) AS VARCHAR) AS orders, max(o_orderpriority) AS priority, max(o_orderstatus) AS status FROM orders GROUP BY o_custkey),
l AS (SELECT a.o_custkey, unnest(['orders', 'priority', 'status']) AS field, unnest([a.orders, a.priority, a.status]) AS before, unnest([b.orders, b.priority, b.status]) AS after FROM a JOIN b ON a.o_custkey = b.o_custkey)
SELECT * FROM l WHERE before IS DISTINCT FROM after
""")
def field_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What changed in each customer's orders between two states, field by field."""
    orders = table(spark, sf_dir, "orders")
    state = lambda df: df.groupBy("o_custkey").agg(F.count("*").alias("orders"), F.max("o_orderpriority").alias("priority"), F.max("o_orderstatus").alias("status"))
    return audit.field_changes(state(orders.where(F.col("o_orderdate") < F.lit("1998-01-01").cast("timestamp"))), state(orders), "o_custkey")


@plans.query("""
SELECT o_orderkey, field, value FROM (SELECT o_orderkey, 'o_orderstatus' AS field, o_orderstatus AS value FROM orders WHERE o_orderstatus NOT IN ('F', 'O') UNION ALL SELECT o_orderkey, 'o_orderpriority', o_orderpriority FROM orders WHERE o_orderpriority NOT IN ('1-URGENT', '2-HIGH', '3-MEDIUM'))
""")
def vocabulary_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders whose status or priority the vocabularies do not have."""
    return audit.violations(table(spark, sf_dir, "orders"), "o_orderkey", {"o_orderstatus": ["F", "O"], "o_orderpriority": ["1-URGENT", "2-HIGH", "3-MEDIUM"]})


@plans.query("""
SELECT h.conv_id, h.turn AS hit, n.turn AS turn, n.role FROM conversations h JOIN conversations n ON h.conv_id = n.conv_id AND n.turn BETWEEN h.turn AND h.turn + 2 WHERE h.role = 'user'
""")
def context_adjacency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user turn with the two turns that follow it: an equi-join on the turn, which is offered three places."""
    turns = table(spark, sf_dir, "conversations")
    asked = turns.where("role = 'user'").select("conv_id", F.col("turn").alias("hit"), F.explode(F.sequence(F.col("turn"), F.col("turn") + 2)).alias("turn"))
    return asked.join(turns.select("conv_id", "turn", "role"), ["conv_id", "turn"]).select("conv_id", "hit", "turn", "role")


@plans.query("SELECT doc_id, CAST(length(text) - length(regexp_replace(text, '[\\x{00AD}\\x{200B}-\\x{200F}\\x{202A}-\\x{202E}\\x{2060}-\\x{2064}\\x{FEFF}]', '', 'g')) AS BIGINT) AS invisible FROM documents")
def invisible_characters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many code points of each document show nothing."""
    return table(spark, sf_dir, "documents").select("doc_id", (F.char_length("text") - F.char_length(without_invisible(F.col("text")))).cast("long").alias("invisible"))


@plans.query("""
SELECT o_custkey, o_orderkey, CAST(dense_rank() OVER (PARTITION BY o_custkey ORDER BY strftime(o_orderdate, '%Y-%m')) AS INTEGER) AS month_no, round(avg(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 4) AS trend FROM orders
""")
def moving_trends(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each customer's orders with the number of their month and the mean price of the last three."""
    by = Window.partitionBy("o_custkey")
    order = by.orderBy("o_orderdate", "o_orderkey").rowsBetween(-2, 0)
    month = F.dense_rank().over(by.orderBy(F.date_format("o_orderdate", "yyyy-MM")))
    return table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", month.alias("month_no"), F.round(F.avg("o_totalprice").over(order), 4).alias("trend"))


QUERIES, SQL = plans.queries, plans.sql
