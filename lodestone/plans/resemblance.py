"""Queries over texts and ids that resemble others."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import resemblance
from ..sources.tables import table
from .registering import Plans

plans = Plans()


@plans.query()
def near_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each turn the one of the five before it in its conversation that it resembles most, from a ratio of 0.3 on."""
    turns = table(spark, sf_dir, "conversations").withColumn("at", F.timestamp_seconds(60 * F.col("turn")))
    found = resemblance.near_repeats(turns, "conv_id", "turn", "text", "at", 0.3, "INTERVAL 5 MINUTES")
    return found.select("conv_id", F.col("id").alias("turn"), "prior", F.round("ratio", 6).alias("ratio"))


@plans.query("""
WITH d AS (SELECT 'C-' || lpad(CAST(c_custkey AS VARCHAR), 6, '0') AS id FROM customer WHERE c_custkey % 4 <> 0),
c AS (SELECT DISTINCT CASE o_orderkey % 5 WHEN 0 THEN left(id, 4) || substr(id, 6) WHEN 1 THEN left(id, 7) || 'X' ELSE id END AS id FROM (SELECT o_orderkey, 'C-' || lpad(CAST(o_custkey AS VARCHAR), 6, '0') AS id FROM orders)),
b AS (SELECT id FROM c WHERE id NOT IN (SELECT id FROM d)),
p AS (SELECT b.id, d.id AS known, levenshtein(b.id, d.id) AS distance FROM b, d WHERE levenshtein(b.id, d.id) <= 1),
m AS (SELECT id, min((distance, known)) AS m FROM p GROUP BY id)
SELECT b.id, m.m[2] AS nearest, CAST(m.m[1] AS BIGINT) AS distance FROM b LEFT JOIN m ON m.id = b.id
""")
def nearest_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nearest known customer of each id that orders cite, some of them misspelt, and that no customer has."""
    name = lambda c: F.concat(F.lit("C-"), F.lpad(F.col(c).cast("string"), 6, "0"))
    defined = table(spark, sf_dir, "customer").where("c_custkey % 4 <> 0").select(name("c_custkey").alias("id"))
    cited = table(spark, sf_dir, "orders").select("o_orderkey", name("o_custkey").alias("id"))
    k, i = F.col("o_orderkey") % 5, F.col("id")
    cited = cited.select(F.when(k == 0, F.concat(F.left(i, F.lit(4)), F.substring(i, 6, 99))).when(k == 1, F.concat(F.left(i, F.lit(7)), F.lit("X"))).otherwise(i).alias("id"))
    return resemblance.nearest_ids(cited, defined, 1)


QUERIES, SQL = plans.queries, plans.sql
