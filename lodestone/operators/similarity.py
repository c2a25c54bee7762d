"""Similarity join of small sets by prefix filtering: no pair is made that a shared rare token does not suggest."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import stored

SKETCH = 4  # words of 64 bits in the sketch of a set


def jaccard_pairs(sets: DataFrame, id_col: str, tokens: str, least: float) -> DataFrame:
    """(a, b, similarity), a < b, of all pairs of different sets with Jaccard similarity of ``least`` or more.

    Equal sets should be one row before. Tokens are ordered by how rare they are; two similar sets share a token among
    the first n - ceil(least * n) + 1 of the larger and the first n - ceil(2 * least / (1 + least) * n) + 1 of the smaller,
    so only those are joined, and only sets of near sizes meet. Each set brings a sketch, the parity of its tokens' hashes:
    two sets differ in as many tokens at least as their sketches do in bits. So the join itself drops pairs that differ too
    much, and the sets are moved for the few that are left.
    """
    rows = sets.select(F.col(id_col).alias("id"), F.array_distinct(F.col(tokens)).alias("t")).where(F.size("t") > 0)
    rows = stored(rows.withColumn("n", F.size("t")), "sets")
    a, b = rows.select(F.col("id").alias("a"), F.col("t").alias("ta")), rows.select(F.col("id").alias("b"), F.col("t").alias("tb"))
    shared = F.size(F.array_intersect("ta", "tb"))
    value = shared / (F.size("ta") + F.size("tb") - shared)
    return candidates(rows, least).join(a, "a").join(b, "b").withColumn("similarity", value).where(F.col("similarity") >= least).select("a", "b", "similarity")


def candidates(rows: DataFrame, least: float) -> DataFrame:
    """(a, b), a < b, of sets (id, t, n) that share a token of their prefixes and whose sizes and sketches allow the similarity."""
    each = rows.select("id", "n", F.explode("t").alias("token"))
    rare = each.groupBy("token").agg(F.count("*").alias("df"))
    bits = [F.bit_xor(F.expr(f"IF(pmod(h, {SKETCH}) = {i}, shiftleft(1L, CAST(pmod(shiftright(h, 32), 64) AS INT)), 0L)")).alias(f"s{i}") for i in range(SKETCH)]
    ranked = each.join(rare, "token").withColumn("h", F.xxhash64("token")).groupBy("id", "n").agg(F.transform(F.array_sort(F.collect_list(F.struct("df", "token"))), lambda s: s["token"]).alias("t"), *bits)
    first = lambda share: (F.col("n") - F.ceil(F.col("n") * share - 1e-9) + 1).cast("int")
    prefix = stored(ranked.select("id", "n", F.array(*[f"s{i}" for i in range(SKETCH)]).alias("s"), first(2 * least / (1 + least)).alias("short"), F.posexplode(F.slice("t", F.lit(1), first(least))).alias("at", "token")), "prefixes")
    left = prefix.select(F.col("id").alias("a"), F.col("n").alias("na"), F.col("s").alias("sa"), "token")
    right = prefix.where("at < short").select(F.col("id").alias("b"), F.col("n").alias("nb"), F.col("s").alias("sb"), "token")
    larger = (F.col("na") > F.col("nb")) | ((F.col("na") == F.col("nb")) & (F.col("a") > F.col("b")))
    apart = sum((F.bit_count(F.col("sa")[i].bitwiseXOR(F.col("sb")[i])) for i in range(SKETCH)), F.lit(0))
    near = larger & (F.col("nb") >= F.col("na") * least - 1e-9) & (apart <= (F.col("na") + F.col("nb")) * ((1 - least) / (1 + least)) + 1e-9)
    return left.join(right, "token").where(near).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
