"""Ledgers and snapshots: linked hashes, their verification, and differences between two states."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

GENESIS = "0" * 64


def content_hash(*columns: Column) -> Column:
    """SHA-256 over the columns as text, parted by a bar; null is empty."""
    return F.sha2(F.concat_ws("|", *[F.coalesce(c.cast("string"), F.lit("")) for c in columns]), 256)


def linked(entries: DataFrame, chain: str, order: str, digest: str) -> DataFrame:
    """entries with the digest of the one before in their chain; the first has the genesis digest."""
    return entries.withColumn("previous", F.coalesce(F.lag(digest).over(Window.partitionBy(chain).orderBy(order)), F.lit(GENESIS)))


def broken_links(entries: DataFrame, chain: str, order: str, digest: str, previous: str) -> DataFrame:
    """The entries whose ``previous`` is not the digest of the one before in their chain."""
    before = F.coalesce(F.lag(digest).over(Window.partitionBy(chain).orderBy(order)), F.lit(GENESIS))
    return entries.withColumn("__before", before).where(~F.col(previous).eqNullSafe(F.col("__before"))).drop("__before")


def differences(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """(key, change): the keys that were added, removed or changed between two states of a table."""
    state = lambda df: df.select(key, content_hash(*[F.col(c) for c in df.columns if c != key]).alias("h"))
    both = state(old).withColumnRenamed("h", "was").join(state(new).withColumnRenamed("h", "is"), key, "full_outer")
    change = F.when(F.col("was").isNull(), "added").when(F.col("is").isNull(), "removed").when(F.col("was") != F.col("is"), "changed")
    return both.select(key, change.alias("change")).where("change is not null")



def field_changes(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """(key, field, before, after): what changed in the fields that both states of a record have, as text."""
    fields = [c for c in old.columns if c != key and c in new.columns]

    def long(df: DataFrame, name: str) -> DataFrame:
        return df.select(key, F.explode(F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).cast("string").alias(name)) for c in fields])).alias("f")).select(key, "f.*")

    both = long(old, "before").join(long(new, "after"), [key, "field"])
    return both.where(~F.col("before").eqNullSafe(F.col("after")))


def violations(rows: DataFrame, key: str, vocabularies: dict[str, list[str]]) -> DataFrame:
    """(key, field, value): values that their field's vocabulary does not have; null is no violation."""
    checks = [F.when(~F.col(c).isin(*allowed), F.struct(F.lit(c).alias("field"), F.col(c).cast("string").alias("value"))) for c, allowed in vocabularies.items()]
    found = rows.select(key, F.explode(F.array(*checks)).alias("v")).where("v is not null")
    return found.select(key, "v.field", "v.value")
