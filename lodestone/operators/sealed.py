"""Records under lock: AES in Galois/counter mode, bound to their id, with keys that can be replaced.

Keys are rows (key_id, key) of a table of the user's own and reach the records by a join, so no key stands in a plan. The
record's id is authenticated with the content: one that was changed, or put in the place of another, does not open.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def seal(rows: DataFrame, keys: DataFrame, key_id: str) -> DataFrame:
    """(id, key_id, sealed) from rows (id, content, key_id): content under the key that the column key_id names.

    A null content stays null; a key that is not among the keys fails the job, so that nothing is stored in the clear or lost.
    """
    known = keys.select(F.col("key_id").alias("k"), "key", F.lit(True).alias("known"))
    both = rows.join(known, F.col(key_id) == F.col("k"), "left")
    key = F.when(F.col("known"), F.col("key")).otherwise(F.raise_error(F.concat(F.lit("no such key: "), F.coalesce(F.col(key_id).cast("string"), F.lit("null")))).cast("binary"))
    sealed = F.aes_encrypt(F.col("content").cast("binary"), key, F.lit("GCM"), F.lit("DEFAULT"), F.lit(b""), F.col("id").cast("string").cast("binary"))
    return both.select("id", F.col(key_id).alias("key_id"), sealed.alias("sealed"))


def opened(sealed: DataFrame, keys: DataFrame) -> DataFrame:
    """(id, key_id, content, state) of sealed rows (id, key_id, sealed): state is open, empty, unknown key or broken."""
    known = keys.select(F.col("key_id").alias("k"), "key")
    both = sealed.join(known, F.col("key_id") == F.col("k"), "left")
    content = F.try_aes_decrypt(F.col("sealed"), F.col("key"), F.lit("GCM"), F.lit("DEFAULT"), F.col("id").cast("string").cast("binary"))
    rows = both.select("id", "key_id", "sealed", F.col("k").isNotNull().alias("known"), content.cast("string").alias("content"))
    state = F.when(F.col("sealed").isNull(), "empty").when(~F.col("known"), "unknown key").when(F.col("content").isNull(), "broken").otherwise("open")
    return rows.select("id", "key_id", "content", state.alias("state"))


def rotated(sealed: DataFrame, keys: DataFrame, to: str) -> DataFrame:
    """(id, key_id, sealed) with all that opens under the key `to`; what it has already, and what does not open, stays as it is."""
    old = sealed.where(~F.col("key_id").eqNullSafe(F.lit(to)))
    plain = opened(old, keys).where("state = 'open'").select("id", "content", F.lit(to).alias("key_id"))
    fresh = seal(plain, keys, "key_id")
    return sealed.join(fresh.select("id"), "id", "left_anti").select("id", "key_id", "sealed").union(fresh)
