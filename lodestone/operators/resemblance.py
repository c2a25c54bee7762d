"""Resemblance of short texts: the ratio of their matching blocks, and the nearest known id of one that is not known.

Both find candidates by joins that lose none: a ratio is at most what lengths and shared characters allow, and an id
within one or two edits of another shares a string with it after as many deletions.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

PLACES = "abcdefghijklmnopqrstuvwxyz0123456789 "  # characters that the bound of a ratio counts one by one


def matched(a: str, b: str) -> int:
    """Characters in the matching blocks of two texts: the longest common block (of equal ones the first in a, then in b), and so on
    on both its sides. In b of 200 characters or more, those that make up more than a hundredth of it, plus one, start no block.
    """
    where: dict[str, list[int]] = {}
    for at, c in enumerate(b):
        where.setdefault(c, []).append(at)
    if len(b) >= 200:
        where = {c: at for c, at in where.items() if len(at) <= len(b) // 100 + 1}
    total, open_ = 0, [(0, len(a), 0, len(b))]
    while open_:
        a0, a1, b0, b1 = open_.pop()
        best, at, to = 0, a0, b0
        runs: dict[int, int] = {}  # length of the block that ends at a place of b and at this place of a
        for i in range(a0, a1):
            now = {}
            for j in where.get(a[i], ()):
                if b0 <= j < b1:
                    now[j] = runs.get(j - 1, 0) + 1
                    if now[j] > best:
                        best, at, to = now[j], i - now[j] + 1, j - now[j] + 1
            runs = now
        # characters that start no block may still be at its ends
        while at > a0 and to > b0 and a[at - 1] == b[to - 1]:
            at, to, best = at - 1, to - 1, best + 1
        while at + best < a1 and to + best < b1 and a[at + best] == b[to + best]:
            best += 1
        if best:
            total += best
            open_ += [(a0, at, b0, to), (at + best, a1, to + best, b1)]
    return total


def ratio(a: str, b: str) -> float:
    """Twice the matched characters in all characters of both; equal texts have 1, an empty one and another 0."""
    return 1.0 if a == b else 2.0 * matched(a, b) / (len(a) + len(b)) if a and b else 0.0


@F.pandas_udf(T.DoubleType())
def ratio_of(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([None if x is None or y is None else ratio(x, y) for x, y in zip(a, b, strict=True)], dtype="float64")


def _bag(text: Column) -> list[Column]:
    """How often each of PLACES is in a text, and how many other characters it has."""
    n = F.char_length(text)
    counts = [n - F.char_length(F.replace(text, F.lit(c), F.lit(""))) for c in PLACES]
    return [*counts, n - sum(counts, F.lit(0))]


def near_repeats(rows: DataFrame, group: str, id_col: str, text: str, at: str, least: float, within: str) -> DataFrame:
    """(group, id, prior, ratio): of the rows of its group at most `within` (an SQL interval) older, the one a row resembles most.

    Only ratios of `least` or more count; of equal ones the smaller prior id. Time is cut to bins as wide as the window, so that a
    row meets the rows of two bins only, and a ratio is computed only where lengths and the bags of characters allow it.
    """
    width = F.expr(f"unix_timestamp(timestamp '1970-01-02 00:00:00' + {within}) - unix_timestamp(timestamp '1970-01-02 00:00:00')")
    known = rows.where(F.col(group).isNotNull() & F.col(text).isNotNull() & F.col(at).isNotNull()).select(group, F.col(id_col).alias("id"), F.col(text).alias("t"), F.col(at).alias("at"), F.array(*_bag(F.col(text))).alias("bag"))
    known = known.withColumn("bin", F.floor(F.unix_timestamp("at") / width))
    new = known.select(group, F.col("bin").alias("b"), "id", "t", "at", "bag").withColumn("bin", F.explode(F.array(F.col("b") - 1, F.col("b"))))
    old = known.select(group, "bin", F.col("id").alias("prior"), F.col("t").alias("u"), F.col("at").alias("then"), F.col("bag").alias("bag2"))
    after = (F.col("then") < F.col("at")) | ((F.col("then") == F.col("at")) & (F.col("prior") < F.col("id")))
    recent = F.col("then") >= F.col("at") - F.expr(within)
    sizes = F.char_length("t") + F.char_length("u")
    shared = F.aggregate(F.zip_with("bag", "bag2", lambda x, y: F.least(x, y)), F.lit(0), lambda s, x: s + x)
    pairs = new.join(old, [group, "bin"]).where(after & recent & (2 * F.least(F.char_length("t"), F.char_length("u")) >= least * sizes) & (2 * shared >= least * sizes))
    found = pairs.select(group, "id", "prior", ratio_of("t", "u").alias("ratio")).where(F.col("ratio") >= least)
    best = F.row_number().over(Window.partitionBy(group, "id").orderBy(F.col("ratio").desc(), "prior"))
    return found.withColumn("r", best).where("r = 1").select(group, "id", "prior", "ratio")


def deletions(word: Column, most: int) -> Column:
    """The distinct strings that are left of a word after at most `most` deletions."""
    out = F.array(word)
    for _ in range(most):
        out = F.array_union(out, F.flatten(F.transform(out, lambda w: F.transform(F.sequence(F.lit(1), F.greatest(F.char_length(w), F.lit(1))), lambda i: F.concat(F.substring(w, F.lit(1), i - 1), F.substring(w, i + 1, F.char_length(w)))))))
    return out


def nearest_ids(cited: DataFrame, defined: DataFrame, most: int = 2) -> DataFrame:
    """(id, nearest, distance) of cited ids that are not defined: the nearest defined one within `most` edits, of equals the smaller.

    Two strings within that distance have a string in common after at most so many deletions each, so an equi-join on these finds
    all candidates; the distance itself is then computed. nearest is null where nothing is near. Both tables have id; a null is none.
    """
    ids = defined.where("id IS NOT NULL").select("id").distinct()
    broken = cited.where("id IS NOT NULL").select("id").distinct().join(ids, "id", "left_anti")
    key = lambda t, name: t.select(F.col("id").alias(name), F.explode(deletions(F.col("id"), most)).alias("key"))
    pairs = key(broken, "id").join(key(ids, "known"), "key").select("id", "known").distinct()
    near = pairs.withColumn("distance", F.levenshtein("id", "known")).where(F.col("distance") <= most)
    best = near.groupBy("id").agg(F.min(F.struct("distance", "known")).alias("m"))
    return broken.join(best, "id", "left").select("id", F.col("m.known").alias("nearest"), F.col("m.distance").cast("long").alias("distance"))
