"""Mixing sources to target weights by systematic sampling.

The targets share 150 % of all words by the sources' weights; no target exceeds twice its source's words, and what is
above is shared again by weight. A document's expected copies are its source's target over the source's words. They
are prefix-summed within the source, one random offset is added, and a document is emitted once for each integer that
its step crosses. Documents are summed in the order of their size, so that each run of neighbours gives what it should
and a source's total misses its target by about one large document at most.

The prefix sum runs over all rows of a source, however many: rows are range-partitioned by (source, size, doc_id), and
a row's place is its place in its partition plus the rows of its source in earlier partitions. Only one row for each
partition and source is ever brought together.

Defined results for odd input: a null or empty text has size 0 and takes 0 words; a null source is a source of its
own, last in order; rows that tie in all three keys are interchangeable; a source without words has target 0; an
empty table gives an empty result; further columns of the input are carried along, whatever their names (of a column
that mix adds itself both are returned; the stage returns its own); names that begin with __ are reserved.

Sources are as few as a corpus has places of origin: one row for each of them comes to one task, which levels their
targets. One row for each source and partition is ordered by source, so a hot source has as many rows as partitions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WORD, scratch, shuffles, stored, table

WEIGHTS = (3, 1, 2)
SHARE = 1.5
MOST = 2
SEED = 9
MIXED = ("source_size", "target", "copies", "taken")  # what mix adds
_ROW_BITS = 33  # of monotonically_increasing_id, below the partition's number


def size_of(text: Column) -> Column:
    """Words of a text; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def _offset(source: Column, seed: int) -> Column:
    """A number in [0, 1) for each source, the same in each run; 16 bits, so that sums with large counts stay exact."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.concat(F.lit("s"), source), F.lit("n"))))
    return F.conv(F.substring(digest, 1, 4), 16, 10).cast("double") / 65536.0


def targets(sizes: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE, most: float = MOST, seed: int = SEED) -> DataFrame:
    """(source, source_size, target, offset) from (source, source_size), a row for each source.

    With c the most a source may give and w its weight, the level is the largest of (words to share - c of the sources
    before) / (w from here on) in the order of c / w; a target is the level times w, or c if that is less.
    """
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))
    weighted = sizes.withColumn("w", F.element_at(F.array(*map(F.lit, weights)), (F.pmod(rank - 1, F.lit(len(weights))) + 1).cast("int")).cast("long"))
    order = Window.orderBy((F.col("source_size") / F.col("w")).asc(), F.col("source").asc_nulls_last())
    before, here_on = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing)
    words = F.sum("source_size").over(Window.partitionBy(F.lit(0))) * F.lit(float(share))
    level = (words - F.coalesce(F.sum("source_size").over(before), F.lit(0)) * F.lit(float(most))) / F.sum("w").over(here_on)
    levels = weighted.withColumn("level", level)
    filled = F.least(F.col("source_size") * F.lit(float(most)), F.col("w") * F.max("level").over(Window.partitionBy(F.lit(0))))
    return levels.select("source", "source_size", filled.alias("target"), _offset(F.col("source"), seed).alias("offset"))


def mix(docs: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE, most: float = MOST, seed: int = SEED) -> DataFrame:
    """docs, which must have doc_id, source and size, with source_size, target, copies and taken (copies times size)."""
    spark = docs.sparkSession
    keys = [F.col("source").asc_nulls_last(), F.col("size").asc(), F.col("doc_id").asc_nulls_last()]
    placed = docs.repartitionByRange(shuffles(spark), *keys).sortWithinPartitions(*keys)
    placed = stored(placed.withColumn("__at", F.monotonically_increasing_id()), "mix")
    part = F.shiftright("__at", _ROW_BITS)
    parts = placed.groupBy(part.alias("__p"), F.col("source").alias("__s")).agg(F.count("*").alias("n"), F.min("__at").alias("__first"), F.sum("size").alias("words"))
    parts = stored(parts, "mix-parts")
    by_source = targets(parts.groupBy(F.col("__s").alias("source")).agg(F.sum("words").alias("source_size")), weights, share, most, seed)
    before = Window.partitionBy("__s").orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.withColumn("__before", F.coalesce(F.sum("n").over(before), F.lit(0)))
    own = [F.col(c).alias(f"__{c}") for c in ("source_size", "target", "offset")]
    parts = parts.join(by_source, F.col("__s").eqNullSafe(by_source["source"])).select("__p", "__s", "__first", "__before", *own)
    each = F.when(F.col("__source_size") > 0, F.col("__target") / F.col("__source_size")).otherwise(0.0)
    rank = F.col("__at") - F.col("__first") + F.col("__before")
    step = F.floor(each * (rank + 1) + F.col("__offset")) - F.floor(each * rank + F.col("__offset"))
    copies = F.least(step, F.ceil(each)).cast("long")
    out = placed.join(parts, (part == F.col("__p")) & placed["source"].eqNullSafe(F.col("__s")))
    added = [F.col("__source_size"), F.col("__target"), copies, copies * placed["size"]]
    return out.select(*[placed[c] for c in docs.columns], *[c.alias(n) for c, n in zip(added, MIXED, strict=True)])


def emitted(mixed: DataFrame) -> DataFrame:
    """The mixed rows themselves: each as often as copies says, numbered from 1 by copy."""
    return mixed.where("copies > 0").withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))


def op9_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", size_of(F.col("text")).alias("size"))
    return mix(stored(docs, "sizes")).select("doc_id", "size", "source_size", "target", "taken")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: the mixed corpus, a row for each copy that is emitted; documents without a copy are gone.

    copies and taken speak of the document and stand in each of its rows; copy numbers them.
    The rows are numbered and written; only their numbers, sources and sizes are ordered, since whole texts in the order
    of their size would give the last range far more bytes than the others.
    """
    own = [c for c in docs.columns if c not in ("size", "copy", *MIXED)]
    rows = stored(docs.select(*own, F.monotonically_increasing_id().alias("__row")), "mix-docs")
    plan = mix(stored(rows.select("__row", "doc_id", "source", size_of(F.col("text")).alias("size")), "sizes"))
    return emitted(rows.join(plan.where("copies > 0").drop("doc_id", "source"), "__row")).drop("__row")


SQL = r"""
WITH sized AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size FROM documents
), weighed AS (
  SELECT source, source_size, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 2 END AS w
  FROM (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source)
), levels AS (
  SELECT source, source_size, w,
         (CAST(sum(source_size) OVER () AS DOUBLE) * CAST(1.5 AS DOUBLE)
          - CAST(coalesce(sum(source_size) OVER (ORDER BY CAST(source_size AS DOUBLE) / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE) * CAST(2 AS DOUBLE))
         / CAST(sum(w) OVER (ORDER BY CAST(source_size AS DOUBLE) / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS DOUBLE) AS level
  FROM weighed
), aims AS (
  SELECT source, source_size, least(CAST(source_size AS DOUBLE) * CAST(2 AS DOUBLE), CAST(w AS DOUBLE) * max(level) OVER ()) AS target,
         CAST(CAST('0x' || substr(md5('9:' || coalesce('s' || source, 'n')), 1, 4) AS BIGINT) AS DOUBLE) / CAST(65536 AS DOUBLE) AS shift
  FROM levels
), ranked AS (
  SELECT s.doc_id, s.size, a.source_size, a.target, a.shift,
         CASE WHEN a.source_size > 0 THEN a.target / CAST(a.source_size AS DOUBLE) ELSE CAST(0 AS DOUBLE) END AS each_,
         row_number() OVER (PARTITION BY s.source ORDER BY s.size, s.doc_id NULLS LAST) AS rank
  FROM sized s JOIN aims a ON s.source IS NOT DISTINCT FROM a.source
)
SELECT doc_id, size, source_size, target,
       CAST(least(floor(each_ * CAST(rank AS DOUBLE) + shift) - floor(each_ * CAST(rank - 1 AS DOUBLE) + shift), ceil(each_)) AS BIGINT) * size AS taken
FROM ranked
"""
