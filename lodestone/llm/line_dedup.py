"""Line dedup with levelled sorted runs of line hashes (DataFrame functions only).

A line's key is the line without blanks at both ends, A-Z lower-cased. A run is a table of key hashes, bucketed and
sorted by the hash, with the number of documents that hold the key and the largest doc_id among them. Each new batch
of lines is aggregated and merge-anti-joined with the runs. The keys that no run holds become a run of their own, so
every key is in one run only; what the batch says of the other keys is noted beside the runs as a recurrence. Two runs
of one level are compacted to one of the next by a merge join, in which no key meets itself. Runs share their buckets,
so neither the anti-joins nor the compaction shuffle or sort what is stored. At the end the recurrences are summed up
and added to the keys they belong to.

Defined results for odd input: a null or empty text is one empty line; short keys are never dropped; an empty table
gives an empty result; rows that repeat a doc_id count as one document and are judged alike; a null doc_id counts as
no document and is never the largest; other columns of the input are carried along, whatever their names (of columns
named n_lines, n_dropped or kept_text both are returned).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ascii_lower, bucketed, discard, scratch, shuffles, strip_blanks, table

MIN_CHARS = 20
MIN_DOCS = 3
BATCHES = 4  # at least; one more for each BATCH documents
BATCH = 1 << 27
SALTS = 8
KEY = ("h1", "h2")


def line_key(line: Column) -> Column:
    return ascii_lower(strip_blanks(line))


def keyed_lines(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """(doc_id, text_hash, pos, h1, h2) of each line whose key has min_chars code points or more."""
    lines = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("pos", "line"))
    keys = lines.where(F.octet_length("line") >= min_chars).withColumn("key", line_key(F.col("line"))).where(F.char_length("key") >= min_chars)
    return keys.select("doc_id", "text_hash", "pos", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit("line"), "key").alias("h2"))


class LineRuns:
    """The levelled store of runs. Level n holds at most one run, made of 2^n batches; no key is in two runs."""

    def __init__(self, spark: SparkSession, buckets: int | None = None):
        self.spark, self.buckets = spark, buckets or shuffles(spark)
        self.levels: list[DataFrame | None] = []
        self.recurrences: list[DataFrame] = []

    def _run(self, rows: DataFrame) -> DataFrame:
        return bucketed(rows, "line-run", self.buckets, list(KEY), ordered=True)

    def add(self, lines: DataFrame) -> DataFrame:
        """Add a batch of (doc_id, h1, h2); return the run of its new keys. A document's rows must be in one batch."""
        held = lines.select("doc_id", *KEY).distinct().groupBy(*KEY).agg(F.count("doc_id").alias("n_docs"), F.max("doc_id").alias("max_doc"))
        batch = self._run(held)
        fresh = batch
        for run in filter(None, self.levels):
            fresh = fresh.join(run.select(*KEY), list(KEY), "left_anti")
        fresh = self._run(fresh)
        if any(self.levels):
            self.recurrences.append(self._run(batch.join(fresh.select(*KEY), list(KEY), "left_anti")))
        discard(batch)
        run, level = fresh, 0
        while level < len(self.levels) and self.levels[level]:
            run, self.levels[level] = self._compacted(self.levels[level], run), None
            level += 1
        self.levels[level : level + 1] = [run]
        return fresh

    def _compacted(self, old: DataFrame, new: DataFrame) -> DataFrame:
        """One run of two that have no key in common."""
        a, b = old.alias("a"), new.alias("b")
        either = [F.coalesce(f"a.{c}", f"b.{c}").alias(c) for c in (*KEY, "n_docs", "max_doc")]
        return self._run(a.join(b, list(KEY), "full_outer").select(*either))

    def keys(self) -> DataFrame:
        """(h1, h2, n_docs, max_doc) of all keys: the runs as one, with what their keys' recurrences add."""
        runs = [x for x in self.levels if x]
        while len(runs) > 1:
            runs = [self._compacted(runs[1], runs[0]), *runs[2:]]
        if not self.recurrences:
            return runs[0]
        again = self.recurrences[0]
        for more in self.recurrences[1:]:
            again = again.union(more)
        again = again.groupBy(*KEY).agg(F.sum("n_docs").alias("more_docs"), F.max("max_doc").alias("later_doc"))
        both = runs[0].join(again, list(KEY), "left")
        return both.select(*KEY, (F.col("n_docs") + F.coalesce("more_docs", F.lit(0))).alias("n_docs"), F.greatest("max_doc", "later_doc").alias("max_doc"))


def line_dedup(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, batches: int | None = None) -> DataFrame:
    """All columns of docs with n_lines, n_dropped and kept_text.

    Keys of min_chars code points or more that min_docs documents hold lose all their lines except in the largest doc_id.
    Without a number of batches there are BATCHES of them, and one more for each BATCH documents.
    """
    spark = docs.sparkSession
    batches = batches or BATCHES + docs.count() // BATCH
    keyed = keyed_lines(docs, min_chars).withColumn("batch", F.pmod(F.xxhash64("doc_id"), F.lit(batches)).cast("int"))
    path = scratch(spark, "lines")
    keyed.write.option("compression", "zstd").partitionBy("batch").parquet(path)
    lines, runs = spark.read.schema(keyed.schema).parquet(path), LineRuns(spark)
    for n in range(batches):
        runs.add(lines.where(F.col("batch") == n))
    dropped = _held_in(lines, runs.keys().where(F.col("n_docs") >= min_docs)).where(~F.col("doc_id").eqNullSafe(F.col("max_doc")))
    dropped = dropped.groupBy(F.col("doc_id").alias("__id"), F.col("text_hash").alias("__hash")).agg(F.collect_set("pos").alias("__drop"))
    both = docs.withColumn("__h", F.xxhash64("text")).join(dropped, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("__h") == F.col("__hash")), "left")
    split = both.withColumn("__lines", F.split(F.coalesce("text", F.lit("")), "\n"))
    kept = F.array_except(F.sequence(F.lit(0), F.size("__lines") - 1), F.col("__drop"))
    text = F.when(F.col("__drop").isNull(), F.coalesce("text", F.lit(""))).otherwise(F.array_join(F.transform(kept, lambda i: F.get("__lines", i)), "\n"))
    return split.select(
        *[docs[c] for c in docs.columns],
        F.size("__lines").cast("long").alias("n_lines"),
        F.when(F.col("__drop").isNull(), 0).otherwise(F.size("__drop")).cast("long").alias("n_dropped"),
        text.alias("kept_text"),
    )


def _held_in(lines: DataFrame, keys: DataFrame) -> DataFrame:
    """lines with the max_doc of their key. A key stands under SALTS salts, so the lines of one go to as many tasks."""
    salted = keys.select(*KEY, "max_doc", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    return lines.withColumn("salt", F.pmod(F.xxhash64("doc_id", "pos"), F.lit(SALTS)).cast("int")).join(salted, [*KEY, "salt"])


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = line_dedup(docs)
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: the texts without the repeated lines, all rows and columns kept; n_chars follows the text."""
    out = line_dedup(docs)
    known = F.col("text").isNotNull()
    changed = {"text": F.when(known, F.col("kept_text")), "n_chars": F.when(known, F.char_length("kept_text")).otherwise(docs["n_chars"]).cast("long")}
    return out.select(*[changed[c].alias(c) if c in changed else docs[c] for c in docs.columns])


SQL = r"""
WITH lines AS (
  SELECT doc_id, pos, line, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM (SELECT doc_id, unnest(ls) AS line, unnest(range(len(ls))) AS pos FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents))
), repeated AS (
  SELECT key, max(doc_id) AS max_doc FROM lines WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3
), judged AS (
  SELECT l.doc_id, l.pos, l.line, (r.key IS NOT NULL AND l.doc_id IS DISTINCT FROM r.max_doc) AS gone FROM lines l LEFT JOIN repeated r ON l.key = r.key
)
SELECT doc_id, CAST(count(*) AS BIGINT) AS n_lines, CAST(sum(CASE WHEN gone THEN 1 ELSE 0 END) AS BIGINT) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM judged GROUP BY doc_id
"""
