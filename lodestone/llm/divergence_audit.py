"""How far the sources of a language differ: term counts by CountVectorizer, group sums, and chi-square-like distances.

A term is a run of letters (every character beyond ASCII counts as one), A-Z lower-cased. For each language
CountVectorizer keeps the terms in at least LEAST of its documents (minDF) with no limit on their number (vocabSize is
the largest integer), and turns rows of terms into sparse vectors. Rows are not single documents: those of a group that
meet in a task are folded before into rows of terms that occur equally often (n) in equally many of them (d, LEAST for
more), so that a term of a task is looked up once and not at each occurrence. A fit reads a row d times, which leaves the
terms in at least LEAST documents the same, and n times a row's vector is added to the sums.

CountVectorizer holds its vocabulary on the driver and sends it to every task; so that neither grows with the corpus, the
terms of a language that keeps more than VOCABULARY of them are dealt by their hash to shards of about as many, each with
a fit of its own: a shard is written once, and a fit reads its shard alone. Vectors are summed by group as sparse cells
(language, source, term, count), never as dense arrays.

With p the smoothed share of a term in parts of a thousand million, the distance of a group from another is the sum of
f = floor((p - q)^2 / q) over the vocabulary. Pairs are evaluated sparsely: terms that neither group has all give the
same f, terms that one of them has are counted by their p (a histogram for each group), and only terms that both have are
looked at one by one. All of it is integer arithmetic.

Defined results for odd input: a null text, lang or source counts as an empty one; documents without terms add nothing but
their group; repeated rows are documents of their own; a language without kept terms has distances 0 and no term rows; a
language with one source has no pair rows; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections import _count_elements, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import CountVectorizer
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import scratch, shuffles, stored, table
from .hashing import pieces

LEAST = 3
MOST = 2**31 - 1
VOCABULARY = 100_000  # terms that one fit keeps at most, as estimated: what the driver holds at once
HELD = 500_000  # terms of groups that a task holds at once
LONGEST = 4096  # terms of a row
PART = 16
RANKS = 200
SCALE = 1_000_000_000


#: Bytes of a text as they count: letters with A-Z lower-cased, and a blank for what stands between terms.
BYTES = bytes(b if b >= 128 else ord(chr(b).lower()) if chr(b).isalpha() else 32 for b in range(256))
FOLDED = "source string, n long, d int, terms array<string>, of string"


def rows_of(groups: dict, least: int) -> Iterator[tuple]:
    """(source, n, d, terms, of): terms of a group that occur n times, in d documents (least for more), at most LONGEST a row."""
    for (of, source), (times, docs) in groups.items():
        alike = defaultdict(list)
        for term, n in times.items():
            alike[n, min(docs[term], least)].append(term)
        for (n, d), terms in alike.items():
            for at in range(0, len(terms), LONGEST):
                yield source, n, d, terms[at : at + LONGEST], of


def batch_of(rows: list[tuple], kinds: tuple) -> pa.RecordBatch:
    """Rows of (source, n, d, terms, a last column of a string or int kind); terms are UTF-8."""
    source, n, d, terms, last = zip(*rows, strict=True)
    ends = np.cumsum([0, *map(len, terms)])
    words = pa.array([t for row in terms for t in row], pa.binary()).view(pa.string())
    lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), words)
    return pa.record_batch([pa.array(source, pa.string()), pa.array(n, pa.int64()), pa.array(d, pa.int32()), lists, pa.array(last, kinds[0])], names=["source", "n", "d", "terms", kinds[1]])


def batches_of(rows: Iterator[tuple], kinds: tuple) -> Iterator[pa.RecordBatch]:
    for part in pieces(rows, lambda row: 64 + 16 * len(row[3])):
        yield batch_of(part, kinds)


def folded(docs: DataFrame, least: int) -> DataFrame:
    """FOLDED: documents of a group that meet in a task as rows of terms that occur equally often there.

    Ranges of (language, source, row) are as long for a group of any size, and most tasks hold one or two groups.
    """

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        groups, held = defaultdict(lambda: ({}, {})), 0
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                for of, source, text in zip(*(c.to_pylist() for c in batch.slice(at, 256).columns), strict=True):
                    times, seen = groups[of, source]
                    terms, before = text.translate(BYTES).split(), len(times)
                    _count_elements(times, terms)
                    _count_elements(seen, set(terms))
                    held += len(times) - before
                if held + len(groups) >= HELD:
                    yield from batches_of(rows_of(groups, least), (pa.string(), "of"))
                    groups.clear()
                    held = 0
        yield from batches_of(rows_of(groups, least), (pa.string(), "of"))

    empty = F.lit("")
    rows = docs.select(F.concat(F.lit("l"), F.hex(F.coalesce("lang", empty))).alias("of"), F.coalesce("source", empty).alias("source"), F.coalesce("text", empty).cast("binary").alias("text"), F.monotonically_increasing_id().alias("row"))
    return rows.repartitionByRange(shuffles(docs.sparkSession), "of", "source", "row").drop("row").mapInArrow(fold, FOLDED)


def dealt(docs: DataFrame, least: int, vocabulary: int):
    """(lang, rows of folded) for each language, and for each shard of the terms of one that keeps many.

    Rows are written by language, so that a fit reads those of its own only; of the corpus the driver gets a row
    for each language.
    """
    spark, path = docs.sparkSession, scratch(docs.sparkSession, "terms")
    folded(docs, least).write.partitionBy("of").option("compression", "zstd").parquet(path)
    every = spark.read.schema(FOLDED).parquet(path)
    # terms kept among a sixteenth of all hashes tell how many a language keeps; results do not depend on it
    some = every.select("of", "d", F.explode(F.expr(f"filter(terms, t -> pmod(xxhash64(t), {PART}) = 0)")).alias("t"))
    some = some.groupBy("of", "t").agg(F.sum("d").alias("d")).where(F.col("d") >= least).groupBy("of").agg(F.count("*").alias("n"))
    langs = every.select("of").distinct().join(some, "of", "left").orderBy("of").collect()
    for of, n in langs:
        lang, mine = bytes.fromhex(of[1:]).decode(), every.where(F.col("of") == of).drop("of")
        shards = max(1, -(-PART * (n or 0) // vocabulary))
        if shards == 1:
            yield lang, mine
            continue

        def split(batches: Iterator[pa.RecordBatch], shards: int = shards) -> Iterator[pa.RecordBatch]:
            def rows() -> Iterator[tuple]:
                for batch in batches:
                    for source, n, d, terms in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                        parts = defaultdict(list)
                        for term in map(str.encode, terms):
                            parts[zlib.crc32(term) % shards].append(term)
                        for shard, part in parts.items():
                            yield source, n, d, part, shard

            yield from batches_of(rows(), (pa.int32(), "shard"))

        path, kind = scratch(spark, "shards"), "source string, n long, d int, terms array<string>, shard int"
        mine.mapInArrow(split, kind).write.partitionBy("shard").option("compression", "zstd").parquet(path)
        parts = spark.read.schema(kind).parquet(path)
        for shard in range(shards):
            yield lang, parts.where(F.col("shard") == shard).drop("shard")


def cells(docs: DataFrame, least: int = LEAST, vocabulary: int = VOCABULARY) -> DataFrame:
    """(lang, source, term, c): how often a group has a term of its language's vocabulary, where it has it at all."""
    spark, path, found = docs.sparkSession, scratch(docs.sparkSession, "cells"), False
    for lang, shard in dealt(docs, least, vocabulary):
        # a row stands once for each of its d documents, so that as many rows have a term as documents, or least at least
        each = shard.select("terms", F.explode(F.sequence(F.lit(1), "d")).alias("_")).select("terms")
        model = CountVectorizer(inputCol="terms", outputCol="v", minDF=float(least), vocabSize=MOST).fit(each)
        words = pa.array(model.vocabulary, pa.string())
        if not len(words):
            continue
        vectors = model.transform(shard).select("source", "n", F.unwrap_udt("v").alias("v"))
        counts = vectors.select("source", "n", "v.values", F.posexplode("v.indices").alias("at", "i")).select("source", "i", (F.col("n") * F.get("values", "at").cast("long")).alias("n"))
        sums = counts.groupBy("source", "i").agg(F.sum("n").alias("c"))
        names = spark.createDataFrame(pa.table({"i": pa.array(range(len(words)), pa.int32()), "term": words}))
        part = sums.join(names, "i").select(F.lit(lang).alias("lang"), "source", "term", "c")
        part.write.mode("append").option("compression", "zstd").parquet(path)
        found = True
    kind = "lang string, source string, term string, c long"
    return spark.read.schema(kind).parquet(path) if found else spark.createDataFrame([], kind)


def share(count: Column, total: Column, kept: Column) -> Column:
    """1 + floor(SCALE * (count + 1) / (total + kept)), in exact arithmetic."""
    above = F.lit(SCALE).cast("decimal(10,0)") * (count + 1).cast("decimal(20,0)")
    return F.lit(1) + F.call_function("div", above, (total + kept).cast("decimal(20,0)"))


def distance(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), q)


def audit(docs: DataFrame, least: int = LEAST, ranks: int = RANKS, vocabulary: int = VOCABULARY) -> DataFrame:
    """(lang, source, part, item, value, rank): other sources of the language by their distance, and the terms most overused."""
    empty = F.lit("")
    found = cells(docs, least, vocabulary)
    of_lang = stored(found.groupBy("lang", "term").agg(F.sum("c").alias("of_lang")), "of-lang")
    langs = of_lang.groupBy("lang").agg(F.count("*").alias("kept"), F.sum("of_lang").alias("lang_total"))
    groups = docs.select(F.coalesce("lang", empty).alias("lang"), F.coalesce("source", empty).alias("source")).distinct()
    totals = found.groupBy("lang", "source").agg(F.sum("c").alias("total"))
    groups = groups.join(totals, ["lang", "source"], "left").join(langs, "lang", "left").fillna(0, ["total", "kept", "lang_total"])
    # zero is the share of a term that the group lacks; without a vocabulary there is nothing to share
    zero = F.when(F.col("kept") > 0, share(F.lit(0), F.col("total"), F.col("kept")))
    groups = stored(groups.withColumn("zero", zero), "groups")
    shares = found.join(groups, ["lang", "source"]).withColumn("p", share(F.col("c"), F.col("total"), F.col("kept")))
    shares = stored(shares.select("lang", "source", "term", "p", "zero", "kept", "lang_total"), "shares")
    out = _pairs(groups, shares).union(_overused(shares, of_lang, ranks))
    return out.select("lang", "source", "part", "item", "value", "rank")


def _overused(shares: DataFrame, of_lang: DataFrame, ranks: int) -> DataFrame:
    q = share(F.col("of_lang"), F.col("lang_total"), F.col("kept"))
    over = shares.join(of_lang, ["lang", "term"]).withColumn("q", q).where("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), distance(F.col("p"), F.col("q")).alias("value"))
    return over.withColumn("rank", F.row_number().over(_ranked())).where(F.col("rank") <= ranks)


def _ranked():
    return Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), F.col("item"))


def _pairs(groups: DataFrame, shares: DataFrame) -> DataFrame:
    a = groups.select("lang", "source", F.col("zero").alias("zero_a"), "kept")
    b = groups.select("lang", F.col("source").alias("item"), F.col("zero").alias("zero_b"))
    none = distance(F.col("zero_a"), F.col("zero_b"))
    pairs = a.join(b, "lang").where("source <> item").withColumn("none", none)
    # terms of one side, as if the other had none of them: by their share, since many terms have the same one
    held = stored(shares.groupBy("lang", "source", "p").agg(F.count("*").alias("m")), "held")
    left = pairs.join(held, ["lang", "source"]).select("lang", "source", "item", (F.col("m") * (distance(F.col("p"), F.col("zero_b")) - F.col("none"))).alias("value"))
    right = pairs.join(held.withColumnRenamed("source", "item"), ["lang", "item"]).select("lang", "source", "item", (F.col("m") * (distance(F.col("zero_a"), F.col("p")) - F.col("none"))).alias("value"))
    # terms of both sides: what the two sums above got wrong
    lists = shares.groupBy("lang", "term").agg(F.sort_array(F.collect_list(F.struct("source", "p", "zero"))).alias("of"))
    both = lists.where(F.size("of") > 1).select("lang", "of", F.posexplode("of").alias("at", "x"))
    both = both.select("lang", "x", F.explode(F.expr("slice(of, at + 2, size(of))")).alias("y"))
    amend = lambda x, y: distance(x["p"], y["p"]) - distance(x["p"], y["zero"]) - distance(x["zero"], y["p"]) + distance(x["zero"], y["zero"])
    x, y = F.col("x"), F.col("y")
    summed = both.groupBy("lang", x["source"].alias("s"), y["source"].alias("t")).agg(F.sum(amend(x, y)).alias("st"), F.sum(amend(y, x)).alias("ts"))
    summed = stored(summed, "both")
    shared = summed.select("lang", F.col("s").alias("source"), F.col("t").alias("item"), F.col("st").alias("value")).union(summed.select("lang", "t", "s", "ts"))
    base = pairs.select("lang", "source", "item", F.coalesce(F.col("kept") * F.col("none"), F.lit(0)).alias("value"))
    every = base.union(left).union(right).union(shared).groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    return every.select("lang", "source", F.lit("pair").alias("part"), "item", "value").withColumn("rank", F.row_number().over(_ranked()))


def op13_divergence_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(table(spark, sf_dir, "documents").select("text", "lang", "source"))


SQL = r"""
WITH docs AS (
  SELECT row_number() OVER () AS d, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text
  FROM documents),
words AS (
  SELECT d, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM docs),
vocabulary AS (SELECT lang, term FROM words GROUP BY lang, term HAVING count(DISTINCT d) >= 3),
sizes AS (SELECT lang, count(*) AS v FROM vocabulary GROUP BY lang),
groups AS (SELECT DISTINCT lang, source FROM docs),
counts AS (SELECT lang, source, term, count(*) AS c FROM words JOIN vocabulary USING (lang, term) GROUP BY ALL),
lang_counts AS (SELECT lang, term, sum(c) AS c FROM counts GROUP BY ALL),
totals AS (SELECT lang, source, coalesce(sum(c), 0) AS n FROM groups LEFT JOIN counts USING (lang, source) GROUP BY ALL),
lang_totals AS (SELECT lang, sum(c) AS n FROM counts GROUP BY lang),
shares AS (
  SELECT lang, source, term, coalesce(c, 0) AS c,
         1 + (1000000000::HUGEINT * (coalesce(c, 0)::HUGEINT + 1)) // (n::HUGEINT + v) AS p
  FROM totals JOIN vocabulary USING (lang) JOIN sizes USING (lang) LEFT JOIN counts USING (lang, source, term)),
lang_shares AS (
  SELECT lang, term, 1 + (1000000000::HUGEINT * (c::HUGEINT + 1)) // (n::HUGEINT + v) AS p
  FROM lang_counts JOIN lang_totals USING (lang) JOIN sizes USING (lang)),
pair_values AS (
  SELECT x.lang, x.source, y.source AS item, sum(((x.p - y.p) * (x.p - y.p)) // y.p) AS value
  FROM shares x JOIN shares y ON x.lang = y.lang AND x.term = y.term AND x.source <> y.source GROUP BY ALL),
pairs AS (
  SELECT x.lang, x.source, 'pair' AS part, y.source AS item, coalesce(value, 0) AS value
  FROM groups x JOIN groups y ON x.lang = y.lang AND x.source <> y.source
  LEFT JOIN pair_values z ON z.lang = x.lang AND z.source = x.source AND z.item = y.source),
overused AS (
  SELECT lang, source, 'term' AS part, term AS item, ((x.p - y.p) * (x.p - y.p)) // y.p AS value
  FROM shares x JOIN lang_shares y USING (lang, term) WHERE c > 0 AND x.p > y.p),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, encode(item)) AS rank
  FROM (SELECT * FROM pairs UNION ALL SELECT * FROM overused))
SELECT lang, source, part, item, value::BIGINT AS value, rank::INT AS rank FROM ranked WHERE part = 'pair' OR rank <= 200
"""
