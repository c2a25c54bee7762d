"""Records as a store of whole tables: upserts, deletions, snapshots, incremental indexes, shards, staged changes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text

SEP = "\0"


def holding(records: DataFrame, phrases: DataFrame, id_col: str, low: str, phrase: str) -> DataFrame:
    """Records joined with the phrases they hold: candidates share the phrase's longest word, and are looked through then."""
    said = lambda c: F.array_distinct(text.words(F.col(c)))
    longest = F.get(F.array_sort(F.transform(text.words(F.col(phrase)), lambda w: F.struct((-F.length(w)).alias("n"), w.alias("w")))), F.lit(0))["w"]
    asked = phrases.withColumn("word", longest)
    # a phrase may begin or end within words, so its words are looked for within the records' words
    vocabulary = records.select(F.explode(said(low)).alias("own")).distinct()
    near = vocabulary.join(asked.select("word").distinct(), F.contains(F.col("own"), F.col("word")))
    rows = records.select(id_col, F.explode(said(low)).alias("own")).join(near, "own").select(id_col, "word").distinct()
    return rows.join(asked, "word").join(records, id_col).where(F.contains(F.col(low), F.col(phrase)))


def upsert(old: DataFrame, new: DataFrame, key: list[str], moment: str) -> DataFrame:
    """The latest row of each key; of equally late ones the new one."""
    rows = old.withColumn("__new", F.lit(0)).unionByName(new.withColumn("__new", F.lit(1)))
    order = Window.partitionBy(*key).orderBy(F.col(moment).desc(), F.col("__new").desc())
    return rows.withColumn("__r", F.row_number().over(order)).where("__r = 1").drop("__r", "__new")


def deleted(records: DataFrame, gone: DataFrame, key: str, receipt: Column) -> tuple[DataFrame, DataFrame]:
    """What is left, and what went, with a receipt."""
    return records.join(gone, key, "left_anti"), records.withColumn("receipt", receipt).join(gone, key, "left_semi")


def manifest(docs: DataFrame, by: str) -> DataFrame:
    """Counts and one digest over all texts of each part of a collection, whatever their order."""
    seal = F.conv(F.substring(F.md5(F.concat_ws(SEP, "doc_id", "text")), 1, 15), 16, 10).cast("long")
    rows = docs.select(by, "doc_id", seal.alias("d"), F.length("text").alias("c"))
    return rows.groupBy(by).agg(F.count("*").alias("n"), F.min("doc_id").alias("first_id"), F.max("doc_id").alias("last_id"), F.sum("c").alias("chars"), F.bit_xor("d").alias("manifest"))


def indexed(docs: DataFrame, id_col: str, body: str) -> DataFrame:
    """(id, term, n)."""
    return docs.select(id_col, F.explode(text.words(F.col(body))).alias("term")).groupBy(id_col, "term").agg(F.count("*").alias("n"))


def reindexed(index: DataFrame, before: DataFrame, after: DataFrame, id_col: str, body: str) -> DataFrame:
    """An index brought up to date: entries of changed and deleted records go, those of changed and new ones are made anew."""
    seal = lambda df, c: df.select(id_col, F.sha2(body, 256).alias(c))
    both = seal(before, "old").join(seal(after, "new"), id_col, "full_outer")
    changed = both.where(~F.col("old").eqNullSafe(F.col("new"))).select(id_col)
    kept = index.join(changed, id_col, "left_anti")
    return kept.unionByName(indexed(after.join(changed, id_col, "left_semi"), id_col, body))


def shard_of(key: Column, shards: int) -> Column:
    """The shard of a key by its hash, the same in each run and system."""
    return (F.conv(F.substring(F.md5(key), 1, 8), 16, 10).cast("long") % shards).cast("long")


def fingerprint(*fields: Column | str) -> Column:
    """SHA-256 over fields, parted by a character that none of them has."""
    return F.sha2(F.concat_ws(SEP, *fields), 256)


def persona_columns(persona: Column, body: Column, source: Column, size: Column) -> list[Column]:
    """What of a record a kind of reader sees: a brief one its head, a technical one its digest."""
    brief = persona == "brief"
    seen = F.when(brief, F.substring(body, 1, 80)).when(persona == "detailed", F.substring(body, 1, 300)).otherwise(F.md5(body))
    return [seen.alias("body"), F.when(~brief, source).alias("source"), F.when(~brief, size).alias("n_chars")]


def applied(rows: DataFrame, changes: DataFrame) -> DataFrame:
    """Orders with one change each applied: a status set, a field updated, a note appended, or superseded."""
    both = rows.join(changes, F.col("o_orderkey") == F.col("target"), "left")
    is_ = lambda op: F.col("op") == op
    status = F.when(is_("set_status"), "X").when(is_("supersede"), "superseded").otherwise(F.col("o_orderstatus"))
    notes = F.when(is_("append"), F.concat(F.lit("note;"), F.col("payload"))).otherwise("note")
    priority = F.when(is_("update_field"), F.col("payload")).otherwise(F.col("o_orderpriority"))
    return both.select("o_orderkey", status.alias("status"), priority.alias("priority"), notes.alias("notes"), F.col("fingerprint").alias("receipt"))


def winner(a: Column, b: Column) -> Column:
    """Which of two conflicting records holds: by a clear gap in priority, then in scope, then by date; else nobody can tell."""
    pick = lambda first, rule: F.when(first, f"a by {rule}").otherwise(f"b by {rule}")
    out = F.when(F.abs(a["p"] - b["p"]) >= 2, pick(a["p"] < b["p"], "priority")).when(F.abs(a["s"] - b["s"]) >= 2, pick(a["s"] > b["s"], "scope"))
    return out.when(a["o_orderdate"] != b["o_orderdate"], pick(a["o_orderdate"] > b["o_orderdate"], "date")).otherwise("manual")


def verdict(body: Column) -> Column:
    """The first rule that keeps a text out of the store, or admitted."""
    size, said = F.length(F.trim(body)), text.words(body)
    out = F.when(size == 0, "empty").when(size < 40, "short").when(size > 50000, "long")
    out = out.when((F.size(said) > 0) & (F.size(F.array_distinct(said)) / F.size(said) < 0.2), "repetitive")
    out = out.when(body.rlike("AKIA[A-Z0-9]{12,}"), "secret").when(F.regexp_count(body, F.lit("[$#@%&*]")) * 5 > size, "noise")
    return out.otherwise("admitted")


def expanded_terms(asked: DataFrame, related: DataFrame, id_col: str, most: int) -> DataFrame:
    """(id, added, terms): up to most related words of each query's words (id, word) that it does not have; related is (word, near)."""
    fresh = asked.join(related, "word").select(id_col, F.col("near").alias("word")).distinct().join(asked, [id_col, "word"], "left_anti")
    ranked = fresh.withColumn("r", F.row_number().over(Window.partitionBy(id_col).orderBy("word"))).where(F.col("r") <= most)
    return ranked.groupBy(id_col).agg(F.count("*").alias("added"), F.array_join(F.array_sort(F.collect_list("word")), " ").alias("terms"))
