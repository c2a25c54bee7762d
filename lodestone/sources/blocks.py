"""Text blocks: ``[PREFIX-id]`` headers followed by ``Key: Value`` lines, list items and continuations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

HEADER = r"^\[([A-Z]+-[A-Za-z0-9_.-]+)\]\s*$"
KEY = r"^([A-Za-z][A-Za-z0-9_]*):\s*(.*)$"
ITEM = r"^\s*-\s+(.*)$"


def parse_blocks(files: DataFrame) -> DataFrame:
    """(path, block_id, line, fields) from (path, content): a row for each block.

    fields maps a key to its value; list items and indented lines below a key are appended to it with line breaks. A
    block's lines are numbered from 1; text before the first header is no block; an empty file has none. Lines are
    exploded and grouped, so a file's blocks are put together where Spark deals them, never on the driver.
    """
    lines = files.select("path", F.posexplode(F.split("content", "\r?\n")).alias("at", "text"))
    in_file, in_block = Window.partitionBy("path").orderBy("at"), Window.partitionBy("path", "block").orderBy("at")
    header = F.regexp_extract("text", HEADER, 1)
    lines = lines.withColumn("head", F.when(header != "", header)).withColumn("block", F.count("head").over(in_file)).where("block > 0")
    key, value = F.regexp_extract("text", KEY, 1), F.regexp_extract("text", KEY, 2)
    item, more = F.regexp_extract("text", ITEM, 1), F.trim("text")
    named = F.when(key != "", key)
    lines = lines.withColumn("key", F.when(F.col("head").isNull(), F.last(named, ignorenulls=True).over(in_block)))
    part = F.when(key != "", F.trim(value)).when(item != "", item).otherwise(more)
    lines = lines.withColumn("part", part)
    values = lines.where("key is not null and part <> ''").groupBy("path", "block", "key").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "part"))), lambda s: s["part"]), "\n").alias("value"))
    fields = values.groupBy("path", "block").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("key", "value")))).alias("fields"))
    heads = lines.where("head is not null").select("path", "block", F.col("head").alias("block_id"), (F.col("at") + 1).alias("line"))
    empty = F.create_map().cast("map<string,string>")
    return heads.join(fields, ["path", "block"], "left").select("path", "block_id", "line", F.coalesce("fields", empty).alias("fields"))


def read_blocks(spark: SparkSession, path: str) -> DataFrame:
    """The blocks of the text files below a path."""
    files = spark.read.text(path, wholetext=True, recursiveFileLookup=True)
    return parse_blocks(files.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("content")))


def typed(value: Column) -> Column:
    """A nested value as text of its type: null, boolean, integer, number or string, the first that fits."""
    low = F.lower(F.trim(value))
    number = F.trim(value)
    return (
        F.when(low.isin("null", "none", "~", ""), F.lit(None).cast("string"))
        .when(low.isin("true", "false"), low)
        .when(number.try_cast("bigint").isNotNull(), number.try_cast("bigint").cast("string"))
        .when(number.try_cast("double").isNotNull(), number.try_cast("double").cast("string"))
        .otherwise(value)
    )


def references(blocks: DataFrame, text: str = "text") -> DataFrame:
    """(src, dst): the ids that the blocks' texts mention and that are blocks themselves."""
    ids = blocks.select(F.col("block_id").alias("dst"))
    said = blocks.select(F.col("block_id").alias("src"), F.explode(F.array_distinct(F.regexp_extract_all(text, F.lit(r"\b([A-Z]+-[A-Za-z0-9_.-]*[A-Za-z0-9])\b"), F.lit(1)))).alias("dst"))
    return said.join(ids, "dst", "left_semi").where("src <> dst").select("src", "dst")


def upserted(old: DataFrame, new: DataFrame, key: str = "block_id") -> DataFrame:
    """old with the rows of new in the place of those with the same key."""
    return old.join(new.select(key), key, "left_anti").unionByName(new, allowMissingColumns=True)


def read_transcript(spark: SparkSession, path: str) -> DataFrame:
    """Messages of JSON-lines transcripts: (path, role, content, timestamp); broken lines are left out."""
    rows = spark.read.schema("role string, content string, timestamp string, _broken string").json(path, mode="PERMISSIVE", columnNameOfCorruptRecord="_broken")
    rows = rows.withColumn("path", F.input_file_name())
    return rows.where("_broken is null and role is not null").select("path", "role", "content", "timestamp")
