"""Helpers shared by the training-data operators: table access, shared scratch folders, text rules."""

from __future__ import annotations

import contextlib
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The white space that separates words and is stripped from lines (fixed values: blank and 0x09-0x0D).
BLANKS = " \t\n\x0b\f\r"
WORD = r"[^\x20\x09-\x0D]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A test table, read by Spark so that any store Spark knows will do."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: ``spark.checkpoint.dir``.

    Where that is unset a temporary folder takes its place, but only for a local master: on a cluster each executor
    would write to its own disk.
    """
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("lodestone.shared.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = f"file://{tempfile.mkdtemp(prefix='lodestone-')}"
        spark.conf.set("lodestone.shared.dir", found)
        spark.sparkContext.setCheckpointDir(found)
    return found


def scratch(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """df written to the shared folder and read again: lineage ends here, and lost executors take nothing with them."""
    path = scratch(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def bucketed(df: DataFrame, name: str, buckets: int, columns: list[str], compression: str = "zstd", ordered: bool = False) -> DataFrame:
    """df written to the shared folder in buckets of columns (sorted by them, if ordered) and read again with these.

    Spark writes buckets through its catalog only; the entry goes once the table is resolved, the files stay.
    """
    spark, path = df.sparkSession, scratch(df.sparkSession, name)
    entry = f"lodestone_{uuid.uuid4().hex}"
    writer = df.repartition(buckets, *columns).write.option("path", path).option("compression", compression).bucketBy(buckets, *columns)
    (writer.sortBy(*columns) if ordered else writer).saveAsTable(entry)
    out = spark.table(entry)
    spark.sql(f"DROP TABLE {entry}")
    return out


def discard(*tables: DataFrame) -> None:
    """Delete stored tables that nothing reads any more: what was made of them must be written itself."""
    for df in tables:
        sc = df.sparkSession.sparkContext
        for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
            path = sc._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)


def salted_join(big: DataFrame, small: DataFrame, keys: list[str], counts: DataFrame, by: list[str]) -> DataFrame:
    """big joined with small on keys, of which counts (keys, n) tells how many rows big has.

    Keys with more rows than a tenth of a task's share are dealt to as many tasks as the session has shuffle partitions, by the
    hash of big's columns ``by``, and small's rows of these are repeated. There are at most ten of them for each partition, so
    the list of them is small at any size and is broadcast.
    """
    tasks = shuffles(big.sparkSession)
    total = counts.agg(F.sum("n")).first()[0] or 0
    hot = F.broadcast(counts.where(F.col("n") > total / (10 * tasks)).select(*keys, F.lit(tasks).alias("salts")))
    left = big.join(hot, keys, "left").withColumn("salt", F.pmod(F.xxhash64(*by), F.coalesce("salts", F.lit(1))).cast("int")).drop("salts")
    right = small.join(hot, keys, "left").withColumn("salt", F.explode(F.sequence(F.lit(0), F.coalesce("salts", F.lit(1)) - 1))).drop("salts")
    return left.join(right, [*keys, "salt"]).drop("salt")


def shuffles(spark: SparkSession) -> int:
    """The number of shuffle partitions the session asks for."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


@contextlib.contextmanager
def small_batches(spark: SparkSession, most: int = 4 << 20):
    """What runs within sends rows to Python in batches of about ``most`` bytes: a task and its worker hold few of them."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, most)
    try:
        yield
    finally:
        spark.conf.set(key, before)


def ascii_lower(text: Column) -> Column:
    """text with A-Z lower-cased and every other character as it was.

    ``lower`` changes only A-Z in a text of ASCII characters alone, and is far faster than ``translate``.
    """
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, UPPER.lower()))


def strip_blanks(text: Column) -> Column:
    return F.btrim(text, F.lit(BLANKS))
