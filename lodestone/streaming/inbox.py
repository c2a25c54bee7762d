"""A folder that is watched: files that come into it are read once, as blocks, and may be archived.

The batch twin is ``sources.blocks.read_blocks`` over the same files.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..sources.blocks import parse_blocks


def watch(spark: SparkSession, folder: str, out: str, checkpoint: str, archive: str | None = None, files_at_once: int = 1000, **trigger) -> StreamingQuery:
    """Start reading what is in folder, and what comes, into a table of blocks at out; by default all there is, and then end.

    A batch writes to a folder of its own number and replaces what an attempt before left there, so a batch that is done again
    after a failure neither doubles nor loses a file. Files that a later batch has passed go to archive, if it is given.
    """
    reader = spark.readStream.format("text").option("wholetext", True).option("maxFilesPerTrigger", files_at_once).option("recursiveFileLookup", True)
    if archive:
        reader = reader.option("cleanSource", "archive").option("sourceArchiveDir", archive)
    files = reader.load(folder).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("content"))

    def write(batch: DataFrame, number: int) -> None:
        parse_blocks(batch).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return files.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def blocks_read(spark: SparkSession, out: str) -> DataFrame:
    """(path, block_id, line, fields, batch) of all batches so far."""
    return spark.read.schema("path string, block_id string, line int, fields map<string,string>, batch long").parquet(out)
