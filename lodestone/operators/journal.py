"""Write-ahead logs: what transactions wrote, as far as they were committed.

A log is lines of JSON (seq, tx, kind, target, content), kind being begin, write, commit or rollback. A transaction counts
once its commit is whole in the log; what it wrote then holds as of the commit, and of two commits the later one wins. One
that was rolled back, or is pending when the log ends, leaves no trace. Lines may be repeated, as when a log is shipped
twice: replaying it again, or over its own result, gives the same state.

Everything is grouped by store and target or transaction, so logs of many stores are replayed together and no log is read
by one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LINE = "seq long, tx string, kind string, target string, content string, broken string"


def parsed(lines: DataFrame) -> DataFrame:
    """(store, at, seq, tx, kind, target, content, torn) from lines (store, at, line); torn lines are no whole record.

    at numbers the lines of a store. A line that is no JSON object, or lacks its seq, tx or a known kind, is torn.
    """
    entry = F.from_json("line", LINE, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "broken"}).alias("e")
    rows = lines.where(F.trim("line") != "").select("store", "at", entry).select("store", "at", "e.*")
    whole = F.col("broken").isNull() & F.col("seq").isNotNull() & F.col("tx").isNotNull() & F.coalesce(F.col("kind").isin("begin", "write", "commit", "rollback"), F.lit(False))
    return rows.select("store", "at", "seq", "tx", "kind", "target", "content", (~whole).alias("torn"))


def outcomes(log: DataFrame) -> DataFrame:
    """(store, tx, outcome, ended): committed, rolled back or pending, by the first record that ends a transaction."""
    ends = F.col("kind").isin("commit", "rollback")
    first = F.min(F.when(ends, F.struct("seq", "kind")))
    known = log.where("NOT torn").groupBy("store", "tx").agg(first.alias("first"))
    name = F.when(F.col("first.kind") == "commit", "committed").when(F.col("first.kind") == "rollback", "rolled back").otherwise("pending")
    return known.select("store", "tx", name.alias("outcome"), F.col("first.seq").alias("ended"))


def replayed(base: DataFrame, log: DataFrame) -> DataFrame:
    """(store, target, content): base (store, target, content) with all that committed transactions wrote; a null content is gone.

    What a transaction writes after its own commit does not count.
    """
    done = outcomes(log).where("outcome = 'committed'").select("store", "tx", "ended")
    writes = log.where("NOT torn AND kind = 'write' AND target IS NOT NULL").join(done, ["store", "tx"]).where(F.col("seq") < F.col("ended"))
    last = writes.groupBy("store", "target").agg(F.max(F.struct("ended", "seq", "content")).alias("w")).select("store", "target", F.col("w.content").alias("content"))
    kept = base.select("store", "target", "content").join(last.select("store", "target"), ["store", "target"], "left_anti")
    return kept.union(last).where("content IS NOT NULL")
