"""Edits that wait for approval: what was proposed for which record, what became of it, and in what order."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def edits(proposals: DataFrame, decisions: DataFrame, records: DataFrame) -> DataFrame:
    """(edit_id, record_id, old_content, new_content, reason, proposed_at, status, decided_at, approver), a row for each proposal.

    proposals has (edit_id, record_id, new_content, reason, at), decisions (edit_id, at, approver, approved), records (record_id,
    content). A proposal without a reason is refused, and nothing decides it. The first decision that is not before the proposal
    counts (of equal times the smaller approver), and later ones change nothing; until then an edit is pending. What a record was
    when it was proposed is kept with it; a record that is unknown had no content.
    """
    asked = proposals.select("edit_id", "record_id", "new_content", "reason", F.col("at").alias("proposed_at"), (F.trim(F.coalesce("reason", F.lit(""))) == "").alias("bare"))
    made = decisions.select("edit_id", F.col("at").alias("then"), "approver", "approved").where("then IS NOT NULL AND approved IS NOT NULL")
    valid = asked.where("NOT bare").select("edit_id", "proposed_at").join(made, "edit_id").where("then >= proposed_at")
    first = valid.groupBy("edit_id").agg(F.min(F.struct("then", "approver", "approved")).alias("d"))
    every = asked.join(first, "edit_id", "left").join(records.select("record_id", F.col("content").alias("old_content")), "record_id", "left")
    status = F.when(F.col("bare"), "refused").when(F.col("d").isNull(), "pending").when(F.col("d.approved"), "applied").otherwise("rejected")
    return every.select("edit_id", "record_id", "old_content", "new_content", "reason", "proposed_at", status.alias("status"), F.col("d.then").alias("decided_at"), F.col("d.approver").alias("approver"))


def history(all_edits: DataFrame) -> DataFrame:
    """all_edits with their number in the record's history, the oldest proposal first; refused ones have none."""
    order = Window.partitionBy("record_id").orderBy("proposed_at", "edit_id")
    return all_edits.where("status <> 'refused'").withColumn("number", F.row_number().over(order))


def pending(all_edits: DataFrame, most: int = 100) -> DataFrame:
    """The oldest edits that nobody decided yet, at most so many."""
    return all_edits.where("status = 'pending'").orderBy("proposed_at", "edit_id").limit(most)


def after_edits(all_edits: DataFrame, records: DataFrame) -> DataFrame:
    """(record_id, content, stale): records as their last applied edit leaves them.

    stale tells that another edit was applied between that one's proposal and its approval, so that it was made for other content.
    """
    done = all_edits.where("status = 'applied'")
    last = done.groupBy("record_id").agg(F.max(F.struct("decided_at", "edit_id", "new_content", "proposed_at")).alias("e"))
    between = done.select("record_id", F.col("decided_at").alias("then"), F.col("edit_id").alias("other")).join(last, "record_id")
    between = between.where("(other <> e.edit_id) AND then > e.proposed_at AND then <= e.decided_at").select("record_id").distinct().withColumn("stale", F.lit(True))
    every = records.join(last, "record_id", "left").join(between, "record_id", "left")
    return every.select("record_id", F.when(F.col("e").isNotNull(), F.col("e.new_content")).otherwise(F.col("content")).alias("content"), F.coalesce("stale", F.lit(False)).alias("stale"))
