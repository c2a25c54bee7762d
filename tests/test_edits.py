"""Edits that wait for approval, case by case."""

import datetime as dt

from lodestone.operators import edits

T = lambda n: dt.datetime(2024, 1, 1) + dt.timedelta(hours=n)


def test_edits(spark):
    proposals = [(1, "a", "a1", "better", T(0)), (2, "a", "a2", "better still", T(1)), (3, "a", "a3", " ", T(2)), (4, "b", None, "gone", T(0)), (5, "new", "n", "x", T(0)), (6, "b", "b6", "y", T(9)), (7, "a", "a7", None, T(0))]
    decisions = [(1, T(5), "z", True), (1, T(4), "y", True), (1, T(4), "x", True), (2, T(6), "x", True), (3, T(3), "x", True), (4, T(-1), "early", False), (4, T(2), "x", True), (4, T(3), "x", False), (6, T(10), "x", False), (99, T(1), "x", True), (5, None, "x", True), (5, T(1), "x", None)]
    records = spark.createDataFrame([("a", "a0"), ("b", "b0"), ("c", "c0")], "record_id string, content string")
    found = edits.edits(spark.createDataFrame(proposals, "edit_id int, record_id string, new_content string, reason string, at timestamp"), spark.createDataFrame(decisions, "edit_id int, at timestamp, approver string, approved boolean"), records).cache()
    assert {r.edit_id: (r.status, r.approver, r.old_content) for r in found.collect()} == {1: ("applied", "x", "a0"), 2: ("applied", "x", "a0"), 3: ("refused", None, "a0"), 4: ("applied", "x", "b0"), 5: ("pending", None, None), 6: ("rejected", "x", "b0"), 7: ("refused", None, "a0")}
    assert {(r.record_id, r.number): r.edit_id for r in edits.history(found).collect()} == {("a", 1): 1, ("a", 2): 2, ("b", 1): 4, ("b", 2): 6, ("new", 1): 5}
    assert [r.edit_id for r in edits.pending(found).collect()] == [5]
    # the second edit of a was made before the first one was applied; the edit of b took its content away
    assert {r.record_id: (r.content, r.stale) for r in edits.after_edits(found, records).collect()} == {"a": ("a2", True), "b": (None, False), "c": ("c0", False)}
