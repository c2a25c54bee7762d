"""Connected components of a graph of links, as joins over its edges.

Defined results for odd input: a link with a null end joins nothing, links may be repeated, turned around or lead from a
node to itself; without links there are no nodes; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored

SALTS = 64


def components(links: DataFrame) -> DataFrame:
    """(node, label) for every node of links (a, b): the smallest node that it can reach.

    Each round gives a node the smallest label among its own and its neighbours', and then that label's own label, so
    the rounds grow with the logarithm of the longest path. Every round is written to the shared folder.
    """
    links = links.select("a", "b").where("a IS NOT NULL AND b IS NOT NULL")
    edges = stored(links.union(links.select("b", "a")).distinct(), "edges")
    labels = stored(edges.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("label")), "labels")
    while True:
        near = edges.join(labels, edges["b"] == labels["node"]).groupBy("a").agg(F.min("label").alias("near"))
        near = stored(labels.join(near, labels["node"] == near["a"]).select("node", "label", F.least("label", "near").alias("new")), "near")
        of = near.select(F.col("node").alias("l"), F.col("new").alias("jumped"))
        both = stored(near.join(of, near["new"] == of["l"]).select("node", "label", "jumped"), "jumped")
        labels = both.select("node", F.col("jumped").alias("label"))
        if both.where("label <> jumped").isEmpty():
            return labels


class Copies:
    """Documents (doc_id, n, f1, f2, ...) with equal sets as one node, the smallest doc_id of those with f1 and f2.

    A set that very many documents have is aggregated in two steps and joined in SALTS parts. Documents without an id or
    with an empty set have no node and take no part in a join.
    """

    def __init__(self, sketch: DataFrame):
        self.sketch = sketch.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int"))
        self.real = F.col("doc_id").isNotNull() & (F.col("n") > 0)
        self.spread = stored(self.sketch.where(self.real).groupBy("f1", "f2", "salt").agg(F.min("doc_id").alias("least")), "spread")
        self.same = stored(self.spread.groupBy("f1", "f2").agg(F.min("least").alias("node")), "copies")

    def nodes(self) -> DataFrame:
        """The sketches of the nodes, each once."""
        same = self.same.select(F.col("f1").alias("g1"), F.col("f2").alias("g2"), "node")
        mine = (F.col("doc_id") == F.col("node")) & (F.col("f1") == F.col("g1")) & (F.col("f2") == F.col("g2"))
        return self.sketch.where(self.real).join(same, mine).drop("g1", "g2", "salt").dropDuplicates(["node", "f1", "f2"])

    def carried(self, labelled: DataFrame) -> DataFrame:
        """(doc_id, n, label) of every document, from labelled (node, label); label is null without one."""
        known = self.spread.join(self.same.join(labelled, "node"), ["f1", "f2"]).select("f1", "f2", "salt", "label")
        have = self.sketch.where(self.real).join(known, ["f1", "f2", "salt"], "left").select("doc_id", "n", "label")
        return have.union(self.sketch.where(~self.real).select("doc_id", "n", F.lit(None).cast("long")))
