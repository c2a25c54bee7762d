"""Ledgers of hash-linked entries, and Merkle trees over their leaves.

A chain is sequential: each entry's hash contains the one before. So a ledger has many chains (here one for each record
and day), which are computed side by side; a chain's entries come together in one task. A tree needs one shuffle for
each level, and a level has half the rows of the one below; proofs take whole subtrees at once, and shuffle leaves before they
are hashed, since hashes do not compress.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import stored as kept

GENESIS = "0" * 64
SEP = "\0"
HEIGHT = 12  # levels of a subtree, whose 2^HEIGHT leaves are one row
PART_ROWS = 1 << 18  # leaves of a task


def entry_hash(before: Column, *fields: Column) -> Column:
    """Hash of an entry: the hash before and the entry's fields, parted by a character that no field has."""
    return F.sha2(F.concat_ws(SEP, before, *fields), 256)


def chained(entries: DataFrame, chain: list[str], order: str, fields: list[str]) -> DataFrame:
    """(chain, order, entry_hash, seq): each entry of each chain with its hash, numbered from 1."""
    held = entries.groupBy(*chain).agg(F.array_sort(F.collect_list(F.struct(order, *fields))).alias("es"))

    def step(acc: Column, e: Column) -> Column:
        before = F.coalesce(F.try_element_at(acc, F.lit(-1))["entry_hash"], F.lit(GENESIS))
        return F.concat(acc, F.array(F.struct(e[order].alias(order), entry_hash(before, *[e[f] for f in fields]).alias("entry_hash"))))

    kind = entries.schema[order].dataType.simpleString()
    start = F.array().cast(f"array<struct<{order}:{kind},entry_hash:string>>")
    rows = held.select(*chain, F.posexplode(F.aggregate("es", start, step)).alias("at", "x"))
    return rows.select(*chain, f"x.{order}", "x.entry_hash", (F.col("at") + 1).cast("long").alias("seq"))


def broken_at(stored: DataFrame, entries: DataFrame, chain: list[str], order: str, fields: list[str]) -> DataFrame:
    """(chain, n, broken_at): the first entry of each chain whose stored hash is not that of what it is now; null if all are."""
    now = chained(entries, chain, order, fields).select(*chain, order, F.col("entry_hash").alias("now"))
    both = stored.join(now, [*chain, order])
    return both.groupBy(*chain).agg(F.count("*").alias("n"), F.min(F.when(F.col("entry_hash") != F.col("now"), F.col("seq"))).alias("broken_at"))


def node_hash(left: Column, right: Column) -> Column:
    """Hash of a node over two others; one without a neighbour is its own."""
    return F.sha2(F.concat(F.lit("N:"), left, F.lit("|"), F.coalesce(right, left)), 256)


def merkle_levels(leaves: DataFrame, tree: str, most: int) -> DataFrame:
    """(tree, level, pos, hash, n) of every node; leaves are (tree, pos from 0, hash, n leaves), most of them in one tree."""
    level, every, n = leaves.select(tree, F.lit(0).alias("level"), "pos", "hash", "n"), [], most
    every.append(level)
    while n > 1:
        left = F.max(F.when(F.col("pos") % 2 == 0, F.col("hash")))
        right = F.max(F.when(F.col("pos") % 2 == 1, F.col("hash")))
        up = level.where("n > 1").groupBy(tree, "level", "n", F.floor(F.col("pos") / 2).alias("up"))
        level = up.agg(node_hash(left, right).alias("hash"))
        level = level.select(tree, (F.col("level") + 1).alias("level"), F.col("up").alias("pos"), "hash", F.floor((F.col("n") + 1) / 2).alias("n"))
        every.append(level)
        n = (n + 1) // 2
    out = every[0]
    for more in every[1:]:
        out = out.union(more)
    return out


def proofs(levels: DataFrame, asked: DataFrame, tree: str) -> DataFrame:
    """(tree, pos, hash, siblings): for each asked leaf the hashes beside its path, from the leaf up."""
    paths = asked.join(levels.where("n > 1").groupBy(tree).agg(F.max("level").alias("top")), tree, "left")
    steps = paths.select(tree, "pos", "hash", F.explode(F.sequence(F.lit(0), F.col("top"))).alias("level"))
    steps = steps.withColumn("own", F.floor(F.col("pos") / F.pow(F.lit(2), F.col("level"))))
    nodes = levels.select(tree, "level", F.col("pos").alias("at"), F.col("hash").alias("side"))
    beside = F.when(F.col("own") % 2 == 0, F.col("own") + 1).otherwise(F.col("own") - 1)
    found = steps.withColumn("at", beside).join(nodes, [tree, "level", "at"], "left")
    side = F.struct("level", (F.col("own") % 2 == 0).alias("is_left"), "side")
    return found.groupBy(tree, "pos", "hash").agg(F.array_sort(F.collect_list(side)).alias("siblings"))


def proven_root(leaf: Column, siblings: Column) -> Column:
    """The root that a leaf's hash and the hashes beside its path lead to."""

    def step(h: Column, s: Column) -> Column:
        side = F.coalesce(s["side"], h)
        left, right = F.when(s["is_left"], h).otherwise(side), F.when(s["is_left"], side).otherwise(h)
        return F.sha2(F.concat(F.lit("N:"), left, F.lit("|"), right), 256)

    return F.aggregate(siblings, leaf, step)


def subtrees(leaves: DataFrame, tree: str, leaf: str, hashed: Column, asks: Column, height: int = HEIGHT) -> DataFrame:
    """(tree, pos, n, hash, steps, asked): the subtrees of 2^height leaves by place, n of them in a tree, each with its root's hash.

    leaves are (tree, pos from 0, n leaves, leaf, ...), hashed is a leaf's hash. asked has, for each leaf that asks tells, the leaf
    and the root that its proof of so many steps within the subtree leads to. A tree of fewer leaves is one lower subtree.
    """
    spread = leaves.withColumn("up", F.shiftright("pos", height)).repartition(leaves.count() // PART_ROWS + 1, tree, "up")
    held = spread.select(tree, "n", "up", F.struct("pos", hashed.alias("hash"), F.when(asks, F.col(leaf)).alias("leaf")).alias("l"))
    held = held.groupBy(tree, "n", "up").agg(F.array_sort(F.collect_list("l")).alias("ls"))
    held = held.withColumn("steps", F.when(F.col("n") > 1, F.least(F.lit(height), F.length(F.bin(F.col("n") - 1)))).otherwise(0))
    rounds = F.when(F.col("steps") > 0, F.sequence(F.lit(0), F.col("steps") - 1)).otherwise(F.array().cast("array<int>"))
    above = lambda a: F.transform(F.sequence(F.lit(0), F.shiftright(F.size(a) - 1, 1)), lambda i: node_hash(F.get(a, 2 * i), F.get(a, 2 * i + 1)))
    levels = F.aggregate(rounds, F.array(F.col("ls")["hash"]), lambda done, _: F.array_append(done, above(F.element_at(done, -1))))
    held = held.withColumn("levels", levels)

    def beside(place: Column) -> Column:
        own = lambda j: F.call_function("shiftright", place, j)
        return F.transform(rounds, lambda j: F.struct(j.alias("level"), (own(j) % 2 == 0).alias("is_left"), F.get(F.get("levels", j), own(j).bitwiseXOR(F.lit(1))).alias("side")))

    first = F.shiftleft("up", height)
    asked = F.transform(F.filter("ls", lambda x: x["leaf"].isNotNull()), lambda x: F.struct(x["leaf"].alias("leaf"), proven_root(x["hash"], beside((x["pos"] - first).cast("int"))).alias("found")))
    many = F.shiftright(F.col("n") - 1, height) + 1
    return held.select(tree, F.col("up").alias("pos"), many.alias("n"), F.get(F.element_at("levels", -1), F.lit(0)).alias("hash"), "steps", asked.alias("asked"))


def proven(leaves: DataFrame, tree: str, leaf: str, hashed: Column, asks: Column, height: int = HEIGHT) -> DataFrame:
    """(leaf, steps, root, proven): the length of each asked leaf's proof, its tree's root, and whether the proof leads there.

    The proof goes up in the leaf's subtree, and on from the subtree's place among the others. A tree of one leaf has no proof.
    """
    parts = kept(subtrees(leaves, tree, leaf, hashed, asks, height), "subtrees")
    every = kept(merkle_levels(parts, tree, parts.agg(F.max("n").alias("n")).first()["n"] or 1), "merkle-levels")
    roots = every.where("n = 1").select(tree, F.col("hash").alias("root"))
    above = kept(proofs(every, parts.select(tree, "pos", "hash"), tree).select(tree, "pos", "siblings"), "proofs")
    both = parts.join(above, [tree, "pos"], "left").join(roots, tree).withColumn("steps", F.col("steps") + F.when(F.col("siblings").isNull(), 0).otherwise(F.size("siblings")))
    found = both.where("steps > 0").select(F.explode("asked").alias("a"), "steps", "siblings", "root")
    last = F.when(F.col("siblings").isNull(), F.col("a.found")).otherwise(proven_root(F.col("a.found"), F.col("siblings")))
    return found.select(F.col("a.leaf").alias(leaf), "steps", "root", (last == F.col("root")).alias("proven"))
