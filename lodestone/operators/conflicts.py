"""Conflicts: intervals that overlap, scopes that meet, signatures whose modalities cannot both hold, texts that contradict.

Overlaps are found by equi-joins only. A day is in one dyadic node of each size, and an interval is the union of at most
two nodes of each size, so the intervals that hold a given day are those that have one of its nodes; of two intervals that
overlap the later start lies in the other one, and in exactly one of its nodes. So each pair comes once, a long interval
makes some dozens of rows and not one for each day, and a key that many records have is spread over its nodes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import by_ascii

LEVELS = 17  # sizes of nodes: intervals lie within 2^16 days

#: Pairs of modalities that cannot both hold, and how grave that is; they hold either way round.
MODALITIES = (
    ("must", "must_not", "critical"),
    ("should", "must_not", "medium"),
    ("should", "should_not", "medium"),
    ("must", "should_not", "medium"),
    ("may", "must_not", "low"),
)

#: Patterns that speak of a negation or reversal.
NEGATIONS = (
    r"\bnot\b", r"\bnever\b", r"\bdon't\b", r"\bdoesn't\b", r"\bshouldn't\b", r"\bwon't\b", r"\bcannot\b", r"\bcan't\b", r"\bdisable\b", r"\bremove\b",
    r"\bdelete\b", r"\bdeprecate\b", r"\brevert\b", r"\bundo\b", r"\broll\s*back\b", r"\binstead\b", r"\breplace\b",
)
#: Words that turn a statement round.
REVERSALS = (("active", "deprecated"), ("enable", "disable"), ("allow", "deny"), ("accept", "reject"), ("start", "stop"), ("add", "remove"), ("increase", "decrease"), ("true", "false"))


def cover(first: Column, last: Column, levels: int = LEVELS) -> Column:
    """The (level, node) whose union is the days first to last, all below 2^(levels - 1)."""

    def at(k: Column) -> Column:
        low = F.call_function("shiftright", first + F.call_function("shiftleft", F.lit(1), k) - 1, k)
        high = F.call_function("shiftright", last + 1, k)
        node = lambda on, n: F.when((low < high) & on, F.struct(k.alias("level"), n.alias("node")))
        return F.array(node(low % 2 == 1, low), node(high % 2 == 1, high - 1))

    return F.filter(F.flatten(F.transform(F.sequence(F.lit(0), F.lit(levels - 1)), at)), lambda n: n.isNotNull())


def overlapping(rows: DataFrame, key: str, id_col: str, first: str, last: str, salts: int = 1) -> DataFrame:
    """(key, a, b, from_day, to_day): pairs of rows of a key whose days (integers, ends included) overlap, each once.

    a starts first; of equal starts it is the smaller id. A null start or end is open; a null key or id, or an end before its
    start, overlaps nothing. Keys with very many rows of the same days can be dealt to salts tasks.
    """
    far = (1 << (LEVELS - 1)) - 1
    held = rows.where(F.col(key).isNotNull() & F.col(id_col).isNotNull())
    spans = held.select(F.col(key).alias("k"), F.col(id_col).alias("id"), F.greatest(F.coalesce(first, F.lit(0)), F.lit(0)).cast("int").alias("s"), F.least(F.coalesce(last, F.lit(far)), F.lit(far)).cast("int").alias("e"))
    spans = spans.where("s <= e")
    nodes = spans.select("k", F.col("id").alias("a"), F.col("s").alias("sa"), F.col("e").alias("ea"), F.explode(cover(F.col("s"), F.col("e"))).alias("n"))
    nodes = nodes.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    nodes = nodes.select("k", "a", "sa", "ea", "n.level", "n.node", "salt")
    days = spans.select("k", F.col("id").alias("b"), F.col("s").alias("sb"), F.col("e").alias("eb"), F.pmod(F.xxhash64("id"), F.lit(salts)).cast("int").alias("salt"), F.explode(F.sequence(F.lit(0), F.lit(LEVELS - 1))).alias("level"))
    days = days.withColumn("node", F.call_function("shiftright", F.col("sb"), F.col("level")))
    met = nodes.join(days, ["k", "level", "node", "salt"]).where((F.col("sa") < F.col("sb")) | ((F.col("sa") == F.col("sb")) & (F.col("a") < F.col("b"))))
    return met.select(F.col("k").alias(key), "a", "b", F.col("sb").alias("from_day"), F.least("ea", "eb").alias("to_day"))


def meet(a: Column, b: Column) -> Column:
    """Whether two lists of a scope meet; an empty or null one is no restriction."""
    free = (F.coalesce(F.size(a), F.lit(0)) < 1) | (F.coalesce(F.size(b), F.lit(0)) < 1)
    return free | F.coalesce(F.arrays_overlap(a, b), F.lit(False))


def severity(m1: Column, m2: Column) -> Column:
    """How gravely two modalities conflict; null if they do not."""
    out = F.when(F.lit(False), F.lit(None).cast("string"))
    for a, b, grave in MODALITIES:
        out = out.when(((m1 == a) & (m2 == b)) | ((m1 == b) & (m2 == a)), grave)
    return out


def signature_conflicts(signatures: DataFrame, salts: int = 1) -> DataFrame:
    """(axis, a, b, severity, kind) of signatures of one axis, within scopes that overlap, that cannot both hold.

    signatures has id, axis, exclusive, modality, predicate, object, relation, linked (ids it composes with or requires),
    projects, channels, first_day and last_day. Pairs that one links to the other, or that both compose or require, are none.
    Opposite modalities conflict if their objects are equal or one is unspecified; equal demands ("must", "should") of the same
    predicate conflict over different objects, hard ones on exclusive axes only.
    """
    pairs = overlapping(signatures, "axis", "id", "first_day", "last_day", salts).select("axis", "a", "b")
    fields = ["id", "exclusive", "modality", "predicate", "object", "relation", "linked", "projects", "channels"]
    side = lambda s: signatures.select(*[F.col(c).alias(f"{c}_{s}") for c in fields])
    both = pairs.join(side("a"), F.col("a") == F.col("id_a")).join(side("b"), F.col("b") == F.col("id_b"))
    has = lambda ids, i: F.coalesce(F.array_contains(ids, i), F.lit(False))
    linked = has(F.col("linked_a"), F.col("b")) | has(F.col("linked_b"), F.col("a"))
    alike = F.coalesce((F.col("relation_a") == F.col("relation_b")) & F.col("relation_a").isin("composes_with", "requires"), F.lit(False))
    both = both.where(~linked & ~alike & meet(F.col("projects_a"), F.col("projects_b")) & meet(F.col("channels_a"), F.col("channels_b")))
    low = lambda c: F.lower(F.coalesce(F.col(c), F.lit("")))
    grave = severity(F.coalesce("modality_a", F.lit("may")), F.coalesce("modality_b", F.lit("may")))
    same_object = low("object_a") == low("object_b")
    opposed = grave.isNotNull() & (same_object | (low("object_a") == "") | (low("object_b") == ""))
    rival = (F.col("modality_a") == F.col("modality_b")) & (low("predicate_a") == low("predicate_b")) & ~same_object
    hard = rival & (F.col("modality_a") == "must") & F.coalesce("exclusive_a", F.lit(True))
    soft = rival & (F.col("modality_a") == "should")
    kind = F.when(opposed, "modality").when(hard | soft, "competing")
    found = both.withColumn("kind", kind).withColumn("severity", F.when(opposed, grave).when(hard, "critical").when(soft, "low"))
    return found.where("kind IS NOT NULL").select("axis", "a", "b", "severity", "kind")


def plain_tokens(text: Column) -> Column:
    """Words of ASCII letters and digits, with what follows an apostrophe; words with other letters are left out."""
    runs = F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}_]+(?:'[a-z]+)?"), F.lit(0))
    return F.filter(runs, lambda w: w.rlike("^[a-z0-9]+('[a-z]+)?$"))


def conflict_type(new: Column, old: Column, similarity: Column) -> Column:
    """What a proposal is to a record of similar words: duplicate, contradiction, refinement or merely related."""
    a, b = F.lower(new), F.lower(old)
    count = lambda t: sum((t.rlike(by_ascii(p)).cast("int") for p in NEGATIONS), F.lit(0))
    word = lambda t, w: t.rlike(by_ascii(rf"\b{w}\b"))
    turned = F.lit(False)
    for x, y in REVERSALS:
        turned = turned | (word(a, x) & word(b, y)) | (word(a, y) & word(b, x))
    denied = (F.abs(count(a) - count(b)) >= 3) & (similarity > 0.5)
    return F.when(similarity > 0.9, "duplicate").when(denied | (turned & (similarity > 0.4)), "contradiction").when(similarity > 0.7, "refinement").otherwise("related")


def cosines(pairs: DataFrame, new: DataFrame, old: DataFrame) -> DataFrame:
    """pairs (a, b) with the cosine of their word counts; new has (a, text), old has (b, text). No common word: no row."""

    def counted(rows: DataFrame, ids: DataFrame, i: str) -> DataFrame:
        words = rows.join(ids, i, "left_semi").select(i, F.explode(plain_tokens(F.col("text"))).alias("w"))
        return words.groupBy(i, "w").agg(F.count("*").alias(f"n_{i}"))

    x, y = counted(new, pairs, "a"), counted(old, pairs, "b")
    size = lambda t, i: t.groupBy(i).agg(F.sqrt(F.sum(F.col(f"n_{i}") * F.col(f"n_{i}"))).alias(f"size_{i}"))
    dots = pairs.join(x, "a").join(y, ["b", "w"]).groupBy("a", "b").agg(F.sum(F.col("n_a") * F.col("n_b")).alias("dot"))
    return dots.join(size(x, "a"), "a").join(size(y, "b"), "b").select("a", "b", (F.col("dot") / (F.col("size_a") * F.col("size_b"))).alias("similarity"))
