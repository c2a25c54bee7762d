"""What a question wants: nine intents, each known by patterns, and what history says of them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import understanding

#: The intents in their order (of equal scores the first counts), with what retrieval takes from each (expansion, hops
#: in the graph, reranking) and the patterns that speak for it.
INTENTS = {
    "WHY": ("rm3", 2, "causal", (r"\bwhy\b", r"\breason\b", r"\bcause\b", r"\bexplain\b", r"\bhow come\b", r"\bwhat made\b")),
    "WHEN": ("date", 1, "temporal", (r"\bwhen\b", r"\bdate\b", r"\btime\b", r"\byear\b", r"\bmonth\b", r"\blast\b.*\b(week|month|year)\b", r"\d{4}-\d{2}-\d{2}", r"\bin \d{4}\b")),
    "ENTITY": ("entity", 1, "exact", (r"\bwho is\b", r"\bwho was\b", r"\bwhat is\b", r"\bwhich\b", r"\bname of\b", r"\btell me about\b")),
    "WHAT": ("rm3", 1, "default", (r"\bwhat\b", r"\bdescribe\b", r"\bdefine\b")),
    "HOW": ("rm3", 2, "procedural", (r"\bhow\b(?!\s+come)", r"\bsteps?\b", r"\bprocess\b", r"\bprocedure\b", r"\bmethod\b", r"\binstructions?\b")),
    "LIST": ("broad", 0, "diversity", (r"\blist\b", r"\ball\b.*\b(of|the)\b", r"\bwhich\b.*\ball\b", r"\bevery\b", r"\benumerate\b", r"\bshow me all\b")),
    "VERIFY": ("exact", 1, "evidence", (r"\bis it true\b", r"\bdid\b.*\b(ever|really)\b", r"\bconfirm\b", r"\bverify\b", r"\btrue that\b", r"\bcorrect that\b", r"\bis that right\b")),
    "COMPARE": ("multi", 2, "balanced", (r"\bcompare\b", r"\bdifference\b", r"\bvs\.?\b", r"\bversus\b", r"\bbetter\b.*\bor\b", r"\bwhich\b.*\bor\b", r"\bcontrast\b", r"\bsimilar\b")),
    "TRACE": ("chain", 3, "temporal", (r"\btrace\b", r"\bsequence\b", r"\bhistory of\b", r"\bevolution\b", r"\bprogress\b", r"\btimeline\b", r"\bover time\b", r"\bchanged?\b.*\bover\b")),
}
#: A second intent counts above this share; so many outcomes are needed to learn from; an outcome is good above this
#: score; below this confidence the kind of question decides, with a confidence of its own.
SECOND, SAMPLES, GOOD, UNSURE, DECIDED = 0.2, 5, 0.3, 0.3, 0.5
KIND_INTENTS = {"temporal": "WHEN", "adversarial": "VERIFY"}


def intent_shares(text: Column) -> Column:
    """(share, order, intent) of every intent that a pattern speaks for, the likeliest first."""
    found = [F.struct((-sum((text.rlike(f"(?i){p}").cast("int") for p in patterns), F.lit(0)) / len(patterns)).alias("less"), F.lit(n).alias("at"), F.lit(intent).alias("intent")) for n, (intent, (*_, patterns)) in enumerate(INTENTS.items())]
    return F.array_sort(F.filter(F.array(*found), lambda x: x.less < 0))


def classified(text: Column, shares: Column) -> Column:
    """(intent, confidence, sub_intents) from a text and its intent_shares, before history counts."""
    empty = ~F.coalesce(text, F.lit("")).rlike(r"\S")
    confidence = F.when(empty, 0.0).when(F.size(shares) == 0, 0.1).otherwise(F.least(-2 * F.get(shares, F.lit(0)).less, F.lit(1.0)))
    others = F.transform(F.filter(F.slice(shares, 2, len(INTENTS)), lambda x: x.less < -SECOND), lambda x: x.intent)
    intent = F.when(empty | (F.size(shares) == 0), "WHAT").otherwise(F.get(shares, F.lit(0)).intent)
    return F.struct(intent.alias("intent"), confidence.alias("confidence"), F.when(empty, F.array().cast("array<string>")).otherwise(others).alias("sub_intents"))


def decided(text: Column, intent: Column, confidence: Column) -> Column:
    """(intent, confidence): what the kind of question says where patterns and history leave an intent unsure."""
    kind = understanding.question_kind(text)
    by_kind = F.lit("WHAT")
    for name, of in KIND_INTENTS.items():
        by_kind = F.when(kind == name, of).otherwise(by_kind)
    unsure = confidence < UNSURE
    return F.struct(F.when(unsure, by_kind).otherwise(intent).alias("intent"), F.when(unsure, DECIDED).otherwise(confidence).alias("confidence"))


def parameter(intent: Column, which: int) -> Column:
    """What retrieval takes from an intent: 0 expansion, 1 hops, 2 reranking; as a string."""
    return F.element_at(F.create_map(*[F.lit(str(x)) for name, of in INTENTS.items() for x in (name, of[which])]), intent)
