"""Queries that retrieve in several hops, and what questions want."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import intents as wants
from ..operators import hops, intents
from ..sources.scratch import stored
from ..sources.tables import table
from . import lifecycle, sql
from .lexical import _BM25, _RANKED, TOP, _asked, _posts, ranked_documents
from .registering import Plans

plans = Plans()

_BRIDGE = f"""
{_BM25}, k AS MATERIALIZED ({_RANKED}),
w AS (SELECT DISTINCT item_id AS qid, unnest(regexp_extract_all(lower(text), '[a-z]+')) AS term FROM benchmark),
e AS (SELECT qid, lower(unnest(regexp_extract_all(regexp_replace(text, '[\\x{{C0}}-\\x{{24F}}]', '_', 'g'), '\\b([A-Z][a-z]{{2,}})\\b', 1))) AS term FROM k JOIN documents USING (doc_id)),
x AS (
  SELECT qid, term, CAST(1 AS DOUBLE) AS w FROM e WHERE length(term) > 1 AND term NOT IN ({sql.quoted(sql.STOPWORDS)}) AND (qid, term) NOT IN (SELECT qid, term FROM w)
  UNION ALL SELECT k.qid, t.term, 0.5 * t.tf FROM k JOIN t USING (doc_id) WHERE length(t.term) > 3 AND (k.qid, t.term) NOT IN (SELECT qid, term FROM q)),
b AS MATERIALIZED (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY weight DESC, term) AS rank FROM (SELECT qid, term, round(sum(w), 6) AS weight FROM x GROUP BY ALL)) WHERE rank <= 12 AND weight >= 2)
"""
_SHARE = "rarity * tf * CAST(2.2 AS DOUBLE) / (tf + CAST(1.2 AS DOUBLE) * (CAST(0.25 AS DOUBLE) + CAST(0.75 AS DOUBLE) * length / mean_length))"


def _said(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("qid"), F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0))).alias("word"))


def _n(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").agg(F.count("*").cast("double").alias("n"))


def _bridges(spark: SparkSession, sf_dir: str, posts: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    asked = stored(_asked(spark, sf_dir), "asked")
    hits = stored(ranked_documents(spark, sf_dir, posts), "hits")
    return asked, hits, stored(hops.bridge_terms(hits, table(spark, sf_dir, "documents"), posts, asked, _said(spark, sf_dir), "doc_id"), "bridges")


@plans.query(f"WITH {_BRIDGE} SELECT qid, term, weight, rank FROM b")
def bridge_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the documents that an item ranks first speak of and the item does not."""
    return _bridges(spark, sf_dir, _posts(spark, sf_dir))[2].select("qid", "term", "weight", "rank")


@plans.query(f"""
WITH {_BRIDGE},
c AS (SELECT b.qid, doc_id, round(CAST(0.3 AS DOUBLE) * sum({_SHARE}), 4) AS score FROM b JOIN t USING (term) JOIN r USING (term) JOIN l USING (doc_id) GROUP BY ALL),
o AS (SELECT DISTINCT qid, doc_id FROM q JOIN t USING (term)),
f AS (SELECT * FROM c WHERE (qid, doc_id) NOT IN (SELECT qid, doc_id FROM k) AND (qid, doc_id) IN (SELECT qid, doc_id FROM o))
SELECT * FROM (SELECT qid, doc_id, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id) AS rank FROM f) WHERE rank <= {TOP}
""")
def bridge_rescore(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best documents beyond an item's first hits, by the terms these bridge to."""
    posts = _posts(spark, sf_dir)
    asked, hits, bridges = _bridges(spark, sf_dir, posts)
    return hops.bridged(hits, bridges, posts, _n(spark, sf_dir), asked, "doc_id", TOP)


@plans.query(f"""
WITH {_BRIDGE.replace("rank <= 10", "rank <= 18").replace("rank <= 12 AND weight", "rank <= 2 AND weight")},
c AS (SELECT b.qid, b.term, doc_id, round({_SHARE}, 6) AS score FROM b JOIN t USING (term) JOIN r USING (term) JOIN l USING (doc_id)),
h AS (SELECT qid, doc_id, max(score) AS score FROM (SELECT *, row_number() OVER (PARTITION BY qid, term ORDER BY score DESC, doc_id) AS i FROM c) WHERE i <= 18 GROUP BY ALL),
p AS (SELECT qid, doc_id, 0 AS round, score FROM k UNION ALL SELECT qid, doc_id, 1, score FROM h WHERE (qid, doc_id) NOT IN (SELECT qid, doc_id FROM k))
SELECT * FROM (SELECT qid, doc_id, round, score, row_number() OVER (PARTITION BY qid ORDER BY round, score DESC, doc_id) AS rank FROM p) WHERE rank <= 60
""")
def iterative_retrieval(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two rounds for each item: its own hits, then those of the two terms that they speak of most."""
    posts = _posts(spark, sf_dir)
    return hops.iterated(table(spark, sf_dir, "documents"), posts, _n(spark, sf_dir), stored(_asked(spark, sf_dir), "asked"), stored(_said(spark, sf_dir), "said"), "doc_id")


#: Questions by number, over d, a day.
_QUESTIONS = (
    "'why did it fail'", "'How come the shipment was late, what made it so, and what was the reason'", "'when was it, in ' || left(d, 4) || ' or on ' || d", "'who is the owner and what is the name of the ship'",
    "'describe the box'", "'how to process it: steps, method, instructions'", "'list all of the parts, every one'", "'is it true, did they ever confirm that'", "'compare this vs. that, which is better or similar'",
    "'trace the history of the order over time'", "'the box'", "'  '", "'Did he not go before noon last week?'", "'which of these are all there, or which is not'", "'what changed over the year'", "'How much time'",
)
_PATTERNS = (
    ("WHY", r"\bwhy\b", r"\breason\b", r"\bcause\b", r"\bexplain\b", r"\bhow come\b", r"\bwhat made\b"),
    ("WHEN", r"\bwhen\b", r"\bdate\b", r"\btime\b", r"\byear\b", r"\bmonth\b", r"\blast\b.*\b(week|month|year)\b", r"\d{4}-\d{2}-\d{2}", r"\bin \d{4}\b"),
    ("ENTITY", r"\bwho is\b", r"\bwho was\b", r"\bwhat is\b", r"\bwhich\b", r"\bname of\b", r"\btell me about\b"),
    ("WHAT", r"\bwhat\b", r"\bdescribe\b", r"\bdefine\b"),
    ("HOW", r"\bhow\b(?:$|\s*[^\sc]|\s+c[^o]|\s*$)", r"\bsteps?\b", r"\bprocess\b", r"\bprocedure\b", r"\bmethod\b", r"\binstructions?\b"),
    ("LIST", r"\blist\b", r"\ball\b.*\b(of|the)\b", r"\bwhich\b.*\ball\b", r"\bevery\b", r"\benumerate\b", r"\bshow me all\b"),
    ("VERIFY", r"\bis it true\b", r"\bdid\b.*\b(ever|really)\b", r"\bconfirm\b", r"\bverify\b", r"\btrue that\b", r"\bcorrect that\b", r"\bis that right\b"),
    ("COMPARE", r"\bcompare\b", r"\bdifference\b", r"\bvs\.?\b", r"\bversus\b", r"\bbetter\b.*\bor\b", r"\bwhich\b.*\bor\b", r"\bcontrast\b", r"\bsimilar\b"),
    ("TRACE", r"\btrace\b", r"\bsequence\b", r"\bhistory of\b", r"\bevolution\b", r"\bprogress\b", r"\btimeline\b", r"\bover time\b", r"\bchanged?\b.*\bover\b"),
)
_NTH = f"CASE event_id % {len(_QUESTIONS)} " + " ".join(f"WHEN {n} THEN {q}" for n, q in enumerate(_QUESTIONS)) + " END"
_VALUES = ", ".join(f"({at}, '{intent}', {len(rest)}, '{p}')" for at, (intent, *rest) in enumerate(_PATTERNS) for p in rest)
_INTENTS = f"""
a AS (SELECT event_id, day, d, value, {_NTH} AS text FROM (SELECT event_id, CAST(ts AS DATE) AS day, strftime(ts, '%Y-%m-%d') AS d, value FROM events)),
v(ord, intent, many, pattern) AS (VALUES {_VALUES}),
y AS (SELECT text, ord, intent, count(*) / CAST(any_value(many) AS DOUBLE) AS share FROM (SELECT DISTINCT text FROM a), v WHERE regexp_matches(text, pattern, 'i') GROUP BY ALL),
z AS (SELECT text, arg_max(intent, share * 100 - ord) AS intent, max(share) AS share, list(intent ORDER BY share DESC, ord) AS names, list(share ORDER BY share DESC, ord) AS shares FROM y GROUP BY text),
g AS MATERIALIZED (
  SELECT event_id, day, value, a.text, coalesce(z.intent, 'WHAT') AS intent, CASE WHEN trim(a.text) = '' THEN 0 WHEN z.text IS NULL THEN CAST(0.1 AS DOUBLE) ELSE least(2 * share, 1) END AS confidence,
         CASE WHEN z.text IS NULL THEN '' ELSE array_to_string(list_filter(names[2:], lambda x, i: shares[i + 1] > 0.2), ',') END AS others
  FROM a LEFT JOIN z ON a.text = z.text)
"""


def _classified(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select("event_id", F.to_date("ts").alias("day"), F.date_format("ts", "yyyy-MM-dd").alias("d"), "value").withColumn("text", F.expr(_NTH))
    return intents.classify(rows, "text")


@plans.query(f"WITH {_INTENTS} SELECT event_id, intent, round(confidence, 3) AS confidence, others FROM g")
def question_intents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the question of each event wants, and what else it may want."""
    rows = _classified(spark, sf_dir)
    return rows.select("event_id", "intent", F.round("confidence", 3).alias("confidence"), F.array_join("sub_intents", ",").alias("others"))


_LEARNED = """
u AS (SELECT intent, day, sum(CASE WHEN event_id % 4 > 0 AND value / 100 > 0.3 THEN 1 ELSE 0 END) AS good, count(*) AS n FROM g GROUP BY ALL),
s AS (SELECT intent, day, 0.5 + 0.5 * sum(good) OVER x / CAST(sum(n) OVER x AS DOUBLE) AS weight, sum(n) OVER x AS n FROM u WINDOW x AS (PARTITION BY intent ORDER BY day)),
m AS (SELECT event_id, g.text, g.intent, round(g.confidence * coalesce((SELECT arg_max(weight, s.day) FROM s WHERE s.intent = g.intent AND s.day < g.day AND s.n >= 5), 1), 3) AS confidence FROM g)
"""


def _adapted(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = stored(_classified(spark, sf_dir), "classified")
    outcomes = rows.select("intent", "day", (F.col("event_id") % 4).alias("results"), (F.col("value") / 100).alias("score"))
    return intents.adapted(rows, intents.learned(outcomes))


@plans.query(f"WITH {_INTENTS}, {_LEARNED} SELECT event_id, intent, confidence FROM m")
def learned_intents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How sure of its intent a question is, after what became of the questions of the days before."""
    return _adapted(spark, sf_dir).select("event_id", "intent", "confidence")


@plans.query(f"""
WITH {_INTENTS}, {_LEARNED}, kinds AS ({{kinds}})
SELECT event_id, CASE WHEN confidence >= 0.3 THEN intent WHEN kind = 'temporal' THEN 'WHEN' WHEN kind = 'adversarial' THEN 'VERIFY' ELSE 'WHAT' END AS intent,
  CASE WHEN confidence < 0.3 THEN 0.5 ELSE confidence END AS confidence FROM m JOIN kinds USING (text)
""".replace("{kinds}", "WITH " + lifecycle._KINDS.replace("FROM conversations", "FROM (SELECT DISTINCT text FROM a)") + " SELECT text, kind FROM q"))
def routed_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each question's intent, by its kind where patterns and history leave it unsure."""
    rows = _adapted(spark, sf_dir)
    return rows.withColumn("r", wants.decided(F.col("text"), F.col("intent"), F.col("confidence"))).select("event_id", "r.intent", "r.confidence")


QUERIES, SQL = plans.queries, plans.sql
