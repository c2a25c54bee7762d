"""Queries over ranked evidence: thinning it, packing it into a budget, and when to answer at all.

Ranked lists are the ten documents each benchmark item ranks first, so what is grouped by item is bounded by that.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text, understanding
from ..operators import evidence, lexical
from ..sources.scratch import stored
from ..sources.tables import table
from . import lexical as ranking
from . import sql
from .registering import Plans

plans = Plans()
D = "CAST({} AS DOUBLE)".format
_HITS = f"WITH RECURSIVE {ranking._BM25}, k AS ({ranking._RANKED}), h AS (SELECT k.qid, k.doc_id, k.score, CAST(k.rank AS BIGINT) AS rank, d.text, d.source, d.lang, d.n_chars FROM k JOIN documents d USING (doc_id))"


def hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(qid, doc_id, score, rank, text, source, lang, n_chars) of what each item ranks first."""
    ranked = stored(ranking.ranked_documents(spark, sf_dir), "hits")
    return ranked.join(table(spark, sf_dir, "documents"), "doc_id")


@plans.query(f"{_HITS} SELECT qid, doc_id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY qid, source ORDER BY score DESC, doc_id) AS a, row_number() OVER (PARTITION BY qid, substr(text, 1, 40) ORDER BY rank) AS b FROM h) WHERE a <= 2 AND b = 1")
def thinned_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits with two of a source at most, and one of those that begin alike."""
    by_source = Window.partitionBy("qid", "source").orderBy(F.col("score").desc(), "doc_id")
    alike = Window.partitionBy("qid", F.substring("text", 1, 40)).orderBy("rank")
    rows = hits(spark, sf_dir).withColumn("a", F.row_number().over(by_source)).withColumn("b", F.row_number().over(alike))
    return rows.where("a <= 2 AND b = 1").select("qid", "doc_id", "score", "rank")


_COSINES = """
f AS (SELECT qid, rank, term, CAST(count(*) AS DOUBLE) AS tf FROM (SELECT qid, rank, unnest(regexp_extract_all(lower(text), '[a-z0-9_]+')) AS term FROM h) GROUP BY ALL),
o AS (SELECT qid, rank, sqrt(sum(tf * tf)) AS norm FROM f GROUP BY ALL),
p AS (SELECT a.qid, a.rank AS ra, b.rank AS rb, sum(a.tf * b.tf) / (any_value(x.norm) * any_value(y.norm)) AS cosine FROM f a JOIN f b ON a.qid = b.qid AND a.term = b.term AND a.rank < b.rank
      JOIN o x ON x.qid = a.qid AND x.rank = a.rank JOIN o y ON y.qid = b.qid AND y.rank = b.rank GROUP BY ALL)
"""


@plans.query(f"""
{_HITS}, {_COSINES}, near AS (SELECT qid, ra, rb FROM p WHERE round(cosine, 6) >= 0.85),
g AS (SELECT qid, 1::BIGINT AS rank, [1::BIGINT] AS kept FROM h WHERE rank = 1
      UNION ALL SELECT g.qid, g.rank + 1, CASE WHEN EXISTS (SELECT 1 FROM near n WHERE n.qid = g.qid AND n.rb = g.rank + 1 AND list_contains(g.kept, n.ra)) THEN g.kept ELSE list_append(g.kept, g.rank + 1) END
      FROM g JOIN h ON h.qid = g.qid AND h.rank = g.rank + 1)
SELECT qid, array_to_string(kept, ',') AS kept FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY rank DESC) AS r FROM g) WHERE r = 1
""")
def distinct_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ranks of the hits that stay when each that is too much like one kept before goes."""
    found = stored(hits(spark, sf_dir).select("qid", "rank", "text"), "texts")
    rows = found.select("qid", "rank", F.explode(text.words(F.col("text"))).alias("term"))
    return evidence.greedy_distinct(evidence.cosines(rows, "qid", "rank"), found.select("qid", "rank"), 0.85).select("qid", F.array_join("kept", ",").alias("kept"))


@plans.query(f"""
{_HITS}, o AS (SELECT *, sum(least(length(text), 500) + 2) OVER (PARTITION BY qid ORDER BY n_chars, doc_id ROWS UNBOUNDED PRECEDING) AS used FROM h)
SELECT qid, count(*) AS packed, CAST(max(used) AS BIGINT) AS chars, md5(string_agg(substr(text, 1, 500), chr(10) || chr(10) ORDER BY n_chars, doc_id)) AS digest FROM o WHERE used <= 3000 GROUP BY qid
""")
def packed_in_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Excerpts of the hits in the order of a field, as many as the budget of characters takes."""
    cut = F.substring("text", 1, 500)
    rows = hits(spark, sf_dir).withColumn("cut", cut)
    order = Window.partitionBy("qid").orderBy("n_chars", "doc_id").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("used", F.sum(F.length("cut") + 2).over(order)).where("used <= 3000")
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n_chars", "doc_id", "cut"))), lambda s: s["cut"]), "\n\n")
    return rows.groupBy("qid").agg(F.count("*").alias("packed"), F.max("used").alias("chars"), F.md5(joined).alias("digest"))


@plans.query(f"{_HITS} SELECT qid, source, count(*) AS n, min(rank) AS first_rank, string_agg(CAST(doc_id AS VARCHAR), ',' ORDER BY rank) AS docs FROM h GROUP BY qid, source")
def packed_by_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits grouped by where they come from, in the order of their rank."""
    docs = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "doc_id"))), lambda s: s["doc_id"].cast("string")), ",")
    return hits(spark, sf_dir).groupBy("qid", "source").agg(F.count("*").alias("n"), F.min("rank").cast("long").alias("first_rank"), docs.alias("docs"))


@plans.query(f"""
{_HITS}, w AS (SELECT item_id, list_distinct(regexp_extract_all(lower(text), '[a-z0-9_]+')) AS asked FROM benchmark),
e AS (SELECT qid, rank, len(list_intersect(asked, list_distinct(regexp_extract_all(lower(text), '[a-z0-9_]+')))) AS overlap, len(asked) AS n FROM h JOIN w ON item_id = qid)
SELECT qid, count(CASE WHEN overlap * 2 >= n THEN 1 END) AS evidence, count(CASE WHEN overlap * 2 < n THEN 1 END) AS denials, string_agg(CAST(rank AS VARCHAR), ',' ORDER BY overlap DESC, rank) AS in_order FROM e GROUP BY qid
""")
def packed_by_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits by how many of the asked words they hold, told apart into evidence and denials."""
    asked = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("qid"), F.array_distinct(text.words(F.col("text"))).alias("asked"))
    rows = hits(spark, sf_dir).select("qid", "rank", text.words(F.col("text")).alias("w")).join(asked, "qid")
    rows = rows.select("qid", "rank", F.size("asked").alias("n"), F.size(F.array_intersect("asked", "w")).alias("overlap"))
    order = F.transform(F.array_sort(F.collect_list(F.struct(-F.col("overlap"), "rank"))), lambda s: s["rank"].cast("string"))
    half = F.col("overlap") * 2 >= F.col("n")
    return rows.groupBy("qid").agg(F.count(F.when(half, 1)).alias("evidence"), F.count(F.when(~half, 1)).alias("denials"), F.array_join(order, ",").alias("in_order"))


@plans.query(f"""
{_HITS}, w AS (SELECT item_id, text AS question, list_distinct(list_filter(regexp_extract_all(lower(text), '[a-z0-9_]+'), lambda x: length(x) > 3)) AS asked FROM benchmark),
e AS (SELECT qid, rank, score, question, CASE WHEN len(asked) = 0 THEN {D(0)} ELSE len(list_intersect(asked, list_distinct(regexp_extract_all(lower(text), '[a-z0-9_]+')))) / CAST(len(asked) AS DOUBLE) END AS overlap FROM h JOIN w ON item_id = qid WHERE rank <= 5),
z AS (SELECT qid, any_value(question) AS question, avg(overlap) AS mean, max(CASE WHEN rank = 1 THEN least({D(1)}, score / 10) END) AS top, {D("count(CASE WHEN overlap > 0.5 THEN 1 END)")} / count(*) AS dense FROM e GROUP BY qid),
c AS (SELECT qid, greatest({D(0)}, least({D(1)}, {D(0.35)} * mean + {D(0.2)} * top + {D(0.15)} * 0.5 + {D(0.2)} * dense - {D(0.1)} * CASE WHEN regexp_matches(lower(question), '\\b(ever|never|at any point|at some point)\\b') THEN 1 - mean ELSE 0 END)) AS confidence FROM z)
SELECT qid, round(confidence, 4) AS confidence, confidence < {D(0.2)} AS abstain FROM c
""")
def abstentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How sure the five best hits make an answer, and whether to give none."""
    items = table(spark, sf_dir, "benchmark")
    asked = F.array_distinct(F.filter(text.words(F.col("text")), lambda w: F.length(w) > 3))
    questions = items.select(F.col("item_id").alias("qid"), asked.alias("asked"), text.lowered(F.col("text")).rlike(text.by_ascii(understanding.EVER)).alias("ever"))
    rows = hits(spark, sf_dir).where("rank <= 5").select("qid", "rank", "score", text.words(F.col("text")).alias("w")).join(questions, "qid")
    overlap = F.when(F.size("asked") == 0, 0.0).otherwise(F.size(F.array_intersect("asked", "w")) / F.size("asked"))
    rows = rows.withColumn("overlap", overlap).groupBy("qid", "ever")
    parts = rows.agg(F.avg("overlap").alias("mean"), F.max(F.when(F.col("rank") == 1, F.least(F.lit(1.0), F.col("score") / 10))).alias("top"), (F.count(F.when(F.col("overlap") > 0.5, 1)) / F.count("*")).alias("dense"))
    sure = evidence.confidence(F.col("mean"), F.col("top"), F.lit(0.5), F.col("dense"), F.when(F.col("ever"), 1 - F.col("mean")).otherwise(0.0))
    return parts.select("qid", F.round(sure, 4).alias("confidence"), (sure < 0.2).alias("abstain"))


_TERMS = sql.terms("benchmark", "item_id", "text")


def _ordered(t: str, id_col: str, where: str = "") -> str:
    """SQL of (id, pos, term) with adjacent stemmed terms, for tables of few rows."""
    stem = sql.stem("word")
    return f"SELECT {id_col}, pos, {stem} AS term FROM (SELECT {id_col}, unnest(w) AS word, unnest(range(len(w))) AS pos FROM (SELECT {id_col}, list_filter(regexp_extract_all(lower(text), '[a-z0-9_]+'), lambda x: length(x) > 1 AND x NOT IN ({sql.quoted(text.STOPWORDS)})) AS w FROM {t} {where}))"


@plans.query(f"""
{_HITS}, qd AS (SELECT DISTINCT doc_id, text FROM h), a AS ({_ordered("benchmark", "item_id")}), b AS ({_ordered("qd", "doc_id")}),
x AS (SELECT DISTINCT a.item_id AS qid, a.term AS t1, c.term AS t2 FROM a JOIN a c ON a.item_id = c.item_id AND c.pos = a.pos + 1),
y AS (SELECT DISTINCT b.doc_id, b.term AS t1, c.term AS t2 FROM b JOIN b c ON b.doc_id = c.doc_id AND c.pos = b.pos + 1),
z AS (SELECT qid, doc_id, count(*) AS n FROM x JOIN y USING (t1, t2) GROUP BY ALL)
SELECT h.qid, h.doc_id, round(score * (1 + {D(0.25)} * coalesce(n, 0)), 2) AS score FROM h LEFT JOIN z ON z.qid = h.qid AND z.doc_id = h.doc_id
""")
def bigram_boost(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits scored up by a quarter for each pair of neighbouring terms that they share with the item."""
    found = hits(spark, sf_dir)
    asked = lexical.bigrams(table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("qid"), "text"), "qid", F.col("text"))
    held = lexical.bigrams(found.select("doc_id", "text").distinct(), "doc_id", F.col("text"))
    pairs = asked.join(held, ["t1", "t2"]).groupBy("qid", "doc_id").agg(F.count("*").alias("n"))
    return found.join(pairs, ["qid", "doc_id"], "left").select("qid", "doc_id", F.round(F.col("score") * (1 + 0.25 * F.coalesce("n", F.lit(0))), 2).alias("score"))


@plans.query(f"""
{_HITS}, c AS (SELECT qid, doc_id, score, unnest(list_transform(range(0, greatest(len(s) - 1, 1), 2), lambda i: array_to_string(list_slice(s, i + 1, i + 3), ' '))) AS chunk FROM (SELECT qid, doc_id, score, list_filter(list_transform(regexp_split_to_array(regexp_replace(trim(text), '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)), lambda x: trim(x)), lambda x: x <> '') AS s FROM h WHERE length(text) > 200)),
w AS (SELECT item_id, list_distinct(regexp_extract_all(lower(text), '[a-z0-9_]+')) AS asked FROM benchmark),
b AS (SELECT qid, doc_id, any_value(score) AS score, max(len(list_intersect(asked, list_distinct(regexp_extract_all(lower(chunk), '[a-z0-9_]+')))) / CAST(len(asked) AS DOUBLE)) AS best FROM c JOIN w ON item_id = qid GROUP BY qid, doc_id)
SELECT qid, doc_id, round({D(0.6)} * score * best + {D(0.4)} * score, 4) AS score FROM b
""")
def chunk_blend(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits of long documents scored by their best chunk of three sentences, blended with the whole."""
    asked = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("qid"), F.array_distinct(text.words(F.col("text"))).alias("asked"))
    long = hits(spark, sf_dir).where(F.length("text") > 200).select("qid", "doc_id", "score", text.sentences(F.col("text")).alias("s"))
    starts = F.sequence(F.lit(0), F.greatest(F.size("s") - 2, F.lit(0)), F.lit(2))
    chunks = long.select("qid", "doc_id", "score", F.explode(F.transform(starts, lambda i: F.array_join(F.slice("s", i + 1, F.lit(3)), " "))).alias("chunk"))
    share = F.size(F.array_intersect("asked", text.words(F.col("chunk")))) / F.size("asked")
    best = chunks.join(asked, "qid").groupBy("qid", "doc_id").agg(F.first("score").alias("score"), F.max(share).alias("best"))
    return best.select("qid", "doc_id", F.round(0.6 * F.col("score") * F.col("best") + 0.4 * F.col("score"), 4).alias("score"))


@plans.query(f"""
{_HITS}, x AS (SELECT t.doc_id, t.term, any_value(tf) AS tf FROM t JOIN (SELECT DISTINCT doc_id FROM h) USING (doc_id) GROUP BY ALL), df AS (SELECT term, count(*) AS df FROM t GROUP BY term),
e AS (SELECT h.qid, x.term, count(*) AS docs, any_value(df.df) AS df FROM h JOIN x USING (doc_id) JOIN df USING (term) WHERE h.rank <= 5 AND x.term NOT IN (SELECT term FROM q WHERE q.qid = h.qid) GROUP BY ALL),
f AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY docs DESC, df, term) AS r FROM e WHERE docs >= 2 AND df < 0.3 * (SELECT n FROM n)) WHERE r <= 8),
g AS (SELECT h.qid, h.doc_id, sum(ln(((SELECT n FROM n) - f.df + {D(0.5)}) / (f.df + {D(0.5)}) + 1) * x.tf / (x.tf + {D(1.2)})) AS more FROM h JOIN f ON f.qid = h.qid JOIN x ON x.doc_id = h.doc_id AND x.term = f.term GROUP BY ALL)
SELECT h.qid, h.doc_id, round(score + {D(0.4)} * coalesce(more, 0), 4) AS score FROM h LEFT JOIN g ON g.qid = h.qid AND g.doc_id = h.doc_id
""")
def expansion_rescore(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits rescored by up to eight terms that at least two of the five best share and that are not too common."""
    posts = ranking._posts(spark, sf_dir)
    ranked = stored(ranking.ranked_documents(spark, sf_dir, posts), "ranked")
    n = table(spark, sf_dir, "documents").agg(F.count("*").cast("double").alias("n")).scalar()
    held = stored(posts.join(ranked.select("doc_id").distinct(), "doc_id", "left_semi"), "held")
    df = lexical.document_frequency(posts.join(held.select("term").distinct(), "term", "left_semi"))
    asked = ranking._asked(spark, sf_dir).select("qid", "term").distinct()
    seen = ranked.where("rank <= 5").select("qid", "doc_id").join(held, "doc_id").join(asked, ["qid", "term"], "left_anti")
    found = seen.groupBy("qid", "term").agg(F.count("*").alias("docs")).join(df, "term").where((F.col("docs") >= 2) & (F.col("df") < 0.3 * n))
    order = Window.partitionBy("qid").orderBy(F.col("docs").desc(), "df", "term")
    chosen = found.withColumn("r", F.row_number().over(order)).where("r <= 8")
    rarity = F.log((n - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1)
    more = ranked.select("qid", "doc_id").join(held, "doc_id").join(chosen.select("qid", "term", "df"), ["qid", "term"])
    more = more.groupBy("qid", "doc_id").agg(F.sum(rarity * F.col("tf") / (F.col("tf") + 1.2)).alias("more"))
    return ranked.join(more, ["qid", "doc_id"], "left").select("qid", "doc_id", F.round(F.col("score") + 0.4 * F.coalesce("more", F.lit(0.0)), 4).alias("score"))


@plans.query(f"""
{_HITS}, v AS (SELECT qid, vec_id, row_number() OVER (PARTITION BY qid ORDER BY s DESC, vec_id) AS rank FROM (SELECT i.item_id AS qid, b.vec_id, round(list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 6) AS s FROM benchmark i JOIN embeddings a ON a.vec_id = i.item_id * 20 JOIN embeddings b ON b.vec_id <> a.vec_id)),
u AS (SELECT qid, doc_id, {D(1)} / (60 + rank) AS part, 'lexical' AS arm FROM h UNION ALL SELECT qid, vec_id, {D(0.5)} / (60 + rank), 'vector' FROM v WHERE rank <= 10)
SELECT qid, doc_id, round(score, 8) AS score, arms, rank FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(score, 8) DESC, doc_id DESC) AS rank FROM (SELECT qid, doc_id, sum(part) AS score, string_agg(arm, '+' ORDER BY arm) AS arms FROM u GROUP BY qid, doc_id)) WHERE rank <= 10
""")
def hybrid_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lexical and the vector ranking of each item fused by reciprocal rank; which arms found what; later ids first."""
    from .ranking import knn_cosine

    ranked = ranking.ranked_documents(spark, sf_dir).select("qid", "doc_id", (1.0 / (60 + F.col("rank"))).alias("part"), F.lit("lexical").alias("arm"))
    near = knn_cosine(spark, sf_dir).where(F.col("qid") % 20 == 0).select((F.col("qid") / 20).cast("long").alias("qid"), F.col("vec_id").alias("doc_id"), (0.5 / (60 + F.col("rank"))).alias("part"), F.lit("vector").alias("arm"))
    near = near.join(table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("qid")), "qid", "left_semi")
    fused = ranked.union(near).groupBy("qid", "doc_id").agg(F.round(F.sum("part"), 8).alias("score"), F.array_join(F.array_sort(F.collect_list("arm")), "+").alias("arms"))
    order = Window.partitionBy("qid").orderBy(F.col("score").desc(), F.col("doc_id").desc())
    return fused.withColumn("rank", F.row_number().over(order)).where("rank <= 10")


@plans.query(f"""
{_HITS}, w AS (SELECT item_id, text AS question FROM benchmark)
SELECT qid, doc_id, round(score * CASE lang WHEN 'en' THEN {D(1.2)} ELSE {D(1)} END * CASE WHEN n_chars > 2000 THEN {D(0.9)} ELSE {D(1.1)} END
  * (CASE WHEN contains(lower(text), lower(substr(question, 1, 12))) THEN {D(1.25)} ELSE {D(1)} END) + CASE WHEN doc_id % 10 = 0 THEN {D(0.5)} ELSE {D(0)} END, 4) AS score FROM h JOIN w ON item_id = qid
""")
def boost_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits through a chain of boosts: language, length, the question's opening, and pinned documents."""
    questions = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("qid"), F.lower(F.substring("text", 1, 12)).alias("opening"))
    rows = hits(spark, sf_dir).join(questions, "qid")
    factors = [
        F.when(F.col("lang") == "en", 1.2).otherwise(1.0),
        F.when(F.col("n_chars") > 2000, 0.9).otherwise(1.1),
        F.when(F.contains(F.lower("text"), F.col("opening")), 1.25).otherwise(1.0),
    ]
    return rows.select("qid", "doc_id", F.round(evidence.boosted(F.col("score"), factors) + F.when(F.col("doc_id") % 10 == 0, 0.5).otherwise(0.0), 4).alias("score"))


QUERIES, SQL = plans.queries, plans.sql
