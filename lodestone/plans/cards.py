"""Queries over records' cards, notes, filters in a row, observations, preferences, representatives and keys."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text, vectors
from ..operators import store
from ..sources.tables import table
from . import evidence
from .registering import Plans

plans = Plans()
D = "CAST({} AS DOUBLE)".format


@plans.query("""
SELECT conv_id, count(*) AS notes, md5(string_agg('- ' || trim(regexp_replace(substr('(' || role || ') ' || text, 1, 120), '^\\([^)]*\\)\\s*', '')), chr(10) ORDER BY turn)) AS digest FROM conversations GROUP BY conv_id
""")
def formatted_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns with a label before them as a list of notes: the label is taken off, each note is a bullet of one head."""
    labelled = F.concat(F.lit("("), "role", F.lit(") "), "text")
    note = F.concat(F.lit("- "), F.trim(text.without_label(F.substring(labelled, 1, 120))))
    rows = table(spark, sf_dir, "conversations").select("conv_id", F.struct("turn", note.alias("note")).alias("s"))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list("s")), lambda s: s["note"]), "\n")
    return rows.groupBy("conv_id").agg(F.count("*").alias("notes"), F.md5(joined).alias("digest"))


@plans.query("""
SELECT doc_id, CAST(len(l) AS BIGINT) AS lines, substr(l[1], 1, 60) AS head, substr(l[len(l)], 1, 60) AS tail, CAST(len(list_filter(l, lambda x: regexp_matches(lower(x), '(error|fail|exception)'))) AS BIGINT) AS failures, CAST(len(list_filter(l, lambda x: regexp_matches(x, '[0-9]+ '))) AS BIGINT) AS tallies
FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents)
""")
def output_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each text by its first and last line, and how many lines tell of failures or counts."""
    rows = table(spark, sf_dir, "documents").select("doc_id", F.split("text", "\n").alias("l"))
    lines = lambda pattern, low=False: F.size(F.filter("l", lambda x: (F.lower(x) if low else x).rlike(pattern))).cast("long")
    head, tail = (F.substring(F.element_at("l", n), 1, 60) for n in (1, -1))
    return rows.select("doc_id", F.size("l").cast("long").alias("lines"), head.alias("head"), tail.alias("tail"), lines("(error|fail|exception)", True).alias("failures"), lines("[0-9]+ ").alias("tallies"))


@plans.query("""
SELECT p_partkey, '["' || p_brand || '"' || ', ' || p_size || ', "' || p_name || ', x"]' AS inline, 3 AS n, p_brand AS first, CAST(p_size AS VARCHAR) AS second, p_name || ', x' AS third FROM part
""")
def inline_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lists written on one line, with quotes where a value has a comma, read again."""
    inline = F.concat(F.lit('["'), "p_brand", F.lit('"'), F.lit(", "), "p_size", F.lit(', "'), "p_name", F.lit(', x"]'))
    rows = table(spark, sf_dir, "part").select("p_partkey", inline.alias("inline")).withColumn("v", text.inline_list(F.col("inline")))
    return rows.select("p_partkey", "inline", F.size("v").alias("n"), *[F.get("v", F.lit(i)).alias(c) for i, c in enumerate(("first", "second", "third"))])


@plans.query("""
SELECT source, count(*) AS blocks, max(doc_id) AS newest, CAST(sum(n_chars) AS BIGINT) AS chars, round(avg(CASE WHEN doc_id < (SELECT max(doc_id) FROM documents) / 2 THEN 1.0 ELSE 0.0 END), 6) AS stale FROM documents GROUP BY source
""")
def index_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What an index over each source holds, and the share of it that is old."""
    docs = table(spark, sf_dir, "documents")
    last = docs.agg(F.max("doc_id")).scalar()
    stale = F.when(F.col("doc_id") < last / 2, 1.0).otherwise(0.0)
    return docs.groupBy("source").agg(F.count("*").alias("blocks"), F.max("doc_id").alias("newest"), F.sum("n_chars").alias("chars"), F.round(F.avg(stale), 6).alias("stale"))


@plans.query(f"""
WITH a AS (SELECT o_orderkey, o_orderstatus, o_orderpriority, o_orderdate, o_totalprice FROM orders WHERE o_orderdate >= TIMESTAMP '1995-06-01' AND o_orderdate < TIMESTAMP '1997-06-01'),
b AS (SELECT * FROM a WHERE o_orderstatus <> 'P'), c AS (SELECT * FROM b WHERE lower(o_orderpriority) = lower('2-high')), d AS (SELECT *, {D(0.5)} * CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END + {D(0.5)} * least(o_totalprice / 300000, 1) AS maturity FROM c)
SELECT o_orderkey, round(maturity, 6) AS maturity, rank FROM (SELECT *, row_number() OVER (ORDER BY o_orderdate DESC, o_orderkey) AS rank FROM d WHERE maturity >= 0.4) WHERE rank <= 100
""")
def filtered_in_turn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders through the filters of a recall, one after the other: dates, lifecycle, an id whatever its case, maturity; the latest hundred."""
    day = lambda d: F.lit(d).cast("timestamp")
    rows = table(spark, sf_dir, "orders").where((F.col("o_orderdate") >= day("1995-06-01")) & (F.col("o_orderdate") < day("1997-06-01")) & (F.col("o_orderstatus") != "P"))
    rows = rows.where(F.lower("o_orderpriority") == "2-high")
    maturity = 0.5 * F.when(F.col("o_orderstatus") == "F", 1).otherwise(0) + 0.5 * F.least(F.col("o_totalprice") / 300000, F.lit(1.0))
    latest = [F.col("o_orderdate").desc(), F.col("o_orderkey")]
    best = rows.withColumn("maturity", maturity).where("maturity >= 0.4").orderBy(*latest).limit(100)
    return best.select("o_orderkey", F.round("maturity", 6).alias("maturity"), F.row_number().over(Window.orderBy(*latest)).alias("rank"))


@plans.query("""
SELECT o_custkey, count(*) AS observations, '[' || string_agg('{"order":' || o_orderkey || ',"status":"' || o_orderstatus || '"}', ',' ORDER BY o_orderkey) || ']' AS facts, count(CASE WHEN o_orderstatus = 'F' THEN 1 END) AS finished FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS r FROM orders) WHERE r <= 5 GROUP BY o_custkey
""")
def entity_observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first five observations of each customer as a JSON array, and what is read out of it again."""
    r = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey"))
    rows = table(spark, sf_dir, "orders").withColumn("r", r).where("r <= 5")
    facts = rows.groupBy("o_custkey").agg(F.to_json(F.array_sort(F.collect_list(F.struct(F.col("o_orderkey").alias("order"), F.col("o_orderstatus").alias("status"))))).alias("facts"))
    back = F.from_json("facts", "array<struct<order:long,status:string>>")
    return facts.select("o_custkey", F.size(back).cast("long").alias("observations"), "facts", F.size(F.filter(back, lambda x: x["status"] == "F")).cast("long").alias("finished"))


@plans.query(f"""
WITH c AS (SELECT o_orderstatus AS domain, o_orderpriority AS strategy, count(*) AS chosen FROM orders GROUP BY 1, 2)
SELECT domain, strategy, chosen, round((chosen + 1) / ({D("sum(chosen) OVER (PARTITION BY domain)")} + count(*) OVER (PARTITION BY domain)), 6) AS preference, row_number() OVER (PARTITION BY domain ORDER BY chosen DESC, strategy) AS rank FROM c
""")
def strategy_preferences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each strategy was chosen in each domain, smoothed, and in what order they are suggested."""
    counts = table(spark, sf_dir, "orders").groupBy(F.col("o_orderstatus").alias("domain"), F.col("o_orderpriority").alias("strategy")).agg(F.count("*").alias("chosen"))
    by = Window.partitionBy("domain")
    share = (F.col("chosen") + 1) / (F.sum("chosen").over(by) + F.count("*").over(by))
    return counts.withColumn("preference", F.round(share, 6)).withColumn("rank", F.row_number().over(by.orderBy(F.col("chosen").desc(), "strategy")))


@plans.query("""
WITH p AS (SELECT user_id, event_type, event_id, lead(event_type) OVER (PARTITION BY user_id ORDER BY event_id) AS next FROM events),
m AS (SELECT event_type, next AS predicted FROM (SELECT event_type, next, row_number() OVER (PARTITION BY event_type ORDER BY count(*) DESC, next) AS r FROM p WHERE next IS NOT NULL AND event_id % 2 = 0 GROUP BY event_type, next) WHERE r = 1)
SELECT event_type, any_value(predicted) AS predicted, count(*) AS tried, round(avg(CASE WHEN next = predicted THEN 1.0 ELSE 0.0 END), 6) AS hit_rate FROM p JOIN m USING (event_type) WHERE next IS NOT NULL AND event_id % 2 = 1 GROUP BY event_type
""")
def prefetch_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What follows each kind most often in one half of the events, and how often that is right in the other."""
    after = F.lead("event_type").over(Window.partitionBy("user_id").orderBy("event_id"))
    rows = table(spark, sf_dir, "events").select("event_type", "event_id", after.alias("next")).where("next IS NOT NULL")
    counts = rows.where("event_id % 2 = 0").groupBy("event_type", "next").agg(F.count("*").alias("n"))
    best = counts.withColumn("r", F.row_number().over(Window.partitionBy("event_type").orderBy(F.col("n").desc(), "next"))).where("r = 1")
    tried = rows.where("event_id % 2 = 1").join(best.select("event_type", F.col("next").alias("predicted")), "event_type")
    right = F.when(F.col("next") == F.col("predicted"), 1.0).otherwise(0.0)
    return tried.groupBy("event_type").agg(F.first("predicted").alias("predicted"), F.count("*").alias("tried"), F.round(F.avg(right), 6).alias("hit_rate"))


@plans.query(f"""
WITH u AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings), a AS (SELECT label, min(vec_id) AS vec_id FROM u GROUP BY label), a1 AS (SELECT u.label, u.vec_id, u.e FROM u JOIN a USING (label, vec_id)),
d AS (SELECT u.label, u.vec_id, u.e, round(1 - list_cosine_similarity(u.e, a1.e), 6) AS d FROM u JOIN a1 USING (label)), b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY d DESC, vec_id) AS r FROM d) WHERE r = 1),
f AS (SELECT d.label, d.vec_id, least(d.d, round(1 - list_cosine_similarity(d.e, b.e), 6)) AS d FROM d JOIN b USING (label)), c AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY d DESC, vec_id) AS r FROM f) WHERE r = 1)
SELECT label, 1 AS place, vec_id FROM a UNION ALL SELECT label, 2, vec_id FROM b UNION ALL SELECT label, 3, vec_id FROM c
""")
def farthest_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three representatives of each label: the first vector, the one farthest from it, and the one farthest from both."""
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "label", F.col("embedding").cast("array<double>").alias("e"))
    chosen = rows.groupBy("label").agg(F.min_by(F.struct("vec_id", "e"), "vec_id").alias("s"))
    out = chosen.select("label", F.lit(1).alias("place"), "s.vec_id")
    left = rows.withColumn("d", F.lit(2.0))
    for place in (2, 3):
        apart = F.round(1 - vectors.cosine(F.col("e"), F.col("s.e")), 6)
        left = left.join(chosen, "label").select("vec_id", "label", "e", F.least("d", apart).alias("d"))
        chosen = left.groupBy("label").agg(F.max_by(F.struct("vec_id", "e"), F.struct("d", -F.col("vec_id"))).alias("s"))
        out = out.union(chosen.select("label", F.lit(place), "s.vec_id"))
    return out


@plans.query("""
SELECT item_id, sha256('recall' || chr(0) || trim(regexp_replace(lower(text), '\\s+', ' ', 'g')) || chr(0) || '10' || chr(0) || 'default') AS cache_key, CAST(length(text) // 4 AS BIGINT) AS tokens, CASE WHEN length(text) // 4 > 50 THEN 'large' ELSE 'small' END AS window FROM benchmark
""")
def cache_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The key under which each item's result would be cached, its tokens and the window it needs."""
    key = store.fingerprint(F.lit("recall"), text.normalised(F.col("text")), F.lit("10"), F.lit("default"))
    tokens = F.floor(F.length("text") / 4)
    return table(spark, sf_dir, "benchmark").select("item_id", key.alias("cache_key"), tokens.alias("tokens"), F.when(tokens > 50, "large").otherwise("small").alias("window"))


@plans.query(f"{evidence._HITS} SELECT qid, count(*) AS hits, 'lexical' AS legs, count(*) < 10 AS degraded, sha256(string_agg(doc_id || ':' || rank, ',' ORDER BY rank)) AS attestation FROM h GROUP BY qid")
def recall_attestations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A digest of what each item's recall gave, with the legs that ran and whether it fell short."""
    listed = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "doc_id"))), lambda s: F.concat_ws(":", s["doc_id"], s["rank"])), ",")
    return evidence.hits(spark, sf_dir).groupBy("qid").agg(F.count("*").alias("hits"), F.lit("lexical").alias("legs"), (F.count("*") < 10).alias("degraded"), F.sha2(listed, 256).alias("attestation"))


_NEIGHBOUR = "n AS (SELECT a AS word, b AS near, count(*) AS n FROM (SELECT p_partkey, unnest(w) AS a, unnest(list_concat(w[2:], [NULL])) AS b FROM (SELECT p_partkey, regexp_extract_all(lower(p_name), '[a-z]{3,}') AS w FROM part)) WHERE b IS NOT NULL AND a <> b GROUP BY 1, 2)"


@plans.query(f"""
WITH {_NEIGHBOUR}, s AS (SELECT word, near, row_number() OVER (PARTITION BY word ORDER BY n DESC, near) AS r FROM n),
q AS (SELECT DISTINCT p_partkey, unnest(regexp_extract_all(lower(p_name), '[a-z]{{3,}}')) AS word FROM part WHERE p_partkey % 20 = 0),
e AS (SELECT DISTINCT q.p_partkey, s.near FROM q JOIN s USING (word) WHERE s.r <= 3), x AS (SELECT e.p_partkey, e.near, row_number() OVER (PARTITION BY e.p_partkey ORDER BY e.near) AS r FROM e LEFT JOIN q ON q.p_partkey = e.p_partkey AND q.word = e.near WHERE q.word IS NULL)
SELECT p_partkey, count(*) AS added, string_agg(near, ' ' ORDER BY near) AS terms FROM x WHERE r <= 8 GROUP BY p_partkey
""")
def related_expansion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names expanded by up to eight words that stand most often after theirs: a table of related words as a parameter."""
    said = F.regexp_extract_all(F.lower("p_name"), F.lit("[a-z]{3,}"), F.lit(0))
    words = table(spark, sf_dir, "part").select("p_partkey", F.posexplode(said).alias("pos", "word"))
    after = words.select("p_partkey", (F.col("pos") - 1).alias("pos"), F.col("word").alias("near"))
    pairs = words.join(after, ["p_partkey", "pos"]).where("word <> near").groupBy("word", "near").agg(F.count("*").alias("n"))
    related = pairs.withColumn("r", F.row_number().over(Window.partitionBy("word").orderBy(F.col("n").desc(), "near"))).where("r <= 3").select("word", "near")
    asked = words.where("p_partkey % 20 = 0").select("p_partkey", "word").distinct()
    return store.expanded_terms(asked, related, "p_partkey", 8)


QUERIES, SQL = plans.queries, plans.sql
