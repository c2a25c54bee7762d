"""Queries over integrity, versions, signals, alerts, exports, votes and what was learned from them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import codes, understanding
from ..sources.scratch import stored
from ..sources.tables import table
from .registering import Plans

plans = Plans()
D = "CAST({} AS DOUBLE)".format

_LINKS = (("orders", "o_custkey", "customer", "c_custkey"), ("lineitem", "l_orderkey", "orders", "o_orderkey"), ("lineitem", "l_partkey", "part", "p_partkey"), ("lineitem", "l_suppkey", "supplier", "s_suppkey"), ("supplier", "s_nationkey", "nation", "n_nationkey"), ("nation", "n_regionkey", "region", "r_regionkey"), ("labels", "doc_id", "documents", "doc_id"))


@plans.query(" UNION ALL ".join(f"SELECT '{a}.{x}' AS link, count(*) AS n, count(CASE WHEN NOT EXISTS (SELECT 1 FROM {b} t WHERE t.{y} = s.{x}) THEN 1 END) AS broken FROM {a} s" for a, x, b, y in _LINKS))
def integrity_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many rows of each table point to nothing."""
    out = None
    for a, x, b, y in _LINKS:
        known = table(spark, sf_dir, b).select(F.col(y).alias("__key")).distinct().withColumn("__known", F.lit(1))
        rows = table(spark, sf_dir, a).select(F.col(x).alias("__own")).join(known, F.col("__own") == F.col("__key"), "left")
        part = rows.agg(F.lit(f"{a}.{x}").alias("link"), F.count("*").alias("n"), F.count(F.when(F.col("__known").isNull(), 1)).alias("broken"))
        out = part if out is None else out.union(part)
    return out


@plans.query("SELECT o_custkey, o_orderkey, version, before, o_totalprice - before_price AS change FROM (SELECT o_custkey, o_orderkey, o_totalprice, row_number() OVER w AS version, lag(o_orderkey) OVER w AS before, lag(o_totalprice) OVER w AS before_price FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey))")
def version_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each customer's orders as versions: number, the one before, and what changed."""
    by = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    rows = table(spark, sf_dir, "orders")
    return rows.select("o_custkey", "o_orderkey", F.row_number().over(by).alias("version"), F.lag("o_orderkey").over(by).alias("before"), (F.col("o_totalprice") - F.lag("o_totalprice").over(by)).alias("change"))


@plans.query("SELECT p_partkey, count(DISTINCT l_orderkey) AS orders, count(DISTINCT o_custkey) AS customers, count(DISTINCT l_suppkey) AS suppliers FROM part LEFT JOIN lineitem ON l_partkey = p_partkey LEFT JOIN orders ON o_orderkey = l_orderkey GROUP BY p_partkey")
def impact_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many orders, customers and suppliers a change of each part would touch."""
    lines = table(spark, sf_dir, "lineitem").select("l_partkey", "l_orderkey", "l_suppkey").join(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    rows = table(spark, sf_dir, "part").join(lines, F.col("p_partkey") == F.col("l_partkey"), "left").groupBy("p_partkey")
    return rows.agg(F.countDistinct("l_orderkey").alias("orders"), F.countDistinct("o_custkey").alias("customers"), F.countDistinct("l_suppkey").alias("suppliers"))


@plans.query("SELECT url_kind, count(*) AS n, min(page_id) AS first_page FROM (SELECT page_id, CASE WHEN regexp_matches(url, '\\.(html?|md|txt)$') THEN 'text' WHEN regexp_matches(url, '\\.(png|jpe?g|gif)$') THEN 'image' WHEN regexp_matches(url, '/$') THEN 'folder' ELSE 'other' END AS url_kind FROM pages) GROUP BY url_kind")
def routed_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages by the kind of file that their address names."""
    kind = F.when(F.col("url").rlike(r"\.(html?|md|txt)$"), "text").when(F.col("url").rlike(r"\.(png|jpe?g|gif)$"), "image").when(F.col("url").rlike("/$"), "folder").otherwise("other")
    return table(spark, sf_dir, "pages").groupBy(kind.alias("url_kind")).agg(F.count("*").alias("n"), F.min("page_id").alias("first_page"))


@plans.query("""
WITH l AS (SELECT doc_id, trim(unnest(string_split(text, chr(10)))) AS line FROM documents),
s AS (SELECT doc_id, CASE WHEN regexp_matches(lower(line), '(license|licence)') THEN 'license' WHEN regexp_matches(lower(line), '(password|secret|token|api_?key)') THEN 'credential' WHEN regexp_matches(line, '[0-9]{3}-[0-9]{4}|@[a-z]+') THEN 'contact' END AS kind, sha256(regexp_replace(lower(line), '\\s+', ' ', 'g')) AS digest FROM l)
SELECT kind, digest, min(doc_id) AS first_doc, count(*) AS times FROM s WHERE kind IS NOT NULL GROUP BY kind, digest
""")
def line_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines that signal something, each normalised line once, with the first document that has it."""
    lines = table(spark, sf_dir, "documents").select("doc_id", F.explode(F.split("text", "\n")).alias("line")).withColumn("line", F.trim("line"))
    low = F.lower("line")
    kind = F.when(low.rlike("(license|licence)"), "license").when(low.rlike("(password|secret|token|api_?key)"), "credential").when(F.col("line").rlike("[0-9]{3}-[0-9]{4}|@[a-z]+"), "contact")
    rows = lines.select("doc_id", kind.alias("kind"), F.sha2(F.regexp_replace(low, r"\s+", " "), 256).alias("digest")).where("kind IS NOT NULL")
    return rows.groupBy("kind", "digest").agg(F.min("doc_id").alias("first_doc"), F.count("*").alias("times"))


@plans.query("""
WITH a AS (SELECT *, CASE WHEN value >= 200 THEN 3 WHEN value >= 100 THEN 2 WHEN value >= 50 THEN 1 ELSE 0 END AS severity FROM events), s AS (SELECT unnest(['log', 'mail', 'page']) AS sink, unnest([1, 2, 3]) AS least)
SELECT sink, event_type, count(*) AS fired, max(event_id) AS last_event FROM a JOIN s ON severity >= least GROUP BY sink, event_type
""")
def fired_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alerts that each sink gets: those of its severity or more."""
    severity = F.when(F.col("value") >= 200, 3).when(F.col("value") >= 100, 2).when(F.col("value") >= 50, 1).otherwise(0)
    sinks = F.slice(F.array(F.lit("log"), F.lit("mail"), F.lit("page")), 1, severity)
    rows = table(spark, sf_dir, "events").select("event_id", "event_type", F.explode(sinks).alias("sink"))
    return rows.groupBy("sink", "event_type").agg(F.count("*").alias("fired"), F.max("event_id").alias("last_event"))


@plans.query("""
SELECT p_partkey, md5('---' || chr(10) || 'id: ' || p_partkey || chr(10) || 'type: ' || p_type || chr(10) || '---' || chr(10) || '# ' || p_name || chr(10)) AS markdown, md5('{"@id":"part:' || p_partkey || '","@type":"Product","name":"' || p_name || '"}') AS jsonld FROM part
""")
def exported_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of parts as Markdown with front matter, and as linked data."""
    markdown = F.format_string("---\nid: %d\ntype: %s\n---\n# %s\n", "p_partkey", "p_type", "p_name")
    linked = F.to_json(F.struct(F.concat(F.lit("part:"), "p_partkey").alias("@id"), F.lit("Product").alias("@type"), F.col("p_name").alias("name")))
    return table(spark, sf_dir, "part").select("p_partkey", F.md5(markdown).alias("markdown"), F.md5(linked).alias("jsonld"))


@plans.query("""
WITH v AS (SELECT event_id, CAST(round(value * 1000) AS BIGINT) AS n FROM events)
SELECT event_id, array_to_string(list_transform(list_filter(range(0, 9), lambda i: i = 0 OR (n >> (7 * CAST(i AS INTEGER))) > 0), lambda i: printf('%02x', ((n >> (7 * CAST(i AS INTEGER))) & 127) + CASE WHEN (n >> (7 * (CAST(i AS INTEGER) + 1))) > 0 THEN 128 ELSE 0 END)), '') AS code, n AS back FROM v
""")
def varint_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values as variable-length bytes of seven bits each, and back."""
    n = F.round(F.col("value") * 1000).cast("long")
    rows = table(spark, sf_dir, "events").select("event_id", codes.uleb128(n).alias("code"))
    return rows.select("event_id", "code", codes.from_uleb128(F.col("code")).alias("back"))


@plans.query("""
SELECT user_id, day, answer, votes, asked, round(votes / CAST(asked AS DOUBLE), 6) AS share, votes * 2 > asked AS accepted FROM (
  SELECT user_id, CAST(CAST(ts AS DATE) AS VARCHAR) AS day, event_type AS answer, count(*) AS votes, CAST(sum(count(*)) OVER (PARTITION BY user_id, CAST(ts AS DATE)) AS BIGINT) AS asked, row_number() OVER (PARTITION BY user_id, CAST(ts AS DATE) ORDER BY count(*) DESC, event_type) AS r FROM events GROUP BY user_id, CAST(ts AS DATE), event_type) WHERE r = 1
""")
def majority_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The answer most of a user's samples of a day agree on, and whether it is more than half."""
    votes = table(spark, sf_dir, "events").groupBy("user_id", F.to_date("ts").cast("string").alias("day"), F.col("event_type").alias("answer")).agg(F.count("*").alias("votes"))
    by = Window.partitionBy("user_id", "day")
    rows = votes.withColumn("asked", F.sum("votes").over(by)).withColumn("r", F.row_number().over(by.orderBy(F.col("votes").desc(), "answer"))).where("r = 1").drop("r")
    return rows.withColumn("share", F.round(F.col("votes") / F.col("asked"), 6)).withColumn("accepted", F.col("votes") * 2 > F.col("asked"))


@plans.query("""
WITH a AS (SELECT o_orderkey, date_diff('day', o_orderdate, (SELECT max(o_orderdate) FROM orders)) AS days FROM orders)
SELECT CASE WHEN days <= 0 THEN 'today' WHEN days <= 7 THEN 'this week' WHEN days <= 31 THEN 'this month' WHEN days <= 365 THEN 'this year' ELSE (days // 365) || ' years ago' END AS age, count(*) AS n, min(o_orderkey) AS first_order FROM a GROUP BY 1
""")
def relative_ages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders by how long ago they were, in words."""
    orders = table(spark, sf_dir, "orders")
    days = F.datediff(orders.agg(F.max("o_orderdate")).scalar(), "o_orderdate")
    age = F.when(days <= 0, "today").when(days <= 7, "this week").when(days <= 31, "this month").when(days <= 365, "this year").otherwise(F.concat(F.floor(days / 365), F.lit(" years ago")))
    return orders.groupBy(age.alias("age")).agg(F.count("*").alias("n"), F.min("o_orderkey").alias("first_order"))


@plans.query(f"""
WITH p AS (SELECT o_custkey, o_orderkey, o_orderstatus, o_orderdate, list_sort(list(DISTINCT l_partkey)) AS parts, list_sort(list(DISTINCT l_suppkey)) AS tools FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY ALL),
c AS (SELECT *, lag(parts) OVER w AS p0, lag(tools) OVER w AS t0, lag(o_orderstatus) OVER w AS s0, lag(o_orderdate) OVER w AS d0 FROM p WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey))
SELECT o_orderkey, round(({D(0.5)} * len(list_intersect(parts, p0)) / len(list_distinct(list_concat(parts, p0))) + {D(0.45)} * len(list_intersect(tools, t0)) / len(list_distinct(list_concat(tools, t0))) + CASE WHEN o_orderstatus = s0 THEN {D(0.3)} ELSE {D(0)} END) * pow({D(0.5)}, date_diff('day', d0, o_orderdate) / {D(30)}), 6) AS similarity FROM c WHERE p0 IS NOT NULL
""")
def trajectory_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How alike each order is to the customer's order before: parts, suppliers, outcome, halved every thirty days."""
    held = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_set("l_partkey").alias("parts"), F.collect_set("l_suppkey").alias("tools"))
    by = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    rows = table(spark, sf_dir, "orders").join(held, F.col("l_orderkey") == F.col("o_orderkey"))
    rows = rows.select("o_orderkey", "o_orderstatus", "o_orderdate", "parts", "tools", *[F.lag(c).over(by).alias(n) for c, n in (("parts", "p0"), ("tools", "t0"), ("o_orderstatus", "s0"), ("o_orderdate", "d0"))]).where("p0 IS NOT NULL")
    alike = lambda a, b: F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b))
    raw = 0.5 * alike("parts", "p0") + 0.45 * alike("tools", "t0") + F.when(F.col("o_orderstatus") == F.col("s0"), 0.3).otherwise(0.0)
    return rows.select("o_orderkey", F.round(raw * F.pow(F.lit(0.5), F.datediff("o_orderdate", "d0") / 30.0), 6).alias("similarity"))


@plans.query("""
WITH e AS (SELECT o_custkey, o_orderstatus, o_orderkey, o_totalprice, row_number() OVER (PARTITION BY o_custkey, o_orderstatus ORDER BY o_orderdate DESC, o_orderkey DESC) AS r FROM orders)
SELECT o_custkey, count(*) AS evidence, count(CASE WHEN r > 1 THEN 1 END) AS superseded, string_agg(CASE WHEN r = 1 THEN o_orderstatus || '=' || o_orderkey END, ';' ORDER BY o_orderstatus) AS truth FROM e GROUP BY o_custkey
""")
def compiled_truths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What holds of each customer: the latest evidence of each kind; older evidence is superseded."""
    r = F.row_number().over(Window.partitionBy("o_custkey", "o_orderstatus").orderBy(F.col("o_orderdate").desc(), F.col("o_orderkey").desc()))
    rows = table(spark, sf_dir, "orders").select("o_custkey", F.when(r == 1, F.concat_ws("=", "o_orderstatus", "o_orderkey")).alias("fact"))
    return rows.groupBy("o_custkey").agg(F.count("*").alias("evidence"), F.count(F.when(F.col("fact").isNull(), 1)).alias("superseded"), F.array_join(F.array_sort(F.collect_list("fact")), ";").alias("truth"))


@plans.query("""
WITH p AS (SELECT user_id, event_id, event_type, value, lead(event_type) OVER w AS next_type, lead(value) OVER w AS next_value FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id))
SELECT event_type AS query, next_type AS refined, count(*) AS tuples, round(avg(next_value - value), 6) AS gain FROM p WHERE next_value > value AND event_type <> next_type GROUP BY 1, 2
""")
def training_tuples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of consecutive queries of which the second did better: what a ranker could learn from."""
    by = Window.partitionBy("user_id").orderBy("event_id")
    rows = table(spark, sf_dir, "events").select(F.col("event_type").alias("query"), "value", F.lead("event_type").over(by).alias("refined"), F.lead("value").over(by).alias("after"))
    better = rows.where((F.col("after") > F.col("value")) & (F.col("query") != F.col("refined")))
    return better.groupBy("query", "refined").agg(F.count("*").alias("tuples"), F.round(F.avg(F.col("after") - F.col("value")), 6).alias("gain"))


@plans.query("""
WITH f AS (SELECT l_partkey, l_suppkey, l_returnflag, min(l_orderkey) AS first_order, count(*) AS told FROM lineitem GROUP BY 1, 2, 3)
SELECT l_returnflag AS status, count(*) AS facts, CAST(sum(told) AS BIGINT) AS told, count(CASE WHEN first_order % 2 = 1 THEN 1 END) AS fresh FROM f GROUP BY 1
""")
def ledger_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts that many agents told, each once, by status, and those that were not known before."""
    facts = table(spark, sf_dir, "lineitem").groupBy("l_partkey", "l_suppkey", "l_returnflag").agg(F.min("l_orderkey").alias("first_order"), F.count("*").alias("told"))
    return facts.groupBy(F.col("l_returnflag").alias("status")).agg(F.count("*").alias("facts"), F.sum("told").alias("told"), F.count(F.when(F.col("first_order") % 2 == 1, 1)).alias("fresh"))


@plans.query("""
WITH a AS (SELECT DISTINCT l_partkey, l_returnflag FROM lineitem WHERE l_shipdate < TIMESTAMP '1996-01-01'), b AS (SELECT l_partkey, l_returnflag, count(*) AS n FROM lineitem WHERE l_shipdate >= TIMESTAMP '1996-01-01' GROUP BY 1, 2)
SELECT b.l_returnflag AS flag, count(*) AS unseen, min(b.l_partkey) AS first_part, CAST(sum(n) AS BIGINT) AS times FROM b LEFT JOIN a ON a.l_partkey = b.l_partkey AND a.l_returnflag = b.l_returnflag WHERE a.l_partkey IS NULL GROUP BY 1
""")
def unseen_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings of a later period that an earlier one did not have, by kind."""
    lines, cut = table(spark, sf_dir, "lineitem"), F.lit("1996-01-01").cast("timestamp")
    earlier = lines.where(F.col("l_shipdate") < cut).select("l_partkey", "l_returnflag").distinct()
    later = lines.where(F.col("l_shipdate") >= cut).groupBy("l_partkey", "l_returnflag").agg(F.count("*").alias("n"))
    fresh = later.join(earlier, ["l_partkey", "l_returnflag"], "left_anti")
    return fresh.groupBy(F.col("l_returnflag").alias("flag")).agg(F.count("*").alias("unseen"), F.min("l_partkey").alias("first_part"), F.sum("n").alias("times"))


@plans.query("SELECT lang AS kind, count(*) AS n, string_agg(head, ' | ' ORDER BY doc_id) FILTER (WHERE r <= 5) AS summary FROM (SELECT lang, doc_id, substr(text, 1, 40) AS head, row_number() OVER (PARTITION BY lang ORDER BY doc_id, text) AS r FROM documents) GROUP BY lang")
def kind_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The heads of each language's five first documents, and how many it has."""
    docs = table(spark, sf_dir, "documents")
    counts = docs.groupBy(F.col("lang").alias("kind")).agg(F.count("*").alias("n"))
    r = F.row_number().over(Window.partitionBy("lang").orderBy("doc_id", "text"))
    heads = docs.select("lang", "doc_id", F.substring("text", 1, 40).alias("head"), r.alias("r")).where("r <= 5")
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("doc_id", "head"))), lambda s: s["head"]), " | ")
    return counts.join(heads.groupBy(F.col("lang").alias("kind")).agg(joined.alias("summary")), "kind")


@plans.query(f"""
WITH s AS (SELECT conv_id, turn, unnest([{", ".join(f"'{k}'" for k in understanding.SUBJECTS)}]) AS subject, unnest([{", ".join("(" + " + ".join(f"CASE WHEN contains(lower(text), '{w}') THEN 1 ELSE 0 END" for w in ws) + f") / {D(len(ws))}" for ws in understanding.SUBJECTS.values())}]) AS share, CASE WHEN role = 'user' THEN {D(1)} ELSE {D(0)} END AS tag, CASE WHEN regexp_matches(text, '[A-Z][a-z]{{2,}}') THEN {D(1)} ELSE {D(0)} END AS entity FROM conversations),
a AS (SELECT *, {D(0.5)} * share + {D(0.3)} * tag + {D(0.2)} * entity AS affinity FROM s)
SELECT subject, count(*) AS turns, round(avg(affinity), 6) AS affinity, round(sum({D(1)} / ({D(1)} + exp(-{D(10)} * (affinity - {D(0.6)})))), 4) AS assigned FROM a WHERE share > 0 GROUP BY subject
""")
def subject_affinities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How near turns are to each subject they touch: words, speaker and names, and what of them is assigned to it."""
    low = F.lower("text")
    share = lambda ws: sum((F.when(F.contains(low, F.lit(w)), 1).otherwise(0) for w in ws), F.lit(0)) / float(len(ws))
    pairs = F.array(*[F.struct(F.lit(k).alias("subject"), share(ws).alias("share")) for k, ws in understanding.SUBJECTS.items()])
    rows = table(spark, sf_dir, "conversations").select(F.when(F.col("role") == "user", 1.0).otherwise(0.0).alias("tag"), F.when(F.col("text").rlike("[A-Z][a-z]{2,}"), 1.0).otherwise(0.0).alias("entity"), F.explode(pairs).alias("s"))
    affinity = 0.5 * F.col("s.share") + 0.3 * F.col("tag") + 0.2 * F.col("entity")
    rows = rows.where("s.share > 0").select("s.subject", affinity.alias("affinity"))
    return rows.groupBy("subject").agg(F.count("*").alias("turns"), F.round(F.avg("affinity"), 6).alias("affinity"), F.round(F.sum(1.0 / (1.0 + F.exp(-10.0 * (F.col("affinity") - 0.6)))), 4).alias("assigned"))


@plans.query("""
WITH w AS (SELECT p_brand, word, count(*) AS n FROM (SELECT p_brand, p_partkey, unnest(list_distinct(regexp_extract_all(lower(p_name || ' ' || p_type), '[a-z]{3,}'))) AS word FROM part) GROUP BY 1, 2),
t AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY n DESC, word) AS r FROM w) WHERE r <= 5),
s AS (SELECT p_partkey, p.p_brand AS own, t.p_brand AS category, count(*) * 2 + CASE WHEN p.p_brand = t.p_brand THEN 1 ELSE 0 END AS score FROM (SELECT p_partkey, p_brand, unnest(list_distinct(regexp_extract_all(lower(p_name || ' ' || p_type), '[a-z]{3,}'))) AS word FROM part) p JOIN t USING (word) GROUP BY 1, 2, 3)
SELECT category, count(*) AS records, CAST(max(score) AS BIGINT) AS best, count(CASE WHEN own = category THEN 1 END) AS own FROM s WHERE score >= 2 GROUP BY category
""")
def distilled_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of each category by the words that are most its own and by its tag, where these score enough."""
    words = F.array_sort(F.array_distinct(F.regexp_extract_all(F.lower(F.concat_ws(" ", "p_name", "p_type")), F.lit("[a-z]{3,}"), F.lit(0))))
    part = table(spark, sf_dir, "part")
    part = part.repartition(part.count() // 200_000 + 1, "p_partkey").select(F.col("p_brand").alias("own"), words.alias("words"))
    # records of the same tag and words score alike, and are counted before categories multiply them
    kinds = stored(part.groupBy("own", "words").agg(F.count("*").alias("copies")), "kinds")
    counts = kinds.select(F.col("own").alias("category"), "copies", F.explode("words").alias("word")).groupBy("category", "word").agg(F.sum("copies").alias("n"))
    top = counts.withColumn("r", F.row_number().over(Window.partitionBy("category").orderBy(F.col("n").desc(), "word"))).where("r <= 5").select("category", "word")
    dealt = kinds.repartition(kinds.count() // 20_000 + 1, "own", "words").select("own", "words", "copies", F.explode("words").alias("word"))
    own = F.col("own") == F.col("category")
    scores = dealt.join(top, "word").groupBy("own", "words", "copies", "category").agg((F.count("*") * 2).alias("n")).withColumn("score", F.col("n") + F.when(own, 1).otherwise(0))
    return scores.where("score >= 2").groupBy("category").agg(F.sum("copies").alias("records"), F.max("score").alias("best"), F.sum(F.when(own, F.col("copies")).otherwise(0)).alias("own"))


@plans.query("""
WITH h AS (SELECT regexp_extract(url, '^https?://([^/]+)', 1) AS host, html FROM pages)
SELECT host, count(*) AS pages, count(CASE WHEN contains(html, '<h1') THEN 1 END) AS with_heading, count(CASE WHEN contains(html, '<nav') THEN 1 END) AS with_navigation, count(CASE WHEN contains(html, '<table') THEN 1 END) AS with_table FROM h GROUP BY host
""")
def page_conventions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the pages of each host have in common."""
    has = lambda mark: F.count(F.when(F.contains("html", F.lit(mark)), 1))
    rows = table(spark, sf_dir, "pages").groupBy(F.regexp_extract("url", "^https?://([^/]+)", 1).alias("host"))
    return rows.agg(F.count("*").alias("pages"), has("<h1").alias("with_heading"), has("<nav").alias("with_navigation"), has("<table").alias("with_table"))


QUERIES, SQL = plans.queries, plans.sql
