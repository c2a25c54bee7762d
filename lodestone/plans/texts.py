"""Queries over texts as sources: blocks, bundles, time references, parts of questions, chunks, digests, messages, queues."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import extensions
from ..functions import text, understanding
from ..sources import blocks, bundle
from ..sources.scratch import scratch_path
from ..sources.tables import table
from .registering import Plans

plans = Plans()
D = "CAST({} AS DOUBLE)".format


def order_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders written as text blocks, a file for each customer."""
    body = F.format_string("[O-%d]\nStatus: %s\nDate: %s\nItems:\n- priority %s\n- seen\n", "o_orderkey", "o_orderstatus", F.date_format("o_orderdate", "yyyy-MM-dd"), "o_orderpriority")
    rows = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", body.alias("body"))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("o_orderkey", "body"))), lambda s: s["body"]), "\n")
    return rows.groupBy(F.col("o_custkey").cast("string").alias("path")).agg(joined.alias("content"))


@plans.query("""
SELECT CAST(o_custkey AS VARCHAR) AS path, 'O-' || o_orderkey AS block_id, 1 + 7 * (row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1) AS line, o_orderstatus AS status, strftime(o_orderdate, '%Y-%m-%d') AS date, 'priority ' || o_orderpriority || chr(10) || 'seen' AS items FROM orders
""")
def parsed_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders that were written as text blocks, parsed back."""
    found = blocks.parse_blocks(order_files(spark, sf_dir))
    return found.select("path", "block_id", F.col("line").cast("long").alias("line"), *[F.col("fields")[c].alias(c.lower()) for c in ("Status", "Date", "Items")])


@plans.query("SELECT o_orderstatus AS status, count(*) AS n, round(sum(o_totalprice), 2) AS total, true AS whole FROM orders GROUP BY o_orderstatus")
def bundle_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders written as a bundle with a manifest, as JSON lines as well, and read back from both."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    at, lines = scratch_path(spark, "bundle"), scratch_path(spark, "lines")
    bundle.write_bundle(orders, at, "orders")
    bundle.write_jsonl(orders, lines)
    back = bundle.read_bundle(spark, at)
    again = spark.read.schema(orders.schema).json(lines)
    same = bundle.fingerprint(back) == bundle.fingerprint(again)
    return again.groupBy(F.col("o_orderstatus").alias("status")).agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"), F.lit(same).alias("whole"))


#: Questions by number, and the days they mean as SQL over ref, the day of the question, and o, the order.
_TIMES = (
    ("'what changed yesterday'", "ref - 1", "ref - 1"),
    ("'orders of the last ' || (o % 30 + 1) || ' days'", "ref - CAST(o % 30 + 1 AS INTEGER)", "ref"),
    ("'seen ' || (o % 20 + 1) || ' weeks ago'", "ref - CAST(7 * (o % 20 + 1) + 3 AS INTEGER)", "ref - CAST(7 * (o % 20 + 1) - 3 AS INTEGER)"),
    ("'last month'", "CAST(date_trunc('month', ref) - INTERVAL 1 MONTH AS DATE)", "CAST(date_trunc('month', ref) AS DATE) - 1"),
    ("'this week'", "CAST(date_trunc('week', ref) AS DATE)", "ref"),
    ("'before ' || d", "NULL", "ref"),
    ("'after ' || d", "ref", "NULL"),
    ("'in ' || y", "CAST(date_trunc('year', ref) AS DATE)", "CAST(date_trunc('year', ref) + INTERVAL 1 YEAR AS DATE) - 1"),
    ("'whenever'", "NULL", "NULL"),
    ("'due today'", "ref", "ref"),
    ("(o % 9) || ' days ago'", "ref - CAST(o % 9 AS INTEGER)", "ref - CAST(o % 9 AS INTEGER)"),
    ("(o % 5 + 1) || ' months ago'", "CAST(date_trunc('month', ref - CAST(30 * (o % 5 + 1) AS INTEGER)) AS DATE)", "last_day(ref - CAST(30 * (o % 5 + 1) AS INTEGER))"),
    ("'Last  Week'", "CAST(date_trunc('week', ref) AS DATE) - 7", "CAST(date_trunc('week', ref) AS DATE) - 1"),
    ("'this month'", "CAST(date_trunc('month', ref) AS DATE)", "ref"),
    ("'last year'", "CAST(date_trunc('year', ref) - INTERVAL 1 YEAR AS DATE)", "CAST(date_trunc('year', ref) AS DATE) - 1"),
    ("'this year'", "CAST(date_trunc('year', ref) AS DATE)", "ref"),
    ("'before March ' || (o % 28 + 1) || ', ' || y", "NULL", "make_date(year(ref), 3, CAST(o % 28 + 1 AS BIGINT))"),
    ("'after june ' || (o % 28 + 1) || ' ' || y", "make_date(year(ref), 6, CAST(o % 28 + 1 AS BIGINT))", "NULL"),
    ("'after february 30, ' || y || ' in may ' || y", "make_date(year(ref), 5, 1)", "make_date(year(ref), 5, 31)"),
    ("'sold in february'", "make_date(year(ref), 2, 1)", "last_day(make_date(year(ref), 2, 1))"),
    ("'sold in december ' || y", "make_date(year(ref), 12, 1)", "make_date(year(ref), 12, 31)"),
    ("'in 3000'", "NULL", "NULL"),
)


def _nth(column: int) -> str:
    return "CASE o % 22 " + " ".join(f"WHEN {n} THEN {rule[column]}" for n, rule in enumerate(_TIMES)) + " END"


@plans.query(f"""
SELECT o AS o_orderkey, CAST({_nth(1)} AS VARCHAR) AS first_day, CAST({_nth(2)} AS VARCHAR) AS last_day FROM (SELECT o_orderkey AS o, CAST(o_orderdate AS DATE) AS ref FROM orders)
""")
def time_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The days that questions speak of, each asked on its order's date."""
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("o"), F.to_date("o_orderdate").alias("ref"))
    rows = rows.withColumn("d", F.date_format("ref", "yyyy-MM-dd")).withColumn("y", F.date_format("ref", "yyyy")).withColumn("q", F.expr(_nth(0)))
    first, last = understanding.time_reference(F.col("q"), F.col("ref"))
    return rows.select(F.col("o").alias("o_orderkey"), first.cast("string").alias("first_day"), last.cast("string").alias("last_day"))


@plans.query("""
WITH t AS (SELECT conv_id, turn, array_to_string(list_slice(string_split(text, ' '), 1, 4), ' ') AS a, array_to_string(list_slice(string_split(text, ' '), 5, 7), ' ') AS b, CASE turn % 3 WHEN 0 THEN ' because ' WHEN 1 THEN ' and then ' ELSE ' ' END AS link FROM conversations WHERE len(string_split(text, ' ')) >= 7)
SELECT conv_id, turn, CAST(CASE WHEN link = ' ' THEN 1 ELSE 3 END AS BIGINT) AS n, a || link || b || CASE WHEN link = ' ' THEN '' ELSE '|' || trim(a, ' ?.!,;') || '|' || trim(b, ' ?.!,;') END AS parts FROM t
WHERE NOT regexp_matches(lower(a || ' ' || b), '\\b(and|but|since|until|before|after|then|once|vs|though|although|because)\\b') AND NOT regexp_matches(a || b, '[\\n\\t]') AND lower(a) <> lower(b)
""")
def question_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions joined by a connective, taken apart again; the whole question comes first."""
    w = F.split("text", " ")
    link = F.when(F.col("turn") % 3 == 0, " because ").when(F.col("turn") % 3 == 1, " and then ").otherwise(" ")
    rows = table(spark, sf_dir, "conversations").where(F.size(w) >= 7).select("conv_id", "turn", F.array_join(F.slice(w, 1, 4), " ").alias("a"), F.array_join(F.slice(w, 5, 3), " ").alias("b"), link.alias("link"))
    clean = ~F.lower(F.concat_ws(" ", "a", "b")).rlike(text.by_ascii(r"\b(and|but|since|until|before|after|then|once|vs|though|although|because)\b")) & ~F.concat("a", "b").rlike(r"[\n\t]") & (F.lower("a") != F.lower("b"))
    parts = understanding.question_parts(F.concat("a", "link", "b"))
    return rows.where(clean).select("conv_id", "turn", F.size(parts).cast("long").alias("n"), F.array_join(parts, "|").alias("parts"))


@plans.query("""
SELECT doc_id, CAST(i AS BIGINT) AS part, length(p) AS chars, md5(p) AS digest FROM (SELECT doc_id, unnest(ps) AS p, unnest(range(len(ps))) AS i FROM (SELECT doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)), lambda x: x <> '') AS ps FROM documents))
""")
def paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents cut where their structure does: at line breaks, empty parts left out."""
    parts = F.filter(F.transform(F.split("text", "\n"), lambda p: text.trimmed(p)), lambda p: p != "")
    rows = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(parts).alias("i", "p"))
    return rows.select("doc_id", F.col("i").cast("long").alias("part"), F.length("p").cast("long").alias("chars"), F.md5("p").alias("digest"))


@plans.query("""
SELECT conv_id, count(*) AS turns, CAST(sum(length(text)) AS BIGINT) AS chars, count(DISTINCT role) AS roles, string_agg(substr(text, 1, 20), ' / ' ORDER BY turn) AS heads, CAST(sum(len(regexp_extract_all(text, '[0-9]+'))) AS BIGINT) AS numbers FROM conversations GROUP BY conv_id
""")
def conversation_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each conversation by its turns' heads and what they hold; a conversation's turns are few."""
    heads = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", F.substring("text", 1, 20).alias("h")))), lambda s: s["h"]), " / ")
    return table(spark, sf_dir, "conversations").groupBy("conv_id").agg(
        F.count("*").alias("turns"), F.sum(F.length("text")).alias("chars"), F.countDistinct("role").alias("roles"), heads.alias("heads"), F.sum(F.regexp_count("text", F.lit("[0-9]+"))).alias("numbers")
    )


@plans.query("SELECT source, bit_xor(CAST('0x' || substr(sha256(text), 1, 15) AS BIGINT)) AS digest, count(*) AS n FROM documents GROUP BY source")
def cluster_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A digest of each source's texts that their order does not change."""
    seal = F.conv(F.substring(F.sha2("text", 256), 1, 15), 16, 10).cast("long")
    return table(spark, sf_dir, "documents").groupBy("source").agg(F.bit_xor(seal).alias("digest"), F.count("*").alias("n"))


@plans.query("""
SELECT conv_id, turn, role, rank FROM (SELECT conv_id, turn, role, row_number() OVER (PARTITION BY role ORDER BY conv_id DESC, turn DESC) AS rank FROM conversations WHERE conv_id >= 20 AND length(text) > 10) WHERE rank <= 20
""")
def inbox(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The twenty newest messages to each role since a point."""
    rows = table(spark, sf_dir, "conversations").where((F.col("conv_id") >= 20) & (F.length("text") > 10))
    order = Window.partitionBy("role").orderBy(F.col("conv_id").desc(), F.col("turn").desc())
    return rows.select("conv_id", "turn", "role", F.row_number().over(order).alias("rank")).where("rank <= 20")


_MEDIA = "CASE page_id % 3 WHEN 0 THEN 'image' WHEN 1 THEN 'audio' ELSE 'text' END"


@plans.query(f"SELECT {_MEDIA} AS kind, count(*) AS n, CAST(sum(CASE page_id % 3 WHEN 0 THEN 85 + 170 * ceil(length(html) / {D(4096)}) WHEN 1 THEN ceil(length(html) / {D(16)}) ELSE ceil(length(html) / {D(4)}) END) AS BIGINT) AS tokens, min(sha256(html)) AS first_hash FROM pages GROUP BY 1")
def media_costs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What pages would cost as images, sound or text."""
    of, size = F.col("page_id") % 3, F.length("html")
    kind = F.when(of == 0, "image").when(of == 1, "audio").otherwise("text")
    cost = F.when(of == 0, 85 + 170 * F.ceil(size / 4096)).when(of == 1, F.ceil(size / 16)).otherwise(F.ceil(size / 4))
    return table(spark, sf_dir, "pages").groupBy(kind.alias("kind")).agg(F.count("*").alias("n"), F.sum(cost).alias("tokens"), F.min(F.sha2("html", 256)).alias("first_hash"))


@plans.query("""
WITH t AS (SELECT doc_id, source, lang, n_chars, length(text) AS actual FROM documents), e AS (SELECT doc_id, unnest([CASE WHEN source IS NULL THEN 'source missing' END, CASE WHEN lang NOT IN ('en', 'de', 'fr', 'es') THEN 'lang not allowed' END, CASE WHEN n_chars <> actual THEN 'n_chars wrong' END, CASE WHEN actual < 100 AND lang = 'en' THEN 'too short for its kind' END]) AS error FROM t)
SELECT error, count(*) AS n, min(doc_id) AS first_id FROM e WHERE error IS NOT NULL GROUP BY error
""")
def ontology_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What breaks the rules of its kind: what each document needs, may have, and what its language adds to that."""
    size = F.char_length("text")
    checks = [("source missing", F.col("source").isNull()), ("lang not allowed", ~F.col("lang").isin("en", "de", "fr", "es")), ("n_chars wrong", F.col("n_chars") != size), ("too short for its kind", (size < 100) & (F.col("lang") == "en"))]
    rows = table(spark, sf_dir, "documents").select("doc_id", F.explode(F.array(*[F.when(c, name) for name, c in checks])).alias("error"))
    return rows.where("error IS NOT NULL").groupBy("error").agg(F.count("*").alias("n"), F.min("doc_id").alias("first_id"))


@plans.query("""
WITH d AS (SELECT md5(trim(regexp_replace(lower(text), '\\s+', ' ', 'g'))) AS same, doc_id, text, source, lang FROM documents),
r AS (SELECT *, row_number() OVER (PARTITION BY same ORDER BY length(text) DESC, doc_id) AS r FROM d)
SELECT max(CASE WHEN r = 1 THEN doc_id END) AS kept, count(*) AS merged, array_to_string(list_sort(list(DISTINCT source)), ',') AS tags FROM r GROUP BY same HAVING count(*) > 1
""")
def merged_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of the same normalised text as one: the longest is kept, with the sources of all."""
    docs = table(spark, sf_dir, "documents").select(F.md5(text.normalised(F.col("text"))).alias("same"), "doc_id", F.length("text").alias("n"), "source")
    out = docs.groupBy("same").agg(F.min(F.struct(-F.col("n"), "doc_id")).alias("best"), F.count("*").alias("merged"), F.array_join(F.array_sort(F.collect_set("source")), ",").alias("tags"))
    return out.where("merged > 1").select(F.col("best.doc_id").alias("kept"), "merged", "tags")


@plans.query(f"""
WITH u AS (SELECT user_id, max(ts) AS seen, count(*) AS n, min(ts) AS born, avg(value) AS mean FROM events GROUP BY user_id),
s AS (SELECT user_id, date_diff('second', seen, (SELECT max(ts) FROM events)) / {D(86400)} AS idle, date_diff('second', born, (SELECT max(ts) FROM events)) / {D(86400)} AS age, mean, n FROM u)
SELECT user_id, round(idle, 6) AS lru, round(age, 6) AS by_age, round(1 / (1 + mean), 6) AS low_surprise, round(0.5 * idle / 30 + 0.3 * age / 30 + 0.2 / (1 + mean), 6) AS composite FROM s
""")
def eviction_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How ripe each user is for eviction by the registered policies."""
    events = table(spark, sf_dir, "events")
    last = events.agg(F.max(F.unix_timestamp("ts"))).scalar()
    rows = events.groupBy("user_id").agg(F.max(F.unix_timestamp("ts")).alias("seen"), F.min(F.unix_timestamp("ts")).alias("born"), F.avg("value").alias("mean"))
    rows = rows.select("user_id", ((last - F.col("seen")) / 86400.0).alias("idle"), ((last - F.col("born")) / 86400.0).alias("age"), "mean")
    return rows.select("user_id", *[F.round(extensions.get("eviction", name)(), 6).alias(name) for name in ("lru", "by_age", "low_surprise", "composite")])


extensions.register("eviction", "lru", lambda: F.col("idle"))
extensions.register("eviction", "by_age", lambda: F.col("age"))
extensions.register("eviction", "low_surprise", lambda: 1 / (1 + F.col("mean")))
extensions.register("eviction", "composite", lambda: 0.5 * F.col("idle") / 30 + 0.3 * F.col("age") / 30 + 0.2 / (1 + F.col("mean")))


@plans.query("""
WITH e AS (SELECT user_id, event_id, length(props) + 100 AS bytes, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS newest, sum(length(props) + 100) OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC ROWS UNBOUNDED PRECEDING) AS held FROM events)
SELECT user_id, count(*) AS rows_all, count(CASE WHEN newest <= 50 AND held <= 4000 THEN 1 END) AS rows_kept, CAST(max(CASE WHEN newest <= 50 AND held <= 4000 THEN held END) AS BIGINT) AS bytes_kept FROM e GROUP BY user_id
""")
def capped_outputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What stays of each user's outputs under a cap of rows and one of bytes: the oldest go first."""
    order = Window.partitionBy("user_id").orderBy(F.col("ts").desc(), F.col("event_id").desc())
    held = F.sum(F.length("props") + 100).over(order.rowsBetween(Window.unboundedPreceding, 0))
    rows = table(spark, sf_dir, "events").select("user_id", F.row_number().over(order).alias("newest"), held.alias("held"))
    kept = (F.col("newest") <= 50) & (F.col("held") <= 4000)
    return rows.groupBy("user_id").agg(F.count("*").alias("rows_all"), F.count(F.when(kept, 1)).alias("rows_kept"), F.max(F.when(kept, F.col("held"))).alias("bytes_kept"))


@plans.query("""
SELECT event_type, CAST(day AS VARCHAR) AS day, (r - 1) // 64 AS batch, count(*) AS n, min(event_id) AS first_id FROM (SELECT event_type, event_id, CAST(ts AS DATE) AS day, row_number() OVER (PARTITION BY event_type, CAST(ts AS DATE) ORDER BY event_id) AS r FROM events) GROUP BY ALL
""")
def micro_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events drained in batches of sixty-four at most, by kind and day, in order."""
    day = F.to_date("ts")
    order = F.row_number().over(Window.partitionBy("event_type", "day").orderBy("event_id"))
    rows = table(spark, sf_dir, "events").select("event_type", "event_id", day.alias("day")).withColumn("batch", F.floor((order - 1) / 64))
    return rows.groupBy("event_type", F.col("day").cast("string").alias("day"), "batch").agg(F.count("*").alias("n"), F.min("event_id").alias("first_id"))


@plans.query("""
WITH h AS (SELECT event_type, date_trunc('hour', ts) AS hour, count(*) AS n FROM events GROUP BY 1, 2)
SELECT event_type AS subscriber, CAST(sum(n) AS BIGINT) AS published, CAST(sum(least(n, 3)) AS BIGINT) AS delivered, CAST(sum(greatest(n - 3, 0)) AS BIGINT) AS dropped FROM h GROUP BY event_type
""")
def change_stream_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each subscriber was sent, got and lost, when it takes three events an hour at most and the oldest are dropped."""
    hours = table(spark, sf_dir, "events").groupBy("event_type", F.date_trunc("hour", "ts").alias("hour")).agg(F.count("*").alias("n"))
    return hours.groupBy(F.col("event_type").alias("subscriber")).agg(F.sum("n").alias("published"), F.sum(F.least("n", F.lit(3))).alias("delivered"), F.sum(F.greatest(F.col("n") - 3, F.lit(0))).alias("dropped"))


@plans.query("""
SELECT user_id, count(*) AS accesses, CAST(max(event_id) AS BIGINT) AS last_event, array_to_string(list_slice(list(event_type ORDER BY n DESC, event_type), 1, 3), ',') AS keywords FROM (SELECT user_id, event_type, count(*) AS n, max(event_id) AS event_id FROM events GROUP BY 1, 2) GROUP BY user_id
""")
def access_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's kinds of access: how many, the last one, and the three most frequent."""
    kinds = table(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.count("*").alias("n"), F.max("event_id").alias("event_id"))
    top = F.transform(F.slice(F.array_sort(F.collect_list(F.struct(-F.col("n"), "event_type"))), 1, 3), lambda s: s["event_type"])
    return kinds.groupBy("user_id").agg(F.count("*").alias("accesses"), F.max("event_id").alias("last_event"), F.array_join(top, ",").alias("keywords"))


@plans.query("""
WITH t AS (SELECT user_id, date_diff('hour', max(ts), (SELECT max(ts) FROM events)) AS idle FROM events GROUP BY user_id)
SELECT CASE WHEN idle <= 24 THEN 'hot' WHEN idle <= 720 THEN 'warm' ELSE 'cold' END AS tier, count(*) AS n, max(idle) AS longest FROM t GROUP BY 1
""")
def recall_tiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users that are hot, warm or cold by the hours since their last event."""
    events = table(spark, sf_dir, "events")
    hour = lambda c: F.floor(F.unix_timestamp(c) / 3600)
    last = events.agg(F.max(hour("ts"))).scalar()
    rows = events.groupBy("user_id").agg((last - F.max(hour("ts"))).alias("idle"))
    tier = F.when(F.col("idle") <= 24, "hot").when(F.col("idle") <= 720, "warm").otherwise("cold")
    return rows.groupBy(tier.alias("tier")).agg(F.count("*").alias("n"), F.max("idle").alias("longest"))


@plans.query("SELECT lang, doc_id, rank FROM (SELECT lang, doc_id, row_number() OVER (PARTITION BY lang ORDER BY md5('7:' || doc_id), doc_id) AS rank FROM documents) WHERE rank <= 25")
def stratified_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Twenty-five documents of each language, drawn by a seeded hash."""
    order = Window.partitionBy("lang").orderBy(F.md5(F.concat(F.lit("7:"), "doc_id")), "doc_id")
    return table(spark, sf_dir, "documents").select("lang", "doc_id", F.row_number().over(order).alias("rank")).where("rank <= 25")


@plans.query("SELECT conv_id, turn // 2 AS session, count(*) AS turns, md5(string_agg(role || ': ' || text, chr(10) ORDER BY turn)) AS digest FROM conversations GROUP BY 1, 2")
def session_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns of a session as one document."""
    said = F.transform(F.array_sort(F.collect_list(F.struct("turn", F.concat_ws(": ", "role", "text").alias("said")))), lambda s: s["said"])
    rows = table(spark, sf_dir, "conversations").groupBy("conv_id", F.floor(F.col("turn") / 2).alias("session"))
    return rows.agg(F.count("*").alias("turns"), F.md5(F.array_join(said, "\n")).alias("digest"))


@plans.query("""
WITH v AS (SELECT o_custkey, o_orderkey, o_totalprice, o_orderdate, lag(o_totalprice) OVER w AS before, lag(o_orderdate) OVER w AS then_ FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)),
s AS (SELECT o_custkey, o_orderkey, least(o_totalprice, before) / greatest(o_totalprice, before) AS similarity, date_diff('day', then_, o_orderdate) AS days FROM v WHERE before IS NOT NULL)
SELECT o_custkey, o_orderkey, round(CAST(least(CASE WHEN similarity > 0.85 THEN 0.3 WHEN similarity > 0.6 THEN 0.8 WHEN similarity > 0.4 THEN 0.5 ELSE 0.2 END + CASE WHEN days < 30 THEN 0.1 ELSE 0 END, 1) AS DOUBLE), 4) AS confidence FROM s
""")
def belief_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How surely each order drifts from the customer's order before: most where they are alike but not the same, and recent."""
    by = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    rows = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_totalprice", "o_orderdate", F.lag("o_totalprice").over(by).alias("before"), F.lag("o_orderdate").over(by).alias("then_")).where("before IS NOT NULL")
    similarity = F.least("o_totalprice", "before") / F.greatest("o_totalprice", "before")
    return rows.select("o_custkey", "o_orderkey", F.round(understanding.drift_confidence(similarity, F.datediff("o_orderdate", "then_")), 4).alias("confidence"))


QUERIES, SQL = plans.queries, plans.sql
