"""Queries over what texts ask, deny, name and are about."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text, understanding
from ..sources.tables import table
from . import sql
from .registering import Plans

plans = Plans()
D = "CAST({} AS DOUBLE)".format


def _list(values) -> str:
    return f"[{sql.quoted(v.replace(chr(39), chr(39) * 2) for v in values)}]"


_WORDS = "list_filter(regexp_split_to_array({}, '\\s+'), lambda x: x <> '')".format
_TURNS = "SELECT conv_id, turn, text, lag(text) OVER (PARTITION BY conv_id ORDER BY turn) AS before FROM conversations"


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns with the text of the turn before; a conversation's turns come together, as few as they are."""
    before = F.lag("text").over(Window.partitionBy("conv_id").orderBy("turn"))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text", before.alias("before"))


@plans.query(f"""
SELECT conv_id, turn, regexp_matches(lower(text), '{understanding.SKEPTICAL}') OR (len(w) <= 5 AND len(list_filter(w, lambda x: length(x) > 4 AND lower(x) NOT IN ({sql.quoted(understanding.BROAD)}))) <= 1) AS skeptical
FROM (SELECT *, {_WORDS("text")} AS w FROM conversations)
""")
def skeptical_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns that invite distractors: superlatives, dates in passing, hardly a specific word."""
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", understanding.is_skeptical(F.col("text")).alias("skeptical"))


_NEGATED = f"""
n AS (SELECT conv_id, turn, text, before, flatten(list_transform({_list(understanding.NEGATIONS)}, lambda n:
        flatten(list_transform(range(1, len(regexp_split_to_array(lower(coalesce(before, '')), concat('\\b', n, '\\b')))), lambda i:
          list_slice({_WORDS("list_reduce(list_slice(regexp_split_to_array(lower(coalesce(before, '')), concat('\\b', n, '\\b')), i + 1, 100000), lambda a, b: a || n || b)")}, 1, 3))))) AS negated
      FROM ({_TURNS}))
"""


@plans.query(f"""
WITH {_NEGATED} SELECT conv_id, turn, array_to_string(negated, ' ') AS negated,
  round(CASE WHEN len(negated) = 0 THEN {D(1)} ELSE {D(1)} - {D(0.3)} * len(list_filter(negated, lambda w: contains(lower(text), w))) / CAST(len(negated) AS DOUBLE) END, 6) AS factor FROM n
""")
def negation_factors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each turn denies, and how much less the next turn counts where it affirms that."""
    rows = turns(spark, sf_dir).withColumn("negated", understanding.negated_words(F.coalesce("before", F.lit(""))))
    return rows.select("conv_id", "turn", F.array_join("negated", " ").alias("negated"), F.round(understanding.negation_factor(F.col("text"), F.col("negated")), 6).alias("factor"))


def _subjects(text_: str) -> str:
    cases = ", ".join(f"CASE WHEN {' OR '.join(f'contains(lower({text_}), {sql.quoted([w])})' for w in words)} THEN '{kind}' END" for kind, words in understanding.SUBJECTS.items())
    return f"list_filter([{cases}], lambda x: x IS NOT NULL)"


@plans.query(f"SELECT doc_id, array_to_string(s, ',') AS subjects, CAST(len(s) AS BIGINT) AS n FROM (SELECT doc_id, {_subjects('text')} AS s FROM documents)")
def subject_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The kinds of subject that each document speaks of."""
    rows = table(spark, sf_dir, "documents").select("doc_id", understanding.subjects(F.col("text")).alias("s"))
    return rows.select("doc_id", F.array_join("s", ",").alias("subjects"), F.size("s").cast("long").alias("n"))


@plans.query(f"""
SELECT conv_id, turn, round(CASE WHEN len(a) = 0 OR len(s) = 0 THEN {D(1)} ELSE {D(1)} + {D(0.15)} * len(list_intersect(a, s)) / CAST(len(a) AS DOUBLE) END, 6) AS factor
FROM (SELECT conv_id, turn, {_subjects('text')} AS s, {_subjects("coalesce(before, '')")} AS a FROM ({_TURNS}))
""")
def subject_factors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How much more a turn counts that speaks of the subjects the turn before asked for."""
    asked, said = understanding.subjects(F.coalesce("before", F.lit(""))), understanding.subjects(F.col("text"))
    return turns(spark, sf_dir).select("conv_id", "turn", F.round(understanding.subject_factor(asked, said), 6).alias("factor"))


@plans.query(f"""
SELECT page_id, array_to_string(list_concat(m, list_filter(flatten(list_transform(y, lambda a: list_transform(m, lambda b: a || '-' || b))), lambda x: x IS NOT NULL)), ' ') AS terms
FROM (SELECT page_id, list_filter([{", ".join(f"CASE WHEN contains(lower(html), '{m}') THEN '{n:02d}' END" for n, m in enumerate(understanding.MONTHS, 1))}], lambda x: x IS NOT NULL) AS m,
        [x FOR x IN list_sort(list_distinct(regexp_extract_all(html, '\\b(20\\d{{2}})\\b', 1)))] AS y FROM pages)
""")
def month_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The terms that the months and years named in a page add."""
    pages = table(spark, sf_dir, "pages")
    years = F.array_join(F.array_sort(F.array_distinct(F.regexp_extract_all("html", F.lit(r"(?<![A-Za-z0-9_])(20\d{2})(?![A-Za-z0-9_])"), F.lit(1)))), " ")
    return pages.select("page_id", F.array_join(understanding.month_terms(F.concat_ws(" ", F.regexp_replace("html", r"(?<![A-Za-z0-9_])20\d{2}(?![A-Za-z0-9_])", ""), years)), " ").alias("terms"))


_SENTENCES = "list_filter(list_transform(regexp_split_to_array(regexp_replace(trim({}), '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)), lambda x: trim(x)), lambda x: x <> '')".format


@plans.query(f"""
SELECT doc_id, CAST(i // 2 AS BIGINT) AS chunk, md5(array_to_string(list_slice(s, i + 1, i + 3), ' ')) AS digest
FROM (SELECT doc_id, s, unnest(range(0, greatest(len(s) - 1, 1), 2)) AS i FROM (SELECT doc_id, {_SENTENCES("text")} AS s FROM documents) WHERE len(s) > 0)
""")
def sentence_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents cut to windows of three sentences that share one with the one before."""
    docs = table(spark, sf_dir, "documents").select("doc_id", text.sentences(F.col("text")).alias("s")).where(F.size("s") > 0)
    starts = F.sequence(F.lit(0), F.greatest(F.size("s") - 2, F.lit(0)), F.lit(2))
    rows = docs.select("doc_id", F.posexplode(F.transform(starts, lambda i: F.slice("s", i + 1, F.lit(3)))).alias("chunk", "c"))
    return rows.select("doc_id", F.col("chunk").cast("long").alias("chunk"), F.md5(F.array_join("c", " ")).alias("digest"))


@plans.query(r"""
SELECT doc_id, array_to_string(list_sort(list_distinct(list_transform(list_concat(regexp_extract_all(text, '"([^"]{3,})"', 1), regexp_extract_all(text, '\b([A-Z][a-z]+(?:\s+[A-Z][a-z]+){1,3})\b', 1)), lambda x: lower(x)))), '|') AS phrases
FROM documents WHERE NOT regexp_matches(text, '[^\x00-\x7F]')
""")
def proper_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quoted phrases and runs of capitalised words in documents of ASCII characters."""
    docs = table(spark, sf_dir, "documents").where(F.octet_length("text") == F.char_length("text"))
    return docs.select("doc_id", F.array_join(text.phrases(F.col("text")), "|").alias("phrases"))


_TF = "SELECT conv_id, turn, term, CAST(count(*) AS DOUBLE) AS tf FROM (SELECT conv_id, turn, unnest(regexp_extract_all(lower(text), '[a-z0-9_]+')) AS term FROM conversations) WHERE length(term) > 1 GROUP BY ALL"


@plans.query(f"""
WITH t AS ({_TF}), n AS (SELECT conv_id, turn, sqrt(sum(tf * tf)) AS norm FROM t GROUP BY ALL),
p AS (SELECT a.conv_id, a.turn, sum(a.tf * b.tf) AS dot FROM t a JOIN t b ON a.conv_id = b.conv_id AND b.turn = a.turn - 1 AND a.term = b.term GROUP BY ALL)
SELECT p.conv_id, p.turn, round(dot / (x.norm * y.norm), 6) AS similarity FROM p JOIN n x ON p.conv_id = x.conv_id AND p.turn = x.turn JOIN n y ON p.conv_id = y.conv_id AND y.turn = p.turn - 1
""")
def turn_cosines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cosine of the term counts of each turn and the turn before, where they share a term."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.explode(text.words(F.col("text"))).alias("term")).where("length(term) > 1")
    tf = rows.groupBy("conv_id", "turn", "term").agg(F.count("*").cast("double").alias("tf"))
    norm = tf.groupBy("conv_id", "turn").agg(F.sqrt(F.sum(F.col("tf") * F.col("tf"))).alias("norm"))
    before = tf.select("conv_id", (F.col("turn") + 1).alias("turn"), "term", F.col("tf").alias("tf_before"))
    dots = tf.join(before, ["conv_id", "turn", "term"]).groupBy("conv_id", "turn").agg(F.sum(F.col("tf") * F.col("tf_before")).alias("dot"))
    earlier = norm.select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("norm").alias("norm_before"))
    both = dots.join(norm, ["conv_id", "turn"]).join(earlier, ["conv_id", "turn"])
    return both.select("conv_id", "turn", F.round(F.col("dot") / (F.col("norm") * F.col("norm_before")), 6).alias("similarity"))


_PROBES = r"list_distinct(list_concat(regexp_extract_all({0}, '[0-9]+(?:\.[0-9]+)?'), regexp_extract_all({0}, '\b[A-Z][a-z]{{2,}}\b')))".format


@plans.query(f"""
SELECT doc_id, CAST(len(p) AS BIGINT) AS n_probes, round(CASE WHEN len(p) = 0 THEN {D(1)} ELSE len(list_filter(p, lambda x: contains(head, x))) / CAST(len(p) AS DOUBLE) END, 6) AS kept
FROM (SELECT doc_id, substr(text, 1, 400) AS head, {_PROBES("text")} AS p FROM documents WHERE NOT regexp_matches(text, '[^\\x00-\\x7F]'))
""")
def summary_retention(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers and names of a document, and the share of them that its head keeps."""
    docs = table(spark, sf_dir, "documents").where(F.octet_length("text") == F.char_length("text"))
    rows = docs.select("doc_id", F.substring("text", 1, 400).alias("head"), text.probes(F.col("text")).alias("p"))
    kept = F.size(F.filter("p", lambda x: F.contains(F.col("head"), x))) / F.size("p")
    return rows.select("doc_id", F.size("p").cast("long").alias("n_probes"), F.round(F.when(F.size("p") == 0, 1.0).otherwise(kept), 6).alias("kept"))


@plans.query("""
SELECT doc_id, md5(trim(regexp_replace(lower(text), '\\s+', ' ', 'g'))) AS digest, count(*) OVER (PARTITION BY md5(trim(regexp_replace(lower(text), '\\s+', ' ', 'g')))) AS copies,
  'out_' || substr(sha256(source || chr(0) || text), 1, 16) AS handle FROM documents
""")
def content_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digest of each document's normalised text, how many documents have it, and a handle for source and text."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text", F.md5(text.normalised(F.col("text"))).alias("digest"))
    copies = docs.groupBy("digest").agg(F.count("*").alias("copies"))
    handle = F.concat(F.lit("out_"), F.substring(F.sha2(F.concat_ws("\0", "source", "text"), 256), 1, 16))
    return docs.join(copies, "digest").select("doc_id", "digest", "copies", handle.alias("handle"))


@plans.query("""
SELECT page_id, array_to_string(list_sort(list_distinct(regexp_extract_all(html, '[0-9]{4}-(?:0[1-9]|1[0-2])-(?:0[1-9]|[12][0-9])'))), ' ') AS dates, CAST(len(regexp_extract_all(html, '<a [^>]*href')) AS BIGINT) AS links FROM pages
""")
def page_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dates written in a page, and how many links it has."""
    dates = F.array_sort(F.array_distinct(F.regexp_extract_all("html", F.lit("[0-9]{4}-(?:0[1-9]|1[0-2])-(?:0[1-9]|[12][0-9])"), F.lit(0))))
    return table(spark, sf_dir, "pages").select("page_id", F.array_join(dates, " ").alias("dates"), F.regexp_count("html", F.lit("<a [^>]*href")).cast("long").alias("links"))


QUERIES, SQL = plans.queries, plans.sql
