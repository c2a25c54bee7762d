"""Lexical ranking: postings, corpus statistics, field-weighted BM25 and pseudo-relevance feedback.

Everything is grouped and joined by term, many queries in one plan. Postings are aggregated before they meet the
queries, so a term that is in every record costs one row for each record, and the number of query terms decides what
is joined to them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scoring, text
from ..sources.scratch import stored

PART_BYTES = 4 << 20  # of text whose words are counted in a task
PART_ROWS = 250_000  # postings that are scored in a task


def terms(records: DataFrame, id_col: str, text_col: Column, stemmed: bool = True) -> DataFrame:
    """(id, term): a row for each term occurrence."""
    rows = records.select(F.col(id_col), F.explode(text.words(text_col)).alias("word")).where(text.is_term(F.col("word")))
    if not stemmed:
        return rows.select(id_col, F.col("word").alias("term"))
    bases = rows.select(id_col, text.lemma(F.col("word")).alias("base")).withColumn("suffix", text.suffix_of(F.col("base")))
    return bases.select(id_col, text.without_suffix(F.col("base"), F.col("suffix")).alias("term"))


def term_counts(records: DataFrame, id_col: str, text_col: Column) -> DataFrame:
    """(id, term, n): how often a record has a stemmed term.

    Records are dealt to as many parts as their texts need, so that a task's counts do not grow. Words are counted by record
    first and stemmed where they are counted: no word that many records have brings these together in a task.
    """
    parts = (records.agg(F.sum(F.octet_length(text_col))).first()[0] or 0) // PART_BYTES + 1
    dealt = records.select(F.col(id_col), text_col.alias("text")).repartition(parts, id_col)
    rows = dealt.select(F.col(id_col), F.explode(text.words(F.col("text"))).alias("word")).where(text.is_term(F.col("word")))
    bases = rows.groupBy(id_col, "word").agg(F.count("*").alias("n")).select(id_col, "n", text.lemma(F.col("word")).alias("base"))
    stems = bases.withColumn("suffix", text.suffix_of(F.col("base"))).select(id_col, text.without_suffix(F.col("base"), F.col("suffix")).alias("term"), "n")
    return stems.groupBy(id_col, "term").agg(F.sum("n").alias("n"))


def postings(fields: list[tuple[DataFrame, float]], id_col: str) -> DataFrame:
    """(id, term, tf): weighted term frequency over fields given as (term rows, weight); a row stands for n occurrences, if it has n."""
    rows = None
    for part, weight in fields:
        part = part.select(id_col, "term", (weight * F.col("n") if "n" in part.columns else F.lit(float(weight))).cast("double").alias("w"))
        rows = part if rows is None else rows.unionByName(part)
    return rows.groupBy(id_col, "term").agg(F.sum("w").alias("tf"))


def lengths(posts: DataFrame, id_col: str) -> DataFrame:
    return posts.groupBy(id_col).agg(F.sum("tf").alias("length"))


def document_frequency(posts: DataFrame) -> DataFrame:
    return posts.groupBy("term").agg(F.count("*").alias("df"))


def shares(posts: DataFrame, n_records: DataFrame, asked: DataFrame, id_col: str, copies: DataFrame | None = None) -> DataFrame:
    """(id, term, share): what each term of asked (term) adds to the score of each record that has it.

    The postings that are asked for are dealt by record, in as many parts as there are postings to fill, and so are the lengths
    of records: what is joined to terms or grouped by record afterwards moves none of them again. Frequencies are written first,
    so that Spark knows how few they are.
    """
    size = lengths(posts, id_col)
    n = n_records.select("n").scalar()
    wanted = posts.join(asked.select("term").distinct(), "term", "left_semi")
    if copies is None:
        mean, df = posts.agg(F.sum("tf")).scalar() / n, document_frequency(wanted)
    else:
        mean = size.join(copies, id_col).agg(F.sum(F.col("length") * F.col("copies"))).scalar() / n
        df = wanted.join(copies, id_col).groupBy("term").agg(F.sum("copies").alias("df"))
    rare = stored(df.select("term", scoring.idf(n, F.col("df")).alias("rarity")), "rarities")
    parts = posts.count() // PART_ROWS + 1
    hits = posts.join(rare, "term").repartition(parts, id_col).join(size.repartition(parts, id_col), id_col)
    return hits.select(id_col, "term", scoring.bm25(F.col("tf"), F.col("length"), mean, F.col("rarity")).alias("share"))


def bm25_scores(posts: DataFrame, n_records: DataFrame, queries: DataFrame, id_col: str, copies: DataFrame | None = None) -> DataFrame:
    """(qid, id, score) of every record that shares a term with a query.

    queries has (qid, term), a row for each occurrence: a term asked twice counts twice. n_records is one row (n). With copies
    (id, copies) a record of posts stands for so many. Queries multiply the shares where their records are, so no pair of a
    query and a record is moved.
    """
    asked = stored(queries.groupBy("qid", "term").agg(F.count("*").alias("times")), "asked")
    found = shares(posts, n_records, asked, id_col, copies).join(asked, "term")
    return found.groupBy("qid", id_col).agg(F.sum(F.col("share") * F.col("times")).alias("score"))


def top_k(scores: DataFrame, by: str, id_col: str, k: int, score: str = "score") -> DataFrame:
    """The k best of each group, ranked; equal scores in the order of the id."""
    order = Window.partitionBy(by).orderBy(F.col(score).desc(), F.col(id_col).asc())
    return scores.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def ranked_by_class(posts: DataFrame, n_records: DataFrame, queries: DataFrame, id_col: str, k: int, digits: int = 6) -> DataFrame:
    """(qid, id, score, rank): the k best records of each query, as top_k has them of bm25_scores, rounded.

    Records of the same weighted terms have the same scores, and so have queries of the same terms. So one record is scored for
    each class of records and one query for each class of queries, and only the k first of a class, by id, can be among the best.
    """
    terms_of = lambda rows, by, *cols: rows.groupBy(by).agg(F.array_sort(F.collect_list(F.struct(*cols))).alias("terms"))
    kinds = terms_of(posts, id_col, "term", "tf")
    first = kinds.groupBy("terms").agg(F.min(id_col).alias("kind"), F.count("*").alias("copies"))
    kinds = stored(kinds.join(first, "terms").select(id_col, "kind", "copies"), "record-kinds")
    heads = kinds.where(F.col(id_col) == F.col("kind")).select(id_col, "copies")
    ways = terms_of(queries, "qid", "term")
    ways = stored(ways.join(ways.groupBy("terms").agg(F.min("qid").alias("way")), "terms").select("qid", "way"), "query-kinds")
    asked = queries.join(ways.where("qid = way").select("qid"), "qid", "left_semi")
    scores = bm25_scores(stored(posts.join(heads.select(id_col), id_col, "left_semi"), "head-postings"), n_records, asked, id_col, heads)
    best = top_k(scores.withColumn("score", F.round("score", digits)), "qid", id_col, k)
    best = best.select(F.col("qid").alias("way"), F.col(id_col).alias("kind"), "score")
    members = top_k(kinds.withColumn("at", F.lit(0)), "kind", id_col, k, "at").select(id_col, "kind")
    whole = top_k(best.join(members, "kind"), "way", id_col, k).select("way", id_col, "score", "rank")
    return ways.join(whole, "way").select("qid", id_col, "score", "rank")


def feedback_terms(posts: DataFrame, ranked: DataFrame, id_col: str, mu: float = 2000.0, k: int = 5) -> DataFrame:
    """The k terms that speak most for the records a query ranked first: Dirichlet-smoothed relevance model.

    ranked has (qid, id, score). A record's share is its score's share of its query's scores. The postings of ranked records are
    written first, so that only their terms are counted in all.
    """
    whole = posts.agg(F.sum("tf")).scalar()
    held = stored(posts.join(ranked.select(id_col).distinct(), id_col, "left_semi"), "held")
    common = posts.join(held.select("term").distinct(), "term", "left_semi").groupBy("term").agg(F.sum("tf").alias("c_tf")).select("term", (F.col("c_tf") / whole).alias("p_term"))
    weight = F.col("score") / F.sum("score").over(Window.partitionBy("qid"))
    chosen = ranked.withColumn("weight", weight).join(lengths(held, id_col), id_col)
    rows = chosen.join(held, id_col).join(common, "term")
    smoothed = (F.col("tf") + mu * F.col("p_term")) / (F.col("length") + mu)
    model = rows.groupBy("qid", "term").agg(F.round(F.sum(F.col("weight") * smoothed), 9).alias("p"))
    return top_k(model, "qid", "term", k, "p")


def bigrams(records: DataFrame, id_col: str, text_col: Column) -> DataFrame:
    """(id, t1, t2): the distinct pairs of stemmed terms that follow each other once stop words are gone."""
    kept = F.filter(text.words(text_col), text.is_term)
    rows = records.select(id_col, F.posexplode(kept).alias("pos", "word")).withColumn("base", text.lemma(F.col("word")))
    stems = rows.withColumn("suffix", text.suffix_of(F.col("base"))).select(id_col, "pos", text.without_suffix(F.col("base"), F.col("suffix")).alias("term"))
    after = stems.select(id_col, (F.col("pos") - 1).alias("pos"), F.col("term").alias("t2"))
    return stems.join(after, [id_col, "pos"]).select(id_col, F.col("term").alias("t1"), "t2").distinct()
