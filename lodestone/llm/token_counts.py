"""Token counts from an exact length histogram.

Documents are encoded whole with a public byte-level BPE vocabulary and aggregated by their encoded length. Everything
else comes from the histogram: suffix sums over the lengths give, for each length L as a context limit, how many
documents and tokens are in documents of L tokens or more and how many tokens are left when every document is cut to
L. Between two lengths of the histogram the truncated total is linear, so the table answers every limit exactly.

The suffix sums are taken in two levels (within runs of BLOCK lengths, and over the runs' totals), so that no task
needs the whole histogram. Defined results for odd input: a null or empty text has 0 tokens; special tokens' strings
are ordinary text; an empty table gives an empty histogram; other columns are ignored.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import stored, table

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: how the vocabulary's texts are split before merging.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
BLOCK = 256


def encoding(vocabulary: bytes):
    """The tokenizer of a file of base64 tokens and their ranks."""
    import tiktoken

    ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, vocabulary.splitlines())}
    return tiktoken.Encoding("lodestone", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def n_tokens(text: Column, vocabulary: str = VOCABULARY) -> Column:
    """Encoded length of a text. The file is read on the driver; its bytes travel with the job."""
    with open(vocabulary, "rb") as f:
        data = f.read()

    @F.pandas_udf(T.LongType())
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encode = encoding(data).encode_ordinary
        for texts in batches:
            yield texts.map(lambda t: len(encode(t)) if t else 0).astype("int64")

    return count(text)


def length_histogram(docs: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """(n_tokens, docs): how many documents have each encoded length."""
    return docs.select(n_tokens(F.col("text"), vocabulary).alias("n_tokens")).groupBy("n_tokens").agg(F.count("*").alias("docs"))


def limits(histogram: DataFrame, block: int = BLOCK) -> DataFrame:
    """The histogram with docs_ge, tokens_ge, docs_le, truncated_total (each document cut to n_tokens) and total_tokens."""
    rows = histogram.withColumn("tokens", F.col("docs") * F.col("n_tokens")).withColumn("block", F.floor(F.col("n_tokens") / block))
    blocks = rows.groupBy("block").agg(F.sum("docs").alias("b_docs"), F.sum("tokens").alias("b_tokens"))
    after = Window.orderBy(F.col("block").desc()).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(F.lit(0))
    blocks = blocks.select(
        "block",
        F.coalesce(F.sum("b_docs").over(after), F.lit(0)).alias("docs_after"),
        F.coalesce(F.sum("b_tokens").over(after), F.lit(0)).alias("tokens_after"),
        F.sum("b_docs").over(whole).alias("all_docs"),
        F.sum("b_tokens").over(whole).alias("total_tokens"),
    )
    within = Window.partitionBy("block").orderBy(F.col("n_tokens").desc())
    rows = rows.join(blocks, "block")
    rows = rows.withColumn("docs_ge", F.sum("docs").over(within) + F.col("docs_after")).withColumn("tokens_ge", F.sum("tokens").over(within) + F.col("tokens_after"))
    return rows.select(
        "n_tokens",
        "docs",
        "docs_ge",
        "tokens_ge",
        (F.col("all_docs") - F.col("docs_ge") + F.col("docs")).alias("docs_le"),
        (F.col("total_tokens") - F.col("tokens_ge") + F.col("docs_ge") * F.col("n_tokens")).alias("truncated_total"),
        "total_tokens",
    )


def quantile(table_of_limits: DataFrame, share: float) -> DataFrame:
    """The least length that at least this share of documents does not exceed."""
    least = (F.col("docs_le") / (F.col("docs_le") + F.col("docs_ge") - F.col("docs"))) >= share
    return table_of_limits.where(least).agg(F.min("n_tokens").alias("n_tokens"))


def truncated_total(table_of_limits: DataFrame, limit: int) -> DataFrame:
    """Tokens left when every document is cut to limit: exact for any limit, in the table or not."""
    above = F.col("n_tokens") >= limit
    at = F.min(F.when(above, F.struct("n_tokens", "truncated_total", "docs_ge")))
    cut = at["truncated_total"] - at["docs_ge"] * (at["n_tokens"] - limit)
    return table_of_limits.agg(F.coalesce(cut, F.max("total_tokens"), F.lit(0)).alias("tokens"))


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return limits(stored(length_histogram(table(spark, sf_dir, "documents").select("text")), "lengths"))
