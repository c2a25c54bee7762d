"""The corpus pipeline: training-data stages applied one after the other to the documents table.

Defined results for odd input: each stage treats nulls, empty and very long texts, ties, repeated rows, empty tables and
clashing names as its module says; further columns of documents are carried through all stages, but for those named
like what the mix adds; of an empty table nothing is left. Without labels of both kinds every document scores alike.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lodestone.llm import decontaminate, line_dedup, minhash_dedup, quality_classifier, source_mix
from lodestone.llm.common import stored, table

#: Each stage takes (spark, docs, sf_dir) and returns what it keeps; all but the last return the columns of documents.
STAGES = [
    ("quality classifier", quality_classifier.stage),
    ("line dedup", line_dedup.stage),
    ("minhash near-dedup", minhash_dedup.stage),
    ("benchmark decontamination", decontaminate.stage),
    ("source mix", source_mix.stage),
]

#: SQL cannot express the classifier, the sketches and the fingerprints: tests hold the run against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows that the last stage returns; what each earlier one keeps is written and read again."""
    docs = table(spark, sf_dir, "documents")
    for n, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if n < len(STAGES) - 1:
            docs = stored(docs, f"pipeline-{n}")
    return docs
