"""Bundles: a table written with a manifest that tells whether it still is what was written."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def fingerprint(df: DataFrame) -> dict:
    """Rows, and two sums over row hashes that do not depend on the rows' order; repeated rows count."""
    h = F.xxhash64(*sorted(df.columns)) if df.columns else F.lit(0)
    row = df.agg(F.count("*").alias("n"), F.bit_xor(h).alias("x"), F.sum(F.pmod(h, F.lit(1_000_000_007))).alias("s")).first()
    return {"rows": row["n"], "xor": row["x"] or 0, "sum": row["s"] or 0, "columns": sorted(f"{n}:{t}" for n, t in df.dtypes)}


def write_bundle(df: DataFrame, path: str, name: str, version: str = "1") -> dict:
    """Write df and its manifest below path; the manifest."""
    df.write.parquet(f"{path}/data")
    manifest = {"name": name, "version": version, **fingerprint(df)}
    df.sparkSession.createDataFrame([(json.dumps(manifest, sort_keys=True),)], "value string").coalesce(1).write.text(f"{path}/manifest")
    return manifest


def read_bundle(spark: SparkSession, path: str, verify: bool = True) -> DataFrame:
    """The bundle's table; ValueError if it is not what the manifest says."""
    manifest = json.loads(spark.read.text(f"{path}/manifest").first()[0])
    df = spark.read.parquet(f"{path}/data")
    if verify and any(manifest[k] != v for k, v in fingerprint(df).items()):
        raise ValueError(f"{manifest['name']} is not what its manifest says")
    return df


def write_jsonl(df: DataFrame, path: str) -> None:
    df.write.json(path)
