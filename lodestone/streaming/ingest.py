"""Structured Streaming: deduplicated ingest, windows over late data, rate limits with state. Each has a batch twin."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read_events(spark: SparkSession, path: str, schema: T.StructType, files_per_trigger: int = 8) -> DataFrame:
    """A stream of the Parquet files that arrive in a folder."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def deduplicated(stream: DataFrame, key: str, moment: str, late: str = "1 hour") -> DataFrame:
    """The first record of each key; keys are forgotten when they can no longer arrive."""
    return stream.withWatermark(moment, late).dropDuplicatesWithinWatermark([key])


def windowed(events: DataFrame, moment: str, by: list[str], width: str, slide: str | None = None, late: str | None = "1 hour") -> DataFrame:
    """(start, by, n, value) of time windows; records later than ``late`` are left out of streams. late=None: batch."""
    rows = events.withWatermark(moment, late) if late else events
    window = F.window(moment, width, slide) if slide else F.window(moment, width)
    return rows.groupBy(window.alias("w"), *by).agg(F.count("*").alias("n"), F.sum("value").alias("value")).select(F.col("w.start").alias("start"), *by, "n", "value")


def sessions(events: DataFrame, moment: str, by: str, gap: str, late: str | None = "1 hour") -> DataFrame:
    """(by, start, end, n) of the sessions of a key, parted by gaps."""
    rows = events.withWatermark(moment, late) if late else events
    return rows.groupBy(F.session_window(moment, gap).alias("s"), by).agg(F.count("*").alias("n")).select(by, F.col("s.start").alias("start"), F.col("s.end").alias("end"), "n")


ADMITTED = T.StructType([T.StructField("client", T.StringType()), T.StructField("id", T.LongType()), T.StructField("at", T.DoubleType()), T.StructField("admitted", T.BooleanType())])
BUCKET = T.StructType([T.StructField("tokens", T.DoubleType()), T.StructField("at", T.DoubleType())])


def admit(times: list[float], tokens: float, last: float | None, rate: float, burst: float) -> tuple[list[bool], float, float | None]:
    """Which requests a token bucket admits, in the order of their times, and the state it is left in."""
    out = []
    for t in times:
        tokens = min(burst, tokens + rate * max(0.0, t - (t if last is None else last)))
        last = t if last is None else max(t, last)
        out.append(tokens >= 1.0)
        tokens -= 1.0 if out[-1] else 0.0
    return out, tokens, last


def rate_limited(stream: DataFrame, rate: float, burst: float) -> DataFrame:
    """(client, id, at, admitted) of a stream (client, id, at in seconds): a token bucket for each client, kept as state."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        tokens, last = state.get if state.exists else (burst, None)
        rows = pd.concat(list(batches)).sort_values(["at", "id"])
        admitted, tokens, last = admit(rows["at"].tolist(), tokens, last, rate, burst)
        state.update((tokens, last))
        yield pd.DataFrame({"client": key[0], "id": rows["id"].to_numpy(), "at": rows["at"].to_numpy(), "admitted": admitted})

    return stream.groupBy("client").applyInPandasWithState(step, ADMITTED, BUCKET, "append", "NoTimeout")


def rate_limited_batch(rows: DataFrame, rate: float, burst: float) -> DataFrame:
    """The same over a table: each client's requests folded in order."""
    ordered = F.array_sort(F.collect_list(F.struct(F.col("at"), F.col("id"))))
    start = F.struct(F.lit(float(burst)).alias("tokens"), F.lit(None).cast("double").alias("at"), F.array().cast("array<struct<id:long,at:double,admitted:boolean>>").alias("out"))

    def step(s, r):
        filled = F.least(F.lit(float(burst)), s["tokens"] + rate * F.greatest(F.lit(0.0), r["at"] - F.coalesce(s["at"], r["at"])))
        ok = filled >= 1.0
        return F.struct(F.when(ok, filled - 1.0).otherwise(filled).alias("tokens"), r["at"].alias("at"), F.concat(s["out"], F.array(F.struct(r["id"].alias("id"), r["at"].alias("at"), ok.alias("admitted")))).alias("out"))

    folded = rows.groupBy("client").agg(F.aggregate(ordered, start, step).alias("s"))
    return folded.select("client", F.explode("s.out").alias("o")).select("client", "o.id", "o.at", "o.admitted")
