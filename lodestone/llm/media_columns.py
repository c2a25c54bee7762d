"""Media columns: bytes as WAV files, and spectral-peak pair fingerprints of them as time-coded arrays.

``wav_of`` stores bytes losslessly as a mono WAV file of unsigned 8-bit samples; ``samples_of`` reads a file back;
``fingerprint_of`` reads a file, takes short-time Fourier transforms over frames of 576 samples that overlap by half,
finds in each of six bands of frequencies the bins that are strongest among the frames nearby, and pairs each peak
with the next two. Its result is two arrays of equal length: ``times``, the frame of each pair's first peak, and
``codes``, the pair's two frequency bins and the frames between them (10, 10 and 5 bits).

Defined results for odd input: a null or empty text is stored as one unit of padding; silence has no peaks and gives
empty arrays; equal bytes give equal files and arrays; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import io
import wave

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import table

UNIT = 576  # bytes that a payload is padded to, and samples in a frame
PAD = b"\xff"
RATE = 8000
HOP = UNIT // 2
BANDS = (1, 8, 18, 36, 72, 144, UNIT // 2 + 1)  # first bin of each band, and the end of the last
NEAR = 4  # frames on both sides in which a peak is the strongest of its band
FAN = 2  # peaks that each is paired with
LONGEST = 31  # frames between the two of a pair at most
BLOCK = 2048  # frames transformed at once


def _stored(payload: bytes) -> bytes:
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(1)
        w.setframerate(RATE)
        w.writeframes(payload)
    return out.getvalue()


def _samples(media: bytes) -> bytes:
    with wave.open(io.BytesIO(media), "rb") as w:
        return w.readframes(w.getnframes())


def _peaks(samples: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Frame and bin of each peak, by frame and then by bin."""
    x = np.frombuffer(samples, np.uint8)
    frames = np.lib.stride_tricks.sliding_window_view(x, UNIT)[::HOP]
    hann = np.hanning(UNIT)
    n, bands = len(frames), len(BANDS) - 1
    loud, bins = np.empty((n, bands), np.int64), np.empty((n, bands), np.int64)
    for at in range(0, n, BLOCK):
        power = np.rint(np.abs(np.fft.rfft((frames[at : at + BLOCK] - 128.0) * hann, axis=1))).astype(np.int64)
        for b in range(bands):
            part = power[:, BANDS[b] : BANDS[b + 1]]
            best = part.argmax(axis=1)
            bins[at : at + BLOCK, b] = best + BANDS[b]
            loud[at : at + BLOCK, b] = part[np.arange(len(part)), best]
    around = np.pad(loud, ((NEAR, NEAR), (0, 0)))
    strongest = np.lib.stride_tricks.sliding_window_view(around, 2 * NEAR + 1, axis=0).max(axis=-1)
    t, b = np.nonzero((loud == strongest) & (loud > 0))
    return t, bins[t, b]


def _pairs(t: np.ndarray, f: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """times and codes of the pairs, by time and then by code."""
    times, codes = [], []
    for k in range(1, FAN + 1):
        gap = t[k:] - t[:-k]
        near = gap <= LONGEST
        times.append(t[:-k][near])
        codes.append((f[:-k][near] << 15) | (f[k:][near] << 5) | gap[near])
    time, code = np.concatenate(times), np.concatenate(codes)
    order = np.lexsort((code, time))
    return time[order].astype(np.int32), code[order].astype(np.int32)


@F.pandas_udf(T.BinaryType())
def wav_of(payload: pd.Series) -> pd.Series:
    return payload.map(_stored, na_action="ignore")


@F.pandas_udf(T.BinaryType())
def samples_of(media: pd.Series) -> pd.Series:
    return media.map(_samples, na_action="ignore")


@F.pandas_udf(T.StructType([T.StructField("times", T.ArrayType(T.IntegerType())), T.StructField("codes", T.ArrayType(T.IntegerType())), T.StructField("samples", T.BinaryType())]))
def fingerprint_of(media: pd.Series) -> pd.DataFrame:
    rows = []
    for m in media:
        samples = _samples(m)
        rows.append((*_pairs(*_peaks(samples)), samples))
    return pd.DataFrame(rows, columns=["times", "codes", "samples"])


def padded(text: Column) -> Column:
    """A text's bytes with padding up to a positive multiple of the unit."""
    raw = F.coalesce(text, F.lit("")).cast("binary")
    missing = F.lit(UNIT) - F.pmod(F.octet_length(raw) - 1, F.lit(UNIT)) - 1
    missing = F.when(F.octet_length(raw) == 0, UNIT).otherwise(missing).cast("int")
    return F.concat(raw, F.substring(F.lit(PAD * UNIT), F.lit(1), missing))


def media_columns(docs: DataFrame) -> DataFrame:
    """doc_id, text, media (the WAV file) and of what is read back samples, times and codes."""
    out = docs.select("doc_id", "text", wav_of(padded(F.col("text"))).alias("media")).withColumn("read", fingerprint_of("media"))
    return out.select("doc_id", "text", "media", "read.samples", "read.times", "read.codes")


def op4_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    media = media_columns(table(spark, sf_dir, "documents").select("doc_id", "text"))
    feature = F.concat_ws(":", F.size("times"), F.sha2(F.concat(F.col("times").cast("string"), F.col("codes").cast("string")), 256))
    return media.select(
        "doc_id",
        F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"),
        F.octet_length("samples").cast("long").alias("payload_bytes"),
        F.sha2("samples", 256).alias("payload_sha256"),
        F.crc32(F.substring("samples", -32, 32)).alias("tail_crc32"),
        F.octet_length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        feature.alias("feature"),
        "times",
        "codes",
    )
