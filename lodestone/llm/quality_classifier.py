"""Quality classifier: a byte-level convolutional network in numpy.

A document's bytes are embedded, and learned filters of WIDTH bytes are laid over all of them. The strongest response
of each filter is taken in overlapping chunks (two blocks each, every block in two chunks) that cover the whole
document; the greatest, the mean and the least of the chunks' maxima go through one hidden layer to one probability
that the label is 1.

The network is trained on the driver on a bounded sample: at most PER_CLASS labelled documents of each class, each of
LONGEST bytes at most, taken by the hash of their id; how much rarer a class is among all labelled documents is put
back into the output's bias. The parameters (about 40 kB) travel with the job and scoring is a map over documents.

Defined results for odd input: a null or empty text is scored as a document without bytes; a score is a function of
the text alone, so equal texts score alike; without labels of both classes the score is the share of label 1, or 0.5
without labels; an empty table gives an empty result; other columns, whatever their names, are never inputs.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import table

PER_CLASS = 1200
LONGEST = 64 * 1024
THRESHOLD = 0.3
FOLDS = 5

DIM, WIDTH, STRIDE, FILTERS, HIDDEN = 4, 8, 2, 24, 16
BLOCK = 256  # bytes; a chunk is two
STEPS, BATCH, RATE = 1500, 16, 0.01
SEGMENT = 256  # blocks convolved at once
SLICES, SLICE = 0.5, (5, 150)  # short slices of texts of label 1 added to the whole texts, as a share of them; bytes
_PAD = 256  # the embedding's row for bytes beyond the end


def held_out(doc_id: Column) -> Column:
    """Whether a document's label must not be learned."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(FOLDS)) == 0, F.lit(False))


class Network:
    """Parameters, the forward pass and the gradients."""

    def __init__(self, seed: int = 1):
        rng = np.random.default_rng(seed)
        draw = lambda *shape, scale: (rng.standard_normal(shape) * scale).astype(np.float32)
        self.p = {
            "embed": draw(_PAD + 1, DIM, scale=0.5),
            "filters": draw(WIDTH * DIM, FILTERS, scale=(WIDTH * DIM) ** -0.5),
            "shift": np.zeros(FILTERS, np.float32),
            "hidden": draw(3 * FILTERS, HIDDEN, scale=(3 * FILTERS) ** -0.5),
            "hidden_shift": np.zeros(HIDDEN, np.float32),
            "out": draw(HIDDEN, scale=HIDDEN**-0.5),
            "out_shift": np.zeros(1, np.float32),
        }
        self.p["embed"][_PAD] = 0

    def _windows(self, codes: np.ndarray) -> np.ndarray:
        flat = self.p["embed"][codes].ravel()
        n = (len(codes) - WIDTH) // STRIDE + 1
        return np.lib.stride_tricks.as_strided(flat, (n, WIDTH * DIM), (STRIDE * DIM * flat.itemsize, flat.itemsize))

    @staticmethod
    def codes(data: bytes) -> np.ndarray:
        """Bytes, filled to whole blocks, with what the last window reads beyond."""
        blocks = max(1, -(-len(data) // BLOCK))
        out = np.full(blocks * BLOCK + WIDTH - STRIDE, _PAD, np.int64)
        out[: len(data)] = np.frombuffer(data, np.uint8)
        return out

    def blocks(self, codes: np.ndarray, places: bool = False) -> tuple[np.ndarray, np.ndarray | None]:
        """Strongest response of each filter in each block, and the window it comes from."""
        n, per = (len(codes) - WIDTH + STRIDE) // BLOCK, BLOCK // STRIDE
        top, where = np.empty((n, FILTERS), np.float32), np.empty((n, FILTERS), np.int64) if places else None
        for a in range(0, n, SEGMENT):
            b = min(n, a + SEGMENT)
            part = (self._windows(codes[a * BLOCK : b * BLOCK + WIDTH - STRIDE]) @ self.p["filters"]).reshape(b - a, per, FILTERS)
            if places:
                best = part.argmax(axis=1)
                where[a:b] = best + np.arange(a, b)[:, None] * per
                top[a:b] = np.take_along_axis(part, best[:, None], axis=1)[:, 0]
            else:
                top[a:b] = part.max(axis=1)
        return np.maximum(top + self.p["shift"], 0), where

    @staticmethod
    def chunks(top: np.ndarray) -> np.ndarray:
        return np.maximum(top[:-1], top[1:]) if len(top) > 1 else top

    def _head(self, chunk: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
        pooled = np.concatenate([chunk.max(axis=0), chunk.mean(axis=0), chunk.min(axis=0)])
        hidden = np.tanh(pooled @ self.p["hidden"] + self.p["hidden_shift"])
        return pooled, hidden, float(hidden @ self.p["out"] + self.p["out_shift"][0])

    def score(self, data: bytes) -> float:
        logit = self._head(self.chunks(self.blocks(self.codes(data))[0]))[2]
        return float(1 / (1 + np.exp(-np.clip(logit, -30, 30))))

    def gradients(self, data: bytes, label: int, out: dict) -> None:
        """Add the gradients of one document's loss to out."""
        p, codes = self.p, self.codes(data)
        top, where = self.blocks(codes, places=True)
        chunk = self.chunks(top)
        pooled, hidden, logit = self._head(chunk)
        d = np.float32(1 / (1 + np.exp(-np.clip(logit, -30, 30))) - label)
        out["out"] += d * hidden
        out["out_shift"] += d
        dh = d * p["out"] * (1 - hidden**2)
        out["hidden"] += np.outer(pooled, dh)
        out["hidden_shift"] += dh
        d_max, d_mean, d_min = (p["hidden"] @ dh).reshape(3, FILTERS)
        dc = np.repeat(d_mean[None] / len(chunk), len(chunk), axis=0)
        each = np.arange(FILTERS)
        np.add.at(dc, (chunk.argmax(axis=0), each), d_max)
        np.add.at(dc, (chunk.argmin(axis=0), each), d_min)
        db = dc if len(top) == 1 else np.zeros_like(top)
        if len(top) > 1:
            first = top[:-1] >= top[1:]
            db[:-1] += dc * first
            db[1:] += dc * ~first
        db = db * (top > 0)
        out["shift"] += db.sum(axis=0)
        at = (where * STRIDE)[..., None] + np.arange(WIDTH)  # blocks, filters, width
        seen = codes[at]
        x = p["embed"][seen].reshape(len(top), FILTERS, WIDTH * DIM)
        out["filters"] += np.einsum("bf,bfk->kf", db, x)
        dx = (db[..., None] * p["filters"].T[None]).reshape(-1, DIM)
        for k in range(DIM):
            out["embed"][:, k] += np.bincount(seen.ravel(), dx[:, k], _PAD + 1).astype(np.float32)

    def fit(self, rows: list[tuple[bytes, int]], seed: int = 1) -> Network:
        """Adam over shuffled batches of the whole texts, and of slices from good ones: few responses alone are no fault."""
        rng = np.random.default_rng(seed)
        good, slices = [data for data, label in rows if label], []
        for data in good[: int(SLICES * len(good))]:
            words = data.split(b" ")
            size, at = rng.integers(*SLICE), rng.integers(len(words))
            slices.append((b" ".join(words[at:])[:size].rpartition(b" ")[0] or words[at], 1))
        rows = rows + slices
        m, v, t = {k: np.zeros_like(x) for k, x in self.p.items()}, {k: np.zeros_like(x) for k, x in self.p.items()}, 0
        while t < STEPS:
            order = rng.permutation(len(rows))
            for at in range(0, min(len(rows), (STEPS - t) * BATCH), BATCH):
                g = {k: np.zeros_like(x) for k, x in self.p.items()}
                batch = order[at : at + BATCH]
                for i in batch:
                    self.gradients(*rows[i], g)
                g["embed"][_PAD] = 0
                t += 1
                rate = RATE * (1 - t / (STEPS + 1))
                for k, x in g.items():
                    x /= len(batch)
                    m[k] = 0.9 * m[k] + 0.1 * x
                    v[k] = 0.99 * v[k] + 0.01 * x * x
                    self.p[k] = (self.p[k] - rate * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.99**t)) + 1e-8)).astype(np.float32)
        return self


def train(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS, longest: int = LONGEST) -> Network | float:
    """A network fitted to labelled documents that are not held out; the share of label 1 where one class is missing."""
    known = labels.where(F.col("quality").isin(0, 1) & ~held_out(F.col("doc_id"))).select("doc_id", "quality").distinct()
    counts = {r["quality"]: r["n"] for r in known.groupBy("quality").agg(F.count("*").alias("n")).collect()}
    if len(counts) < 2:
        return float(next(iter(counts), 0.5))
    rows: list = []
    for label in (0, 1):
        # the ids are drawn first, so that only the texts of the sample meet the labels
        ids = known.where(F.col("quality") == label).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class)
        texts = docs.where(F.octet_length("text") <= longest).select("doc_id", "text").join(F.broadcast(ids), "doc_id")
        rows += [((r["text"] or "").encode(), label) for r in texts.orderBy(F.xxhash64("doc_id"), "doc_id", "text").limit(per_class).collect()]
    ones = sum(label for _, label in rows)
    if not 0 < ones < len(rows):
        return counts[1] / sum(counts.values())
    net = Network().fit(rows)
    net.p["out_shift"] = net.p["out_shift"] + np.float32(np.log(counts[1] / counts[0]) - np.log(ones / (len(rows) - ones)))
    return net


def scores(docs: DataFrame, model: Network | float, name: str = "score") -> DataFrame:
    """docs with a score, the probability of label 1; a column of that name is replaced."""

    @F.pandas_udf(T.DoubleType())
    def score(text: pd.Series) -> pd.Series:
        one = model.score if isinstance(model, Network) else lambda _: model
        return text.map(lambda t: one((t or "").encode())).astype("float64")

    return docs.withColumn(name, score("text"))


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = scores(docs, train(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents that the classifier rejects go."""
    model = train(docs.select("doc_id", "text"), table(spark, sf_dir, "labels"))
    return scores(docs, model, "__score").where(F.col("__score") >= THRESHOLD).drop("__score")
