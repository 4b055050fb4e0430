"""Toxicity by logistic regression, learnt by FTRL-proximal over hashed word n-grams and skip-grams.

Features of a text: its words (lower-cased, cut at anything but letters and digits), pairs of neighbours, and pairs
with one and two words between, hashed into BUCKETS; each counts once a text.  FTRL-proximal keeps a learning rate for each
coordinate, and its L1 term leaves most weights at zero, so what is sent to the executors is a short list.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidelog.llm.common import bounded_sample, mapped, small_rows

BUCKETS, SKIPS = 1 << 20, (1, 2, 3)
ALPHA, BETA, L1, L2, EPOCHS = 2.0, 1.0, 16.0, 0.0, 10
SAMPLE_ROWS, THRESHOLD = 16_000, 0.7

_WORD = regex.compile(r"[\p{L}\p{N}]+")
_MIX = np.uint64(0x9E3779B97F4A7C15)


class _Hashes(dict):
    """Word -> 64-bit hash, of words met lately."""

    def __missing__(self, word: str) -> int:
        if len(self) >= 300_000:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word)
        return h


_HASHES = _Hashes()


def features(text: str | None) -> np.ndarray:
    """The text's distinct buckets, ascending; whole texts, no matter how long."""
    words = _WORD.findall((text or "").lower())
    h = np.fromiter(map(_HASHES.__getitem__, words), dtype=np.uint64, count=len(words))
    parts = [h]
    for skip in SKIPS:
        if len(h) > skip:
            x = h[:-skip] * _MIX + h[skip:] + np.uint64(skip)
            parts.append((x ^ (x >> np.uint64(31))) * _MIX)
    return np.unique(np.concatenate(parts) >> np.uint64(44)).astype(np.int32)


@dataclass
class Model:
    """Weights of the buckets that have any, by bucket; bias."""

    buckets: np.ndarray
    weights: np.ndarray
    bias: float

    def dense(self) -> np.ndarray:
        out = np.zeros(BUCKETS)
        out[self.buckets] = self.weights
        return out

    def score(self, text: str | None, dense: np.ndarray) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.bias + dense[features(text)].sum(), -35, 35))))


def train(rows: list[tuple[np.ndarray, int]], epochs: int = EPOCHS, alpha: float = ALPHA, beta: float = BETA, l1: float = L1, l2: float = L2) -> Model:
    """FTRL-proximal over rows of (buckets, label) in the order given, epochs times.  The bias is not regularised."""
    z, n = np.zeros(BUCKETS), np.zeros(BUCKETS)
    bias_z = bias_n = 0.0

    def weights(i):
        s = z[i]
        return np.where(np.abs(s) <= l1, 0.0, -(s - np.sign(s) * l1) / ((beta + np.sqrt(n[i])) / alpha + l2))

    for _ in range(epochs):
        for i, y in rows:
            w = weights(i)
            bias = -bias_z / ((beta + np.sqrt(bias_n)) / alpha)
            g = 1 / (1 + np.exp(-np.clip(bias + w.sum(), -35, 35))) - y
            z[i] += g - (np.sqrt(n[i] + g * g) - np.sqrt(n[i])) / alpha * w
            n[i] += g * g
            bias_z += g - (np.sqrt(bias_n + g * g) - np.sqrt(bias_n)) / alpha * bias
            bias_n += g * g
    every = np.flatnonzero(np.abs(z) > l1)
    return Model(every, weights(every), float(-bias_z / ((beta + np.sqrt(bias_n)) / alpha)))


def fit(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> Model:
    """A model of docs with labels (doc_id, toxic; one row each).

    It is fitted on at most rows labels, chosen and ordered by a hash of doc_id, in one task; the driver gets only the
    weights that L1 leaves.  Rows without a label are left out; without rows, every score is 0.5.
    """
    known = labels.filter("toxic IS NOT NULL").select("doc_id", F.col("toxic").cast("int").alias("y"))
    chosen = bounded_sample(docs, known, "y", rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        data = [(features(t), y) for b in small_rows(batches) for t, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist())]
        m = train(data) if data else Model(np.zeros(0, dtype=np.int64), np.zeros(0), 0.0)
        yield pa.RecordBatch.from_arrays([pa.array([*m.buckets.tolist(), -1], pa.int64()), pa.array([*m.weights.tolist(), m.bias], pa.float64())], names=["bucket", "weight"])

    found = mapped(chosen, run, "bucket long, weight double").toPandas().sort_values("bucket")
    if not len(found):
        return Model(np.zeros(0, dtype=np.int64), np.zeros(0), 0.0)
    return Model(found.bucket.to_numpy()[1:], found.weight.to_numpy()[1:], float(found.weight.iloc[0]))


def score(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, score, predicted for each row of docs, in a pass without a shuffle.

    Null and empty texts have the score of the bias alone.  Null doc_ids and repeated rows are rows like others.
    Nothing but the text decides.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)  # BUCKETS weights at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        dense = m.dense()
        for b in small_rows(batches):
            s = [m.score(t, dense) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(s, pa.float64()), pa.array([int(x >= threshold) for x in s], pa.int32())], names=["doc_id", "score", "predicted"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return mapped(docs.select("doc_id", "text"), run, f"doc_id {kind}, score double, predicted int")


def fold() -> Column:
    """crc32 of doc_id as text, mod 3; rows of 1 are held out."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3


def score_documents(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted: learnt from the labelled documents that are not held out.

    A null doc_id is not held out and has no label.
    """
    known = labels.filter(fold() != 1).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    out = score(docs, fit(docs, known), threshold)
    return out.select("doc_id", F.coalesce(fold() == 1, F.lit(False)).alias("held_out"), "score", "predicted")

