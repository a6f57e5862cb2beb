"""Quality classifier by supervised subword embeddings.

Words and their character n-grams share hashed buckets, each with a learned vector. A document is
the average of all its vectors, a softmax layer gives the class, and numpy stochastic gradient
descent learns both. Since score and average are linear up to the softmax, a fitted model is
folded into one number per bucket: scoring sums these over the distinct words of a slice of texts.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .text import bounded_sample, coded, hashed_ngrams, lean, segment_sums, slices, split_words, texts

#: Bounds of the labelled sample that training sees; the driver holds it.
SAMPLE_ROWS = 4000
SAMPLE_CHARS = 6_000_000
BUCKETS = 1 << 17
SIZES = (3, 4)
DIMENSIONS = 8
#: Stands for a word that repeats the one before it.
AGAIN = "\x00"


def _stream(array: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Codes of the words, texts' offsets, features of each code, features' offsets. A word said again at once is a word of its own kind."""
    flat, offsets = split_words(array, lower=False)
    codes, words = coded(flat)
    if len(codes):
        again = np.concatenate([[False], codes[1:] == codes[:-1]])
        again[offsets[:-1][offsets[:-1] < len(codes)]] = False
        codes = np.where(again, len(words), codes)
        words.append(AGAIN)
    return codes, offsets, *hashed_ngrams(words, SIZES, BUCKETS, whole=True)


def _bags(array: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct features of each text with their share of all its features: buckets, shares, offsets."""
    codes, offsets, features, of = _stream(array)
    buckets, shares, ends = [], [], [0]
    for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist()):
        c, n = np.unique(codes[a:b], return_counts=True)
        sizes = of[c + 1] - of[c]
        every = np.concatenate([features[of[k] : of[k + 1]] for k in c.tolist()]) if len(c) else np.empty(0, np.int64)
        u, inverse = np.unique(every, return_inverse=True)
        share = np.bincount(inverse, np.repeat(n, sizes), len(u)) if len(u) else np.empty(0)
        buckets.append(u.astype(np.int32))
        shares.append((share / max(share.sum(), 1)).astype(np.float32))
        ends.append(ends[-1] + len(u))
    return np.concatenate(buckets), np.concatenate(shares), np.array(ends)


class SubwordClassifier:
    """fit() learns from texts and classes 0/1; table() gives one logit per bucket, and the bias."""

    def __init__(self, seed: int = 7, epochs: int = 6, rate: float = 4.0):
        self.seed, self.epochs, self.rate = seed, epochs, rate
        self.vectors = np.zeros((BUCKETS, DIMENSIONS), np.float32)
        self.out, self.bias = np.zeros((DIMENSIONS, 2), np.float32), np.zeros(2, np.float32)

    def fit(self, array: pa.Array, classes: np.ndarray) -> SubwordClassifier:
        if not len(array):
            return self
        rng = np.random.default_rng(self.seed)
        self.vectors = rng.uniform(-1, 1, (BUCKETS, DIMENSIONS)).astype(np.float32) / DIMENSIONS
        buckets, shares, ends = _bags(array)
        target = np.eye(2, dtype=np.float32)[classes]
        steps = self.epochs * len(array)
        done = 0
        for _ in range(self.epochs):
            for batch in np.array_split(rng.permutation(len(array)), max(1, len(array) // 16)):
                rate = self.rate * (1 - done / steps) + 0.05
                done += len(batch)
                places = np.concatenate([np.arange(ends[i], ends[i + 1]) for i in batch])
                own = np.repeat(np.arange(len(batch)), ends[batch + 1] - ends[batch])
                b, s = buckets[places], shares[places]
                rows = self.vectors[b] * s[:, None]
                mean = np.stack([np.bincount(own, rows[:, k], len(batch)) for k in range(DIMENSIONS)], 1).astype(np.float32)
                z = mean @ self.out + self.bias
                z = np.exp(z - z.max(1, keepdims=True))
                error = z / z.sum(1, keepdims=True) - target[batch]
                back = error @ self.out.T
                self.out -= rate / len(batch) * (mean.T @ error)
                self.bias -= 0.1 * rate / len(batch) * error.sum(0)
                np.add.at(self.vectors, b, -rate * s[:, None] * back[own])
        return self

    def table(self) -> tuple[np.ndarray, float]:
        return (self.vectors @ (self.out[:, 1] - self.out[:, 0])).astype(np.float32), float(self.bias[1] - self.bias[0])


def score_texts(array: pa.Array, table: np.ndarray, bias: float) -> np.ndarray:
    """The probability of class 1 for each text."""
    codes, offsets, features, of = _stream(array)
    sums, counts = segment_sums(table[features], of), np.diff(of)
    total, n = segment_sums(sums[codes], offsets), segment_sums(counts[codes], offsets)
    return 1 / (1 + np.exp(-(np.divide(total, n, out=np.zeros_like(total), where=n > 0) + bias)))


def fit_quality(documents: DataFrame, labels: DataFrame, label: str = "quality") -> tuple[np.ndarray, float]:
    """Fits on a bounded sample of labelled documents (doc_id, text; doc_id, label).

    Labels other than 0 and 1, null ids and null texts are left out; a document with several label rows counts with each.
    """
    told = labels.where(F.col(label).isin(0, 1)).select(F.col("doc_id").cast("long").alias("doc_id"), label)
    rows = bounded_sample(documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), SAMPLE_ROWS, SAMPLE_CHARS, members=told)
    return SubwordClassifier().fit(pa.array([r.text for r in rows], pa.string()), np.array([r[label] for r in rows], np.int64)).table()


def quality_scores(documents: DataFrame, model: tuple[np.ndarray, float]) -> DataFrame:
    """doc_id and score (0 to 1) of each whole text.

    A null or blank text scores the prior. Repeated rows repeat, a null doc_id stays null, other
    columns are ignored, an empty table gives none; a model without training rows scores 0.5.
    """
    table, bias = model

    def run(batches):
        for batch in slices(batches):
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(score_texts(texts(batch), table, bias), pa.float64())], names=["doc_id", "score"])

    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(lean(run), "doc_id long, score double")
