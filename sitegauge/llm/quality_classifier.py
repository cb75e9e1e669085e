"""Quality classifier: logistic regression on hashed word n-grams, learned with follow-the-regularised-leader."""

from __future__ import annotations

import re
import sys
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Shipped, by_slice, crc_fold, slices
from .training import sample

BITS = 18
#: Labelled rows to learn from, and their code points; the one place where rows are sampled.
MAX_TRAINING_ROWS = 8192
MAX_TRAINING_CHARS = 60_000_000
EPOCHS = 3
ALPHA, BETA, L1, L2 = 0.3, 1.0, 0.02, 0.02
#: Values are shares of the text's n-grams times this.
SCALE = 24.0
THRESHOLD = 0.3
CACHED_WORDS = 200_000
_SPACE = re.compile(r"[\x20\x09-\x0D]+")


class WordHashes(dict):
    """word -> 48 bits of its hash, then 16 bits of its shape's; forgets all when it gets large."""

    def __missing__(self, word: str) -> int:
        if len(self) >= CACHED_WORDS:
            self.clear()
        shape = re.sub(r"(.)\1+", r"\1", "".join("A" if c.isupper() else "a" if c.isalpha() else "0" if c.isdigit() else c for c in word))
        out = (xxhash.xxh64_intdigest(word) & ~0xFFFF) | (xxhash.xxh32_intdigest(shape) & 0xFFFF)
        self[word] = out
        return out


def ngrams(text: str, hashes: WordHashes) -> np.ndarray:
    """Bins of a text's word and word-shape unigrams and bigrams; a bigram of equal words has one more bin."""
    words = [w for w in _SPACE.split(text) if w]
    h = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    if not len(h):
        return np.zeros(0, np.int64)
    top, a, b = np.uint64(64 - BITS), np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
    word, shape = h >> np.uint64(16), (h & np.uint64(0xFFFF)) + np.uint64(1 << 50)
    parts = [word * a, shape * a, (word[:-1] * b + word[1:]) * a, (shape[:-1] * b + shape[1:]) * a]
    parts.append(np.full(int((word[:-1] == word[1:]).sum()), 0x9E3779B97F4A7C15 * 7 & (1 << 64) - 1, np.uint64))
    return (np.concatenate(parts) >> top).astype(np.int64)


def features(text: str, hashes: WordHashes) -> tuple[np.ndarray, np.ndarray]:
    """Bins and values of a text, the bias last."""
    bins, counts = np.unique(ngrams(text, hashes), return_counts=True)
    x = counts * (SCALE / max(1, counts.sum()))
    return np.append(bins, 1 << BITS).astype(np.int32), np.append(x, 1.0).astype(np.float32)


def train(data: Sequence[tuple[np.ndarray, np.ndarray, float]], epochs: int = EPOCHS) -> np.ndarray:
    """Weights by bin, the bias last, from rows (bins, values, label): FTRL-proximal with a learning rate for each bin."""
    z, n, w = (np.zeros((1 << BITS) + 1) for _ in range(3))
    for _ in range(epochs):
        for i, x, y in data:
            zi, ni = z[i], n[i]
            wi = np.where(np.abs(zi) > L1, -(zi - np.sign(zi) * L1) / ((BETA + np.sqrt(ni)) / ALPHA + L2), 0.0)
            p = 1 / (1 + np.exp(-np.clip(wi @ x, -30, 30)))
            g = (p - y) * x
            sigma = (np.sqrt(ni + g * g) - np.sqrt(ni)) / ALPHA
            z[i] = zi + g - sigma * wi
            n[i] = ni + g * g
            w[i] = wi
    return np.where(np.abs(z) > L1, -(z - np.sign(z) * L1) / ((BETA + np.sqrt(n)) / ALPHA + L2), 0.0)


def score_text(text: str, weights: np.ndarray, hashes: WordHashes) -> float:
    bins = ngrams(text, hashes)
    dot = weights[-1] + (weights[bins].sum() * SCALE / len(bins) if len(bins) else 0.0)
    return float(1 / (1 + np.exp(-np.clip(dot, -30, 30))))


def _learner(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rows, hashes = [], WordHashes()
    for b in slices(batches):
        for i, text, label in zip(b["doc_id"].to_pylist(), b["text"].to_pylist(), b["label"].to_pylist(), strict=True):
            rows.append((xxhash.xxh64_intdigest(str(i)), *features(text, hashes), float(label)))
    rows.sort(key=lambda r: r[0])
    if rows:
        w = train([r[1:] for r in rows])
        at = np.flatnonzero(w)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(w[at])], ["bin", "weight"])


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", max_rows: int = MAX_TRAINING_ROWS) -> np.ndarray:
    """Weights learned from a bounded sample of labelled rows, in one task; without labelled rows all are 0.

    At most 2**BITS + 1 weights come back.
    """
    drawn = sample(docs, labels, label, max_rows, MAX_TRAINING_CHARS).coalesce(1)
    w = np.zeros((1 << BITS) + 1)
    for r in drawn.mapInArrow(_learner, "bin int, weight double").collect():
        w[r["bin"]] = r["weight"]
    return w


def score(docs: DataFrame, weights: np.ndarray, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score (0 to 1, higher: better) and predicted, one row per row of docs.

    A null text counts as empty; an empty text gets the bias alone. Other
    columns of docs are ignored; an empty table gives an empty result.
    """
    shipped = Shipped(docs.sparkSession, weights.astype(np.float64))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, w = WordHashes(), shipped.value

        def work(b: pa.RecordBatch) -> pa.RecordBatch:
            scores = [score_text(t or "", w, hashes) for t in b["text"].to_pylist()]
            return pa.RecordBatch.from_arrays([b["doc_id"], b["held_out"], pa.array(scores, pa.float64())], ["doc_id", "held_out", "score"])

        yield from by_slice(work)(batches)

    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", (crc_fold(F.col("doc_id")) == 0).alias("held_out"), F.col("text").cast("string").alias("text"))
    out = rows.mapInArrow(run, f"doc_id {kind}, held_out boolean, score double")
    return out.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


cloudpickle.register_pickle_by_value(sys.modules[__name__])
