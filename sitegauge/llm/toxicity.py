"""Toxicity: every significant maximal segment of token log-odds, calibrated by extreme values."""

from __future__ import annotations

import math
import re
import sys
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Shipped, by_slice, crc_fold, slices
from .training import sample

BITS = 20
#: Labelled rows to learn from; the one place where rows are sampled.
MAX_TRAINING_ROWS = 30_000
#: Tokens are lower-case words; a word has its own bin and one for each of these prefixes.
PREFIXES = (4, 5, 6)
#: Weight of the Dirichlet prior as a share of all tokens; the z at which half of a bin's log-odds counts; what each token of a passage costs.
PRIOR = 0.05
HALF_Z = 4.5
COST = 0.15
#: Steps of a score in the tables that calibration sums.
STEP = 0.01
#: A segment is a toxic passage if fewer are expected by chance in a text of its length.
MAX_EXPECTED = 0.05
MAX_EXCESS = 50.0
THRESHOLD = 0.5
CACHED_WORDS = 200_000
_TOKEN = re.compile(r"[^\W_]+")


def bins_of(token: str) -> list[int]:
    forms = [token, *(f"{token[:k]}*" for k in PREFIXES if len(token) >= k)]
    return [xxhash.xxh64_intdigest(x) >> (64 - BITS) for x in forms]


def tokens(text: str) -> list[str]:
    return _TOKEN.findall(text.lower())


def log_odds(toxic: np.ndarray, clean: np.ndarray) -> np.ndarray:
    """Score of each bin: its log-odds ratio under an informative Dirichlet prior, above 0 for toxic, below 0 for clean texts.

    The prior spreads its weight over the bins as both classes together fill
    them, so rare bins shrink to even odds; and each log-odds ratio shrinks
    by its own standard error, to a half of it at HALF_Z errors.
    """
    both = toxic + clean
    n1, n0, total = max(1.0, toxic.sum()), max(1.0, clean.sum()), max(1.0, both.sum())
    weight = PRIOR * total
    prior = weight * both / total + 1e-3
    a, b = toxic + prior, clean + prior
    delta = np.log(a / np.maximum(n1 + weight - a, 1e-9)) - np.log(b / np.maximum(n0 + weight - b, 1e-9))
    sigma = np.sqrt(1 / a + 1 / b)
    return np.where(both > 0, delta**3 / (delta**2 + (HALF_Z * sigma) ** 2), 0.0)


class TokenScores(dict):
    """token -> its log-odds less COST; forgets all when it gets large.

    The log-odds are the largest of its bins' if one is above 0, else the
    least: a word isn't clean for a prefix that toxic words have too.
    """

    def __init__(self, table: np.ndarray) -> None:
        super().__init__()
        self.table = table

    def __missing__(self, token: str) -> float:
        if len(self) >= CACHED_WORDS:
            self.clear()
        own = [float(self.table[i]) for i in bins_of(token)]
        out = self[token] = (max(own) if max(own) > 0 else min(own)) - COST
        return out


def segments(scores: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (start, end, score), in one pass and order of the text.

    A segment joins the nearest earlier one whose sum before it is lower,
    if that makes the joint one better than either. Each segment keeps a link
    to that earlier one, past those it can never join; so a search never
    walks over a segment twice, and the pass is linear. Only positive scores
    start one, so runs of others cost one subtraction of prefix sums.
    """
    sums = np.concatenate([[0.0], np.cumsum(scores)])
    found: list[tuple[float, float, int, int, int]] = []  # sum before, sum after, start, end, link
    for i in np.flatnonzero(scores > 0).tolist():
        left, right, start, end = float(sums[i]), float(sums[i + 1]), i, i + 1
        j = len(found) - 1
        while True:
            while j >= 0 and found[j][0] >= left:
                j = found[j][4]
            if j < 0 or found[j][1] >= right:
                found.append((left, right, start, end, j))
                break
            left, _, start, _, link = found[j]
            del found[j:]
            j = link
    return [(s, e, r - le) for le, r, s, e, _ in found]


@dataclass
class Model:
    table: np.ndarray
    rate: float = 1.0  # lambda and log K of the extreme-value law of the best score by chance
    log_k: float = 0.0
    slope: float = 1.0
    bias: float = -1.0

    def excess(self, scores: np.ndarray) -> tuple[float, list[tuple[int, int, float]]]:
        """Sum of the significant segments' bits beyond chance, and those segments."""
        n, total, kept = max(1, len(scores)), 0.0, []
        for s, e, x in segments(scores):
            beyond = self.rate * x - self.log_k - math.log(n)
            if beyond >= -math.log(MAX_EXPECTED):
                total += beyond
                kept.append((s, e, x))
        return total, kept

    def probability(self, excess: float) -> float:
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, self.slope * min(excess, MAX_EXCESS) + self.bias))))


def _scored(text: str, cache: TokenScores) -> np.ndarray:
    own = tokens(text)
    return np.fromiter(map(cache.__getitem__, own), np.float64, len(own))


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    count = np.zeros((2, 1 << BITS))
    for b in slices(batches):
        for text, label in zip(b["text"].to_pylist(), b["label"].to_pylist(), strict=True):
            # once a document, so that one long or repetitive text doesn't make its words toxic
            seen = {i for t in set(tokens(text)) for i in bins_of(t)}
            count[1 if label else 0, list(seen)] += 1
    for label in (0, 1):
        at = np.flatnonzero(count[label])
        if len(at):
            yield pa.RecordBatch.from_arrays(
                [pa.array(at.astype(np.int32)), pa.array(np.full(len(at), label, np.int32)), pa.array(count[label][at])], ["bin", "label", "n"]
            )


def _chance(table: Shipped):
    """A mapInArrow function over clean texts: how many segments have each score (in STEPs), and how many tokens there are (at -1)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache, seen = TokenScores(table.value), Counter()
        for b in slices(batches):
            for text in b["text"].to_pylist():
                scores = _scored(text, cache)
                seen[-1] += len(scores)
                seen.update(round(x / STEP) for _, _, x in segments(scores))
        yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.int64()), pa.array(list(seen.values()), pa.int64())], ["at", "n"])

    return run


def _excesses(model: Shipped):
    """A mapInArrow function over texts (text, label): each label with the text's excess in STEPs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.value
        cache = TokenScores(m.table)
        for b in slices(batches):
            at = [round(min(MAX_EXCESS, m.excess(_scored(t, cache))[0]) / STEP) for t in b["text"].to_pylist()]
            yield pa.RecordBatch.from_arrays([b["label"], pa.array(at, pa.int64())], ["label", "at"])

    return run


def calibrate_chance(model: Model, counts: dict[int, int]) -> Model:
    """Fits the extreme-value law of scores by chance on counts of clean texts' segments by score, and of their tokens at -1.

    Segments by chance: K of them a token, the scores of the better half
    exponential, so the best of a text is extreme-value distributed. Two
    quantiles give the rate, as a few mislabelled texts don't move them.
    """
    length, total = counts.get(-1, 0), sum(n for at, n in counts.items() if at >= 0)
    if length:
        ats = sorted(k for k in counts if k >= 0)
        upto = np.cumsum([counts[k] for k in ats])
        half, most = (ats[int(np.searchsorted(upto, q * total))] * STEP if total else 0.0 for q in (0.5, 0.95))
        model.rate = float(np.clip(math.log(0.5 / 0.05) / max(most - half, STEP), 0.2, 5.0)) if total else 5.0
        model.log_k = math.log(max(total / 2, 0.5) / length) + model.rate * half
    return model


def calibrate_link(model: Model, counts: list[tuple[int, int, int]]) -> Model:
    """Fits the logistic link from a text's excess to a probability on counts (label, excess in STEPs, texts)."""
    t = np.array([at * STEP for _, at, _ in counts])
    y, n = np.array([1.0 if label else 0.0 for label, _, _ in counts]), np.array([float(k) for _, _, k in counts])
    if len(set(y.tolist())) == 2:
        w = np.zeros(2)
        x = np.stack([t, np.ones_like(t)], 1)
        for _ in range(50):  # Newton's method with a small ridge
            p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
            h = (x * (n * p * (1 - p))[:, None]).T @ x + 0.1 * np.eye(2)
            w -= np.linalg.solve(h, x.T @ (n * (p - y)) + 0.1 * w)
        model.slope, model.bias = max(1e-3, float(w[0])), float(w[1])
    return model


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", max_rows: int = MAX_TRAINING_ROWS) -> Model:
    """A model from a bounded sample of labelled training rows.

    Three quarters of it give the token counts, summed by bin (at most
    2**BITS of them); the rest the calibration, as counts of scores in steps,
    summed by executors too. Without labelled rows every text scores the same.
    """
    drawn = sample(docs, labels, label, max_rows)
    for_scores = F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(4)) > 0
    count = np.zeros((2, 1 << BITS))
    by_bin = drawn.where(for_scores).select("text", "label").mapInArrow(_counts, "bin int, label int, n double")
    summed = by_bin.groupBy("bin").agg(*(F.sum(F.when(F.col("label") == k, F.col("n")).otherwise(0.0)).alias(f"n{k}") for k in (0, 1)))
    for b in summed.toArrow().to_batches():
        at = b["bin"].to_numpy()
        count[0, at], count[1, at] = b["n0"].to_numpy(), b["n1"].to_numpy()
    model = Model(log_odds(count[1], count[0]).astype(np.float32))
    rest = drawn.where(~for_scores).select("text", "label")
    chance = rest.where("label = 0").select("text").mapInArrow(_chance(Shipped(docs.sparkSession, model.table)), "at long, n long")
    model = calibrate_chance(model, {r["at"]: r["n"] for r in chance.groupBy("at").agg(F.sum("n").alias("n")).collect()})
    found = rest.mapInArrow(_excesses(Shipped(docs.sparkSession, model)), "label int, at long").groupBy("label", "at").count()
    return calibrate_link(model, sorted((r["label"], r["at"], r["count"]) for r in found.collect()))


def score(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score (0 to 1, higher: likelier toxic), predicted and the toxic passages, one row per row of docs.

    passages: (start, end) in tokens, maximal runs of letters and digits, and the score of each significant segment.
    A null text counts as empty and has none. Other columns of docs are
    ignored; an empty table gives an empty result.
    """
    shipped = Shipped(docs.sparkSession, model)
    passage = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shipped.value
        cache = TokenScores(m.table)

        def work(b: pa.RecordBatch) -> pa.RecordBatch:
            scores, passages = [], []
            for text in b["text"].to_pylist():
                excess, kept = m.excess(_scored(text or "", cache))
                scores.append(m.probability(excess))
                passages.append([{"start": s, "end": e, "score": x} for s, e, x in kept])
            return pa.RecordBatch.from_arrays(
                [b["doc_id"], b["held_out"], pa.array(scores, pa.float64()), pa.array(passages, passage)], ["doc_id", "held_out", "score", "passages"]
            )

        yield from by_slice(work)(batches)

    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", (crc_fold(F.col("doc_id")) == 0).alias("held_out"), F.col("text").cast("string").alias("text"))
    out = rows.mapInArrow(run, f"doc_id {kind}, held_out boolean, score double, passages array<struct<start:int,end:int,score:double>>")
    return out.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


cloudpickle.register_pickle_by_value(sys.modules[__name__])
