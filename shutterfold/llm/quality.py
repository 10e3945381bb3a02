"""Quality classifier: Bradley-Terry pairwise ranking.

Every document gets a feature vector from its whole text: frequencies of
characters and word statistics.  Preference pairs (a document of label 1 over
one of label 0) train linear scores by logistic loss on feature differences;
a quantile of the training scores is the threshold, and scores are mapped to
0..1 so that the threshold falls on ``CUT``.

Fitting takes at most ``MAX_LABELLED`` labelled rows, chosen by a hash of
their ids, and ``PAIRS`` pairs drawn from them; these are the only limits, and
scoring reads every text, however long.  A document labelled 0 and 1 counts as
1.  Null and empty texts get the score of an all-zero vector with length zero.
Repeated rows score alike, ties in score fall on the same side of the
threshold.  Without labels of both kinds every document scores 0.5; an
empty table gives no rows.  Other columns pass through, one named like ``out``
is replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textarrays

CUT = 0.3
MAX_LABELLED = 4000
PAIRS = 24000
N_FEATURES = 128 + 8


def features(texts: pa.Array | pa.ChunkedArray) -> Iterator[np.ndarray]:
    """Feature rows (documents x N_FEATURES, float32) for runs of documents, in order."""
    for _, _, data, offsets in textarrays.chunks(texts):
        docs = len(offsets) - 1
        size = np.diff(offsets)
        doc = np.repeat(np.arange(docs), size)
        counts = np.bincount(doc * 128 + np.minimum(data, 127), minlength=docs * 128).reshape(docs, 128)
        words = textarrays.Words(data, offsets)
        hashes = words.hashes()
        n_words = np.diff(words.first)
        of = np.repeat(np.arange(docs), n_words)
        per_word = 1.0 / np.maximum(n_words, 1)
        again = np.zeros(len(hashes), bool)
        again[1:] = (hashes[1:] == hashes[:-1]) & (of[1:] == of[:-1])
        order = np.lexsort((hashes, of))
        repeat = np.zeros(len(hashes), bool)
        repeat[1:] = (hashes[order][1:] == hashes[order][:-1]) & (of[order][1:] == of[order][:-1])
        last = data[words.end - 1] if len(words.end) else np.empty(0, np.uint8)
        odd_end = (last < 128) & ~(((last | 32) >= 97) & ((last | 32) <= 122)) & (last != 46) & (last != 44)
        length = (words.end - words.start).astype(float)
        total = lambda x: np.bincount(of, weights=x, minlength=docs)
        mean = total(length) * per_word
        rows = np.column_stack(
            [
                np.sqrt(counts / np.maximum(size, 1)[:, None]),
                np.log1p(size) / 10,
                np.log1p(n_words) / 10,
                mean / 10,
                np.sqrt(np.maximum(total(length * length) * per_word - mean * mean, 0)) / 10,
                total(again) * per_word,
                total(np.bincount(order, weights=repeat, minlength=len(hashes))) * per_word,
                total(odd_end) * per_word,
                counts[:, 10] * per_word,
            ]
        )
        yield rows.astype(np.float32)


@dataclass(frozen=True)
class Model:
    centre: np.ndarray
    weights: np.ndarray
    threshold: float
    slope: float

    def score(self, rows: np.ndarray) -> np.ndarray:
        raw = (rows.astype(np.float64) - self.centre) @ self.weights
        return 1 / (1 + np.exp(-np.clip(self.slope * (raw - self.threshold) + np.log(CUT / (1 - CUT)), -40, 40)))


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float, rounds: int = 25) -> np.ndarray:
    """Newton steps for logistic loss with an L2 penalty."""
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -40, 40)))
        grad = x.T @ (p - y) / len(y) + ridge * w
        hess = (x * (p * (1 - p))[:, None]).T @ x / len(y) + ridge * np.eye(len(w))
        step = np.linalg.solve(hess, grad)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    return w


def fit_rows(rows: np.ndarray, label: np.ndarray, pairs: int = PAIRS, seed: int = 7) -> Model:
    """Bradley-Terry scores from preference pairs, and the quantile that splits the labels best."""
    good, bad = rows[label == 1].astype(np.float64), rows[label == 0].astype(np.float64)
    if not len(good) or not len(bad):
        width = rows.shape[1] if rows.ndim == 2 and rows.shape[1] else N_FEATURES
        return Model(np.zeros(width), np.zeros(width), -np.log((1 - CUT) / CUT), 1.0)
    spread = np.maximum(rows.astype(np.float64).std(axis=0), 1e-3)
    pick = np.random.default_rng(seed)
    diff = (good[pick.integers(len(good), size=pairs)] - bad[pick.integers(len(bad), size=pairs)]) / spread
    sign = np.where(np.arange(pairs) % 2 == 0, 1.0, -1.0)
    weights = _logistic(diff * sign[:, None], (sign > 0).astype(float), 1e-3) / spread
    centre = good.mean(axis=0)
    up, down = (good - centre) @ weights, (bad - centre) @ weights
    raw = np.concatenate([up, down])
    grid = np.quantile(raw, np.linspace(0.005, 0.995, 400))
    found = [(np.mean(up >= t) + np.mean(down < t), t) for t in grid]
    best = max(f for f, _ in found)
    threshold = float(np.median([t for f, t in found if f >= best - 1e-9]))
    side = np.concatenate([np.full(len(up), 0.5 / len(up)), np.full(len(down), 0.5 / len(down))])
    slope = min(20.0, max(0.05, 2.0 / max(1e-6, float(np.sqrt(np.sum(side * (raw - threshold) ** 2))))))
    return Model(centre, weights, threshold, slope)


def fit(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED) -> Model:
    """Trains on a bounded, hash-chosen sample of the labelled rows that the caller passes."""
    sample = (
        labels.where("doc_id is not null and quality in (0, 1)")
        .groupBy("doc_id")
        .agg(F.max("quality").alias("label"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(max_labelled)
    )

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for part in features(batch["text"]):
                yield pa.RecordBatch.from_arrays(
                    [batch["label"][at : at + len(part)].cast(pa.int32()), pa.array([x.tobytes() for x in part], pa.binary())], ["label", "x"]
                )
                at += len(part)

    found = (
        docs.select("doc_id", "text")
        .join(F.broadcast(sample), "doc_id")  # at most max_labelled short rows
        .select("label", "text")
        .mapInArrow(rows, "label int, x binary")
        .collect()
    )
    found.sort(key=lambda r: (r["label"], bytes(r["x"])))
    x = np.array([np.frombuffer(r["x"], np.float32) for r in found]).reshape(len(found), N_FEATURES)
    return fit_rows(x, np.array([r["label"] for r in found]))


def score(docs: DataFrame, model: Model, text: str = "text", out: str = "score") -> DataFrame:
    """Adds ``out double`` from the whole text and nothing else."""

    @F.arrow_udf("double")
    def scored(texts: pa.Array) -> pa.Array:
        parts = [model.score(x) for x in features(texts)]
        return pa.array(np.concatenate(parts) if parts else np.empty(0))

    return docs.withColumn(out, scored(F.col(text)))


def held_out(doc_id: str = "doc_id"):
    """Rows that training must not see."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 5 == 0, F.lit(True))


def trained(docs: DataFrame, labels: DataFrame) -> Model:
    """The production model: labels of the training folds only."""
    return fit(docs, labels.where(~held_out()))
