"""Operator 10: text quality by Naive Bayes support vectors.

Features are indicators of runs of one to three token shapes (classes of characters with repeats
collapsed; "=" for a token that repeats the one before). An indicator is scaled by its class
log-count ratio, rows are scaled to length 1, and a linear hinge-loss model is fitted by dual coordinate
descent; a logistic curve over its margin gives the score.

The model has the `features` (30,000) commonest runs of the sample, which bounds what is broadcast, and dual descent runs over the sample on the driver. Very
long texts are scored whole; equal texts have equal scores.

The model is fitted on at most `most` labelled rows (a documented bound), never on held-out ones. Null and empty texts
have only the constant feature. If one of the labels is missing, every score is the share of label 1, or 0.5
without labels. Null doc_id: not held out. Repeated rows are scored each. An empty table gives no rows. Other columns don't matter.
"""

from __future__ import annotations

import hashlib
import math
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veritab.llm.common import batch, table, typed
from veritab.llm.labelled import feature_counts, sample_labelled, sparse_rows
from veritab.llm.wordhash import bounded, utf8

_CLASSES = bytes(97 if 97 <= i <= 122 or i >= 128 else 65 if 65 <= i <= 90 else 48 if 48 <= i <= 57 else i for i in range(256))
_REPEAT = re.compile(rb"([aA0])\1+")


def shape_ngrams(text: bytes) -> set[bytes]:
    tokens, shapes = text.split(), _REPEAT.sub(rb"\1", text.translate(_CLASSES)).split()
    # a long shape goes by its digest, which stands for all of it
    shapes = [b"=" if t == before else s if len(s) <= 16 else hashlib.blake2b(s, digest_size=8).digest() for t, before, s in zip(tokens, [None, *tokens], shapes)]
    out = set(shapes)
    out.update(map(b" ".join, zip(shapes, shapes[1:])))
    out.update(map(b" ".join, zip(shapes, shapes[1:], shapes[2:])))
    return out


def dual_coordinate_descent(rows: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, n: int, cost: np.ndarray, epochs: int, seed: int, tolerance: float = 1e-3) -> np.ndarray:
    """Weights of a linear model with hinge loss and an L2 penalty; rows: (feature numbers, values), y: 1 or -1.

    Minimises |w|^2 / 2 + sum of cost * max(0, 1 - y * w.x). Rows of zeros don't change the weights.
    """
    w, alpha, rng = np.zeros(n), np.zeros(len(rows)), np.random.default_rng(seed)
    square = [float(v @ v) for _, v in rows]
    for _ in range(epochs):
        most = 0.0
        for i in rng.permutation(len(rows)):
            if not square[i]:
                continue
            at, v = rows[i]
            g = y[i] * (w[at] @ v) - 1
            a = min(max(alpha[i] - g / square[i], 0.0), cost[i])
            if a != alpha[i]:
                w[at] += (a - alpha[i]) * y[i] * v
                most = max(most, abs(a - alpha[i]))
                alpha[i] = a
        if most < tolerance:
            break
    return w


def logistic_fit(margin: np.ndarray, y: np.ndarray, rounds: int = 50) -> tuple[float, float]:
    """a, b of the curve 1 / (1 + exp(-(a * margin + b))), by Newton steps with a small penalty."""
    x, p = np.stack([margin, np.ones_like(margin)], 1), np.zeros(2)
    for _ in range(rounds):
        q = 1 / (1 + np.exp(-np.clip(x @ p, -35, 35)))
        grad = x.T @ (q - y) + 1e-2 * p
        step = np.linalg.solve((x * (q * (1 - q))[:, None]).T @ x + 1e-2 * np.eye(2), grad)
        p = p - np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return float(p[0]), float(p[1])


class QualityModel:
    def __init__(self, ratio: dict[bytes, tuple[int, float]], weights: np.ndarray, slope: float, offset: float):
        self.known = {f: (k, r) for f, (k, r) in ratio.items()}
        self.weights, self.slope, self.offset = weights, slope, offset

    def vector(self, text: bytes) -> tuple[np.ndarray, np.ndarray]:
        known = self.known
        found = sorted(known[f] for f in shape_ngrams(text) if f in known)
        at = np.array([k for k, _ in found] + [len(known)], np.int64)
        v = np.array([r for _, r in found] + [1.0])
        return at, v / math.sqrt(float(v @ v))

    def score(self, text: bytes) -> float:
        if not len(self.weights):
            return self.offset
        at, v = self.vector(text)
        z = self.slope * float(self.weights[at] @ v) + self.offset
        return 1 / (1 + math.exp(-max(-35.0, min(35.0, z))))


def fit_quality(docs: DataFrame, labels: DataFrame, where: Column | None = None, most: int = 20_000, least: int = 3, features: int = 30_000, cost: float = 1.0, epochs: int = 20, seed: int = 20240613) -> QualityModel:
    sample = sample_labelled(docs, labels, "quality", most, where)
    n = {r.label: r["count"] for r in sample.groupBy("label").count().collect()}
    n0, n1 = n.get(0, 0), n.get(1, 0)
    if not n0 or not n1:
        return QualityModel({}, np.zeros(0), 0.0, n1 / (n0 + n1) if n0 + n1 else 0.5)
    counts = feature_counts(sample, shape_ngrams, least, features)
    ratio = {f: (k, math.log((b + 1) / (n1 + 2)) - math.log((a + 1) / (n0 + 2))) for k, (f, a, b) in enumerate(counts)}
    model = QualityModel(ratio, np.zeros(1), 0.0, 0.0)

    def vector(text):
        at, v = model.vector(text)
        return at.tolist(), v.tolist()

    made = sparse_rows(sample, vector)
    y = np.array([1.0 if label else -1.0 for label, _, _ in made])
    rows = [(np.array(at), np.array(v)) for _, at, v in made]
    # both classes weigh the same
    each = np.where(y > 0, len(y) / (2 * n1), len(y) / (2 * n0)) * cost
    w = dual_coordinate_descent(rows, y, len(ratio) + 1, each, epochs, seed)
    a, b = logistic_fit(np.array([w[at] @ v for at, v in rows]), (y > 0).astype(float))
    return QualityModel(ratio, w, a, b)


def held_out(doc_id: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


_SCORE = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("score", pa.float64()), ("predicted", pa.int32())])


def score_quality(docs: DataFrame, model: QualityModel, threshold: float = 0.7) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(model)  # at most `features` entries
    d = typed(docs, doc_id="long", text="string").select("doc_id", held_out().alias("held_out"), "text")

    def run(batches):
        m = shared.value
        for b in bounded(batches):
            data, offsets = utf8(b.column(2))
            raw, at = data.tobytes(), offsets.tolist()
            scores = [m.score(raw[i:j]) for i, j in zip(at, at[1:])]
            yield batch(_SCORE, [b.column(0), b.column(1), scores, [int(s >= threshold) for s in scores]])

    return d.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def op10_nbsvm_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score_quality(docs, fit_quality(docs, table(spark, sf_dir, "labels"), ~held_out()))
