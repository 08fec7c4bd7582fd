"""Operator 7: toxicity grades by cumulative-link ordinal regression.

P(grade <= k) = 1 / (1 + exp(w . x - cut_k)) for grades 0 to 3: one weight for each word, shared by the
ordered cuts. x has 1 + log(count) for each known word of the text (lower case, digits, letters and characters beyond
ASCII). The expected severity is the sum of P(grade > k); a text with P(grade > 0) of at least `reject` is rejected.

Labels say only toxic or not. Grades above 0 are therefore made from the labelled toxic texts: by how many
of the words that mark toxic texts a text has, cut at thirds. The model is fitted on at most `most` labelled rows
(a documented bound); of copies and near copies among them only one counts when words are chosen, so that the ordinary words of a text
that was copied often don't become marks.

Words are counted over the sample, of which the 500,000 commonest are kept; the model has the `features` (5,000) that mark labels most, which bounds what
is broadcast. Very long texts are scored whole, and texts of one severity tie: no row's score depends on another's.

Null and empty texts have no features: their severity is that of the cuts alone. Without labelled toxic or
labelled clean texts every severity is 0. Repeated rows are scored each. An empty table gives no rows. Other columns don't matter.
"""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from veritab.llm.common import batch, table, typed
from veritab.llm.decontaminate import item_words
from veritab.llm.labelled import feature_counts, sample_labelled, sparse_rows
from veritab.llm.wordhash import bounded, utf8

GRADES = 4


class OrdinalModel:
    def __init__(self, known: dict[bytes, int], weights: np.ndarray, cuts: np.ndarray):
        self.known, self.weights, self.cuts = known, weights, cuts

    def vector(self, text: bytes) -> tuple[list[int], list[float]]:
        counts = Counter(filter(lambda k: k is not None, map(self.known.get, item_words(text))))
        at = sorted(counts)
        return at, [1 + math.log(counts[k]) for k in at]

    def above(self, text: bytes) -> np.ndarray:
        """P(grade > k) for k from 0."""
        if not len(self.cuts):
            return np.zeros(GRADES - 1)
        at, v = self.vector(text)
        s = float(self.weights[at] @ np.array(v)) if at else 0.0
        return 1 / (1 + np.exp(np.clip(self.cuts - s, -35, 35)))


def cumulative_link_fit(rows: list[tuple[list[int], list[float]]], grade: np.ndarray, n: int, penalty: float = 3e-5, rounds: int = 800, rate: float = 0.05) -> tuple[np.ndarray, np.ndarray]:
    """Weights and ascending cuts that minimise the mean negative log likelihood plus an L2 penalty (Adam over all rows)."""
    owner = np.repeat(np.arange(len(rows)), [len(a) for a, _ in rows])
    at = np.array([k for a, _ in rows for k in a], np.int64)
    value = np.array([v for _, x in rows for v in x])
    top = GRADES - 1
    share = np.array([(grade <= k).mean() for k in range(top)]).clip(1e-4, 1 - 1e-4)
    start = np.log(share / (1 - share))
    p = np.concatenate([np.zeros(n), [start[0]], np.log(np.diff(start).clip(1e-2))])
    m, v2 = np.zeros_like(p), np.zeros_like(p)
    for t in range(1, rounds + 1):
        w, gaps = p[:n], np.exp(p[n + 1 :])
        cuts = np.concatenate([[-np.inf], p[n] + np.concatenate([[0], np.cumsum(gaps)]), [np.inf]])
        s = np.bincount(owner, value * w[at], len(rows))
        hi, lo = cuts[grade + 1] - s, cuts[grade] - s
        a, b = 1 / (1 + np.exp(-hi.clip(-35, 35))), 1 / (1 + np.exp(-lo.clip(-35, 35)))
        a, b = np.where(np.isinf(hi), 1.0, a), np.where(np.isinf(lo), 0.0, b)
        like = (a - b).clip(1e-12)
        da, db = a * (1 - a) / like, b * (1 - b) / like
        g = np.zeros_like(p)
        g[:n] = np.bincount(at, value * ((da - db) / len(rows))[owner], n) + penalty * w
        by_cut = np.array([db[grade == k + 1].sum() - da[grade == k].sum() for k in range(top)]) / len(rows)
        g[n] = by_cut.sum()
        g[n + 1 :] = [by_cut[k + 1 :].sum() * gaps[k] for k in range(top - 1)]
        m, v2 = 0.9 * m + 0.1 * g, 0.999 * v2 + 0.001 * g * g
        p = p - rate * (m / (1 - 0.9**t)) / (np.sqrt(v2 / (1 - 0.999**t)) + 1e-8)
    return p[:n], p[n] + np.concatenate([[0], np.cumsum(np.exp(p[n + 1 :]))])


def fit_toxicity(docs: DataFrame, labels: DataFrame, most: int = 20_000, least: int = 3, features: int = 5_000) -> OrdinalModel:
    sample = sample_labelled(docs, labels, "toxic", most)
    one_each = sample.dropDuplicates(["cluster", "label"])
    n = {r.label: r["count"] for r in one_each.groupBy("label").count().collect()}
    n0, n1 = n.get(0, 0), n.get(1, 0)
    if not n0 or not n1:
        return OrdinalModel({}, np.zeros(0), np.zeros(0))
    counts = feature_counts(one_each, item_words, least, 500_000)
    # words of toxic texts beyond chance: the gain in log likelihood over the common rate exceeds the log of the words tried
    marks, rate = [], n1 / (n0 + n1)
    for f, a, b in counts:
        if b > rate * (a + b):
            gain = b * math.log(b / (a + b) / rate) + (a * math.log(a / (a + b) / (1 - rate)) if a else 0.0)
            if gain >= math.log(len(counts)) - 2 and b >= 2 * a:
                marks.append((gain, f))
    marks = [f for _, f in sorted(marks, reverse=True)[:features]]
    if not marks:
        return OrdinalModel({}, np.zeros(0), np.zeros(0))
    model = OrdinalModel({f: k for k, f in enumerate(marks)}, np.zeros(len(marks)), np.zeros(GRADES - 1))
    made = sparse_rows(one_each, model.vector)
    label = np.array([y for y, _, _ in made])
    hits = np.array([sum(math.exp(v - 1) for v in x) for _, _, x in made])
    grade = label * (1 + np.searchsorted(np.quantile(hits[label == 1], [1 / 3, 2 / 3]), hits))
    weights, cuts = cumulative_link_fit([(a, x) for _, a, x in made], grade.astype(int), len(marks))
    return OrdinalModel(model.known, weights, cuts)


_GRADE = pa.schema([("doc_id", pa.int64()), ("severity", pa.float64()), ("grade", pa.int32()), ("toxic", pa.int32())])


def grade_toxicity(docs: DataFrame, model: OrdinalModel, reject: float = 0.3) -> DataFrame:
    """doc_id, expected severity (0 to 3), likeliest grade by the median, and whether the text is rejected."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # at most `features` words
    d = typed(docs, doc_id="long", text="string")

    def run(batches):
        m = shared.value
        for b in bounded(batches):
            data, offsets = utf8(b.column(1))
            raw, at = data.tobytes(), offsets.tolist()
            p = np.array([m.above(raw[i:j]) for i, j in zip(at, at[1:])]).reshape(-1, GRADES - 1)
            yield batch(_GRADE, [b.column(0), p.sum(1), (p >= 0.5).sum(1), (p[:, 0] >= reject).astype(int)])

    return d.mapInArrow(run, "doc_id long, severity double, grade int, toxic int")


def without_toxic(docs: DataFrame, model: OrdinalModel, reject: float = 0.3) -> DataFrame:
    """The documents that aren't rejected, with all their columns."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    place = docs.columns.index("text")

    def run(batches):
        m = shared.value
        for b in bounded(batches):
            keep = [m.above((t or "").encode())[0] < reject for t in b.column(place).to_pylist()]
            yield b.filter(pa.array([bool(k) for k in keep], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def op7_toxicity_grades(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return grade_toxicity(docs, fit_toxicity(docs, table(spark, sf_dir, "labels")))
