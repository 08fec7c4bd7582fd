import math
import random
import zlib

import numpy as np
import pytest

from tests.llm.helpers import documents, none, rows, text
from veritab.llm import quality, toxicity
from veritab.llm.labelled import sample_labelled

BAD = ["vilest", "wretched", "rotten", "filthy", "awful"]


def corpus(n=500):
    rng = random.Random(9)
    docs, labels = [], []
    for i in range(n):
        good, toxic, ws = rng.random() < 0.8, rng.random() < 0.25, text(rng, rng.randint(20, 60)).split()
        if toxic:
            for _ in range(rng.randint(1, 8)):
                ws.insert(rng.randrange(len(ws)), rng.choice(BAD))
        docs.append((i, " ".join(ws) if good else " ".join(w.upper() + "###" for w in ws)))
        labels.append((i, int(good), int(toxic)))
    return docs, labels


@pytest.fixture(scope="module")
def labelled(spark):
    docs, labels = corpus()
    return spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), docs, labels


def test_quality_on_held_out_rows(spark, labelled):
    docs, labels, raw, known = labelled
    got = {r.doc_id: r for r in quality.score_quality(docs, quality.fit_quality(docs, labels, ~quality.held_out())).collect()}
    assert len(got) == len(raw)
    truth = {d: q for d, q, _ in known}
    out = [d for d, r in got.items() if r.held_out]
    assert set(out) == {d for d in truth if zlib.crc32(str(d).encode()) % 4 == 2}
    assert np.mean([got[d].predicted == truth[d] for d in out]) >= 0.95
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in got.values())


def test_held_out_labels_are_not_learnt(spark, labelled):
    docs, labels, *_ = labelled
    wrong = labels.selectExpr("doc_id", "CASE WHEN crc32(CAST(CAST(doc_id AS STRING) AS BINARY)) % 4 = 2 THEN 1 - quality ELSE quality END AS quality")
    a, b = (sorted(map(tuple, quality.score_quality(docs, quality.fit_quality(docs, x, ~quality.held_out())).collect())) for x in (labels, wrong))
    assert a == b


def test_toxicity(spark, labelled):
    docs, labels, raw, known = labelled
    model = toxicity.fit_toxicity(docs, labels)
    got = {r.doc_id: r for r in toxicity.grade_toxicity(docs, model).collect()}
    truth = {d: t for d, _, t in known}
    assert np.mean([got[d].toxic == truth[d] for d in truth]) >= 0.95
    one, many = model.above(b"vilest") , model.above(b"vilest wretched Rotten! filthy### awful vilest rotten")
    assert (one <= many).all() and many.sum() > 1.5 and (np.diff(many) <= 0).all() and (np.diff(model.cuts) > 0).all()
    kept = {r.doc_id for r in toxicity.without_toxic(docs, model).collect()}
    assert kept == {d for d, r in got.items() if not r.toxic}


def test_odd_tables(spark, labelled):
    docs, labels, *_ = labelled
    qm, tm = quality.fit_quality(docs, labels), toxicity.fit_toxicity(docs, labels)
    assert quality.score_quality(documents(spark), qm).count() == len(rows())
    assert toxicity.grade_toxicity(documents(spark), tm).count() == len(rows())
    assert quality.score_quality(none(spark), qm).count() == toxicity.grade_toxicity(none(spark), tm).count() == 0
    empty = labels.where("false")
    assert {r.score for r in quality.score_quality(docs, quality.fit_quality(docs, empty)).collect()} == {0.5}
    assert {r.severity for r in toxicity.grade_toxicity(docs, toxicity.fit_toxicity(docs, empty)).collect()} == {0.0}
    odd = spark.createDataFrame([(0, 1), (0, 0), (1, None), (None, 1), (2, 7), (3, 1)], "doc_id long, quality int")
    assert sorted(r.label for r in sample_labelled(docs, odd, "quality", 100).collect()) == [0, 1]


def test_dual_coordinate_descent_reaches_the_optimum():
    """Rows of any length; the dual gap bounds the distance to the optimum."""
    rng = np.random.default_rng(1)
    x = rng.standard_normal((200, 3)) * rng.uniform(0.2, 5, (200, 1))
    x[7] = 0
    y = np.where(x @ np.array([1.0, -2.0, 0.5]) >= 0, 1.0, -1.0)
    cost = rng.uniform(0.5, 2, 200)
    w = quality.dual_coordinate_descent([(np.arange(3), r) for r in x], y, 3, cost, 3000, 1, tolerance=1e-10)
    assert np.mean(np.where(x @ w >= 0, 1, -1) == y) > 0.97

    def loss(w):
        return w @ w / 2 + cost @ np.maximum(0, 1 - y * (x @ w))

    # plain subgradient steps, which know nothing of the dual, find nothing better
    best, v = loss(w), w.copy()
    for t in range(1, 20_001):
        active = y * (x @ v) < 1
        v = v - (v - (cost * y * active) @ x) / (50 + t)
        assert loss(v) >= best - 1e-6
    assert loss(v) < best * 1.05
    for _ in range(300):
        assert loss(w + rng.standard_normal(3) * 10.0 ** rng.uniform(-6, 0)) >= best - 1e-9


def likelihood(rows, grade, w, cuts, penalty):
    out = 0.0
    for (at, v), g in zip(rows, grade):
        s = sum(w[k] * x for k, x in zip(at, v))
        below = [0.0, *(1 / (1 + math.exp(s - c)) for c in cuts), 1.0]
        out -= math.log(below[g + 1] - below[g]) / len(rows)
    return out + penalty * sum(x * x for x in w) / 2


def test_cumulative_link_fit_reaches_the_optimum():
    """Against the likelihood in plain Python: no small change of a weight or of a cut makes it better."""
    rng = np.random.default_rng(3)
    x, true = rng.standard_normal((150, 4)), np.array([1.5, -1.0, 0.5, 0.0])
    noisy = x @ true + rng.logistic(size=150)
    grade = np.searchsorted([-0.5, 0.7, 1.9], noisy)
    rows = [(list(range(4)), r.tolist()) for r in x]
    w, cuts = toxicity.cumulative_link_fit(rows, grade, 4, penalty=1e-3, rounds=4000)
    best = likelihood(rows, grade, w, cuts, 1e-3)
    for k in range(7):
        for step in (0.05, -0.05, 0.3, -0.3):
            p = np.concatenate([w, cuts])
            p[k] += step
            if (np.diff(p[4:]) > 0).all():
                assert likelihood(rows, grade, p[:4], p[4:], 1e-3) >= best - 1e-7
    assert (np.sign(w[:3]) == np.sign(true[:3])).all() and best < likelihood(rows, grade, np.zeros(4), cuts, 1e-3)
