import hashlib
import random

import numpy as np
import pytest

from tests.llm.helpers import WORD, documents, none, rows, text
from veritab.llm import substring_dedup as sd


def brute(docs, window=50):
    first = {}
    for d, t in docs:
        w = WORD.findall(t or "")
        for i in range(len(w) - window + 1):
            k, d2 = tuple(w[i : i + window]), sd._LAST if d is None else d
            first[k] = min(first.get(k, d2), d2)
    out = []
    for d, t in docs:
        w, d2 = WORD.findall(t or ""), sd._LAST if d is None else d
        gone = {j for i in range(len(w) - window + 1) if first[tuple(w[i : i + window])] < d2 for j in range(i, i + window)}
        kept = [x for j, x in enumerate(w) if j not in gone]
        out.append((d, len(w), len(gone), hashlib.sha256(" ".join(kept).encode()).hexdigest()))
    return out


def key(r):
    return tuple(str(x) for x in r)[:4]


@pytest.mark.parametrize("most", [5_000, 1])
def test_against_all_windows(spark, most):
    got = sd.without_repeats(documents(spark), most=most, shard_contents=5).collect()
    assert sorted(map(key, got)) == sorted(map(key, brute([r[:2] for r in rows()])))
    assert sd.without_repeats(none(spark)).count() == 0


def test_shared_passages_and_repeating_texts(spark):
    rng = random.Random(4)
    parts = [text(rng, 70) for _ in range(4)] + ["la " * 90, "do re " * 50]
    docs = [(i, " ".join(rng.choice(parts) if rng.random() < 0.5 else text(rng, 30) for _ in range(4))) for i in range(40)]
    got = sd.without_repeats(spark.createDataFrame(docs, "doc_id long, text string"), with_text=True).collect()
    assert sorted(map(key, got)) == sorted(map(key, brute(docs)))
    assert all(hashlib.sha256(r.text.encode()).hexdigest() == r.kept_sha256 for r in got)


@pytest.mark.parametrize("window", [10, 64, 100])
def test_windows_of_other_sizes(spark, window):
    rng = random.Random(window)
    parts = [text(rng, window + rng.randint(0, 30)) for _ in range(4)] + ["la " * (2 * window)]
    docs = [(i, " ".join(rng.choice(parts) if rng.random() < 0.6 else text(rng, 15) for _ in range(4))) for i in range(30)]
    got = sd.without_repeats(spark.createDataFrame(docs, "doc_id long, text string"), window=window).collect()
    assert sorted(map(key, got)) == sorted(map(key, brute(docs, window)))


def test_seeds_beyond_the_window(spark):
    with pytest.raises(ValueError):
        sd.without_repeats(none(spark), window=5, seed=8)


def test_index_ranges():
    rng = np.random.default_rng(1)
    for _ in range(20):
        text_ = np.append(rng.integers(1, 5, 40), 0)
        index = sd.FmIndex(text_, 5)
        for n in (1, 2, 3, 5):
            i = int(rng.integers(0, 35))
            low, high = np.array([0]), np.array([len(text_)])
            for c in text_[i : i + n][::-1]:
                low, high = index.extend(np.array([c]), low, high)
            at = {k for k in range(len(text_)) if text_[k : k + n].tolist() == text_[i : i + n].tolist()}
            assert set(index.sa[low[0] : high[0]].tolist()) == at
