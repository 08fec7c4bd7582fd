import math
import random
import re
from collections import Counter

import pytest

from tests.llm.helpers import LOWER, documents, none, rows
from veritab.llm import tiered_search as ts

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(t):
    return TERM.findall((t or "").translate(LOWER))


def brute(docs, items, top=50):
    bags = [(i, Counter(terms(t))) for i, t in docs if terms(t)]
    n, total = len(bags), sum(b.total() for _, b in bags)
    df = Counter(t for _, b in bags for t in b)
    out = []
    for item, text in items:
        scored = []
        for i, b in bags:
            m = 100 - 50 + 50 * b.total() * n // total
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * b[t] // (1000 * b[t] + 20 * m)) for t in set(terms(text)) if b[t])
            if s:
                scored.append((-s, i is None, i or 0))
        out += [(item, k, None if gone else i, -s) for k, (s, gone, i) in enumerate(sorted(scored)[:top], 1)]
    return sorted(out, key=str)


def found(df):
    return sorted(((r.item_id, r["rank"], r.doc_id, r.score) for r in df.collect()), key=str)


def items(rng):
    texts = [r[1] for r in rows() if r[1] and len(r[1].split()) > 40]
    out = [(k, " ".join(rng.choice(texts).split()[:n])) for k, n in enumerate((1, 5, 30, 60, 3000))]
    return out + [(7, "TWO words"), (7, "TWO words"), (None, "a b c one"), (9, None), (10, ""), (11, "nowhere-found zzzzzz"), (12, "ça été là, same SAME")]


@pytest.mark.parametrize(("top", "postings", "most", "block"), [(50, 1_000_000, 200, 300_000), (3, 300, 10, 40), (1, 2000, 200, 5), (2, 500, 0, 300_000)])
def test_documents(spark, top, postings, most, block):
    asked = items(random.Random(1))
    bench = spark.createDataFrame([(*i, "x", 1) for i in asked], "item_id long, text string, item string, score int")
    want = brute([(r[0], r[1]) for r in rows()], asked, top)
    assert found(ts.ranked_search(documents(spark).repartition(3), bench, top, postings, most, block)) == want


def test_proofs(spark):
    """Items of rare terms end at the first tier, items of common ones fall through; both are exact."""
    rng = random.Random(3)
    words = [f"w{k}" for k in range(40)]
    docs = [(k, " ".join(rng.choices(words, [1 / (j + 1) for j in range(40)], k=rng.randint(5, 60))) + (" rare" * (k % 7) if k % 50 == 0 else "")) for k in range(2000)]
    asked = [(0, "rare"), (1, "rare w0"), (2, " ".join(words)), (3, "w1 w2"), (4, "w39 rare")]
    d, q = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(asked, "item_id long, text string")
    read = []
    original = ts._exact
    try:
        ts._exact = lambda paths: read.append(len(paths)) or original(paths)
        assert found(ts.ranked_search(d, q, 4, 3000)) == brute(docs, asked, 4)
    finally:
        ts._exact = original
    assert read, "no item was proven before the last tier"


def test_empty(spark):
    bench = spark.createDataFrame([(1, "a b c one")], "item_id long, text string")
    assert ts.ranked_search(none(spark), bench).count() == 0
    assert ts.ranked_search(documents(spark), bench.where("false")).count() == 0
    assert ts.ranked_search(documents(spark), spark.createDataFrame([(1, None)], "item_id long, text string")).count() == 0


def test_all_terms(spark):
    index = ts.build_index(documents(spark), None, 1000)
    bags = [Counter(terms(r[1])) for r in rows() if terms(r[1])]
    assert (index.documents, index.words) == (len(bags), sum(b.total() for b in bags))
    assert sum(sum(r.df) for r in index.shards.collect()) == sum(map(len, bags))
