from collections import defaultdict

import pytest

from tests.llm.helpers import WORD, documents, none, rows
from veritab.llm import mix_sources


def shares(sizes):
    """Targets by filling up, round after round."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    weight = {s: i % 3 + 1 for i, s in enumerate(names)}
    out, rest, open_ones = {}, float(sum(sizes.values())), set(names)
    while True:
        total = sum(weight[s] for s in open_ones)
        full = [s for s in open_ones if rest * weight[s] / total > 3 * sizes[s]]
        if not full:
            return out | {s: rest * weight[s] / total for s in open_ones}
        for s in full:
            out[s] = 3.0 * sizes[s]
            open_ones.discard(s)
        rest -= sum(out[s] for s in full)


def test_targets_and_words_taken(spark):
    docs = documents(spark)
    got = mix_sources.mix(docs, bucket_rows=7, fan_in=3).collect()
    sizes = defaultdict(int)
    for d, t, _, s, *_ in rows():
        sizes[s] += len(WORD.findall(t or ""))
    want = shares(sizes)
    taken, largest = defaultdict(int), defaultdict(int)
    for r in got:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(want[r.source])
        assert 0 <= r.copies <= 3 and r.taken == r.copies * r.size
        taken[r.source] += r.taken
        largest[r.source] = max(largest[r.source], r.size)
    assert len(got) == len(rows())
    assert all(abs(taken[s] - want[s]) <= largest[s] for s in want)
    again = mix_sources.mix(docs.repartition(5), bucket_rows=7, fan_in=3).collect()
    key = lambda r: tuple(str(x) for x in r)
    assert sorted(map(key, got)) == sorted(map(key, again))


def test_near_the_targets(spark):
    """A source with one document of half its words, and the tables: within 1 % of each target."""
    import random

    rng = random.Random(7)
    docs = [(i, f"s{i % 3}", "w " * (rng.randint(1, 400) if i > 2 else 15_000)) for i in range(600)]
    made = spark.createDataFrame(docs, "doc_id long, source string, text string")
    for df in (made, spark.read.parquet("/root/testdata/sf0.1/documents.parquet")):
        got = mix_sources.mix(df).groupBy("source").agg({"target": "max", "taken": "sum"}).collect()
        for r in got:
            assert abs(r["sum(taken)"] - r["max(target)"]) <= 0.01 * r["max(target)"], r


def test_expectations_hold(spark):
    """Over many seeds each document is taken as often as its source's target asks for, large ones too."""
    docs = spark.createDataFrame([(i, "ab"[i % 2], "w " * (4000 if i < 2 else 20 + i)) for i in range(300)], "doc_id long, source string, text string")
    took = defaultdict(list)
    for seed in range(6):
        for r in mix_sources.mix(docs, seed=seed).collect():
            took[r.source, r.size > 1000].append(r.copies - r.target / r.source_size)
    assert all(abs(sum(v) / len(v)) < (0.5 if large else 0.04) for (_, large), v in took.items())


def test_limit_reshares(spark):
    d = spark.createDataFrame([(1, "a", "a a"), (2, "b", "b " * 30), (3, "c", "c"), (4, "d", None)], "doc_id long, source string, text string")
    got = {r.source: r.target for r in mix_sources.mix(d).collect()}
    assert got == pytest.approx(shares({"a": 2, "b": 30, "c": 1, "d": 0}))
    assert mix_sources.mix(none(spark)).count() == 0


def test_settle_keeps_the_words():
    import random

    rng = random.Random(3)
    size, part = [rng.randint(1, 90) for _ in range(500)], [rng.random() for _ in range(500)]
    before, p = sum(a * b for a, b in zip(size, part)), list(part)
    states, open_one = mix_sources.settle(size, p, [rng.random() for _ in size])
    assert sum(s < 0 for s in states) <= 1
    assert sum(a * (p[i] if s < 0 else s) for i, (a, s) in enumerate(zip(size, states))) == pytest.approx(before)
    # a fraction of 0.3 ends at 1 three times in ten
    mean = sum(mix_sources.settle([3, 7], [0.3, 0.6], [0, rng.random()])[0][0] == 1 for _ in range(4000)) / 4000
    assert 0.27 < mean < 0.33
