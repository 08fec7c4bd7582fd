"""The cover search against all combinations, whole, capped, and dealt to any number of subtrees."""

import itertools
import random

import pytest

from veritab.operators import covers, mining


def brute(sigs, n, most):
    out = []
    for size in range(most + 1):
        for c in itertools.combinations(range(n), size):
            if all(set(s) & set(c) for s in sigs) and not any(set(b) < set(c) for b in out):
                out.append(c)
    return out


def packed(sigs):
    sigs = sorted({tuple(sorted(s)) for s in sigs}, key=lambda s: (len(s), s))
    n = max((p for s in sigs for p in s), default=-1) + 1
    return covers.Bitmaps([sum(1 << p for p in s) for s in sigs], [sum(1 << i for i, s in enumerate(sigs) if p in s) for p in range(n)])


def plain_search(sigs, most):
    """The same order without bit vectors, states or bounds: what the first clauses are."""
    sigs = sorted({tuple(sorted(s)) for s in sigs}, key=lambda s: (len(s), s))
    met = lambda p: {i for i, s in enumerate(sigs) if p in s}
    found = []

    def go(chosen, allowed):
        left = [i for i, s in enumerate(sigs) if not set(s) & set(chosen)]
        if not left:
            found.append(tuple(chosen))
            return
        if len(chosen) == most:
            return
        pivot = [p for p in sigs[left[0]] if p in allowed]
        allowed = allowed - set(pivot)
        for p in sorted(pivot, key=lambda p: (-len(met(p) & set(left)), p)):
            grown = [*chosen, p]
            if all(met(q) - set().union(*(met(r) for r in grown if r != q)) for q in grown):
                go(grown, allowed)
                allowed = allowed | {p}

    go([], set(p for s in sigs for p in s))
    return found


def test_search():
    rng = random.Random(1)
    for _ in range(400):
        n = rng.randint(1, 8)
        sigs = [rng.sample(range(n), rng.randint(0, n)) for _ in range(rng.randint(0, 9))]
        most = rng.randint(0, 5)
        maps = packed(sigs)
        found = maps.search(covers.Node((), (1 << len(maps.columns)) - 1), most, None)
        assert sorted(tuple(sorted(c)) for c in found) == sorted(brute(sigs, n, most))
        assert found == plain_search(sigs, most)
        for enough in (2, 5, 50):
            assert [c for x in maps.frontier(enough, most) for c in maps.search(x, most, None)] == found


@pytest.mark.parametrize("seed", range(4))
def test_first_covers(spark, seed):
    rng = random.Random(seed)
    sigs = [sorted(rng.sample(range(9), rng.randint(2, 6))) for _ in range(25)]
    d = spark.createDataFrame([(s, 1) for s in sigs + sigs[:3]], "sig array<int>, w long")
    want = [tuple(sorted(c)) for c in plain_search(sigs, 4)]
    assert sorted(tuple(r[0]) for r in mining.minimal_covers(d, 4).collect()) == sorted(want)
    for first in (1, 3, 1000):
        assert sorted(tuple(r[0]) for r in mining.minimal_covers(d, 4, first=first).collect()) == sorted(want[:first])


def test_bounds(spark):
    d = spark.createDataFrame([([k, k + 1],) for k in range(6)], "sig array<int>")
    with pytest.raises(ValueError, match="more than 5"):
        mining.minimal_covers(d, 2, most_signatures=5)
    assert mining.minimal_covers(d.where("false"), 2).collect()[0].clause == []
    assert mining.minimal_covers(spark.createDataFrame([([],), ([1],)], "sig array<int>"), 2).isEmpty()


def test_many_signatures(spark):
    """More than one part of a packed bit vector."""
    d = spark.range(7 * 5 * 11 * 13 * 9).selectExpr("transform(array(0, 7, 12, 23, 36), (x, k) -> cast(x + id % array(7, 5, 11, 13, 9)[k] as int)) as sig")
    got = [tuple(r.clause) for r in mining.minimal_covers(d, 5, most_signatures=50_000).collect()]
    assert got == [tuple(range(7, 12))]
