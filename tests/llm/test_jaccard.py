import random
from collections import defaultdict

import numpy as np
import pytest

from tests.llm.helpers import LOWER, WORD, documents, none, rows, text
from veritab.llm import jaccard_join as jj


def shingle_set(t, size):
    w = WORD.findall((t or "").translate(LOWER))
    return frozenset(tuple(w[i : i + size]) for i in range(len(w) - size + 1)) if len(w) >= size else frozenset([tuple(w)] if w else [])


def brute(docs, size=4, percent=85):
    """(doc_id, set size, component) of every row, in plain Python."""
    sets = [shingle_set(t, size) for _, t in docs]
    part = list(range(len(docs)))

    def root(x):
        while part[x] != x:
            x = part[x]
        return x

    for i in range(len(docs)):
        for j in range(i):
            if sets[i] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                part[root(i)] = root(j)
    least = defaultdict(list)
    for i, (d, _) in enumerate(docs):
        if d is not None:
            least[root(i)].append(d)
    return [(d, len(sets[i]), min(least[root(i)], default=None)) for i, (d, _) in enumerate(docs)]


def key(r):
    return tuple(str(x) for x in r)


@pytest.mark.parametrize("block", [5_000, 3])
def test_against_all_pairs(spark, block):
    got = jj.jaccard_components(documents(spark), block=block).collect()
    assert sorted(map(key, got)) == sorted(map(key, brute([r[:2] for r in rows()])))
    assert jj.jaccard_components(none(spark)).count() == 0


def near_copies(seed):
    rng = random.Random(seed)
    base = text(rng, 60).split()
    line = " " + text(rng, 8)
    out = []
    for _ in range(60):
        w = list(base)
        for _ in range(rng.randint(0, 3)):
            w[rng.randrange(len(w))] = text(rng, 1)
        out.append(" ".join(w) + line * rng.randint(0, 1))
    out += [text(rng, 30) + line for _ in range(30)]
    rng.shuffle(out)
    return list(enumerate(out))


@pytest.mark.parametrize("seed", [1, 2])
def test_large_group_with_a_common_line(spark, seed):
    docs = near_copies(seed)
    for size, percent, block in ((4, 85, 5_000), (5, 80, 10)):
        got = jj.jaccard_components(spark.createDataFrame(docs, "doc_id long, text string"), size, percent, block=block).collect()
        assert sorted(map(tuple, got)) == sorted(brute(docs, size, percent))


def test_copies_of_a_passage_common_in_one_slice_only(spark):
    rng = random.Random(3)
    passage = " " + text(rng, 48)
    docs = [(i, text(rng, 55) + passage) for i in range(20)]
    copies = [(20 + i, docs[i][1]) for i in range(3)] + [(23 + i, text(rng, 40)) for i in range(17)]
    both = spark.createDataFrame(spark.sparkContext.parallelize(docs + copies, 2), "doc_id long, text string")
    assert [len(p) for p in both.rdd.glom().collect()] == [20, 20] and 3 <= jj._COMMON < 20
    rows = jj.shared_shingles(both, 4, 4)
    shared = rows.where("kind = 1").select("hash", "node").unionByName(jj._common(rows).select("hash", "node"))
    assert shared.count() == shared.distinct().count() == sum(len(shingle_set(t, 4) & shingle_set(passage, 4)) for _, t in docs)
    got = jj.jaccard_components(both).collect()
    assert sorted(map(tuple, got)) == sorted(brute(docs + copies))


def test_links_of_random_sets():
    rng = np.random.default_rng(5)
    for _ in range(60):
        n = int(rng.integers(2, 14))
        sets = [set(rng.choice(14, rng.integers(1, 13), replace=False).tolist()) for _ in range(n)]
        h = np.array([x for s in sets for x in sorted(s)], np.uint64)
        v = np.array([i for i, s in enumerate(sets) for _ in s], np.int64)
        part = list(range(n))
        for a, b in jj.occurrence_links(h, v, np.array([len(s) for s in sets]), 60):
            assert 100 * len(sets[a] & sets[b]) >= 60 * len(sets[a] | sets[b])
            part = [part[a] if p == part[b] else p for p in part]
        for i in range(n):
            for j in range(i):
                if 100 * len(sets[i] & sets[j]) >= 60 * len(sets[i] | sets[j]):
                    assert part[i] == part[j]


def test_blocks_are_kept_once(spark):
    """A component of many blocks: its rows are exchanged once however many blocks meet, and each pair of blocks that can link meets once."""
    candidates = spark.createDataFrame([(i, i % 2, 90 + i % 40, 90) for i in range(400)], "node long, root long, n long, m long")
    blocks = jj._blocks(candidates, 85, 1_000).collect()
    assert sorted(r.node for r in blocks) == list(range(400))
    kinds = {(r.root, r.band, r.own) for r in blocks}
    met = [tuple(r) for r in jj._pairs(spark.createDataFrame(list(kinds), "root long, band long, own int")).select("root", "i_band", "i", "j_band", "j").collect()]
    wanted = {frozenset([a, b]) for a in kinds for b in kinds if a != b and a[0] == b[0] and abs(a[1] - b[1]) <= 1}
    assert len(met) == len(wanted) > 100
    assert {frozenset([(r, a, i), (r, b, j)]) for r, a, i, b, j in met} == wanted
    docs = near_copies(7)
    got = jj.jaccard_components(spark.createDataFrame(docs, "doc_id long, text string"), block=150).collect()
    assert sorted(map(key, got)) == sorted(map(key, brute(docs)))


def test_links_between_sides():
    rng = random.Random(4)
    for _ in range(40):
        base = rng.sample(range(300), 20)
        sets = [set(rng.sample(base, rng.randint(12, 20))) | {rng.randrange(300)} for _ in range(rng.randint(2, 20))]
        side = np.array([rng.randint(0, 1) for _ in sets])
        h, v = np.array([x * 7919 for s in sets for x in s], np.uint64), np.repeat(np.arange(len(sets)), [len(s) for s in sets])
        found = jj.occurrence_links(h, v, np.array([len(s) for s in sets]), 60, side)
        links = [(a, b) for a in range(len(sets)) for b in range(a) if side[a] != side[b] and 100 * len(sets[a] & sets[b]) >= 60 * len(sets[a] | sets[b])]
        assert all((max(x), min(x)) in links for x in found)
        part = list(range(len(sets)))
        for a, b in found:
            part = [part[b] if p == part[a] else p for p in part]
        assert all(part[a] == part[b] for a, b in links)


def test_many_buckets_name_a_node_seldom(spark):
    """Rows of a slice don't fill with the names of its nodes as the table, and so the buckets, grow; results are the same."""
    rng = np.random.default_rng(2)
    sets = {i: np.unique(rng.integers(0, 1 << 64, 500, dtype=np.uint64)) for i in range(1, 400)}
    sent = {n: sum(len(x) for r in jj._packed(sets, n)[0] for x in r[1:]) for n in (100, 1_000)}
    assert sent[1_000] < 1.1 * sent[100]
    docs = near_copies(9)
    for buckets in (130, 515, 1_030):
        got = jj.jaccard_components(spark.createDataFrame(docs, "doc_id long, text string"), buckets=buckets).collect()
        assert sorted(map(key, got)) == sorted(map(key, brute(docs)))


def test_a_bucket_with_one_shingle_of_a_slice(spark):
    """A short slice over many buckets sends rows of one shingle each."""
    docs = [(0, "a b c d e f g"), (1, "a b c d e f g"), (2, "x y z"), (3, "a b c d e f h")]
    got = jj.jaccard_components(spark.createDataFrame(docs, "doc_id long, text string"), buckets=64).collect()
    assert sorted(map(key, got)) == sorted(map(key, brute(docs)))
