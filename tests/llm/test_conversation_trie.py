import hashlib
import random
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from veritab.llm import conversation_trie as ct
from veritab.llm.running import running

SCHEMA = "conv_id long, turn long, role string, text string, depth string, n string, k1 string"


def conversations(seed=1, long=120):
    rng = random.Random(seed)
    out = []
    for c in [*range(-6, 40), 100, 101, 104, 10**12, 10**12 + 1]:
        for t in range(rng.choice([1, 1, 2, 3, 5, 8, 9, 12])):
            turn = None if rng.random() < 0.05 else rng.choice([t, t, t, 3])
            out.append((c, turn, rng.choice(["user", "user", None]), rng.choice(["hi", "hi", "hi", "ça va", "", None]), "d", "n", "k"))
    out += [(7, t, "user", "same", None, None, None) for t in range(long)] + [(8, t, "user", "same", None, None, None) for t in range(long - 1)]
    out += [(200 + c, 0, "user", "x" * 50_000, None, None, None) for c in range(30)]
    return out + [(None, 1, "user", "lost", None, None, None), out[0], out[0]]


def turns(rows):
    found = defaultdict(list)
    for c, turn, role, text, *_ in rows:
        if c is not None:
            found[c].append((turn is not None, turn or 0, role or "", text or ""))
    return {c: [(r, x) for *_, r, x in sorted(v)] for c, v in found.items()}


def rebuilt(convs):
    out = {}
    for c, own in convs.items():
        h = zlib.crc32(str(c).encode()) % 9
        out[c] = convs.get(c - (c % 5 if c >= 0 else -(-c % 5)), [])[:h] + own[h:]
    return out


def brute(convs):
    members, ends = defaultdict(list), defaultdict(list)
    for c, seq in sorted(convs.items()):
        for d in range(len(seq) + 1):
            members[tuple(seq[:d])].append(c)
        ends[tuple(seq)].append(c)
    kids = defaultdict(list)
    for p in members:
        if p:
            kids[p[:-1]].append(p)

    leaves, saved = {}, {}
    for p in sorted(members, key=len, reverse=True):
        own = (len(members[p]) - 1) * len(p[-1][1].encode()) if p else 0
        leaves[p] = sum(leaves[k] for k in kids[p]) if kids[p] else 1
        saved[p] = own + sum(saved[k] for k in kids[p])
    return sorted(
        (m[0], len(p), members[p[:-1]][0] if p else None, len(m), len(kids[p]), leaves[p], saved[p], hashlib.sha256(",".join(map(str, ends[p])).encode()).hexdigest())
        for p, m in members.items()
    )


def collected(nodes):
    return sorted((r.conv, r.depth, r.parent, r.n_convs, r.n_children, r.n_leaves, r.saved, r.ends_sha256) for r in nodes.collect())


@pytest.mark.parametrize("seed", [1, 2])
def test_against_brute(spark, seed):
    rows = conversations(seed)
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    assert collected(ct.conversation_trie(df)) == brute(turns(rows))
    assert collected(ct.prefix_trie(ct.rebuilt(ct.numbered(df)))) == brute(rebuilt(turns(rows)))


def test_blocks_and_empty(spark, monkeypatch):
    rows = conversations(4, long=30)
    df = spark.createDataFrame(rows, SCHEMA)
    monkeypatch.setattr(ct, "_BLOCK", 7)
    assert collected(ct.prefix_trie(ct.rebuilt(ct.numbered(df)))) == brute(rebuilt(turns(rows)))
    assert ct.conversation_trie(df.where("false")).count() == 0
    assert ct.prefix_trie(ct.rebuilt(ct.numbered(df.where("false")))).count() == 0


def test_ends(spark):
    rows = [(1, 0, c) for c in random.Random(1).sample(range(-5000, 5000), 3000)] + [(2, 3, 9), (1, 2, 10), (1, 2, -3)]
    got = {(r.node, r.depth): r.ends_sha256 for r in ct.hashed_lists(spark.createDataFrame(rows, "node long, depth long, conv long"), most=7).collect()}
    want = defaultdict(list)
    for n, d, c in rows:
        want[n, d].append(c)
    assert got == {k: hashlib.sha256(",".join(map(str, sorted(v))).encode()).hexdigest() for k, v in want.items()}


@pytest.mark.parametrize("descending", [False, True])
def test_running(spark, descending):
    """One key with most of the rows, so that it is carried over several ranges."""
    rng = random.Random(2)
    rows = [(0, rng.choice([1, 5, 5, 5, 5, 5, 9]), i, rng.randint(-9, 9), rng.getrandbits(40), rng.choice([None, None, i]), rng.choice([None, i])) for i in range(2000)]
    df = spark.createDataFrame(rows, "a long, b long, i long, add long, xor long, last long, before long").repartition(3)
    order = F.col("i").desc() if descending else F.col("i").asc()
    batch = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "97")
    try:
        got = running(df, ["a", "b"], [order], {m: m for m in ("add", "xor", "last", "before")})
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    want, state = [], {}
    for a, b, i, add, xor, last, before in sorted(rows, key=lambda r: -r[2] if descending else r[2]):
        s = state.setdefault(b, [0, 0, None, None])
        prior = s[3]
        s[0], s[1], s[2], s[3] = s[0] + add, s[1] ^ xor, last if last is not None else s[2], before if before is not None else s[3]
        want.append((a, b, i, s[0], s[1], s[2], prior))
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)
