import hashlib
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tests.llm.helpers import LOWER, documents, none, rows
from veritab.llm.line_dedup import LineRuns, line_dedup, line_keys

SPACE = "\x20\x09\x0a\x0b\x0c\x0d"


def brute(texts, least_docs, least_chars):
    lines = [(t or "").split("\n") for t in texts]
    keys = [[x.strip(SPACE).translate(LOWER) for x in ls] for ls in lines]
    n = Counter(k for ks in keys for k in set(ks) if len(k) >= max(least_chars, 1))
    out = []
    for ls, ks in zip(lines, keys):
        kept = [x for x, k in zip(ls, ks) if n[k] < least_docs]
        out.append((len(ls), len(ls) - len(kept), "\n".join(kept)))
    return out


def lined(seed=3):
    """Texts of lines that are shared by few, by many, within one text, and with other spaces and cases."""
    rng = random.Random(seed)
    common = ["Cookie notice", "all rights reserved", "ÉTÉ à la", "x", "İ ı", " nbsp "]
    texts = []
    for k in range(60):
        parts = [rng.choice(["", " ", "\t"]) + rng.choice(common) + rng.choice(["", "  ", "\r"]) for _ in range(rng.randint(0, 4))]
        parts = [p.upper() if rng.random() < 0.3 else p for p in parts] + [f"line {rng.randint(0, 25)}", "", " \t"]
        rng.shuffle(parts)
        texts.append("\n".join(parts))
    return texts + [None, "", "\n", "\n\n", "Cookie notice\n" * 3000, "y" * 300_000 + "\nx"]


@pytest.mark.parametrize(("least_docs", "least_chars", "batches", "fan"), [(10, 1, 4, 3), (2, 2, 7, 2), (1, 3, 1, 3), (200, 1, 2, 2)])
def test_against_brute(spark, least_docs, least_chars, batches, fan):
    texts = lined()
    df = spark.createDataFrame([(i if i % 9 else None, t, i) for i, t in enumerate(texts)], "doc_id long, text string, n_lines int").repartition(6)
    df = df.withColumns({"line_a": F.lit("a"), "places": F.lit("p"), "key": F.lit("k"), "batch": F.lit(1)})
    got = line_dedup(df, least_docs, least_chars, batches, fan)
    assert got.columns == [*df.columns, "n_lines_", "n_dropped"]
    want = brute(texts, least_docs, least_chars)
    for r in got.collect():
        n, gone, kept = want[r["n_lines"]]
        assert (r["n_lines_"], r["n_dropped"], r["text"] or "") == (n, gone, kept), r["n_lines"]
        assert r["text"] is not None or texts[r["n_lines"]] is None


def test_documents(spark):
    want = brute([r[1] for r in rows()], 3, 1)
    got = sorted((str(r.doc_id), r.n_lines, r.n_dropped, hashlib.sha256((r.text or "").encode()).hexdigest()) for r in line_dedup(documents(spark), 3).collect())
    assert got == sorted((str(r[0]), n, gone, hashlib.sha256(kept.encode()).hexdigest()) for r, (n, gone, kept) in zip(rows(), want))
    assert line_dedup(none(spark)).count() == 0


def test_runs(spark):
    """Counts over many batches, with compactions of several levels; few runs are left at any time."""
    runs, n = LineRuns(spark, 4, fan=2), Counter()
    rng = random.Random(5)
    for _ in range(6):
        keys = [bytes([rng.randrange(12)]) for _ in range(10)]
        n.update(keys)
        runs.add(spark.createDataFrame([(bytearray(k),) for k in keys], "key binary"))
        assert all(len(level) < 2 for level in runs.levels)
    assert {bytes(r.key) for r in runs.common().collect()} == {k for k, c in n.items() if c >= 4}
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("line_run_")]


def test_keys():
    assert line_keys(None, 1) == line_keys(b"", 1) == line_keys(b"\n \r\n", 1) == {}
    assert line_keys("A b \n\ta B\nÉ".encode(), 1) == {b"a b": [0, 1], "É".encode(): [2]}
    assert line_keys("É\nab".encode(), 2) == {b"ab": [1]}
