"""Each stage against plain Python, on a corpus with toxic texts, copies, test items and a hot source."""

import random
import zlib
from pathlib import Path

import corpus_pipeline
import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tests.llm.helpers import WORD, text
from tests.llm.test_classifiers import BAD
from tests.llm.test_decontaminate import brute as contaminated
from tests.llm.test_jaccard import brute as linked

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    rng = random.Random(11)
    base = str(tmp_path_factory.mktemp("sf"))
    items = [(i, text(rng, 25)) for i in range(6)]
    docs, labels = [], []
    for i in range(300):
        ws, toxic = text(rng, rng.randint(30, 80)).split(), rng.random() < 0.3
        if toxic:
            for _ in range(4):
                ws.insert(rng.randrange(len(ws)), rng.choice(BAD))
        elif rng.random() < 0.2:
            ws[10:10] = rng.choice(items)[1].split()
        docs.append((i, " ".join(ws), "en", rng.choice(["a", "a", "b", None]), 1))
        labels.append((i, 1, int(toxic)))
    clean = [d for d, la in zip(docs, labels) if not la[2]]
    docs += [(300 + k, d[1] if k % 2 else d[1] + " end", *d[2:]) for k, d in enumerate(clean[:20])]
    docs += [(400, None, None, None, None), (401, "", "en", "b", 0), (401, "", "en", "b", 0), (None, "no id", "en", "a", 5)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{base}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{base}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{base}/benchmark.parquet")
    return base, docs, labels, items


def test_stages(spark, sf_dir):
    base, raw, labels, items = sf_dir
    docs = spark.read.parquet(f"{base}/documents.parquet")
    out = {}
    for name, stage in corpus_pipeline.STAGES:
        path = f"{base}/{name}"
        stage(spark, docs, base).write.parquet(path)
        docs = spark.read.parquet(path)
        out[name] = [tuple(r) for r in docs.collect()]
        if name != "token_ids":
            assert docs.columns == COLUMNS
    key = lambda r: tuple(map(str, r))
    toxic = {d for d, _, t in labels if t}
    kept = out["toxicity"]
    ids = [r[0] for r in kept]
    assert set(map(key, kept)) <= set(map(key, raw)) and len(kept) == sum(r[0] in ids for r in raw)
    assert sum(d in toxic for d in ids) <= 0.03 * len(toxic) and sum(r[0] not in toxic and r[0] not in ids for r in raw) <= 0.01 * len(raw)

    groups = linked([r[:2] for r in kept], 5, 80)
    stay = [r for r, (d, n, c) in zip(kept, groups) if not n or d is None or d == c]
    assert sorted(map(key, out["near_duplicates"])) == sorted(map(key, stay))

    hit = {r: contaminated(r[1], items) for r in out["near_duplicates"]}
    left = {r[0]: r for r in out["decontamination"]}
    for r, (n, bad, *_) in hit.items():
        if bad > n / 2:
            assert r[0] not in left
        elif not bad:
            assert left[r[0]] == (*r[:4], None if r[1] is None else len(r[1]))
        else:
            assert not contaminated(left[r[0]][1], items)[4] and len(WORD.findall(left[r[0]][1])) == n - bad

    mixed = out["mixture"]
    counts = {r: mixed.count(r) for r in set(mixed)}
    assert set(counts) <= set(out["decontamination"]) and max(counts.values()) <= 3
    size = lambda rs: sum(len(WORD.findall(r[1] or "")) for r in rs)
    assert abs(size(mixed) - size(out["decontamination"])) <= 3 * 110

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = sorted((str(r[0]), zlib.crc32(np.array([*t.encode(r[1] or "", add_special_tokens=False).ids, 0], "<u4").tobytes())) for r in mixed)
    assert sorted((str(r[0]), r[3]) for r in out["token_ids"]) == want


CLASH = [*COLUMNS, "row", "ROW_", "mix_key", "mix_times", "mix_copy", "mix_copies", "group", "stays", "key"]
CLASH_SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} string" for c in CLASH[5:])


def test_odd_rows_and_clashing_columns(spark, sf_dir):
    """Null, empty and very long texts, repeats, ids that repeat or are missing; columns with the stages' own names come back as they were."""
    base, *_ = sf_dir
    rng = random.Random(5)
    long, near = text(rng, 30_000), text(rng, 60)
    rows = [(1, None), (1, None), (2, ""), (3, long), (4, long + " end"), (5, near), (5, near + " tail"), (5, text(rng, 40)), (None, near), (None, text(rng, 40)), (6, text(rng, 50)), (6, None)]
    extra = [f"x{k}" for k in range(len(CLASH) - 5)]
    full = [(d, t, "en", "a", None if t is None else len(t), *extra) for d, t in rows]
    docs = spark.createDataFrame(full, CLASH_SCHEMA)
    none = spark.createDataFrame([], CLASH_SCHEMA)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        got = [tuple(r) for r in stage(spark, docs, base).collect()]
        assert all(r[5:] == tuple(extra) and r[2:4] == ("en", "a") for r in got)
        assert stage(spark, none, base).columns == CLASH and stage(spark, none, base).count() == 0
        if name == "near_duplicates":
            # long and its near copy: one row; near three times: the one with an id, the smaller hash of two
            assert sorted(str(r[0]) for r in got) == sorted(map(str, [1, 1, 2, 3, 5, 5, None, 6, 6]))
            assert sum((r[1] or "").startswith(near) for r in got) == 1
        if name in ("toxicity", "decontamination"):
            assert sorted(map(str, got)) == sorted(map(str, full))
    assert corpus_pipeline.token_ids(spark, docs, base).count() == len(rows)
    assert corpus_pipeline.token_ids(spark, none, base).count() == 0


def test_run(spark, sf_dir):
    assert corpus_pipeline.run(spark, sf_dir[0]).columns == ["doc_id", "start", "n_tokens", "ids_crc32"]


def test_near_duplicates_keep_no_texts(spark, sf_dir):
    """The stage leaves no copy of the texts in the shared folder; of rows alike in doc_id and text the one read first stays."""
    base, raw, *_ = sf_dir
    corpus_pipeline.shared_dir(spark, "x")  # sets the folder
    folder = Path(spark.conf.get("spark.checkpoint.dir").removeprefix("file://"))
    before = set(folder.iterdir()) if folder.exists() else set()
    rows = [(7, "a b c d e f g", "first"), (7, "a b c d e f g", "second"), (7, None, "x"), (7, None, "y"), (8, " \t", "z"), (8, " \t", "z"), (9, "a b c d e f g", "w")]
    docs = spark.createDataFrame(spark.sparkContext.parallelize(rows, 2), "doc_id long, text string, source string")
    got = corpus_pipeline.near_duplicates(spark, docs, base).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, [rows[0], *rows[2:6]]))
    new = [p for p in set(folder.iterdir()) - before if any(p.glob("*.parquet"))]
    assert new and not any(f.dataType.simpleString() == "string" for p in new for f in spark.read.parquet(str(p)).schema)
