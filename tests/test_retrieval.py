"""The index gives what scoring every section gives."""

import random

import pytest
from pyspark.sql import functions as F

from veritab.functions import text
from veritab.operators import retrieval

WORDS = ["aa", "aaa", "aAAa", "Abab", "b", "ß", "straße", "中文", "a😀b", "zzz", "ab a", "A"]


def made(rng, n):
    parts = ["aaaa", "abab", "Straße", "中文字", "xa😀by", "b", " ", "aaaaaaa", "AB a"]
    return [(None if k % 17 == 0 else k // 2, None if k % 11 == 0 else "".join(rng.choice(parts) for _ in range(rng.randint(0, 12))), rng.choice(["b", "aaa", "", None]), k) for k in range(n)]


def key(rows):
    return [(r.score, r.place) for r in rows]


@pytest.mark.parametrize("first", [1, 1_000])
def test_like_scoring_all(spark, tmp_path, first):
    rng = random.Random(first)
    d = spark.createDataFrame(made(rng, 120), "place long, text string, tag string, id long").repartition(3)
    index = retrieval.section_index(d.where("id < 70"), ["text", "tag"], "place", f"file://{tmp_path}/index").add(d.where("id >= 70"))
    for words, weights, k in [(WORDS, {"text": 1, "tag": 3}, 10), (["aaa", "aaa"], {"text": 2}, 5), (["b"], {"tag": 1}, 500), (["Straße", "😀"], {"text": 1}, 3), (["zzz"], {"text": 1}, 3), (["abab", "b"], {"text": 2, "tag": -1}, 8)]:
        got = index.best(spark, words, weights, k, first=first)
        assert got.columns == [*d.columns, "score"]
        assert key(got.collect()) == key(text.best_sections(d, words, weights, "place", k).collect())
    assert index.best(spark, [], {"text": 1}, 3).count() == 0


def test_bounds_hold_and_leave_out(spark, tmp_path):
    d = spark.createDataFrame(made(random.Random(5), 80), "place long, text string, tag string, id long").coalesce(1)
    index = retrieval.section_index(d, ["text"], "place", f"file://{tmp_path}/index")
    bounds = {r.index_id: r.bound for r in index.candidates(spark, ["abab", "Straße"], {"text": 1}).collect()}
    scores = {r.index_id: r.s for r in d.select(F.monotonically_increasing_id().alias("index_id"), text.keyword_score(["abab", "Straße"], {"text": 1}).alias("s")).collect()}
    assert all(bounds.get(i, 0) >= s for i, s in scores.items())
    assert 0 < len(bounds) < 80
    plan = index.candidates(spark, ["abab"], {"text": 1})._jdf.queryExecution().executedPlan().toString()
    assert "In(run" in plan


def test_empty_table_and_wrong_questions(spark, tmp_path):
    d = spark.createDataFrame([], "place long, text string")
    index = retrieval.section_index(d, ["text"], "place", f"file://{tmp_path}/index")
    assert index.best(spark, ["a"], {"text": 1}, 3).count() == 0
    with pytest.raises(ValueError):
        index.best(spark, ["a"], {"tag": 1}, 3)
    with pytest.raises(ValueError):
        index.best(spark, [""], {"text": 1}, 3)
    with pytest.raises(ValueError):
        index.add(d.withColumn("Index_Id", F.lit(1)))


def test_hex_dump(spark):
    def dump(b, limit):
        lines = [f"{i:04x}  {b[i : min(i + 16, limit)].hex(' '):<47}  {''.join(chr(x) if 32 <= x < 127 else '.' for x in b[i : min(i + 16, limit)])}" for i in range(0, min(len(b), limit), 16)]
        return "\n".join([*lines, *([f"… ({len(b) - limit} more bytes)"] if len(b) > limit else [])])

    rng = random.Random(2)
    data = [b"", b"a", bytes(range(256)), b"\n\r\x00" * 11, "é中".encode() * 9, rng.randbytes(70_000)]
    d = spark.createDataFrame([(i, bytearray(b)) for i, b in enumerate(data)] + [(99, None)], "i int, b binary")
    for limit in (16, 40, 100_000):
        got = {r.i: r.t for r in d.select("i", text.hex_dump(F.col("b"), limit).alias("t")).collect()}
        assert got == {i: dump(b, limit) for i, b in enumerate(data)} | {99: None}


def test_postings_hold_many_sections_a_row(spark, tmp_path):
    texts = ["Aabab", "aabab", "", None, "x😀", "é中文字é中", "ab"] * 20
    d = spark.createDataFrame(list(enumerate(texts)), "place long, text string").coalesce(1)
    retrieval.section_index(d, ["text"], "place", f"file://{tmp_path}/index")
    got = spark.read.parquet(f"{tmp_path}/index/postings")
    assert {"ids", "ns"} <= set(got.columns)
    every = got.select("run", F.explode(F.arrays_zip("ids", "ns")).alias("p")).select("run", "p.ids", "p.ns").collect()
    numbered = spark.read.parquet(f"{tmp_path}/index/sections")
    wanted = numbered.select("index_id", F.explode(retrieval.runs(F.col("text"))).alias("run")).groupBy("run", "index_id").count().collect()
    assert sorted(map(tuple, every)) == sorted(map(tuple, wanted))
    assert got.count() < len(every)
