"""State by key: the stream, with late events over several batches, gives what the batch gives for the events the watermark has passed."""

import random
from datetime import datetime, timedelta, timezone

from veritab.streaming import jobs

START = datetime(2024, 1, 1, tzinfo=timezone.utc)


def made(rng, n):
    return [(rng.choice(["a", "a", "a", "b", None]), START + timedelta(seconds=rng.randint(0, 3000) + k), k, rng.random() < 0.1, rng.choice(["pending", "running", "done", "failed"])) for k in range(n)]


def test_batch(spark):
    rows = [("a", START + timedelta(seconds=s), k, end, st) for k, (s, end, st) in enumerate([(0, False, "done"), (3, False, "running"), (5, False, "pending"), (6, False, "done"), (7, True, "done"), (8, False, "failed")])]
    d = spark.createDataFrame([*rows, (None, START, 9, False, "x"), ("b", None, 10, False, "x")], "k string, ts timestamp, id long, ended boolean, status string")
    got = {r.event: ((r.job_at - 1704067200_000_000) // 1_000_000, r.reused) for r in jobs.reused_jobs(d, "k", "ts", "id", "ended", 5).collect()}
    assert got == {0: (0, False), 1: (0, True), 2: (0, True), 3: (6, False), 5: (8, False)}
    states = {r.event: (r.before, r.legal) for r in jobs.job_statuses(d, "k", "ts", "id", "status").collect()}
    assert states == {0: (None, False), 1: (None, True), 2: ("running", False), 3: ("running", True), 4: ("done", False), 5: ("done", False)}
    assert jobs.reused_jobs(d.where("false"), "k", "ts", "id", "ended").count() == 0


def test_stream_with_late_events(spark, tmp_path):
    schema = "k string, ts timestamp, id long, ended boolean, status string"
    rng = random.Random(3)
    rows = sorted(made(rng, 200), key=lambda r: r[1] + timedelta(seconds=rng.randint(0, 500)))  # late by less than the watermark's ten minutes
    rows += [("z", START + timedelta(days=1), 900, False, "pending"), ("z", START + timedelta(days=2), 901, False, "pending")]
    for i in range(5):
        part = rows[i * 41 : (i + 1) * 41] if i < 4 else rows[164:]
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    for name, f in (("reused", lambda d: jobs.reused_jobs(d, "k", "ts", "id", "ended", 60)), ("states", lambda d: jobs.job_statuses(d, "k", "ts", "id", "status"))):
        q = f(source).writeStream.format("parquet").option("checkpointLocation", f"{tmp_path}/c-{name}").trigger(availableNow=True).start(f"{tmp_path}/{name}")
        assert q.awaitTermination(120)
        got = sorted(map(str, spark.read.parquet(f"{tmp_path}/{name}").where("key <> 'z'").collect()))
        whole = sorted(map(str, f(spark.read.schema(schema).parquet(f"{tmp_path}/in")).where("key <> 'z'").collect()))
        assert got == whole and len(got) > 100
