import hashlib
import io
import random

from veritab.llm import warc_writer as ww
from veritab.llm.common import shared_dir

SCHEMA = "page_id long, url string, html string, digest string, first string, size string, n string"


def pages():
    rng = random.Random(2)
    big = ["<p>" + "word " * rng.randint(30, 60) + str(i) for i in range(6)]
    out = [(i, f"http://x/{i} é", rng.choice(big)) for i in range(40)]
    out += [(50, None, None), (51, "", ""), (52, "u", "short"), (53, "u", "short"), (54, "u\r\nX: y", "é" * 50), (55, "u", "é" * 50), (56, "u", "z" * 300_000), (None, "u", big[0]), out[5], out[5]]
    return [(*r, "a", "b", "c", "d") for r in out]


def brute():
    first = {}
    for p, _, h, *_ in pages():
        if p is not None and len((h or "").encode()) >= 100:
            first[h] = min(first.get(h, p), p)
    for p, _, h, *_ in pages():
        f = first.get(h)
        again = f is not None and (p is None or p > f)
        raw = (h or "").encode()
        yield p, len(raw), hashlib.sha256(raw).hexdigest(), "revisit" if again else "response", f if again else None


def key(r):
    return tuple(str(x) for x in r)


def test_archives(spark):
    d = spark.createDataFrame(pages(), SCHEMA)
    files = ww.write_warcs(d, shared_dir(spark, "warc"), file_bytes=4000)
    assert files.count() > 4
    assert sorted(map(key, ww.read_warcs(files).drop("url").collect())) == sorted(map(key, brute()))
    none = ww.write_warcs(d.where("false"), shared_dir(spark, "warc"))
    assert none.count() == 0 and ww.read_warcs(none).count() == 0


def test_records_alone_and_without_training():
    recs = [ww.record(i, "u", b"hello %d" % i, "d", 7, None, "2024-01-01T00:00:00Z") for i in range(3)]
    out = io.BytesIO()
    starts = ww.write_archive(out, recs, 3, 1000, 10_000)
    raw = out.getvalue()
    assert raw[:4] == b"\x5d\x2a\x4d\x18"
    assert [b for _, b in ww.read_archive(io.BytesIO(raw))] == [r.partition(b"\r\n\r\n")[2][:-4] for r in recs]
    assert all(raw[s : s + 4] == b"\x28\xb5\x2f\xfd" for s in starts)
