"""Operator 4: WARC archives, each record a Zstandard frame with a dictionary trained on the archive.

An archive (`*.warc.zst`) begins with a skippable frame (magic 0x184D2A5D) that holds the dictionary,
then a frame for each record. The dictionary is trained on the first 64 KiB of each sampled record (the trainer's samples; every record is
written whole). Equal payloads of at least `least` bytes are stored once, by the row
with the smallest page_id; the others become revisit records that refer to it.

Very long pages are written whole, as one record. Null or empty html: an empty payload, always a response. Null page_id: last in order, and no page
header. Rows that repeat the smallest page_id of a payload are responses too. Null url: no target
header. An empty table gives no archive and no row. Other columns don't matter.
"""

from __future__ import annotations

import hashlib
import io
import re
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veritab.llm.common import batch, open_fs, shared_dir, table, typed, write_atomically

DICT_FRAME = 0x184D2A5D
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def record_id(page_id: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}:{digest}')}>"


def record(page_id: int | None, url: str | None, payload: bytes | None, digest: str, size: int, refers_to: int | None, date: str) -> bytes:
    """A whole WARC record. payload: None for a revisit."""
    head = ["WARC/1.1", f"WARC-Type: {'response' if payload is not None else 'revisit'}", f"WARC-Record-ID: {record_id(page_id, digest)}", f"WARC-Date: {date}"]
    if url:
        head.append("WARC-Target-URI: " + re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url))
    head.append(f"WARC-Payload-Digest: sha256:{digest}")
    if page_id is not None:
        head.append(f"X-Page-Id: {page_id}")
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    if payload is None:
        head += [f"WARC-Profile: {REVISIT_PROFILE}", f"WARC-Refers-To: {record_id(refers_to, digest)}", f"X-Refers-To-Page-Id: {refers_to}"]
        block = http
    else:
        block = http + payload
    head += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def train(records: list[bytes], size: int, sample_bytes: int) -> zstandard.ZstdCompressionDict | None:
    """A dictionary from evenly spaced records of the archive, sample_bytes of them at most."""
    step, samples, held = max(1, sum(map(len, records)) // sample_bytes), [], 0
    for r in records[::step]:
        samples.append(r[:65536])
        held += len(samples[-1])
        if held >= sample_bytes:
            break
    if not samples:
        return None
    try:
        return zstandard.train_dictionary(min(size, max(256, held // 8)), samples, k=256, d=8)
    except zstandard.ZstdError:  # too little to train on: the samples themselves serve
        return zstandard.ZstdCompressionDict(b"".join(samples)[-size:], dict_type=zstandard.DICT_TYPE_RAWCONTENT)


def write_archive(out, records: list[bytes], level: int, dict_size: int, sample_bytes: int) -> list[int]:
    """Writes the dictionary frame and a frame for each record; returns where each frame begins."""
    made = train(records, dict_size, sample_bytes)
    at, starts = 0, []
    if made is not None:
        raw = made.as_bytes()
        out.write(struct.pack("<II", DICT_FRAME, len(raw)) + raw)
        at = 8 + len(raw)
        made.precompute_compress(level=level)
    zstd = zstandard.ZstdCompressor(level=level, dict_data=made, write_checksum=True)
    for r in records:
        frame = zstd.compress(r)
        out.write(frame)
        starts.append(at)
        at += len(frame)
    return starts


def read_archive(f) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, block) of each record of an archive, one record in memory at a time."""
    head = f.read(8)
    made = None
    if len(head) == 8 and struct.unpack("<I", head[:4])[0] == DICT_FRAME:
        raw = f.read(struct.unpack("<I", head[4:])[0])
        kind = zstandard.DICT_TYPE_AUTO if raw[:4] == b"\x37\xa4\x30\xec" else zstandard.DICT_TYPE_RAWCONTENT
        made = zstandard.ZstdCompressionDict(raw, dict_type=kind)
    else:
        f.seek(0)
    lines = io.BufferedReader(zstandard.ZstdDecompressor(dict_data=made).stream_reader(f, read_across_frames=True), 1 << 18)
    while (first := lines.readline()) != b"":
        if not first.startswith(b"WARC/"):
            raise ValueError("not at a WARC record")
        headers = {}
        while (line := lines.readline()) not in (b"\r\n", b""):
            k, _, v = line.decode().partition(":")
            headers[k] = v.strip()
        n = int(headers["Content-Length"])
        block = lines.read(n)
        if len(block) != n or lines.read(4) != b"\r\n\r\n":
            raise ValueError("a record is cut short")
        yield headers, block


_FILE = pa.schema([("file", pa.string()), ("n_records", pa.int64()), ("bytes", pa.int64())])


def write_warcs(pages: DataFrame, folder: str, least: int = 100, date: str = "2024-01-01T00:00:00Z", file_bytes: int = 64 << 20, level: int = 9, dict_size: int = 112 << 10, sample_bytes: int = 4 << 20) -> DataFrame:
    """Archives of about file_bytes of records, the most that a task holds besides one record; returns a row per archive."""
    p = typed(pages, page_id="long", url="string", html="string").withColumn("html", F.coalesce("html", F.lit("")))
    p = p.withColumns({"digest": F.sha2(F.col("html").cast("binary"), 256), "size": F.octet_length("html").cast("long")})
    # counted before the exchange; a payload that many pages share is one row here, and the join splits its pages
    firsts = p.where(F.col("size") >= least).groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n"))
    firsts = firsts.where("n > 1 and first is not null").select("digest", "first")
    p = p.join(firsts, "digest", "left")
    p = p.withColumn("refers_to", F.when(F.col("page_id").isNull() | (F.col("page_id") > F.col("first")), F.col("first")))
    p = p.select("page_id", "url", F.when(F.col("refers_to").isNull(), F.col("html")).alias("html"), "digest", "size", "refers_to")

    def write(batches):
        part, number, held, records = TaskContext.get().partitionId(), 0, 0, []

        def flush():
            nonlocal number, held, records
            file = f"{folder}/part-{part:06d}-{number:04d}.warc.zst"
            size = write_atomically(file, lambda out: write_archive(out, records, level, dict_size, sample_bytes))
            row = batch(_FILE, [[file], [len(records)], [size]])
            number, held, records = number + 1, 0, []
            return row

        for b in batches:
            for r in b.to_pylist():
                payload = None if r["html"] is None else r["html"].encode()
                records.append(record(r["page_id"], r["url"], payload, r["digest"], r["size"], r["refers_to"], date))
                held += len(records[-1])
                if held >= file_bytes:
                    yield flush()
        if records:
            yield flush()

    p.mapInArrow(write, "file string, n_records long, bytes long").write.parquet(f"{folder}/manifest")
    return pages.sparkSession.read.parquet(f"{folder}/manifest")


_PAGE = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("url", pa.string())])


def read_warcs(files: DataFrame) -> DataFrame:
    """A row per record of the archives. A response's size and digest are taken from its payload, and must agree with its headers."""
    spread = files.select("file").repartition(int(files.sparkSession.conf.get("spark.sql.shuffle.partitions")), "file")

    def read(batches):
        for b in batches:
            for file in b.column(0).to_pylist():
                fs, path = open_fs(file)
                rows = []
                with fs.open_input_file(path) as f:
                    for h, block in read_archive(f):
                        http, _, payload = block.partition(b"\r\n\r\n")
                        kind, digest = h["WARC-Type"], h["WARC-Payload-Digest"].removeprefix("sha256:")
                        size = int(re.search(rb"Content-Length: (\d+)", http)[1])
                        if kind == "response" and (size != len(payload) or hashlib.sha256(payload).hexdigest() != digest):
                            raise ValueError(f"a payload in {file} isn't the one that was archived")
                        page, to = h.get("X-Page-Id"), h.get("X-Refers-To-Page-Id")
                        rows.append((None if page is None else int(page), size, digest, kind, None if to is None else int(to), h.get("WARC-Target-URI")))
                yield batch(_PAGE, [list(c) for c in zip(*rows)])

    return spread.mapInArrow(read, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string")


def op4_warc_dictionary(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = write_warcs(table(spark, sf_dir, "pages"), shared_dir(spark, "warc"))
    return read_warcs(files).drop("url")


ORACLE_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, strlen(html)::BIGINT AS payload_bytes, sha256(html) AS payload_digest FROM p),
f AS (SELECT payload_digest, min(page_id) AS first FROM d WHERE payload_bytes >= 100 GROUP BY 1)
SELECT d.page_id, d.payload_bytes, d.payload_digest,
       CASE WHEN d.page_id > f.first THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN d.page_id > f.first THEN f.first END AS refers_to
FROM d LEFT JOIN f USING (payload_digest)
"""
