"""Packet captures: files are cut to frames in Python, frames are decoded by Spark's own functions."""

from __future__ import annotations

import pickle
import re
import struct
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, replace

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_MAGIC = {b"\xd4\xc3\xb2\xa1": ("<", 1e6), b"\xa1\xb2\xc3\xd4": (">", 1e6), b"\x4d\x3c\xb2\xa1": ("<", 1e9), b"\xa1\xb2\x3c\x4d": (">", 1e9)}
_SECTION = b"\x0a\x0d\x0d\x0a"


#: a frame's header isn't believed beyond this, and a block's length neither
_LONGEST = 1 << 24
#: frames in a row that have to fit before a place is taken for the start of one
_CHAIN = 8


class _Held:
    """A capture in memory."""

    def __init__(self, raw: bytes):
        self.raw, self.size = raw, len(raw)

    def read(self, at: int, n: int) -> bytes:
        return self.raw[at : at + n]


class _File:
    """A capture in a file system, read in pieces."""

    def __init__(self, path: str):
        system, name = pafs.FileSystem.from_uri(re.sub(r"^file:/(?!/)", "file:///", path))
        self.file = system.open_input_file(name)
        self.size, self.at, self.piece = self.file.size(), 0, b""

    def read(self, at: int, n: int) -> bytes:
        if not (self.at <= at and at + n <= self.at + len(self.piece)):
            self.file.seek(at)
            self.at, self.piece = at, self.file.read(max(n, 1 << 20))
        return self.piece[at - self.at : at - self.at + n]


@dataclass(frozen=True)
class Format:
    """How to read on from a place: byte order; of pcap the time unit and link type, of pcapng those of the section's interfaces so far."""

    order: str
    unit: float = 1e6
    link: int = 1
    ports: tuple[tuple[int, float, int], ...] | None = None  # link type, unit, longest frame


def begin(source: _Held | _File) -> tuple[Format, int]:
    """The format and the place of the first frame or block."""
    head = source.read(0, 24)
    if head[:4] in _MAGIC:
        order, unit = _MAGIC[head[:4]]
        return Format(order, unit, struct.unpack(order + "I", head[20:24])[0] & 0xFFFF if len(head) == 24 else 1), 24
    if head[:4] == _SECTION:
        return Format("<", ports=()), 0
    raise ValueError("not a packet capture")


def _interface(order: str, body: bytes) -> tuple[int, float, int]:
    unit, k = 1e6, 8
    while k + 4 <= len(body):
        code, n = struct.unpack(order + "2H", body[k : k + 4])
        if code == 0:
            break
        if code == 9 and n:
            b = body[k + 4]
            unit = float(2 ** (b & 127)) if b & 128 else float(10**b)
        k += 4 + (n + 3) // 4 * 4
    link, longest = struct.unpack(order + "H2xI", body[:8])
    return link, unit, longest


def walk(source: _Held | _File, form: Format, at: int, stop: int) -> Iterator[tuple[int, Format, tuple | None]]:
    """From a frame's place to the first that begins at `stop` or later: the place after it, the format there, and (time, original length, link type, bytes).

    A frame that is cut off by the end of the capture is left out. Simple packet blocks have no time.
    """
    while at < stop and at + (16 if form.ports is None else 12) <= source.size:
        if form.ports is None:
            sec, part, held, size = struct.unpack(form.order + "4I", source.read(at, 16))
            after = at + 16 + held
            if after > source.size:
                return
            yield (at := after), form, (sec + part / form.unit, size, form.link, source.read(after - held, held))
            continue
        head = source.read(at, 12)
        if head[:4] == _SECTION:
            form = Format("<" if head[8:12] == b"\x4d\x3c\x2b\x1a" else ">", ports=())
        kind, size = struct.unpack(form.order + "2I", head[:8])
        if size < 12 or at + size > source.size:
            return
        frame, body = None, source.read(at + 8, size - 12) if kind in (1, 3, 6) else b""
        if kind == 1:
            form = replace(form, ports=(*form.ports, _interface(form.order, body)))
        elif kind == 6:
            port, high, low, held, length = struct.unpack(form.order + "5I", body[:20])
            link, unit, _ = form.ports[port] if port < len(form.ports) else (1, 1e6, 0)
            frame = ((high << 32) + low) / unit, length, link, body[20 : 20 + held]
        elif kind == 3:
            (length,) = struct.unpack(form.order + "I", body[:4])
            link, _, longest = form.ports[0] if form.ports else (1, 1e6, 0)
            frame = None, length, link, body[4 : 4 + min(length, longest or length)]
        at += size
        yield at, form, frame


def frames(raw: bytes) -> Iterator[tuple]:
    """(time, original length, link type, bytes) of each frame of a pcap or pcapng file; a cut last frame is left out."""
    source = _Held(raw)
    form, at = begin(source)
    return (f for _, _, f in walk(source, form, at, source.size) if f)


def _fits(source: _Held | _File, form: Format, at: int) -> int | None:
    """The place after what may begin here, if it looks like a frame's header (pcap) or a block (pcapng)."""
    if form.ports is None:
        head = source.read(at, 16)
        if len(head) < 16:
            return None
        _, part, held, size = struct.unpack(form.order + "4I", head)
        return at + 16 + held if part < form.unit and held <= size and size <= _LONGEST else None
    head = source.read(at, 8)
    if len(head) < 8:
        return None
    kind, size = struct.unpack(form.order + "2I", head)
    known = kind in (1, 2, 3, 4, 5, 6, 0xBAD, 0x40000BAD) or head[:4] == _SECTION
    if not known or size < 12 or size % 4 or size > _LONGEST or source.read(at + size - 4, 4) != head[4:]:
        return None
    return at + size


def resynchronised(source: _Held | _File, form: Format, at: int, stop: int) -> int:
    """The first place from which a chain of frames fits, up to the capture's end or _CHAIN long; `stop` if there is none before."""
    step = 1 if form.ports is None else 4
    at = -(-at // step) * step
    while at < stop:
        place, n = at, 0
        while place is not None and n < _CHAIN and place < source.size:
            place, n = _fits(source, form, place), n + 1
        if place is not None:
            return at
        at += step
    return stop


_FRAME = pa.schema([("file", pa.string()), ("number", pa.int64()), ("time", pa.float64()), ("length", pa.int64()), ("link", pa.int32()), ("data", pa.binary())])
_FRAME_DDL = "file string, number long, time double, length long, link int, data binary"


def _batches(rows: Iterable[tuple]) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []
    size = 0
    for r in rows:
        held.append(r)
        size += len(r[-1]) + 64
        if size > 4 << 20:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), _FRAME)], schema=_FRAME)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), _FRAME)], schema=_FRAME)


def read_frames(spark: SparkSession, path: str, range_bytes: int = 64 << 20) -> DataFrame:
    """file, number (from 1), time, length, link, data of each frame.

    Captures of at most range_bytes are read whole, by Spark's reader. Larger ones are cut to byte ranges (see split_ranges), so their folder has to be one
    that tasks can open.
    """

    def whole(batches):
        for b in batches:
            for file, raw in zip(b.column(0).to_pylist(), b.column(1)):
                yield from _batches((file, k, *f) for k, f in enumerate(frames(raw.as_py()), 1))

    def part(batches):
        for b in batches:
            for r in b.to_pylist():
                found = walk(_File(r["file"]), pickle.loads(r["form"]), r["start"], r["stop"])
                yield from _batches((r["file"], k, *f) for k, f in enumerate((f for _, _, f in found if f), r["first"]))

    files = spark.read.format("binaryFile").load(path)
    small = files.where(F.col("length") <= range_bytes).select("path", "content").mapInArrow(whole, _FRAME_DDL)
    large = files.where(F.col("length") > range_bytes).select("path", "length")
    return small.unionByName(split_ranges(large, range_bytes).repartition("file", "start").mapInArrow(part, _FRAME_DDL))


def write_frames(frames_: DataFrame, folder: str, link: int = 1) -> DataFrame:
    """Writes (time in microseconds, data) of each partition as one pcap file into a folder that tasks can open; file, n of each.

    A file appears under its name when it is whole, and a repeated task replaces it by the same bytes.
    """
    import uuid

    from pyspark import TaskContext

    from veritab.sources.staging import staged

    def put(batches):
        system, base = pafs.FileSystem.from_uri(re.sub(r"^file:/(?!/)", "file:///", folder))
        system.create_dir(base, recursive=True)
        name, n = f"part-{TaskContext.get().partitionId():05d}.pcap", 0
        part = f"{base}/.{name}.{uuid.uuid4().hex}"
        with system.open_output_stream(part) as out:
            out.write(struct.pack("<IHHiIII", 0xA1B2C3D4, 2, 4, 0, 0, _LONGEST, link))
            for b in batches:
                for us, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                    out.write(struct.pack("<IIII", us // 1_000_000, us % 1_000_000, len(data), len(data)) + data)
                    n += 1
        system.move(part, f"{base}/{name}")
        yield pa.RecordBatch.from_pydict({"file": [f"{folder}/{name}"], "n": [n]})

    picked = frames_.select(F.col("time").cast("long").alias("time"), F.col("data").cast("binary").alias("data"))
    return staged(picked.mapInArrow(put, "file string, n long"))


def split_ranges(files: DataFrame, range_bytes: int) -> DataFrame:
    """file, start, stop, form, first (number of the first frame) of ranges that begin and end between frames. files: path, length.

    A task looks for the first frame of its byte range and walks to the range's end; what it took for a frame's start is right only if the range before ends
    there. A second step checks this along each file, from its head on, and walks a range again where it wasn't; so no frame's content can mislead the result.
    """
    cut = files.select("path", F.explode(F.sequence(F.lit(0).cast("long"), F.col("length") - 1, F.lit(range_bytes).cast("long"))).alias("start"))

    def summary(source, form, at, stop):
        n, end, added = 0, at, form
        for end, added, f in walk(source, form, at, stop):  # noqa: B007
            n += f is not None
        return n, end, added

    def guess(batches):
        names = ("path", "start", "guess", "end", "n", "before", "form")
        for b in batches:
            rows = []
            for path, start in zip(*(b.column(c).to_pylist() for c in ("path", "start"))):
                source = _File(path)
                form, first = begin(source)
                stop = min(start + range_bytes, source.size)
                # interfaces of pcapng are told at the head, in most captures
                for place, form, f in walk(source, form, first, min(source.size, first + (1 << 16))) if start and form.ports is not None else ():  # noqa: B007, B020
                    if f is not None:
                        break
                at = first if start == 0 else resynchronised(source, form, max(start, first), stop)
                n, end, after = summary(source, form, at, stop)
                rows.append((path, start, at, end, n, pickle.dumps(form), pickle.dumps(after)))
            yield pa.RecordBatch.from_pydict({k: list(c) for k, c in zip(names, zip(*rows))} if rows else {k: [] for k in names}, schema=guessed)

    guessed = pa.schema([("path", pa.string()), ("start", pa.int64()), ("guess", pa.int64()), ("end", pa.int64()), ("n", pa.int64()), ("before", pa.binary()), ("form", pa.binary())])

    def checked(t: pa.Table) -> pa.Table:
        out, at, first, form, source = [], None, 1, None, None
        for r in sorted(t.to_pylist(), key=lambda r: r["start"]):
            before = pickle.loads(r["before"])
            at, form = (r["guess"], before) if at is None else (at, form)
            n, end, after = r["n"], r["end"], pickle.loads(r["form"])
            if (r["guess"], before) != (at, form):
                source = source or _File(r["path"])
                n, end, after = summary(source, form, at, min(r["start"] + range_bytes, source.size))
            out.append((r["path"], at, end, pickle.dumps(form), first))
            at, first, form = end, first + n, after
        return pa.table({k: list(c) for k, c in zip(("file", "start", "stop", "form", "first"), zip(*out))})

    found = cut.repartition("path", "start").mapInArrow(guess, "path string, start long, guess long, end long, n long, before binary, form binary")
    return found.groupBy("path").applyInArrow(checked, "file string, start long, stop long, form binary, first long")


def _number(data: Column, at, size: int) -> Column:
    """Unsigned big-endian number of `size` bytes at a place from 0; null beyond the end."""
    part = F.substring(data, F.lit(1) + at, F.lit(size))
    return F.when(F.octet_length(part) == size, F.conv(F.hex(part), 16, 10).cast("bigint"))


def _address(data: Column, at: int | Column) -> Column:
    """Four numbers; null beyond the end."""
    parts = [_number(data, F.lit(at) + k, 1).cast("string") for k in range(4)]
    return F.when(parts[3].isNotNull(), F.concat_ws(".", *parts))


def _address6(data: Column, at: Column) -> Column:
    """Eight groups in hex; the leftmost run of zero groups is cut to two colons. Null beyond the end."""
    groups = [F.lower(F.conv(F.hex(F.substring(data, at + 2 * k + 1, F.lit(2))), 16, 16)) for k in range(8)]
    whole = F.regexp_replace(F.concat_ws(":", *groups), r"\A(.*?)(?:\A|:)0(?::0)+(?::|\z)", "$1::")
    return F.when(F.octet_length(F.substring(data, at + 1, F.lit(16))) == 16, whole)


def _text(data: Column, at: Column, size: int | Column) -> Column:
    """Bytes as text, a character a byte."""
    return F.decode(F.substring(data, at + 1, size if isinstance(size, Column) else F.lit(size)), "ISO-8859-1")


def _dns_name(data: Column, message: Column) -> Column:
    """The first name asked for in a DNS message, pointers followed, 128 steps at most; "<root>" for the empty name."""
    byte = lambda at: F.coalesce(_number(data, at, 1), F.lit(0))

    def step(state: Column, _: Column) -> Column:
        at, size = state["at"], byte(state["at"])
        label = F.struct((at + size + 1).alias("at"), F.concat(state["labels"], F.array(_text(data, at, size + 1).substr(F.lit(2), size.cast("int")))).alias("labels"), F.lit(False).alias("done"))
        jump = F.struct((message + (size - 192) * 256 + byte(at + 1)).alias("at"), state["labels"].alias("labels"), F.lit(False).alias("done"))
        end = F.struct(at.alias("at"), state["labels"].alias("labels"), F.lit(True).alias("done"))
        return F.when(state["done"], state).when(size == 0, end).when(size >= 192, jump).otherwise(label)

    start = F.struct((message + 12).cast("bigint").alias("at"), F.array().cast("array<string>").alias("labels"), F.lit(False).alias("done"))
    name = F.array_join(F.aggregate(F.sequence(F.lit(1), F.lit(128)), start, step)["labels"], ".")
    return F.when(name == "", "<root>").otherwise(name)


def application(data: Column, at: Column, tcp: Column) -> tuple[Column, Column]:
    """(protocol, line) of what begins at a place in a frame: DNS questions, TLS records, first lines of HTTP, each by its ports; else null.

    Uses the columns src_port and dst_port.
    """
    on = lambda *ports: F.col("src_port").isin(*ports) | F.col("dst_port").isin(*ports)
    dns = on(53) & (F.octet_length(data) >= at + 12)
    answer = F.when(_number(data, at + 2, 2) >= 0x8000, " response").otherwise("")
    name = F.when(_number(data, at + 4, 2) > 0, _dns_name(data, at)).otherwise("")
    asked = F.trim(F.concat(F.lit("Standard query"), answer, F.lit(" 0x"), F.lpad(F.lower(F.hex(_number(data, at, 2))), 4, "0"), F.lit(" "), name))
    kind, first = _number(data, at, 1), _number(data, at + 5, 1)
    tls = tcp & on(443) & kind.between(20, 24) & (_number(data, at + 1, 1) == 3)
    # fixed values: names of records and handshakes
    record = F.when(kind == 22, "Handshake").when(kind == 23, "Application Data").when(kind == 21, "Alert").when(kind == 20, "Change Cipher Spec").otherwise("Record")
    shake = F.when(first == 1, "Client Hello").when(first == 2, "Server Hello").when(first == 11, "Certificate")
    hello = F.concat(F.lit("TLS "), F.when(kind == 22, F.coalesce(shake, record)).otherwise(record))
    line = F.substring_index(_text(data, at, 256), "\r\n", 1)
    http = tcp & on(80, 8080) & line.rlike(r"^((GET|POST|PUT|DELETE|HEAD|OPTIONS|PATCH) |HTTP/[0-9])")
    return F.when(dns, "DNS").when(tls, "TLS").when(http, "HTTP"), F.when(dns, asked).when(tls, hello).when(http, F.left(line, F.lit(120)))


#: most extension headers that are followed
_HEADERS = 8


def _after_extensions(data: Column, at: Column) -> tuple[Column, Column]:
    """(protocol, place) of what follows an IPv6 header and its chain of hop-by-hop, routing, destination, authentication and fragment headers.

    Of a fragment but the first the place is null, as no header of a protocol is there.
    """
    byte = lambda k: _number(data, k, 1)

    def step(s: Column, _: Column) -> Column:
        kind, here = s["kind"], s["at"]
        size = F.when(kind == 44, 8).when(kind == 51, (byte(here + 1) + 2) * 4).otherwise((byte(here + 1) + 1) * 8)
        later = (kind == 44) & (_number(data, here + 2, 2) >= 8)
        after = F.struct(byte(here).alias("kind"), F.when(~later, here + size).alias("at"))
        return F.when(kind.isin(0, 43, 44, 51, 60) & here.isNotNull() & byte(here + 1).isNotNull(), after).otherwise(s)

    start = F.struct(byte(at + 6).alias("kind"), (at + 40).cast("bigint").alias("at"))
    end = F.aggregate(F.sequence(F.lit(1), F.lit(_HEADERS)), start, step)
    return end["kind"], end["at"]


def decode(frames_: DataFrame) -> DataFrame:
    """Adds Ethernet, ARP, IPv4, IPv6, ICMP, TCP and UDP fields and a line of DNS, TLS and HTTP (app_line); null where a frame has none.

    Link types: Ethernet (1), with an 802.1Q tag or without, Linux cooked (113), and IP without a link header (12, 101, 228, 229).
    """
    d, link = F.col("data"), F.col("link")
    cooked, bare = link == 113, link.isin(12, 101, 228, 229)
    tag = F.when(_number(d, F.lit(12), 2) == 0x8100, 4).otherwise(0)
    of_version = F.when(F.shiftright(_number(d, F.lit(0), 1), 4) == 4, 0x0800).when(F.shiftright(_number(d, F.lit(0), 1), 4) == 6, 0x86DD)
    f = frames_.withColumn("ip_at", F.when(bare, 0).when(cooked, 16).otherwise(F.lit(14) + tag))
    f = f.withColumn("eth_type", F.when(bare, of_version).when(cooked, _number(d, F.lit(14), 2)).otherwise(_number(d, F.lit(12) + tag, 2)))
    known = (link == 1) | cooked | bare
    is_ip, is_ip6 = known & (F.col("eth_type") == 0x0800), known & (F.col("eth_type") == 0x86DD)
    next6, at6_ = _after_extensions(d, F.col("ip_at"))
    f = f.withColumn("ip_proto", F.when(is_ip, _number(d, F.col("ip_at") + 9, 1)).when(is_ip6, next6)).withColumn("after6", F.when(is_ip6, at6_))
    f = f.withColumn("ip_len", F.when(is_ip, _number(d, F.col("ip_at") + 2, 2))).withColumn("ip_ttl", F.when(is_ip, _number(d, F.col("ip_at") + 8, 1)))
    for name, at, at6 in (("ip_src", 12, 8), ("ip_dst", 16, 24)):
        f = f.withColumn(name, F.when(is_ip, _address(d, F.col("ip_at") + at)).when(is_ip6, _address6(d, F.col("ip_at") + at6)))
    f = f.withColumn("l4_at", F.when(is_ip, F.col("ip_at") + (_number(d, F.col("ip_at"), 1).bitwiseAND(15)) * 4).when(is_ip6, F.col("after6")))
    tcp, ports = F.col("ip_proto") == 6, F.col("ip_proto").isin(6, 17)
    f = f.withColumn("src_port", F.when(ports, _number(d, F.col("l4_at"), 2))).withColumn("dst_port", F.when(ports, _number(d, F.col("l4_at") + 2, 2)))
    f = f.withColumns({"tcp_seq": F.when(tcp, _number(d, F.col("l4_at") + 4, 4)), "tcp_ack": F.when(tcp, _number(d, F.col("l4_at") + 8, 4)), "tcp_hdr_len": F.when(tcp, F.shiftright(_number(d, F.col("l4_at") + 12, 1), 4) * 4), "tcp_flags": F.when(tcp, _number(d, F.col("l4_at") + 13, 1)), "tcp_window": F.when(tcp, _number(d, F.col("l4_at") + 14, 2))})
    names = [(1, "FIN"), (2, "SYN"), (4, "RST"), (8, "PSH"), (16, "ACK"), (32, "URG")]
    f = f.withColumn("tcp_flag_names", F.when(tcp, F.array_join(F.array_compact(F.array(*(F.when(F.col("tcp_flags").bitwiseAND(b) > 0, n) for b, n in names))), ",")))
    arp, icmp = known & (F.col("eth_type") == 0x0806), F.col("ip_proto").isin(1, 58)
    f = f.withColumns({"icmp_type": F.when(icmp, _number(d, F.col("l4_at"), 1)), "icmp_code": F.when(icmp, _number(d, F.col("l4_at") + 1, 1))})
    f = f.withColumn("udp_len", F.when(F.col("ip_proto") == 17, _number(d, F.col("l4_at") + 4, 2)))
    f = f.withColumn("arp_opcode", F.when(arp, _number(d, F.col("ip_at") + 6, 2)))
    f = f.withColumns({"arp_src": F.when(arp, _address(d, F.col("ip_at") + 14)), "arp_dst": F.when(arp, _address(d, F.col("ip_at") + 24))})
    f = f.withColumn("protocol", F.when(tcp, "TCP").when(F.col("ip_proto") == 17, F.when((F.col("src_port") == 53) | (F.col("dst_port") == 53), "DNS").otherwise("UDP")).when(F.col("ip_proto") == 1, "ICMP").when(F.col("ip_proto") == 58, "ICMPv6").when(is_ip, "IPv4").when(arp, "ARP").when(F.col("eth_type") == 0x86DD, "IPv6").otherwise("other"))
    app, line = application(d, F.col("app_at"), tcp)
    f = f.withColumn("app_at", F.when(tcp, F.col("l4_at") + F.col("tcp_hdr_len")).when(F.col("ip_proto") == 17, F.col("l4_at") + 8))
    return f.withColumn("app_line", line).withColumn("protocol", F.coalesce(app, "protocol")).drop("ip_at", "l4_at", "app_at", "after6")


def read_capture(spark: SparkSession, path: str) -> DataFrame:
    return decode(read_frames(spark, path))


def _mac(data: Column, at: int) -> Column:
    parts = F.lower(F.hex(F.substring(data, at + 1, 6)))
    return F.when(F.octet_length(data) >= at + 6, F.regexp_replace(parts, "(..)(?=.)", "$1:"))


def _option(data: Column, at: Column, end: Column, kind: int) -> Column:
    """Place of a TCP option's value; null if it isn't there. An option list has at most 40 bytes."""
    byte = lambda k: _number(data, k, 1)

    def step(s: Column, _: Column) -> Column:
        k, here = byte(s["at"]), s["at"]
        inside = s["found"].isNull() & (here < end) & k.isNotNull() & (k != 0)
        found = F.when((k == kind) & (byte(here + 1) >= 2), here + 2)
        go = F.struct((here + F.when(k == 1, 1).otherwise(F.greatest(F.coalesce(byte(here + 1), F.lit(1)), F.lit(1)))).alias("at"), found.alias("found"))
        return F.when(inside, go).otherwise(s)

    start = F.struct(at.cast("bigint").alias("at"), F.lit(None).cast("bigint").alias("found"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(40)), start, step)["found"]


def capture_columns(frames_: DataFrame) -> DataFrame:
    """The 32 named columns of a capture scan, for Ethernet frames with IPv4, TCP and UDP; null where a frame has none. Payload lengths leave padding out."""
    d = F.col("data")
    tag = F.when(_number(d, F.lit(12), 2) == 0x8100, 4).otherwise(0)
    ether = F.col("link") == 1
    is_ip = ether & (_number(d, F.lit(12) + tag, 2) == 0x0800)
    f = frames_.withColumn("_ip", F.when(is_ip, F.lit(14) + tag)).withColumn("_ihl", _number(d, F.col("_ip"), 1).bitwiseAND(15) * 4)
    ip = lambda at, n: _number(d, F.col("_ip") + at, n)
    f = f.withColumn("_first", ip(6, 2).bitwiseAND(0x1FFF) == 0).withColumn("_l4", F.when(F.col("_first"), F.col("_ip") + F.col("_ihl")))
    tcp, udp = ip(9, 1) == 6, ip(9, 1) == 17
    f = f.withColumn("_tcp", F.when(tcp, F.col("_l4"))).withColumn("_udp", F.when(udp, F.col("_l4")))
    t, u = (lambda c: lambda at, n: _number(d, F.col(c) + at, n))("_tcp"), (lambda c: lambda at, n: _number(d, F.col(c) + at, n))("_udp")
    f = f.withColumn("_head", F.shiftright(t(12, 1), 4) * 4)
    options, end = F.col("_tcp") + 20, F.col("_tcp") + F.col("_head")
    f = f.withColumn("_scale", _option(d, options, end, 3)).withColumn("_stamp", _option(d, options, end, 8))
    scale = F.when(F.col("_tcp").isNotNull() & (_number(d, F.col("_scale"), 1) > 0), _number(d, F.col("_scale"), 1)).otherwise(1)
    named = {
        "frame.number": F.col("number"), "frame.time_epoch": F.col("time"), "frame.len": F.col("length"),
        "eth.src": F.when(ether, _mac(d, 6)), "eth.dst": F.when(ether, _mac(d, 0)),
        "ip.version": F.shiftright(ip(0, 1), 4), "ip.hdr_len": F.col("_ihl"), "ip.len": ip(2, 2), "ip.id": ip(4, 2), "ip.flags": F.shiftright(ip(6, 2), 13),
        "ip.frag_offset": ip(6, 2).bitwiseAND(0x1FFF), "ip.ttl": ip(8, 1), "ip.proto": ip(9, 1),
        "ip.src": F.when(is_ip, _address(d, F.col("_ip") + 12)), "ip.dst": F.when(is_ip, _address(d, F.col("_ip") + 16)),
        "tcp.srcport": t(0, 2), "tcp.dstport": t(2, 2), "tcp.hdr_len": F.col("_head"), "tcp.flags": t(12, 2).bitwiseAND(0x1FF),
        "tcp.len": F.when(F.col("_tcp").isNotNull(), F.greatest(F.lit(0), ip(2, 2) - F.col("_ihl") - F.col("_head"))), "tcp.seq": t(4, 4), "tcp.ack": t(8, 4),
        "tcp.urgent_pointer": t(18, 2), "tcp.window_size_value": t(14, 2), "tcp.window_size_scalefactor": scale, "tcp.window_size": t(14, 2),
        "tcp.options.timestamp.tsval": _number(d, F.col("_stamp"), 4), "tcp.options.timestamp.tsecr": _number(d, F.col("_stamp") + 4, 4),
        "udp.srcport": u(0, 2), "udp.dstport": u(2, 2), "udp.length": u(4, 2),
        "_ws.col.protocol": F.when(F.col("_tcp").isNotNull(), "TCP").when(F.col("_udp").isNotNull(), "UDP").when(is_ip, "IP"),
    }
    return f.select(*(c.alias(k) for k, c in named.items()))
