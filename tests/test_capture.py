"""Captures cut to byte ranges against the walk from the head, header chains, cooked frames, and the named columns."""

import random
import struct

import pytest

from tests.test_sources import pcap, tcp_frame
from veritab.sources import capture


def frame(rng, n):
    return b"\0" * 12 + struct.pack(">H", 0x0800) + rng.randbytes(n)


def blocks(rng, frames, order="<"):
    """pcapng of two sections, the second with two interfaces that are told between frames; enhanced and simple packet blocks."""
    block = lambda kind, body: struct.pack(order + "II", kind, len(body) + 12) + body + struct.pack(order + "I", len(body) + 12)
    section = block(0x0A0D0D0A, struct.pack(order + "IHHq", 0x1A2B3C4D, 1, 0, -1))
    port = lambda digits: block(1, struct.pack(order + "HHI", 1, 0, 100) + struct.pack(order + "HHB3xHH", 9, 1, digits, 0, 0))
    out = section + port(9)
    for k, f in enumerate(frames):
        if k == len(frames) // 2:
            out += section + port(6)
        if k == len(frames) * 3 // 4:
            out += port(3)
        if k % 5 == 4:
            out += block(3, struct.pack(order + "I", len(f)) + f[:100] + b"\0" * (-len(f[:100]) % 4))
        else:
            out += block(6, struct.pack(order + "IIIII", int(k > len(frames) * 3 // 4), 0, 1000 * k, len(f), len(f)) + f + b"\0" * (-len(f) % 4))
    return out


@pytest.mark.parametrize("kind", ["pcap", "pcapng", "inside", "zeros", "big"])
def test_ranges(spark, tmp_path, kind):
    rng = random.Random(len(kind))
    made = [frame(rng, rng.choice([0, 5, 60, 400])) for _ in range(300)]
    if kind == "inside":  # captures inside frames, and frames of zeros: places that look like starts but aren't
        inner = pcap([(k, tcp_frame()) for k in range(12)])[24:]
        made = [b"\0" * 14 + inner if k % 3 else b"\0" * 700 for k in range(60)]
    if kind == "zeros":
        made = [b"\0" * rng.choice([64, 700]) for _ in range(80)]
    raw = blocks(rng, made, "<" if kind == "pcapng" else ">") if kind in ("pcapng", "big") else pcap([(k + 0.5, f) for k, f in enumerate(made)])
    (tmp_path / "a.cap").write_bytes(raw[: -7 if kind == "pcap" else None])
    (tmp_path / "b.cap").write_bytes(pcap([(1.0, tcp_frame())]))
    want = [("a.cap", k, *f) for k, f in enumerate(capture.frames((tmp_path / "a.cap").read_bytes()), 1)]
    want += [("b.cap", k, *f) for k, f in enumerate(capture.frames((tmp_path / "b.cap").read_bytes()), 1)]
    assert len(want) > 50
    for size in (400, 3000, 1 << 20):
        got = capture.read_frames(spark, f"file://{tmp_path}/*.cap", range_bytes=size).collect()
        assert sorted((r.file.rsplit("/", 1)[1], r.number, r.time, r.length, r.link, bytes(r.data)) for r in got) == want


def test_header_chains(spark):
    def ip6(kind, rest, link=14):
        return b"\0" * 12 + b"\x86\xdd" + struct.pack(">IHBB", 6 << 28, len(rest), kind, 64) + bytes(15) + b"\1" + bytes(15) + b"\2" + rest

    udp = struct.pack(">HHHH", 5000, 4000, 8, 0)
    hop, routing, options = bytes([43, 0]) + bytes(6), bytes([60, 1]) + bytes(14), bytes([17, 0]) + bytes(6)
    auth = bytes([17, 4]) + bytes(22)
    made = [
        ip6(17, udp), ip6(0, hop + routing + options + udp), ip6(51, auth + udp), ip6(44, bytes([17, 0, 0, 1, 0, 0, 0, 9]) + udp),
        ip6(44, bytes([17, 0, 0, 8, 0, 0, 0, 9]) + b"x" * 20), ip6(0, b"\x2b"), ip6(0, (bytes([0, 0]) + bytes(6)) * 9 + udp),
    ]
    v4 = struct.pack(">BBHHHBBH4s4s", 0x45, 0, 28, 1, 0, 64, 17, 0, bytes([10, 0, 0, 1]), bytes([10, 0, 0, 2])) + udp
    others = [(113, bytes(14) + b"\x08\x00" + v4), (101, v4), (229, made[0][14:]), (113, bytes(14) + b"\x86\xdd" + made[1][14:]), (101, b""), (113, b"\0")]
    d = spark.createDataFrame([(k, 1, bytearray(f)) for k, f in enumerate(made)] + [(10 + k, n, bytearray(f)) for k, (n, f) in enumerate(others)], "number long, link int, data binary")
    got = {r.number: (r.ip_proto, r.src_port, r.udp_len) for r in capture.decode(d).collect()}
    whole, none = (17, 5000, 8), (None, None, None)
    assert [got[k] for k in range(7)] == [whole, whole, whole, whole, (17, None, None), (0, None, None), (0, None, None)]
    assert [got[k] for k in range(10, 16)] == [whole, whole, whole, whole, none, none]
    assert {r.ip_src for r in capture.decode(d).where("number in (10, 11)").collect()} == {"10.0.0.1"}


def test_named_columns(spark):
    options = bytes([1, 1, 8, 10]) + struct.pack(">II", 77, 88) + bytes([3, 3, 7, 0])
    tcp = struct.pack(">HHIIBBHHH", 1234, 80, 5, 6, 9 << 4, 0x18, 512, 0, 3) + options + b"abc"
    ip = lambda proto, body, flags=0x4000: struct.pack(">BBHHHBBH4s4s", 0x45, 0, 20 + len(body), 9, flags, 64, proto, 0, bytes([10, 0, 0, 1]), bytes([10, 0, 0, 2])) + body
    eth = bytes(range(6)) + bytes([0xAA] * 6) + b"\x08\x00"
    made = [eth + ip(6, tcp) + b"pad", eth + ip(17, struct.pack(">HHHH", 1, 2, 8, 0)), eth + ip(6, tcp, 0x2001), eth[:12] + b"\x08\x06", eth + ip(1, b"\x08\0")]
    d = spark.createDataFrame([(k, 1.5, len(f), 1, bytearray(f)) for k, f in enumerate(made, 1)], "number long, time double, length long, link int, data binary")
    out = capture.capture_columns(d)
    assert len(out.columns) == 32
    a, b, c, e, i = out.orderBy("`frame.number`").collect()
    assert (a["eth.src"], a["eth.dst"], a["ip.flags"], a["ip.id"], a["ip.hdr_len"], a["ip.len"]) == ("aa:aa:aa:aa:aa:aa", "00:01:02:03:04:05", 2, 9, 20, 59)
    assert (a["tcp.srcport"], a["tcp.hdr_len"], a["tcp.flags"], a["tcp.len"], a["tcp.urgent_pointer"], a["tcp.window_size_scalefactor"]) == (1234, 36, 24, 3, 3, 7)
    assert (a["tcp.options.timestamp.tsval"], a["tcp.options.timestamp.tsecr"], a["tcp.window_size"], a["_ws.col.protocol"]) == (77, 88, 512, "TCP")
    assert (b["udp.srcport"], b["udp.dstport"], b["udp.length"], b["tcp.len"], b["tcp.window_size_scalefactor"], b["_ws.col.protocol"]) == (1, 2, 8, None, 1, "UDP")
    assert (c["ip.frag_offset"], c["tcp.srcport"], c["_ws.col.protocol"]) == (1, None, "IP")
    assert (e["ip.version"], e["_ws.col.protocol"], i["ip.proto"], i["_ws.col.protocol"]) == (None, None, 1, "IP")
