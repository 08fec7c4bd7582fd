"""Files written by the tests themselves: captures, delimited text, uploads, sections; and a stream."""

import json
import struct

import pytest
from pyspark.sql import functions as F

from veritab.functions import logic
from veritab.operators.checks import cell_changes
from veritab.operators.rules import Rule
from veritab.sources import capture, demo, sinks, tables
from veritab.streaming import events


def tcp_frame(src=1234, dst=80, flags=0x12, tag=False):
    eth = b"\0" * 12 + (b"\x81\x00\x00\x05" if tag else b"") + b"\x08\x00"
    ip = struct.pack(">BBHHHBBH4s4s", 0x45, 0, 44, 1, 0, 64, 6, 0, bytes([10, 0, 0, 1]), bytes([10, 0, 0, 2]))
    return eth + ip + struct.pack(">HHIIBBHHH", src, dst, 4000000000, 7, 0x60, flags, 512, 0, 0) + b"\0" * 4


def pcap(frames, order="<", magic=0xA1B2C3D4, unit=1_000_000):
    out = struct.pack(order + "IHHiIII", magic, 2, 4, 0, 0, 65535, 1)
    for t, f in frames:
        out += struct.pack(order + "IIII", int(t), round((t % 1) * unit), len(f), len(f)) + f
    return out


def pcapng(frames):
    block = lambda kind, body: struct.pack("<II", kind, len(body) + 12) + body + struct.pack("<I", len(body) + 12)
    out = block(0x0A0D0D0A, struct.pack("<IHHq", 0x1A2B3C4D, 1, 0, -1)) + block(1, struct.pack("<HHI", 1, 0, 0) + struct.pack("<HHB3xHH", 9, 1, 9, 0, 0))
    for t, f in frames:
        k = round(t * 1e9)
        out += block(6, struct.pack("<IIIII", 0, k >> 32, k & 0xFFFFFFFF, len(f), len(f)) + f + b"\0" * (-len(f) % 4))
    return out


@pytest.mark.parametrize("raw", [pcap([(1.5, tcp_frame()), (2.0, tcp_frame(tag=True))]), pcap([(1.5, tcp_frame()), (2.0, tcp_frame(tag=True))], ">"), pcap([(1.5, tcp_frame()), (2.0, tcp_frame(tag=True))], magic=0xA1B23C4D, unit=1_000_000_000), pcapng([(1.5, tcp_frame()), (2.0, tcp_frame(tag=True))])])
def test_capture(spark, tmp_path, raw):
    (tmp_path / "a.pcap").write_bytes(raw)
    got = tables.read_table(spark, f"file://{tmp_path}/a.pcap").orderBy("number").collect()
    assert [(r.number, round(r.time, 6)) for r in got] == [(1, 1.5), (2, 2.0)]
    for r in got:
        assert (r.ip_src, r.ip_dst, r.src_port, r.dst_port, r.tcp_seq, r.tcp_hdr_len, r.tcp_flag_names, r.protocol) == ("10.0.0.1", "10.0.0.2", 1234, 80, 4000000000, 24, "SYN,ACK", "TCP")


def test_other_protocols(spark):
    import ipaddress

    a, b = (ipaddress.ip_address(x) for x in ("fe80::1:2a", "2001:db8:1:2:3:4:5:6"))
    eth = lambda kind: b"\0" * 12 + struct.pack(">H", kind)
    ip6 = lambda proto, src, dst, body: eth(0x86DD) + struct.pack(">IHBB", 6 << 28, len(body), proto, 64) + src.packed + dst.packed + body
    none = ipaddress.ip_address("::")
    ip4 = struct.pack(">BBHHHBBH4s4s", 0x45, 0, 28, 1, 0, 64, 1, 0, bytes([10, 0, 0, 1]), bytes([10, 0, 0, 2]))
    arp = struct.pack(">HHBBH6s4s6s4s", 1, 0x0800, 6, 4, 1, b"\0" * 6, bytes([10, 0, 0, 1]), b"\0" * 6, bytes([10, 0, 0, 9]))
    made = [ip6(17, a, b, struct.pack(">HHHH", 5000, 53, 8, 0)), ip6(58, none, a, b"\x87\0"), eth(0x0800) + ip4 + b"\x08\0", eth(0x0806) + arp, ip6(17, a, b, b"")[:40], eth(0x0806)]
    d = spark.createDataFrame([(k, 1, bytearray(x)) for k, x in enumerate(made)], "number long, link int, data binary")
    got = capture.decode(d).orderBy("number").collect()
    assert [r.protocol for r in got] == ["DNS", "ICMPv6", "ICMP", "ARP", "UDP", "ARP"]
    assert [(r.ip_src, r.ip_dst) for r in got] == [(str(a), str(b)), ("::", str(a)), ("10.0.0.1", "10.0.0.2"), (None, None), (str(a), None), (None, None)]
    assert [(r.src_port, r.dst_port, r.udp_len) for r in got if r.ip_proto == 17] == [(5000, 53, 8), (None, None, None)]
    assert [(r.icmp_type, r.icmp_code) for r in got] == [(None, None), (135, 0), (8, 0), (None, None), (None, None), (None, None)]
    assert [(r.arp_opcode, r.arp_src, r.arp_dst) for r in got if r.protocol == "ARP"] == [(1, "10.0.0.1", "10.0.0.9"), (None, None, None)]


def test_cut_capture_and_other_files():
    raw = pcap([(1.0, tcp_frame()), (2.0, tcp_frame())])
    assert len(list(capture.frames(raw[:-3]))) == 1
    with pytest.raises(ValueError):
        list(capture.frames(b"nothing"))


def test_delimited_text_and_aliases(spark, tmp_path):
    (tmp_path / "f.csv").write_text("Src IP;proto;bytes\n1.1.1.1;TCP;10\n2.2.2.2;UDP;20\n")
    d = tables.read_table(spark, f"file://{tmp_path}/f.csv")
    f = tables.first_alias(d, {"src": ["Src IP", "source"], "protocol": ["Proto"], "dst": ["to"]})
    assert sorted(tuple(r) for r in f.collect()) == [("1.1.1.1", "TCP", None), ("2.2.2.2", "UDP", None)]
    with pytest.raises(ValueError):
        tables.required(d, ["Packets"])


def test_json_rows(spark, tmp_path):
    (tmp_path / "f.json").write_text(json.dumps({"rows": [{"a": 1}, {"a": 2}]}))
    assert sorted(r.a for r in tables.read_table(spark, f"file://{tmp_path}/f.json").collect()) == [1, 2]


def test_sections(spark, tmp_path):
    (tmp_path / "k.md").write_text("# T\nintro\n## One\nbody 1\nmore\n## Two\nbody 2\n")
    got = tables.knowledge_sections(spark, f"file://{tmp_path}/k.md").orderBy("place").collect()
    assert [(r.heading, r.body) for r in got] == [("One", "body 1\nmore"), ("Two", "body 2")]


def test_source_guard():
    assert tables.allowed_source("/data/a/b.csv", "/data", [".csv"]) == "/data/a/b.csv"
    for p in ("/data/../etc/x.csv", "/data/x.exe"):
        with pytest.raises(ValueError):
            tables.allowed_source(p, "/data", [".csv"])


def test_stream_checks(spark, tmp_path):
    d = spark.createDataFrame([(1, "2024-01-01 00:00:00", 5.0), (1, "2024-01-01 00:00:00", 5.0), (2, "2024-01-01 00:01:00", 50.0), (3, "2024-01-02 00:00:00", 1.0)], "id int, ts string, value double").withColumn("ts", F.to_timestamp("ts"))
    d.write.parquet(f"file://{tmp_path}/in")
    s = events.once_each(events.event_stream(spark, f"file://{tmp_path}/in", d.schema), "id", "ts")
    q = s.writeStream.format("memory").queryName("seen").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    assert sorted(r.id for r in spark.sql("select id from seen").collect()) == [1, 2, 3]
    v = events.windowed_violations(events.event_stream(spark, f"file://{tmp_path}/in", d.schema), [Rule("E", logic.le(F.col("value"), 10.0))], "ts", "1 hour")
    q = v.writeStream.format("memory").queryName("bad").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    assert [(r.rule_id, r.n) for r in spark.sql("select * from bad").collect()] == [("E", 1)]


def test_rule_files_and_cache(spark, tmp_path):
    from veritab.sources import sinks

    r = spark.createDataFrame([("N1", "a <= 1")], "rule_id string, text string")
    sinks.write_rules(r, f"file://{tmp_path}/rules")
    assert [tuple(x) for x in sinks.read_rules(spark, f"file://{tmp_path}/rules").select("rule_id", "text").collect()] == [("N1", "a <= 1")]
    (tmp_path / "doc.json").write_text(json.dumps({"rules": [{"rule_id": "N2"}]}, indent=1))
    assert [x.rule_id for x in sinks.read_rules(spark, f"file://{tmp_path}/doc.json").collect()] == ["N2"]
    (tmp_path / "bad.json").write_text("{}")
    with pytest.raises(ValueError):
        sinks.read_rules(spark, f"file://{tmp_path}/bad.json")
    made = []
    for _ in range(2):
        assert sinks.cached(spark, f"file://{tmp_path}/cache", "k", lambda: made.append(1) or r).count() == 1
    assert made == [1]


def test_loose_rows_and_addresses(spark):
    from veritab.operators import flows
    from veritab.sources import sinks

    d = spark.createDataFrame([("Sure, here:\nTCP,1,60\nno row\nUDP,2,80",)], "value string")
    assert sorted(tuple(r) for r in sinks.loose_rows(d, "Proto string, Packets int, Bytes int").collect()) == [("TCP", 1, 60), ("UDP", 2, 80)]
    m = spark.createDataFrame([(bytes([1, 2, 255]), "a:1"), (None, "::1")], "b binary, h string")
    assert [tuple(r) for r in m.select(flows.mac_text(F.col("b")), flows.host_part(F.col("h"))).collect()] == [("01:02:ff", "a"), (None, "::1")]


def test_application_lines(spark):
    eth = b"\0" * 12 + b"\x08\0"

    def frame(proto, src, dst, body):
        ip = struct.pack(">BBHHHBBH4s4s", 0x45, 0, 20, 1, 0, 64, proto, 0, bytes([10, 0, 0, 1]), bytes([10, 0, 0, 2]))
        l4 = struct.pack(">HHHH", src, dst, 8 + len(body), 0) if proto == 17 else struct.pack(">HHIIBBHHH", src, dst, 1, 1, 0x50, 0x18, 512, 0, 0)
        return eth + ip + l4 + body

    dns = lambda flags, names: struct.pack(">6H", 0xAB, flags, 1, 0, 0, 0) + names
    made = [
        frame(17, 5000, 53, dns(0x100, b"\3www\7example\3com\0\0\1\0\1")), frame(17, 53, 5000, dns(0x8180, b"\1a\xc0\x10\1b\1c\0")), frame(17, 5000, 53, dns(0, b"\0")),
        frame(17, 5000, 53, dns(0, b"\xc0\x0c")), frame(17, 5000, 53, b"\0\1"), frame(6, 5000, 443, b"\x17\3\3\0\1\0"), frame(6, 443, 5000, b"\x16\3\3\0\1\2"), frame(6, 443, 5000, b"GET / HTTP/1.1"),
        frame(6, 80, 5000, b"HTTP/1.1 200 OK\r\nA: b\r\n"), frame(6, 5000, 8080, b"POST /" + b"x" * 400 + b" HTTP/1.1"), frame(6, 5000, 80, b""), frame(6, 5000, 80, b"get / HTTP/1.1"),
    ]
    d = spark.createDataFrame([(k, 1, bytearray(x)) for k, x in enumerate(made)], "number long, link int, data binary")
    got = [(r.protocol, r.app_line) for r in capture.decode(d).orderBy("number").collect()]
    assert got == [
        ("DNS", "Standard query 0x00ab www.example.com"), ("DNS", "Standard query response 0x00ab a.b.c"), ("DNS", "Standard query 0x00ab <root>"),
        ("DNS", "Standard query 0x00ab <root>"), ("DNS", None), ("TLS", "TLS Application Data"), ("TLS", "TLS Server Hello"), ("TCP", None),
        ("HTTP", "HTTP/1.1 200 OK"), ("HTTP", "POST /" + "x" * 114), ("TCP", None), ("TCP", None),
    ]


def test_json_sections(spark, tmp_path):
    files = {
        "a_b.json": {"title": "Doc", "tags": "x, y", "sections": [{"heading": "H", "body": " text "}, "no object", {"name": "N", "content": ["p", " q ", ""], "tags": ["t u"], "url": "there"}, {"title": "without body"}]},
        "list.json": [{"text": "one"}],
        "one.json": {"summary": "whole", "topic": "T", "source": "s"},
        "none.json": {"other": 1},
        "bad.json": "[not json",
    }
    for name, v in files.items():
        (tmp_path / name).write_text(v if name == "bad.json" else json.dumps(v))
    got = {tuple(r) if not isinstance(r.tags, list) else (*tuple(r)[:5], tuple(r.tags)) for r in tables.json_sections(spark, f"file://{tmp_path}").collect()}
    assert got == {
        ("a_b.json", 1, "Doc", "H", "text", ("x", "y", "a", "b")), ("there", 3, "Doc", "N", "p\nq", ("x", "y", "a", "b", "t u")),
        ("list.json", 1, "list", "section-1", "one", ("list",)), ("s", 1, "one", "T", "whole", ("one",)),
    }


def test_marked_csv_and_run(spark, tmp_path):
    d = spark.createDataFrame([(1, "a")], "n int, s string")
    tables.write_csv(d.coalesce(1), f"file://{tmp_path}/csv", {"n": "数"}, mark=True)
    assert next((tmp_path / "csv").glob("*.csv")).read_bytes() == "\ufeff数,s\n1,a\n".encode()
    path = sinks.write_run(spark, f"file://{tmp_path}/runs", "flows", "basic", {"fields": {"n": "integer"}}, {"predicates": d, "rules": d.where("n > 1")})
    assert path.endswith("_flows_basic")
    read = lambda name: json.loads("".join(r.value for r in spark.read.text(f"{path}/{name}").collect()))
    assert read("fields") == {"n": "integer"} and read("manifest")["rows"] == {"predicates": 1, "rules": 0} and read("predicates") == {"n": 1, "s": "a"}


def test_fault_package(spark, tmp_path):
    clean = demo.clean_package(spark)
    paths = demo.write_package(clean, f"file://{tmp_path}/package")
    cells = spark.read.json(paths["truth_table"])
    faulty = spark.read.csv(paths["faulty"], header=True, schema=clean.schema)
    # the cells of the single faults are the differences of all together
    both = cell_changes(clean, faulty, demo.PERIOD, demo.AMOUNTS).select("PeriodIndex", "column", "old", "new").collect()
    assert sorted(map(tuple, both)) == sorted(map(tuple, cells.select("PeriodIndex", "column", "old", "new").collect()))
    assert clean.where("OtherAssets <= 0").isEmpty()
    with pytest.raises(NotImplementedError):
        demo.injected("other", clean)
