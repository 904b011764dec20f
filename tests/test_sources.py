"""Capture decoding, JSON records, streams and lineage on rows made by hand."""

import struct

from pyspark.sql import functions as F

from kerngrain.operators import lineage, records
from kerngrain.sources import capture
from kerngrain.streaming import streams


V4 = lambda *x: bytes(x) + bytes(12)
SIX = bytes.fromhex("20010db8000000000000000000000001")
COMM = b"nginx\0junk\xff\0\0\0\0\0"


def socket(src=V4(10, 0, 0, 1), dst=V4(10, 0, 0, 2), family=2, ts=5):
    """Time, pid, tid, two addresses, ports (the second in network order), family: 54 bytes, packed by hand."""
    return struct.pack("<QII", ts, 1234, 1235) + src + dst + struct.pack("<H", 54321) + struct.pack(">H", 8080) + struct.pack("<H", family)


def connect(comm=COMM, ret=-111, **x):
    return socket(**x) + bytes(2) + struct.pack("<i", ret) + bytes(4) + struct.pack("<Q", 99) + comm + struct.pack("<I", 4026531840) + bytes(4)


def execution(comm=b"sh" + bytes(14), name=b"/bin/true", start=657653680687218):
    return struct.pack("<QIIIIQiI", 7, 42, 7, 4294967294, 1000, 99, 0, 43) + comm + name.ljust(256, b"\0") + bytes(range(32)) + struct.pack("<Q", start)


def opened(path=b"/etc/shadow", ret=-13):
    return struct.pack("<QIIQiI", 9, 42, 1000, 99, ret, 32768) + b"cat".ljust(16, b"\0") + path.ljust(256, b"\0")


GOLDEN = [
    (1, "kernel.tcp.connect", connect()),
    (2, "kernel.tcp.connect", connect()[:95]),
    (3, "kernel.tcp.connect", connect() + b"more"),
    (4, "kernel.tcp.connect", connect(src=SIX, dst=SIX[::-1], family=10)),
    (5, "kernel.tcp.connect", connect(comm=b"\xff\xfe" + bytes(14))),
    (6, "kernel.tcp.connect", connect(comm=b"sixteen-bytes-xx")),
    (7, "kernel.tcp.connect", None),
    (8, "kernel.tcp.close", socket() + bytes(2) + struct.pack("<QQQQ", 11, 22, 33000, 99) + COMM + struct.pack("<I", 5) + bytes(4)),
    (9, "kernel.tcp.close", socket() + bytes(2) + struct.pack("<QQQQ", 2**63, 22, 33000, 99) + COMM + struct.pack("<I", 5) + bytes(4)),
    (10, "kernel.tcp.retransmit", socket() + bytes([8]) + bytes(1 + 4 + 4) + struct.pack("<Q", 99) + COMM + struct.pack("<I", 5) + bytes(4)),
    (11, "kernel.process.exec", execution()),
    (12, "kernel.process.exec", execution(start=0)),
    (13, "kernel.file.open", opened()),
    (14, "kernel.file.open_attempt", opened(b"/" + b"x" * 255, -2)),
    (15, "kernel.unknown", connect()),
    (16, None, connect()),
]


def test_structures_have_their_sizes():
    sizes = {t: len(raw) for _, t, raw in GOLDEN if raw and t in capture.LAYOUTS and _ not in (2, 3)}
    assert sizes == {t: size for t, (_, size) in capture.LAYOUTS.items()} == {"kernel.tcp.connect": 96, "kernel.tcp.close": 112, "kernel.tcp.retransmit": 96, "kernel.process.exec": 352, "kernel.file.open": 304, "kernel.file.open_attempt": 304}


def test_decoding_a_mixed_table(spark):
    df = spark.createDataFrame(GOLDEN, "event_id long, event_type string, raw binary").withColumns({"node_id": F.lit("n"), "tags": F.array(F.lit("a"))}).coalesce(1)
    got = {r.event_id: r for r in capture.decode(df).collect()}
    assert len(got) == 16 and all(r.node_id == "n" and r.tags == ["a"] for r in got.values())
    c = got[1]
    assert (c.observed_at_ns, c.pid, c.tid, c.src_ip, c.src_port, c.dst_ip, c.dst_port, c.family, c.ret, c.cgroup_id, c.comm, c.netns) == (5, 1234, 1235, "10.0.0.1", 54321, "10.0.0.2", 8080, 2, -111, 99, "nginx", 4026531840)
    assert c.decode_error is None and c.filename is None and c.bytes_sent is None and c.path_truncated is None
    assert got[2].decode_error == got[7].decode_error == "too short" and got[2].pid is None and got[3].decode_error is None and got[3].ret == -111
    assert (got[4].src_ip, got[4].dst_ip, got[4].dst_port) == ("2001:db8::1", "100::b80d:120", 8080) and got[5].comm == "" and got[6].comm == "sixteen-bytes-xx"
    assert (got[8].bytes_sent, got[8].bytes_received, got[8].duration_ns, got[8].cgroup_id, got[8].comm, got[8].netns) == (11, 22, 33000, 99, "nginx", 5)
    assert got[9].decode_error == "out of range" and got[9].pid is None and got[10].state == 8 and got[10].cgroup_id == 99
    x = got[11]
    assert (x.observed_at_ns, x.pid, x.ppid, x.uid, x.gid, x.cgroup_id, x.ret, x.tid, x.comm, x.filename, x.start_boottime_ns) == (7, 42, 7, 4294967294, 1000, 99, 0, 43, "sh", "/bin/true", 657653680687218)
    assert x.argv_hash == bytes(range(32)).hex()
    o = got[13]
    assert (o.observed_at_ns, o.pid, o.uid, o.cgroup_id, o.ret, o.flags, o.comm, o.path, o.path_truncated) == (9, 42, 1000, 99, -13, 32768, "cat", "/etc/shadow", False)
    assert got[14].path == "/" + "x" * 255 and got[14].path_truncated is True
    assert got[15].decode_error == got[16].decode_error == "no layout"
    assert capture.decode(df.limit(0)).count() == 0


def test_captures_to_process_identity(spark):
    rows = spark.createDataFrame(GOLDEN, "event_id long, event_type string, raw binary").withColumns({"cluster": F.lit("c"), "node_id": F.lit("k8s-node-uid:8f01"), "boot_id": F.lit("b")})
    rec = records.normalize(capture.to_events(capture.decode(rows)))
    boot = F.lit("550E8400-E29B-41D4-A716-446655440000")
    by = lambda df: {r.event_id: r.labels for r in df.collect()}
    got = by(records.with_runtime_subject(rec, F.col("node_id"), boot))
    assert len(got) == 11  # what could not be decoded is no record
    assert got[11]["runtime_subject_id"].startswith("sha256:") and got[11]["boot_id"] == "550e8400-e29b-41d4-a716-446655440000" and got[11]["runtime_canonicalization_version"] == "1"
    assert (got[11]["gid"], got[11]["host_tgid"], got[11]["host_tid"], got[11]["leader_start_boottime_ns"]) == ("1000", "42", "43", "657653680687218") and got[11]["argv_hash"] == "sha256:" + bytes(range(32)).hex()
    assert "runtime_subject_id" not in got[12] and "leader_start_boottime_ns" not in got[12] and "runtime_identity_method" not in got[12] and "runtime_subject_id" not in got[1]
    assert got[14]["path_truncated"] == "true" and "path_truncated" not in got[13] and got[10]["tcp_state"] == "CLOSE_WAIT"
    for node, b in ((F.lit(""), boot), (F.col("node_id"), F.lit("not a boot id")), (F.lit(None).cast("string"), boot)):
        assert all("runtime_subject_id" not in x and "boot_id" not in x for x in by(records.with_runtime_subject(rec, node, b)).values())


def test_declared_layouts(spark):
    rows = [("p", "comm", 72, "u64"), ("p", "sk_skc_daddr", 32, "u32"), ("p", "sk_skc_dport", 50, "u16"), ("p", "ret", 56, "i32"), ("p", "netns", 88, "u32"), ("q", "big", 16, "u64"), ("q", "low", 16, "i64")]
    layouts = capture.declared(rows, {"p": 96, "q": 24})
    captures = [(1, "p", connect()), (2, "q", struct.pack("<QIIQ", 1, 2, 3, 2**64 - 1)), (3, "q", struct.pack("<QIIQ", 1, 2, 3, 77)), (4, "q", b"")]
    got = {r.event_id: r for r in capture.to_declared(spark.createDataFrame(captures, "event_id long, event_type string, raw binary"), layouts).collect()}
    assert (got[1].dst_ip, got[1].dst_port, got[1].ret, got[1].comm, got[1].src_ip, got[1].entity_ids) == ("10.0.0.2", 8080, -111, "nginx", None, ["process:1234", "netns:4026531840"])
    assert got[2].decode_error == "out of range" and got[3].entity_ids == ["process:2", "big:77", "low:77"] and got[4].decode_error == "too short"


def test_json_records_keep_what_is_corrupt(spark, tmp_path):
    (tmp_path / "x.json").write_text('{"id":"a","type":"t","labels":{"k":"v"}}\nnot json\n')
    a, bad = capture.read_records(spark, f"file://{tmp_path}").orderBy(F.col("id").isNull()).collect()
    assert a.labels == {"k": "v"} and a.outcome is None and bad._corrupt_record == "not json"


def test_as_of_takes_the_latest_before(spark):
    left = spark.createDataFrame([("n", 1, 5), ("n", 2, 10), ("m", 3, 10)], "node_id string, e long, t long")
    right = spark.createDataFrame([("n", 5, "a"), ("n", 9, "b"), ("n", 11, "c")], "node_id string, s long, v string")
    got = lineage.as_of(left, right, ["node_id"], "t", "s", ["v"])
    assert {r.e: r.v for r in got.collect()} == {1: "a", 2: "b", 3: None}


def test_receipts_split(spark):
    s = spark.createDataFrame([("n", "p", t, d) for t, d in [(0, 1), (10, 2), (20, 1), (50, 1)]], "node_id string, probe_id string, polled_ns long, dropped long")
    assert [(r.from_ns, r.to_ns) for r in lineage.receipts(s, 10).orderBy("from_ns").collect()] == [(0, 10), (20, 20), (50, 50)]


def test_fan_out_needs_the_primary_alone(spark):
    seen, warned = [], []
    df = spark.range(3)
    bad = lambda batch, epoch: 1 / 0
    streams.fan_out(lambda b, e: seen.append(b.count()), [bad, lambda b, e: seen.append(e)], lambda e, w: warned.append(w))(df, 7)
    assert seen == [3, 7] and "ZeroDivisionError" in warned[0]
    try:
        streams.fan_out(bad, [lambda b, e: seen.append("no")], lambda e, w: None)(df, 8)
    except ZeroDivisionError:
        pass
    assert seen == [3, 7]


def test_as_of_by_spans_is_the_same(spark):
    left = spark.range(300).selectExpr("concat('n', id % 2) as node_id", "id as e", "id * 37 % 1000 as t")
    right = spark.range(9).selectExpr("concat('n', id % 2) as node_id", "id * 111 as s", "id as v")
    rows = lambda df: sorted((r.e, r.v) for r in df.collect() if r.v is not None)
    plain = rows(lineage.as_of(left, right, ["node_id"], "t", "s", ["v"]))
    assert plain and all(rows(lineage.as_of(left, right, ["node_id"], "t", "s", ["v"], n)) == plain for n in (7, 100, 5000))


def test_as_of_by_spans_holds_every_nanosecond_and_ties(spark):
    at = 150_000 * 60_000_000_000
    left = spark.createDataFrame([("n", 1, at - 1), ("n", 2, at), ("n", 3, at + 10**12)], "node_id string, e long, t long")
    right = spark.createDataFrame([("n", at - 5, "a"), ("n", at - 5, "b"), ("n", at, "c")], "node_id string, s long, v string")
    for bucket in (None, 60_000_000_000):
        assert {r.e: r.v for r in lineage.as_of(left, right, ["node_id"], "t", "s", ["v"], bucket).collect()} == {1: "b", 2: "c", 3: "c"}
