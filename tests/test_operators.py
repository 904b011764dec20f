"""Operators on rows made by hand."""

import hashlib

from pyspark.sql import functions as F

from kerngrain.functions import columns as E
from kerngrain.operators import binding, knowledge, lineage, loss, pairing, records, rules, select
from kerngrain.schemas import EVENTS

ID = "ab" * 32


def event(**x):
    base = {c.split()[0]: None for c in EVENTS.split(", ")}
    return tuple((base | {"event_id": 1, "cluster": "c", "node_id": "n", "observed_at_ns": 0, "pid": 7, "cgroup_id": 9, "comm": "nginx"} | x).values())


def frame(spark, *rows):
    return spark.createDataFrame([event(**r) for r in rows], EVENTS)


TCP = dict(src_ip="10.0.0.1", src_port=54321, dst_ip="10.0.0.2", dst_port=8080)


def test_connect_failure_has_an_error_and_success_has_none(spark):
    rec = records.normalize(frame(spark, dict(event_type="kernel.tcp.connect", ret=-111, **TCP), dict(event_id=2, event_type="kernel.tcp.connect", ret=0, **TCP)))
    bad, good = rec.orderBy("event_id").collect()
    assert (bad.severity, bad.outcome, bad.error.code, bad.labels["errno_num"]) == ("warning", "failure", "ECONNREFUSED", "-111")
    assert len(bad.error.possible_causes) == 3 and bad.correlation_keys == ["10.0.0.1:54321->10.0.0.2:8080"]
    assert (good.severity, good.outcome, good.error) == ("info", "success", None) and "errno_num" not in good.labels
    assert good.process_data.uid is None and good.network_data.direction == "egress"


def test_absent_is_null_never_zero(spark):
    rec = records.normalize(frame(spark, dict(event_type="kernel.tcp.close", duration_ns=0, bytes_sent=5, **TCP), dict(event_id=2, event_type="kernel.process.exec", ppid=0, ret=0, filename="/bin/sh", uid=1000)))
    close, ex = rec.orderBy("event_id").collect()
    assert close.duration_us is None and close.network_data.bytes_sent == 5
    assert ex.process_data.ppid is None and ex.process_data.exit_code is None and ex.entity_ids == ["process:7", "executable:/bin/sh"]


def test_open_attempt_never_refers_to_a_resource(spark):
    rec = records.normalize(frame(spark, dict(event_type="kernel.file.open_attempt", ret=-2, path="/etc/shadow"))).first()
    assert rec.outcome == "failure" and rec.labels["requested_path"] == "/etc/shadow" and "resource_ref_id" not in rec.labels and rec.labels["path_resolution"] == "unresolved"


def test_runtime_subject_against_hashlib(spark):
    part = lambda b: len(b).to_bytes(8, "big") + b
    boot = "550E8400-E29B-41D4-A716-446655440000"
    want = hashlib.sha256(b"d" + part(b"node") + part(boot.lower().encode()) + part((4217).to_bytes(4, "big")) + part((657653680687218).to_bytes(8, "big")) + part((1).to_bytes(2, "big"))).hexdigest()
    got = lambda node, b, t, s: spark.range(1).select(records.runtime_subject(F.lit(node), F.lit(b), F.lit(t), F.lit(s), "d")).first()[0]
    assert got("node", boot, 4217, 657653680687218) == f"sha256:{want}"
    assert got(" node", boot, 4217, 1) is None and got("node", "x", 4217, 1) is None and got("node", boot, 0, 1) is None


def test_container_paths(spark):
    paths = {f"/k/cri-containerd-{ID}.scope": ("containerd", ID), f"/k/crio-{ID}.scope": ("cri-o", ID), f"/docker/{ID}": ("docker", ID), f"/k/{ID.upper()}": ("containerd", ID), "/system.slice": None, f"/{ID}/crio-zz.scope": None}
    rows = spark.createDataFrame([(p,) for p in paths], "p string").select("p", E.container_of_path(F.col("p")).alias("x")).collect()
    assert {r.p: tuple(r.x) if r.x else None for r in rows} == paths


def test_sensitive_paths(spark):
    yes = ["/etc/shadow", "/home/a/b/.ssh/id", "/var/run/secrets/x", "/etc/kubernetes/a/b"]
    no = ["/etc/shadow2", "/home/.ssh/id", "/tmp/x", "/var/run/secrets"]
    got = {r.p for r in spark.createDataFrame([(p,) for p in yes + no], "p string").where(E.matches_path(F.col("p"))).collect()}
    assert got == set(yes)
    assert E.path_pattern("/a[b]?") == r"(?s)^/a\[b\].$" and E.parse_patterns(" , ") == list(E.SENSITIVE_PATHS)


def test_errno_both_ways(spark):
    r = spark.range(1).select(E.errno_name(F.lit(-13)), E.errno_name(F.lit(-42)), E.errno_number(F.lit("E42")), E.errno_number(F.lit("ETIMEDOUT")), E.errno_number(F.lit("x"))).first()
    assert tuple(r) == ("EACCES", "E42", -42, -110, -1)


def test_guard_rails_of_rules(spark):
    ev = frame(spark, dict(event_type="kernel.tcp.connect", ret=-111, **TCP), dict(event_id=2, event_type="kernel.tcp.retransmit", tcp_state="ESTABLISHED", **TCP), dict(event_id=3, event_type="kernel.tcp.retransmit", tcp_state="CLOSE_WAIT", **TCP))
    refused, loss_, wait = [r.conclusion for r in knowledge.explain(ev).orderBy("event_id").collect()]
    assert "network" not in refused and "application" not in loss_ and "application" in wait


def test_losses_need_three_in_ten_seconds(spark):
    at = [0, 4, 10, 15, 40]
    ev = frame(spark, *[dict(event_id=i, event_type="kernel.tcp.retransmit", tcp_state="ESTABLISHED", observed_at_ns=s * 10**9, **TCP) for i, s in enumerate(at)])
    assert {(r.event_id, r.n) for r in rules.losses(ev).collect()} == {(2, 3)}


def test_followed_takes_the_next_close(spark):
    ev = frame(spark, *[dict(event_id=i, event_type=f"kernel.tcp.{t}", observed_at_ns=n, **TCP) for i, (t, n) in enumerate([("connect", 0), ("close", 5), ("close", 6), ("connect", 7), ("close", 3 * 10**9)])])
    assert [(r.event_id, r.next_id) for r in rules.followed(ev, "kernel.tcp.connect", "kernel.tcp.close", rules.CONNECTION, 1).collect()] == [(0, 1)]


def test_counters_that_go_back(spark):
    s = spark.createDataFrame([("n", "p", 3, 0, 20), ("n", "p", 5, 0, 30), ("n", "p", 2, 0, 40)], "node_id string, probe_id string, dropped long, tracking_start_ns long, polled_ns long")
    assert [(r.delta, r.from_ns) for r in loss.counter_deltas(s).orderBy("polled_ns").collect()] == [(3, 0), (2, 20), (2, 30)]


def test_gap_classes_sum_to_the_total(spark):
    ev = frame(spark, dict(event_type="kernel.tcp.close"), dict(event_id=2, event_type="kernel.process.exec", observed_at_ns=9), dict(event_id=3, event_type="kernel.tcp.retransmit"))
    g = loss.gaps(ev, "ringbuffer_overflow", "node_id").first()
    assert (g.dropped_records, g.dropped_reliability, g.dropped_attribution, g.gap_end_ns) == (3, 2, 1, 9)


def test_shedding_drops_reliability_first(spark):
    b = spark.createDataFrame([("c", "n", i, k, i, 1, 1) for i, k in enumerate(["attribution", "reliability", "attribution", "reliability"])], "cluster string, node_id string, batch_id long, class string, enqueued_ms long, records long, bytes long")
    assert {(r.batch_id, r.kept) for r in loss.shed(b, 3, 10, 100).collect()} == {(0, True), (2, True), (3, True), (1, False)}


def test_delivery_is_idempotent(spark):
    rec = records.idempotency_key(records.normalize(frame(spark, dict(event_type="kernel.tcp.close", **TCP), dict(event_type="kernel.tcp.close", **TCP), dict(event_id=2, event_type="kernel.tcp.close", cluster=" ", **TCP))))
    none = rec.limit(0)
    assert sorted(r.status for r in loss.deliver(rec, none).collect()) == ["ACCEPTED", "DUPLICATE", "REJECTED"]
    assert sorted(r.status for r in loss.deliver(rec, rec).collect()) == ["DUPLICATE", "DUPLICATE", "REJECTED"]


def test_binding_prefers_the_live_path(spark):
    ev = frame(spark, dict(event_type="kernel.tcp.close"), dict(event_id=2, cgroup_id=0), dict(event_id=3, cgroup_id=8), dict(event_id=4, pid=8, cgroup_id=11))
    cg = spark.createDataFrame([("c", "n", 9, f"/docker/{'0' * 64}"), ("c", "n", 11, "/init"), ("c", "other", 8, f"/docker/{ID}")], "cluster string, node_id string, cgroup_id long, path string")
    live = spark.createDataFrame([("c", "n", 7, f"/docker/{ID}")], "cluster string, node_id string, pid long, path string")
    pods = spark.createDataFrame([(ID.upper(), "u", "ns")], "container_id string, pod_uid string, namespace string")
    got = {r.event_id: (r.pod_uid, r.provenance, r.unbound_reason) for r in binding.bind(ev, cg, pods, live).collect()}
    assert got == {1: ("u", "observed", None), 2: (None, None, "no_cgroup"), 3: ("u", "observed", None), 4: (None, None, "host_process")}


def test_pods_latest_and_flat(spark):
    c = spark.createDataFrame([("apply", 1, "a", "x"), ("apply", 2, "a", "y"), ("apply", 1, "b", "x"), ("delete", 2, "b", "x")], "op string, seq long, pod_uid string, namespace string")
    assert [(r.pod_uid, r.namespace) for r in binding.latest_pods(c).collect()] == [("a", "y")]
    p = spark.createDataFrame([("a", "n", [f"containerd://{ID}"], None), (None, "n", [f"docker://{ID}"], ["x"])], "pod_uid string, namespace string, containers array<string>, init_containers array<string>")
    assert [tuple(r) for r in binding.flatten_pods(p).collect()] == [(ID, "a", "n")]


def test_questions_find_their_probes(spark):
    kb = knowledge.load(spark)
    q = spark.createDataFrame([("1", "why are connections failing"), ("2", "packet loss"), ("3", "connection refused"), ("4", "which process is writing to disk"), ("5", "zzz")], "question_id string, question string")
    first = {r.question_id: (r.function, r.layer) for r in knowledge.find(q, kb, 1).collect()}
    assert (first["1"][0], first["2"][0], first["3"][0], first["4"][1]) == ("tcp_connect", "tcp_retransmit_skb", "tcp_connect", "fs") and "5" not in first
    assert knowledge.dangling(kb).count() == 0 and kb.count() == 20
    assert {r.layer: (r.n_probes, r.n_broken) for r in knowledge.statistics(kb).collect()} == {"tcp": (8, 0), "memory": (3, 0), "fs": (4, 0), "process": (3, 0), "sched": (2, 0)}
    ev = frame(spark, dict(event_type="kernel.tcp.connect", ret=-111, **TCP))
    full = {r.question_id: r for r in knowledge.ask(q, kb, ev).collect()}
    assert full["3"].events == "1" and full["3"].action == rules.ACTIONS["R02"] and not full["3"].kb_only and full["4"].kb_only and "tcp_connect" in full["3"].probes_used
    answers = {k: (r.answer, r.severity) for k, r in full.items()}
    assert answers["3"] == (rules.BY_ID["R02"].conclusion, "error") and answers["5"][0] == "no probe answers this" and answers["4"][0] == "no event tells"


def test_every_nth_counts_over_buckets(spark):
    ev = frame(spark, *[dict(event_id=i, event_type="kernel.tcp.close", observed_at_ns=i * 7 * 10**9) for i in range(50)])
    assert [r.event_id for r in select.every_nth(ev, 10).orderBy("event_id").collect()] == [9, 19, 29, 39, 49]


def test_validation(spark):
    rec = records.normalize(frame(spark, dict(event_type="kernel.tcp.close", cluster=" ", **TCP)))
    assert records.violations(rec).first().violations == ["cluster is blank"]


def test_a_number_of_a_cgroup_is_of_its_node(spark):
    ev = frame(spark, dict(event_type="kernel.tcp.close"), dict(event_id=2, node_id="m", event_type="kernel.tcp.close"))
    cg = spark.createDataFrame([("c", "n", 9, f"/docker/{ID}"), ("c", "m", 9, "/init")], "cluster string, node_id string, cgroup_id long, path string")
    pods = spark.createDataFrame([(ID, "u", "ns")], "container_id string, pod_uid string, namespace string")
    assert {r.node_id: (r.pod_uid, r.unbound_reason) for r in binding.bind(ev, cg, pods).collect()} == {"n": ("u", None), "m": (None, "host_process")}


def test_what_is_rejected_makes_no_duplicate(spark):
    rows = [("k", "", 1), ("k", "c", 2), ("k", "c", 3)]
    batch = spark.createDataFrame([(k, c, "n", t, str(t)) for k, c, t in rows], "idempotency_key string, cluster string, node_id string, observed_at_ns long, id string")
    assert [r.status for r in loss.deliver(batch, batch.limit(0)).orderBy("observed_at_ns").collect()] == ["REJECTED", "ACCEPTED", "DUPLICATE"]
    r = loss.delivery_results(loss.deliver(batch, batch.limit(0)), "node_id").first()
    assert (r.accepted, r.rejected, r.reasons, r.retryable) == (2, 1, "blank cluster or node: 1", False)


def test_sequences_stay_within_a_boot_and_are_linear(spark):
    ev = frame(spark, *[dict(event_id=i, boot_id=b, event_type=t, observed_at_ns=ns, **TCP) for i, b, t, ns in [(1, "x", "kernel.tcp.connect", 5), (2, "x", "kernel.tcp.connect", 6), (3, "x", "kernel.tcp.close", 9), (4, "y", "kernel.tcp.connect", 7), (5, "x", "kernel.tcp.connect", 10)]])
    got = {r.event_id: (r.next_id, r.after_ns) for r in rules.followed(ev, "kernel.tcp.connect", "kernel.tcp.close", rules.CONNECTION, 1).collect()}
    assert got == {1: (3, 4), 2: (3, 3)}
    left = {r.event_id for r in rules.unanswered(ev, "kernel.tcp.connect", "kernel.tcp.close", rules.CONNECTION, 1).collect()}
    assert left == {4, 5}
    many = spark.range(200_000).selectExpr("id as event_id", "'c' as cluster", "'n' as node_id", "'b' as boot_id", "1L as pid", "case when id % 1000 = 999 then 'z' else 'a' end as event_type", "id as observed_at_ns")
    assert rules.followed(many, "a", "z", rules.PROCESS, 1).count() == 199_800  # one key, one step for each row


def test_metrics_while_reading(spark):
    from pyspark.sql import Observation

    from kerngrain.operators.metrics import observed

    seen = Observation("batch")
    assert observed(frame(spark, dict(event_type="t", ret=-1, observed_at_ns=4), dict(event_type="t", ret=0)), seen).count() == 2
    assert seen.get == {"events": 2, "failures": 1, "last_ns": 4}


def test_filters_of_probes(spark):
    ev = frame(spark, dict(event_type="a", dst_port=1), dict(event_id=2, event_type="a", dst_port=2), dict(event_id=3, event_type="a"), dict(event_id=4, event_type="b"))
    filters = spark.createDataFrame([("a", 1, None, None, None), ("a", None, None, 9, None)], "event_type string, dst_port int, src_ip string, pid long, comm string")
    assert sorted(r.event_id for r in select.probe_filters(ev, filters).collect()) == [1, 4]


def test_losses_are_counted_across_spans(spark):
    at = [50, 55, 60, 61, 118, 119, 121, 240]
    ev = frame(spark, *[dict(event_id=i, event_type="kernel.tcp.retransmit", tcp_state="ESTABLISHED", observed_at_ns=s * 10**9, **TCP) for i, s in enumerate(at)], dict(event_id=9, event_type="kernel.tcp.retransmit", tcp_state="ESTABLISHED", observed_at_ns=None, **TCP))
    assert sorted((r.event_id, r.n) for r in rules.losses(ev).collect()) == [(2, 3), (3, 3), (6, 3)]


def test_a_parent_is_the_last_execution_of_its_pid(spark):
    second = 10**9
    ev = frame(spark, *[dict(event_id=i, event_type="kernel.process.exec", pid=p, ppid=q, observed_at_ns=t * second, comm=c) for i, p, q, t, c in [(1, 1, None, 0, "init"), (2, 7, 1, 500, "a"), (3, 8, 1, 70, "b"), (4, 1, None, 400, "again"), (5, 9, 5, 600, "c")]])
    assert {r.event_id: (r.parent_event, r.parent_comm) for r in lineage.parents(ev).collect()} == {2: (4, "again"), 3: (1, "init"), 5: (None, None)}


def test_batches_part_by_class_in_order(spark):
    kinds = ["kernel.tcp.close", "kernel.tcp.connect", "kernel.tcp.retransmit", "kernel.process.exec"]
    ev = frame(spark, *[dict(event_id=i, event_type=kinds[i % 4], ret=0, observed_at_ns=100 - i, **TCP) for i in range(4)], dict(event_id=9, event_type="kernel.tcp.close", observed_at_ns=5, node_id="m", **TCP))
    found = records.split_by_class(records.normalize(ev), "node_id").collect()
    assert {(r.node_id, r.evidence_class, r.position): r.event_id for r in found} == {("n", "attribution", 0): 3, ("n", "attribution", 1): 1, ("n", "reliability", 0): 2, ("n", "reliability", 1): 0, ("m", "reliability", 0): 9}


def test_sizes_of_batches(spark):
    rec = records.normalize(frame(spark, *[dict(event_id=i, event_type="kernel.tcp.close", node_id="n" * (1 + i // 2), **TCP) for i in range(3)]))
    each = {r.event_id: r.approx_bytes for r in records.approximate_bytes(rec).collect()}
    whole = rec.where("event_id = 0").select(F.to_json(F.struct("id", "source", "type", "severity", "outcome", "correlation_keys", "entity_ids", "labels", "network_data", "process_data"))).first()[0]
    assert each[0] == len(whole.encode()) + 2 * len("tcp_close") + len("1") + len("tcp") + 256
    fixed = 128 + len("kerngrain" + "0.1" + "6.8.0" + "c")
    assert {r.node_id: (r.n, r.approx_bytes) for r in records.batch_bytes(rec, "node_id").collect()} == {"n": (2, each[0] + each[1] + fixed + 1), "nn": (1, each[2] + fixed + 2)}


def test_the_first_resolver_that_knows_tells(spark):
    ev = frame(spark, *[dict(event_id=i, event_type="kernel.process.exec", pid=i) for i in (1, 1, 2, 3)])
    of = lambda *rows: lambda keys: keys.join(spark.createDataFrame(rows, "pid long, container_id string, pod_uid string, namespace string"), "pid")
    found = binding.resolved(ev, of((1, "b", "p1", "x"), (1, "a", "p1", "x"), (2, None, None, "nothing")), of((1, "z", "z", "z"), (2, None, "p2", "y")))
    assert sorted((r.pid, r.resolver, r.container_id, r.pod_uid, r.namespace) for r in found.where("pid < 3").collect()) == [(1, 0, "a", "p1", "x"), (1, 0, "a", "p1", "x"), (2, 1, None, "p2", "y")]
    assert [(r.resolver, r.pod_uid) for r in found.where("pid = 3").collect()] == [(None, None)]


def test_asked_events_are_the_last_minute_in_order(spark):
    second = 10**9
    ev = frame(spark, *[dict(event_id=i, event_type="kernel.tcp.connect" if i % 2 else "kernel.tcp.close", ret=-111 if i % 2 else None, observed_at_ns=i * 10 * second, **TCP) for i in range(12)])
    times = lambda df: [(r.ts_ns // second, r.total) for r in df.orderBy("ts_ns").collect()]
    assert times(records.get_events(ev, 110 * second, "kernel.tcp.connect", limit=2)) == [(50, 2), (70, 2)]
    assert times(records.get_events(ev, 110 * second, limit=3)) == [(90, 3), (100, 3), (110, 3)]
    assert times(records.get_events(ev, 110 * second, dst_port=1)) == []
    assert {r.interp for r in records.get_events(ev, 110 * second, "kernel.tcp.connect").collect()} == {"no process listens on the destination port"}


def test_patterns_are_parted_and_trimmed():
    assert E.parse_patterns(" /a/* ,, /b/ ,") == ["/a/*", "/b/"] and E.parse_patterns(" , ") == list(E.SENSITIVE_PATHS)


def test_only_failed_exits_are_attempts(spark):
    rows = [("enter", "/a", None), ("exit", None, 0), ("exit", None, -2), ("enter", "/b", None), ("enter", "/c", None), ("exit", None, -13)]
    ev = frame(spark, *[dict(event_id=i, event_type="kernel.file.open", path=p, ret=r, observed_at_ns=i) for i, (_, p, r) in enumerate(rows)])
    kind = F.element_at(F.array(*[F.lit(k) for k, _, _ in rows]), (F.col("event_id") + 1).cast("int"))
    found = records.normalize(pairing.attempts(ev.withColumn("kind", kind))).collect()
    assert [(r.event_id, r.labels["requested_path"], r.labels["errno"], r.outcome) for r in found] == [(5, "/c", "EACCES", "failure")]


def test_batches_settle(spark):
    items = spark.createDataFrame([(1, "ACCEPTED", None, False), (1, "DUPLICATE", None, False), (2, "ACCEPTED", None, False), (2, "REJECTED", "a", False), (2, "REJECTED", "b", None), (2, "REJECTED", "a", False), (3, "REJECTED", "full", True), (3, "REJECTED", "a", False)], "batch int, status string, reason string, retryable boolean")
    found = {r.batch: (r.accepted, r.duplicates, r.rejected, r.reasons, r.outcome, r.warning) for r in loss.settled(items, "batch").collect()}
    assert found == {1: (2, 1, 0, "", "delivered", "1 duplicate items"), 2: (1, 0, 3, "a: 2; b: 1", "partial_failure", None), 3: (0, 0, 2, "a: 1; full: 1", "retry", None)}


def test_samples_by_hash_are_the_same_each_time(spark):
    ev = spark.range(4000).withColumnRenamed("id", "event_id")
    first, again = ({r.event_id for r in select.sampled(x, 4).collect()} for x in (ev, ev.repartition(7)))
    assert first == again and 800 < len(first) < 1200
