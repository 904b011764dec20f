"""State in streams, readiness, ingress and intervals on rows made by hand."""

import threading
import time

from pyspark.sql import functions as F

from kerngrain.operators import binding, lineage, loss, rules
from kerngrain.operators.intervals import points_in
from kerngrain.streaming import state, streams
from kerngrain.streaming.readiness import PROGRESS, Progress, readiness

YEAR = 31_536_000_000_000_000


def test_intervals_of_all_lengths(spark):
    points = spark.range(2000).selectExpr("'n' as node", "id as p", "id * 977 % 5000 as at").unionByName(spark.createDataFrame([("n", -1, None), ("m", -2, 5), ("n", -3, YEAR)], "node string, p long, at long"))
    spans = spark.range(3000).selectExpr("'n' as node", "id as s", "id * 31 % 5000 as a", "id * 31 % 5000 + case when id % 500 = 0 then 4000 when id % 10 = 0 then 300 else id % 7 end as b")
    odd = spark.createDataFrame([("n", -1, None, 5), ("n", -2, 9, 3), ("n", -3, 100, None), ("n", -4, -50, 20), ("n", -5, 0, YEAR)], "node string, s long, a long, b long")
    spans = spans.unionByName(odd)
    got = sorted((r.p, r.s) for r in points_in(points, spans, ["node"], "at", "a", "b").collect())
    p, s = points.collect(), spans.collect()
    ends = [(x.s, x.a, 2**63 - 1 if x.b is None else x.b) for x in s if x.a is not None]
    assert got == sorted((x.p, n) for x in p if x.node == "n" and x.at is not None for n, a, b in ends if a <= x.at <= b)


def test_a_gap_of_decades_is_a_few_rows(spark):
    events = spark.createDataFrame([("c", "n", 5, 1)], "cluster string, node_id string, observed_at_ns long, event_id long")
    long_gap = spark.createDataFrame([("c", "n", 0, 1_700_000_000_000_000_000), ("d", "n", 0, 10)], "cluster string, node_id string, gap_start_ns long, gap_end_ns long")
    began = time.time()
    assert loss.during_gaps(events, long_gap).count() == 1 and time.time() - began < 30
    assert loss.during_gaps(events, long_gap.limit(0)).count() == 0


def test_placements_hold_from_one_move_to_the_next(spark):
    moves = spark.createDataFrame([("n", 10, "a"), ("n", 20, "b"), ("n", 20, "c"), ("m", 5, "x")], "node string, valid_from long, place string")
    events = spark.createDataFrame([("n", e, t) for e, t in enumerate([9, 10, 19, 25, 10**15])], "node string, event_id long, observed_at_ns long")
    got = {r.event_id: r.place for r in lineage.placed(events, moves, "node").collect()}
    assert got.keys() == {1, 2, 3, 4} and got[1] == got[2] == "a" and got[3] == got[4] and got[3] in ("b", "c")


WATCH = [(1, "apply", "a"), (2, "apply", "b"), (3, "init", None), (4, "init_apply", "a"), (5, "init", None), (6, "init_apply", "b"), (7, "init_done", None), (8, "delete", "a"), (9, "delete", "b"), (10, "init", None), (11, "init_done", None), (12, "init_done", None), (13, "apply", "b"), (14, "init", None), (15, "init_done", None)]
CHANGES = [(1, "apply", "a"), (2, "apply", "b"), (4, "apply", "a"), (6, "apply", "b"), (7, "delete", "a"), (9, "delete", "b"), (13, "apply", "b"), (15, "delete", "b")]


def test_listings_delete_once_and_broken_ones_nothing(spark):
    """a is named only by the listing that is broken off, so the whole one deletes it; that delete is not repeated."""
    watch = spark.createDataFrame([("c", s, op, uid, f"{uid}{s}" if uid else None) for s, op, uid in WATCH], "cluster string, seq long, op string, pod_uid string, pod string")
    got = sorted((r.seq, r.op, r.pod_uid, r.pod) for r in binding.watch_changes(watch).collect())
    assert [x[:3] for x in got] == CHANGES and all((x[3] is None) == (x[1] == "delete") for x in got)


def _replayed(rows):
    """What a watch amounts to, row after row in order of seq."""
    out, clusters = [], {}
    for cluster, seq, op, uid, pod in sorted(rows, key=lambda r: r[1]):
        seen = clusters.setdefault(cluster, {"pods": {}, "begin": None})
        if op == "init":
            seen["begin"] = seq
        elif op == "init_done" and seen["begin"] is not None:
            gone = [x for x, last in seen["pods"].items() if last < seen["begin"]]
            out += [(cluster, seq, "delete", x, None) for x in gone if seen["pods"].pop(x) is not None]
            seen["begin"] = None
        elif op in ("apply", "init_apply"):
            seen["pods"][uid] = seq
            out.append((cluster, seq, "apply", uid, pod))
        elif op == "delete" and seen["pods"].pop(uid, None) is not None:
            out.append((cluster, seq, "delete", uid, None))
    return sorted(out, key=lambda r: (r[1], r[3]))


def _watch(n, block, pods):
    """Two clusters' blocks of numbers with a listing each, of which one in three is broken off."""
    rows = []
    for i in range(n):
        b, k = divmod(i, block)
        op = "init" if k == 0 else "init_done" if k == 2 and b // 2 % 3 else "init_apply" if k <= 2 else "delete" if i * 7 % 5 == 0 else "apply"
        rows.append((f"c{b % 2}", i, op, f"pod-{i * 7919 % 104729 % pods}", f"ns-{i % 7}"))
    return rows


WATCHED = "cluster string, seq long, op string, pod_uid string, pod string"


def test_a_row_looks_for_one_listing_however_many_there_are(spark):
    rows = _watch(200_000, 4, 50)
    watch = spark.createDataFrame(rows, WATCHED).repartition(4)
    began = time.time()
    got = sorted(map(tuple, binding.watch_changes(watch).collect()), key=lambda r: (r[1], r[3]))
    assert time.time() - began < 40
    assert got == _replayed(rows)


def test_listings_are_found_beyond_spans(spark):
    rows = _watch(3000, 97, 7)
    want = _replayed(rows)
    for span in (2, 50, 1000):
        got = binding.watch_changes(spark.createDataFrame(rows, WATCHED), span).collect()
        assert sorted(map(tuple, got), key=lambda r: (r[1], r[3])) == want


def test_listings_as_a_stream_in_any_order(spark, tmp_path):
    rows = spark.createDataFrame([("c", s, op, uid or "", "p") for s, op, uid in WATCH] + [("z", 0, "tick", "", "")], "cluster string, seq long, op string, pod_uid string, pod string")
    rows = rows.withColumn("event_time", F.when(F.col("cluster") == "z", F.lit("2034-01-01").cast("timestamp")).otherwise(F.timestamp_seconds(F.lit(1704067200) + F.col("seq"))))
    rows.where("seq % 2 = 1").coalesce(1).write.parquet(f"{tmp_path}/in")
    rows.where("seq % 2 = 0 and cluster = 'c'").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    rows.where("cluster = 'z'").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(f"file://{tmp_path}/in")
    with state.stateful(spark):
        streams.run_once(state.pod_changes(stream, "1 day"), f"file://{tmp_path}/out", f"file://{tmp_path}/state")
    assert sorted((r.seq, r.op, r.pod_uid) for r in spark.read.parquet(f"{tmp_path}/out").collect()) == CHANGES


def _streamed(spark, path, files, change):
    """Files of a watch, one to a batch, and then a row of a day long after all others, which closes what waits, through a stream: what it gives."""
    for rows in [*files, [("z", 0, "tick", "", "")]]:
        seen_at = F.when(F.col("cluster") == "z", F.lit("2034-01-01").cast("timestamp")).otherwise(F.timestamp_seconds(F.lit(1704067200) + F.col("seq")))
        frame = spark.createDataFrame(rows, WATCHED).withColumn("event_time", seen_at)
        frame.coalesce(1).write.mode("append").parquet(f"{path}/in")
    stream = spark.readStream.schema(frame.schema).option("maxFilesPerTrigger", 1).parquet(f"file://{path}/in")
    with state.stateful(spark):
        streams.run_once(change(stream), f"file://{path}/out", f"file://{path}/state")
    return sorted(map(tuple, spark.read.parquet(f"{path}/out").collect()), key=lambda r: (r[1], r[3]))


def test_a_stream_of_one_cluster_is_not_a_call_for_each_row(spark, tmp_path):
    rows = [("c", *r[1:]) for r in _watch(60_000, 97, 60)]
    began = time.time()
    files = [[r for r in rows if r[1] * 7919 % 104729 % 2 == i] for i in range(2)]
    assert _streamed(spark, tmp_path, files, lambda w: state.pod_changes(w, "30 days")) == _replayed(rows)
    assert time.time() - began < 45


def test_rows_wait_in_blocks_while_the_watermark_moves(spark, tmp_path):
    """Files follow one another in time, but some rows come a file late and some twice; of blocks of three rows the watermark passes a part."""
    rows, processor = _watch(300, 20, 7), state.PodWatch()
    processor.block = 3
    files = [[r for r in rows if r[1] // 60 + (r[1] % 10 == 3) == i] for i in range(6)]
    files = [f + [r for r in f if r[1] % 9 == 0] for f in files]
    assert _streamed(spark, tmp_path, files, lambda w: state.run_in_order(w, processor, ["cluster"], "seq", "seq", "70 seconds")) == _replayed(rows)


TCP = "event_id long, cluster string, node_id string, boot_id string, src_ip string, src_port int, dst_ip string, dst_port int, observed_at_ns long, event_type string, ret int, bytes_sent long, bytes_received long"


def test_lifetimes_of_connections(spark):
    c = ("c", "n", "b", "s", 1, "d", 2)
    row = lambda i, t, kind, ret=None, sent=None: (i, *c, t, f"kernel.tcp.{kind}", ret, sent, sent)
    rows = [row(1, 10, "retransmit"), row(2, 20, "close", sent=7), row(3, 30, "connect", 0), row(4, 40, "retransmit"), row(5, 50, "retransmit"), row(6, 60, "close", sent=9), row(7, 70, "connect", -111), row(8, 80, "connect", 0), row(9, 90, "connect", 0), row(10, 95, "retransmit")]
    lives = rules.lifetimes(spark.createDataFrame(rows, TCP))
    got = [(r.connect_id, r.close_id, r.lifetime_ns, r.losses, r.bytes_sent, r.state) for r in lives.orderBy(F.coalesce("begin_ns", "end_ns")).collect()]
    assert got == [(None, 2, None, 1, 7, "closed_unseen"), (3, 6, 30, 2, 9, "closed"), (7, None, None, 0, None, "failed"), (8, None, None, 0, None, "superseded"), (9, None, None, 1, None, "open")]
    (b,) = rules.backends(lives).collect()
    assert (b.connections, b.failed, b.open, b.closed, b.superseded, b.losses, b.lossy, b.mean_lifetime_ns) == (4, 1, 1, 1, 1, 4, 3, 30)


def test_a_pid_used_twice_is_two_processes_and_late_rows_amend(spark):
    schema = "cluster string, node_id string, boot_id string, pid long, observed_at_ns long, start_boottime_ns long, ingested long, event_id long, comm string"
    row = lambda t, start, ingested, e, comm, pid=7: ("c", "n", "b", pid, t, start, ingested, e, comm)
    early = spark.createDataFrame([row(10, 9, 1, 1, "sh"), row(100, 99, 2, 2, "curl"), row(5, 4, 1, 3, "other", 8)], schema)
    lives = lineage.process_lives(early)
    got = lambda df: sorted((r.pid, r.valid_from, r.valid_to, r.comm) for r in df.collect())
    assert got(lives) == [(7, 10, 100, "sh"), (7, 100, None, "curl"), (8, 5, None, "other")]
    late = spark.createDataFrame([row(10, 9, 5, 4, "bash"), row(50, 49, 6, 5, "cat"), row(100, 99, 1, 6, "older")], schema)
    assert got(lineage.amended(lives, late)) == [(7, 10, 50, "bash"), (7, 50, 100, "cat"), (7, 100, None, "curl"), (8, 5, None, "other")]
    ends = spark.createDataFrame([("c", "n", "b", 7, 60), ("c", "n", "b", 7, 70), ("c", "n", "x", 8, 6)], "cluster string, node_id string, boot_id string, pid long, observed_at_ns long")
    assert got(lineage.process_lives(early, ends)) == [(7, 10, 60, "sh"), (7, 100, None, "curl"), (8, 5, None, "other")]


def test_ingress_tried_again_changes_nothing(spark, tmp_path):
    schema = "event_id long, id string, batch_id string, cluster string, node_id string, event_type string, observed_at_ns long, idempotency_key string"
    item = lambda e, batch, key, kind="kernel.tcp.connect", cluster="c", hour=1: (e, f"{hour * 3600000:015d}-{key}", batch, cluster, "n", kind, e, key)
    first = spark.createDataFrame([item(1, "a", "k1"), item(2, "a", "k1"), item(3, "b", "k2"), item(4, "c", "k3", "agent.other"), item(5, "c", "k4", "kernel.file.open"), item(6, "d", "k5"), item(7, "d", "k6", cluster=" ")], schema)
    second = spark.createDataFrame([item(8, "e", "k2"), item(9, "e", "k5"), item(10, "e", "k7", hour=9), item(11, "e", "k4", "kernel.file.open")], schema)
    write, path = streams.ingress(f"file://{tmp_path}"), f"{tmp_path}/items"
    got = lambda: {r.event_id: r.status for r in spark.read.parquet(path).collect()}
    write(first, 0)
    one = {1: "ACCEPTED", 2: "DUPLICATE", 3: "ACCEPTED", 4: "UNSUPPORTED", 5: "GATED", 6: "REJECTED", 7: "REJECTED"}
    assert got() == one
    write(first, 0)
    assert got() == one
    write(second, 1)
    both = one | {8: "DUPLICATE", 9: "ACCEPTED", 10: "ACCEPTED", 11: "GATED"}
    assert got() == both
    write(second, 1), write(first, 0), write(second, 1)
    assert got() == both
    keys = spark.read.parquet(f"{tmp_path}/keys")
    assert sorted(r.idempotency_key for r in keys.collect()) == ["k1", "k2", "k5", "k7"] and {r.hour for r in keys.collect()} == {1, 9}
    results = {r.batch_id: (r.accepted, r.rejected, r.reasons) for r in spark.read.parquet(f"{tmp_path}/results").collect()}
    assert results["a"] == (2, 0, "") and results["d"] == (0, 2, "blank cluster or node in the batch: 2") and results["c"] == (0, 0, "")


def test_lateness_keeps_every_row(spark, tmp_path):
    rows = [("c", n, t, None if t % 2 else t) for n, ts in (("a", [1000, 1010, 2, 1020]), ("b", [1, 2, 3])) for t in ts]
    schema = "cluster string, node_id string, observed_at_ns long, big long"
    types = lambda df: df.withColumns({"event_type": F.lit("kernel.tcp.close"), "big": F.col("big") + 2**60})
    for part in (rows[:2] + rows[4:5], rows[2:4] + rows[5:]):
        types(spark.createDataFrame(part, schema)).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(schema + ", event_type string").option("maxFilesPerTrigger", 1).parquet(f"file://{tmp_path}/in")
    with state.stateful(spark):
        streams.run_once(state.with_lateness(stream, 500), "", f"file://{tmp_path}/state", each=streams.late_gaps(f"file://{tmp_path}/out"))
    good = sorted((r.node_id, r.observed_at_ns, r.big) for r in spark.read.parquet(f"{tmp_path}/out/events").collect())
    assert good == sorted((n, t, b + 2**60 if b is not None else None) for _, n, t, b in rows if (n, t) != ("a", 2))
    (gap,) = spark.read.parquet(f"{tmp_path}/out/gaps").collect()
    assert (gap.node_id, gap.dropped_records, gap.gap_start_ns, gap.cause, gap.dropped_reliability) == ("a", 1, 2, "late_data", 1)


def test_a_stalled_stream_is_live_but_not_ready(spark, tmp_path):
    for i in range(3):
        spark.range(i * 10, i * 10 + 10).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    progress, hold = Progress(), threading.Event()
    spark.streams.addListener(progress)
    slow = lambda batch, epoch: batch.count() and epoch == 1 and hold.wait(60)
    rows = spark.readStream.schema("id long").option("maxFilesPerTrigger", 1).parquet(f"file://{tmp_path}/in")
    query = rows.writeStream.foreachBatch(slow).option("checkpointLocation", f"file://{tmp_path}/state").trigger(processingTime="0 seconds").start()
    now = lambda: readiness(progress.table(spark).where(F.col("query") == query.id), int(time.time() * 1000), 3000).first()
    until = lambda holds: next((r for r in (now() for _ in iter(lambda: time.sleep(0.3) or time.time() < end, False)) if r and holds(r)), None)
    try:
        end = time.time() + 60
        stalled = until(lambda r: r.rows == 10 and r.stalled)
        assert stalled is not None and stalled.live and not stalled.ready
        hold.set()
        end = time.time() + 60
        assert until(lambda r: r.rows == 30 and r.ready and not r.stalled) is not None
        query.stop()
        end = time.time() + 60
        assert until(lambda r: not r.live and not r.stalled) is not None
    finally:
        hold.set()
        query.stop()
        spark.streams.removeListener(progress)


def test_readiness_of_reports(spark):
    row = lambda kind, at, rows=None, epoch=None, behind=None: ("q", None, kind, at, epoch, rows, behind, None, None, None)
    of = lambda *rows: readiness(spark.createDataFrame(list(rows), PROGRESS), 100_000).first()
    r = of(row("started", 1000), row("progress", 30_000, 5, 0, 2))
    assert (r.rows, r.behind, r.live, r.stalled, r.ready) == (5, 2, True, True, False)
    assert of(row("started", 1000), row("progress", 30_000, 5, 0, 2), row("idle", 99_000)).ready
    assert not of(row("started", 1000), row("failed", 2000)).live and not of(row("started", 1000), row("failed", 2000)).stalled
    assert readiness(spark.createDataFrame([], PROGRESS), 5).count() == 0
