"""Streams over the driver's events: written as files to the shared folder, read as a stream to its end."""

from __future__ import annotations

import time

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.binding import watch_changes
from ..operators.records import idempotency_key, normalize
from ..operators.rules import NODE
from ..schemas import EVENTS
from ..sources.adapter import MORE_SQL, kernel_events, more_events
from ..sources.shared import shared_dir
from ..streaming import state, streams
from ..streaming.readiness import Progress, readiness
from . import json_sql as J
from .queries import _CONCLUSION, _DROPS, _ID, _LIVES, KE, TCP_ID, _samples, query


def _stream(spark: SparkSession, sf_dir: str, rows: DataFrame | None = None) -> tuple[DataFrame, str]:
    """Events as a stream of files, at last one event an hour after all others, so that every window is closed."""
    path = shared_dir(spark)
    rows = kernel_events(spark, sf_dir) if rows is None else rows
    rows.write.parquet(f"{path}/events")
    last = spark.read.parquet(f"{path}/events").groupBy().agg(F.max("observed_at_ns").alias("last"))
    names = {c: F.lit(None).cast(t) for c, t in (x.split() for x in EVENTS.split(", "))}
    tick = last.select(*[x.alias(c) for c, x in (names | {"event_id": F.lit(-1).cast("long"), "event_type": F.lit("agent.tick"), "observed_at_ns": F.col("last") + 3_600_000_000_000}).items()])
    tick.coalesce(1).write.mode("append").parquet(f"{path}/events")
    return streams.event_stream(spark, f"{path}/events"), path


def _appended(stream: DataFrame, path: str) -> DataFrame:
    streams.run_once(stream, f"{path}/out", f"{path}/state")
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{path}/out")


def _wall(ns: str) -> Column:
    """A wall time for a monotonic one: no row is at the first instant of all, which a watermark counts as late."""
    return F.timestamp_micros(F.lit(1704067200000000) + F.expr(f"{ns} div 1000"))


def _shuffled(spark: SparkSession, rows: DataFrame, last: dict[str, str], files: int = 6) -> tuple[DataFrame, str]:
    """Rows with event_time as a stream of files, dealt by chance, and one row a day later that closes what waits."""
    path = shared_dir(spark)
    rows.repartition(files, F.xxhash64(*rows.columns)).write.parquet(f"{path}/rows")
    tick = spark.range(1).select(*[(F.expr(last[f.name]) if f.name in last else F.lit(None)).cast(f.dataType).alias(f.name) for f in rows.schema])
    tick.coalesce(1).write.mode("append").parquet(f"{path}/rows")
    return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 2).parquet(f"{path}/rows"), path


_TICK = {"event_time": "timestamp '2034-01-01 00:00:00'", "cluster": "'tick'"}


@query(KE + f", {_DROPS.replace('node_id, probe_id', 'node_id, probe_id, m').replace('SELECT probe_id, CASE', 'SELECT node_id, probe_id, m, coalesce(lag(m) OVER w, 0) * 60000000000 AS from_ns, CASE').replace('PARTITION BY node_id, probe_id, m ORDER', 'PARTITION BY node_id, probe_id ORDER')} SELECT node_id, probe_id, m * 60000000000 AS polled_ns, delta, from_ns FROM d")
def st04_counter_deltas_stream(spark, sf_dir):
    """W3 as a stream over polls that come in any order: deltas wait for the watermark, and are those of the batch form."""
    samples = _samples(spark, sf_dir).withColumns({"cluster": F.lit("c1"), "event_time": _wall("polled_ns")})
    rows, path = _shuffled(spark, samples, {**_TICK, "node_id": "''", "probe_id": "''", "polled_ns": "0", "dropped": "0", "tracking_start_ns": "0"})
    with state.stateful(spark):
        found = _appended(state.counter_deltas(rows, "2 hours"), path)
    return found.where("cluster = 'c1'").select("node_id", "probe_id", "polled_ns", "delta", "from_ns")


@query(KE + _LIVES + "SELECT * FROM lives")
def j04_lifetimes_stream(spark, sf_dir):
    """J4 as a stream of files in any order: connections are given when they end, are superseded, or have been quiet for an hour."""
    columns = ["cluster", "node_id", "boot_id", "src_ip", "src_port", "dst_ip", "dst_port", "event_id", "observed_at_ns", "event_type", "ret", "bytes_sent", "bytes_received"]
    ev = kernel_events(spark, sf_dir).where("event_type like 'kernel.tcp.%'").select(*columns).withColumn("event_time", _wall("observed_at_ns"))
    rows, path = _shuffled(spark, ev, {**_TICK, "node_id": "''", "boot_id": "''", "src_ip": "''", "src_port": "0", "dst_ip": "''", "dst_port": "0", "event_id": "-1", "observed_at_ns": "0", "event_type": "'agent.tick'"})
    with state.stateful(spark):
        found = _appended(state.lifetimes(rows, "2 hours"), path)
    return found.withColumns({c: F.col(c).cast("int") for c in ("src_port", "dst_port")})


_WATCH = """w AS (SELECT concat('c', CAST(o_orderkey // 97 % 2 AS VARCHAR)) AS cluster, o_orderkey AS seq, CASE WHEN o_orderkey % 97 = 0 THEN 'init' WHEN o_orderkey % 97 = 40 AND o_orderkey // 97 % 3 <> 0 THEN 'init_done' WHEN o_orderkey % 97 < 40 THEN 'init_apply' WHEN o_orderkey % 6 = 0 THEN 'delete' ELSE 'apply' END AS op,
  concat('pod-', CAST(o_custkey % 60 AS VARCHAR)) AS pod_uid, concat('ns-', CAST(o_orderkey % 7 AS VARCHAR)) AS pod FROM orders)"""


def _watch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as two clusters' watches: blocks of 97 numbers, each with a listing, of which one in three is broken off."""
    n = "o_orderkey div 97"
    op = f"case when o_orderkey % 97 = 0 then 'init' when o_orderkey % 97 = 40 and {n} % 3 <> 0 then 'init_done' when o_orderkey % 97 < 40 then 'init_apply' when o_orderkey % 6 = 0 then 'delete' else 'apply' end as op"
    rows = spark.read.parquet(f"{sf_dir}/orders.parquet").selectExpr(f"concat('c', cast({n} % 2 as string)) as cluster", "o_orderkey as seq", op, "concat('pod-', cast(o_custkey % 60 as string)) as pod_uid", "concat('ns-', cast(o_orderkey % 7 as string)) as pod")
    return rows.withColumn("event_time", _wall("seq * 1000000"))


_WATCHED = f"""WITH {_WATCH}, l AS (SELECT cluster, seq AS init_seq, lead(seq) OVER o AS done_seq, lead(op) OVER o AS last, op FROM w WHERE op IN ('init', 'init_done') WINDOW o AS (PARTITION BY cluster ORDER BY seq)),
t AS (SELECT *, lead(seq) OVER (PARTITION BY cluster, pod_uid ORDER BY seq) AS next FROM w WHERE op IN ('apply', 'init_apply', 'delete')),
g AS (SELECT t.cluster, t.seq, t.op, t.pod_uid, t.pod, t.next, (SELECT min(done_seq) FROM l WHERE l.cluster = t.cluster AND l.op = 'init' AND l.last = 'init_done' AND l.init_seq > t.seq AND t.op <> 'delete') AS gone FROM t),
h AS (SELECT *, gone IS NOT NULL AND (next IS NULL OR gone < next) AS listed_out FROM g),
k AS (SELECT *, lag(op <> 'delete' AND NOT listed_out) OVER (PARTITION BY cluster, pod_uid ORDER BY seq) AS was FROM h)
SELECT cluster, seq, CASE WHEN op = 'delete' THEN 'delete' ELSE 'apply' END AS op, pod_uid, CASE WHEN op <> 'delete' THEN pod END AS pod FROM k WHERE op <> 'delete' OR was UNION ALL SELECT cluster, gone, 'delete', pod_uid, NULL FROM k WHERE listed_out"""


@query(_WATCHED)
def s04_watch(spark, sf_dir):
    """What a watch with listings, whole and broken off, amounts to."""
    return watch_changes(_watch(spark, sf_dir).drop("event_time"))


@query(_WATCHED)
def s04_watch_stream(spark, sf_dir):
    """The same as a stream of rows in any order."""
    rows, path = _shuffled(spark, _watch(spark, sf_dir), {**_TICK, "seq": "0", "op": "'tick'", "pod_uid": "''"})
    with state.stateful(spark):
        return _appended(state.pod_changes(rows, "30 days"), path)


_START = "unix_micros(window.start) * 1000 as window_start_ns"


@query(KE + "SELECT cluster, node_id, boot_id, dst_ip, dst_port, observed_at_ns // 60000000000 * 60000000000 AS window_start_ns, count(*) AS n FROM ke WHERE event_type = 'kernel.tcp.connect' AND ret <> 0 GROUP BY ALL HAVING count(*) >= 2")
def st02_r06_stream(spark, sf_dir):
    rows, path = _stream(spark, sf_dir)
    return _appended(streams.failing_backends(rows, least=2), path).selectExpr(*NODE, "dst_ip", "dst_port", _START, "n")


@query(KE + f"""SELECT cluster, node_id, boot_id, {TCP_ID} AS conn_id, w * 1000000000 AS window_start_ns, count(*) AS n FROM (SELECT *, unnest(range(observed_at_ns // 1000000000 - 9, observed_at_ns // 1000000000 + 1)) AS w FROM ke
  WHERE event_type = 'kernel.tcp.retransmit' AND tcp_state = 'ESTABLISHED') GROUP BY ALL HAVING count(*) >= 3""")
def st02_r12_stream(spark, sf_dir):
    rows, path = _stream(spark, sf_dir)
    return _appended(streams.losses(rows), path).selectExpr(*NODE, "conn_id", _START, "n")


@query(KE + f"SELECT cluster, node_id, boot_id, {TCP_ID} AS conn_id, observed_at_ns // 1000000000 * 1000000000 AS window_start_ns, count(*) AS n FROM ke WHERE event_type = 'kernel.tcp.retransmit' GROUP BY ALL")
def st02_a11_stream(spark, sf_dir):
    rows, path = _stream(spark, sf_dir)
    return _appended(streams.coalesced(rows), path).selectExpr(*NODE, "conn_id", _START, "n")


@query(KE + f"SELECT {_ID} AS id, observed_at_ns AS ts_ns, pid, concat(src_ip, ':', src_port) AS src, concat(dst_ip, ':', dst_port) AS dst, {_CONCLUSION} AS interp FROM ke WHERE dst_port = 443 AND {_ID} > '000000000100000'")
def q04_subscribe_stream(spark, sf_dir):
    """A feed of one port from behind an id on, with interpretations."""
    rows, path = _stream(spark, sf_dir)
    feed = streams.subscribe(rows, interpreted=True, after_id="000000000100000", dst_port=443)
    return _appended(feed, path).select("id", "ts_ns", "pid", "src", "dst", "interp")


@query(KE + "SELECT count(DISTINCT event_id // 2) AS n FROM ke")
def st05_once_stream(spark, sf_dir):
    rows, path = _stream(spark, sf_dir)
    rec = normalize(rows.where("event_id >= 0")).withColumn("event_time", F.timestamp_micros(F.expr("observed_at_ns div 1000")))
    keyed = idempotency_key(rec).withColumn("idempotency_key", F.expr("cast(event_id div 2 as string)")).select("idempotency_key", "event_time")
    return _appended(streams.once(keyed), path).agg(F.count("*").alias("n"))


@query(KE + """, e AS (SELECT event_id, node_id, pid, event_type, lag(event_type) OVER w AS before, lag(path) OVER w AS path0 FROM (SELECT * FROM ke WHERE event_type IN ('kernel.file.open', 'kernel.process.exec')) WINDOW w AS (PARTITION BY cluster, node_id, boot_id, pid ORDER BY observed_at_ns, event_id))
SELECT event_id, node_id, pid, path0 AS path FROM e WHERE event_type = 'kernel.process.exec' AND before = 'kernel.file.open'""")
def j03_pairing_stream(spark, sf_dir):
    rows, path = _stream(spark, sf_dir)
    kind = F.when(F.col("event_type") == "kernel.file.open", "enter").when(F.col("event_type") == "kernel.process.exec", "exit")
    rows = rows.withColumn("event_time", _wall("observed_at_ns")).select("event_id", *NODE, "pid", F.when(F.col("event_id") < 0, "tick").otherwise(kind).alias("kind"), "path", "observed_at_ns", "event_time")
    with state.stateful(spark):
        return _appended(state.paired(rows.where("kind is not null").fillna("", [*NODE]).fillna(0, ["pid"])), path).select("event_id", "node_id", "pid", "path")


@query(KE + f"SELECT {J.ID} AS id, {J.SOURCE} AS source, event_type AS type, {J.SEVERITY} AS severity, {J.OUTCOME} AS outcome, cluster, {J.DURATION} AS duration_us, 'raw' AS enrichment_state, {J.array(J.text(J.KEY))} AS correlation_keys, {J.ERROR} AS error, {J.ENTITIES} AS entity_ids, {J.LABELS} AS labels, {J.NETWORK} AS network_data, {J.PROCESS_DATA} AS process_data FROM ke")
def k02_s03_json_round_trip(spark, sf_dir):
    """Records written as JSON and read again, all their fields."""
    from ..sources.capture import read_records, write_records

    path = shared_dir(spark)
    write_records(normalize(kernel_events(spark, sf_dir)), f"{path}/records")
    back = read_records(spark, f"{path}/records").where("_corrupt_record is null")
    nested = ("correlation_keys", "error", "entity_ids", "labels", "network_data", "process_data")
    return back.select("id", "source", "type", "severity", "outcome", "cluster", "duration_us", "enrichment_state", *[F.to_json(c).alias(c) for c in nested])


@query(f"WITH {MORE_SQL}, " + """x AS (SELECT cluster, node_id, boot_id, comm, observed_at_ns, CASE WHEN observed_at_ns // 1000 - lag(observed_at_ns // 1000) OVER w < 30000000 THEN 0 ELSE 1 END AS new
  FROM me WHERE event_type = 'kernel.process.exit' AND ret <> 0 WINDOW w AS (PARTITION BY cluster, node_id, boot_id, comm ORDER BY observed_at_ns)),
y AS (SELECT *, sum(new) OVER (PARTITION BY cluster, node_id, boot_id, comm ORDER BY observed_at_ns) AS burst FROM x)
SELECT cluster, node_id, boot_id, comm, min(observed_at_ns) // 1000 * 1000 AS window_start_ns, count(*) AS n FROM y GROUP BY cluster, node_id, boot_id, comm, burst""")
def st02_r41_sessions_stream(spark, sf_dir):
    rows, path = _stream(spark, sf_dir, more_events(spark, sf_dir))
    found = streams.crash_bursts(rows).withColumnRenamed("session_window", "window")
    return _appended(found, path).selectExpr(*NODE, "comm", _START, "n")


@query(KE + """, m AS (SELECT node_id, event_id % 4 AS part, max(observed_at_ns) AS last FROM ke GROUP BY ALL), w AS (SELECT a.node_id, a.part, max(b.last) - 300000000000 AS mark FROM m a JOIN m b ON a.node_id = b.node_id AND b.part < a.part GROUP BY ALL),
x AS (SELECT ke.*, event_id % 4 AS epoch, coalesce(observed_at_ns < mark, false) AS late FROM ke LEFT JOIN w ON ke.node_id = w.node_id AND event_id % 4 = w.part)
SELECT node_id, epoch, count(*) FILTER (WHERE late) AS dropped_records, min(CASE WHEN late THEN observed_at_ns END) AS gap_start_ns, max(CASE WHEN late THEN observed_at_ns END) AS gap_end_ns, CASE WHEN count(*) FILTER (WHERE late) > 0 THEN 'late_data' END AS cause, count(*) FILTER (WHERE NOT late) AS on_time FROM x GROUP BY ALL""")
def st03_late_gaps_stream(spark, sf_dir):
    """Files of all times, one after the other: what is older than the node's newest of the files before, by more than five minutes, is late; all else goes on."""
    path = shared_dir(spark)
    for part in range(4):
        kernel_events(spark, sf_dir).where(F.col("event_id") % 4 == part).coalesce(1).write.mode("append").parquet(f"{path}/events")
    rows = streams.event_stream(spark, f"{path}/events", files_per_trigger=1)
    with state.stateful(spark):
        streams.run_once(state.with_lateness(rows), "", f"{path}/state", each=streams.late_gaps(f"{path}/out"))
    epoch = F.col("epoch").cast("long").alias("epoch")
    good = spark.read.parquet(f"{path}/out/events").groupBy("node_id", epoch).agg(F.count("*").alias("on_time"))
    found = spark.read.parquet(f"{path}/out/gaps").select("node_id", epoch, "dropped_records", "gap_start_ns", "gap_end_ns", "cause")
    return good.join(found, ["node_id", "epoch"], "full").withColumns({c: F.coalesce(c, F.lit(0)) for c in ("on_time", "dropped_records")})


_ARRIVALS = f"""a AS (SELECT *, event_id % 4 AS f FROM ke UNION ALL SELECT *, (event_id + 1) % 4 AS f FROM ke WHERE event_id % 3 = 0),
i AS (SELECT *, CASE WHEN event_id % 4000 = 5 THEN '' ELSE cluster END AS named, concat(node_id, '/', f) AS batch_id FROM a),
r AS (SELECT *, max(named = '') OVER (PARTITION BY batch_id) AS refused, event_type NOT LIKE 'kernel.file.%' AS open FROM i),
s AS (SELECT *, CASE WHEN refused THEN 'REJECTED' WHEN NOT open THEN 'GATED' WHEN row_number() OVER (PARTITION BY event_id, named, refused OR NOT open ORDER BY f, observed_at_ns, event_id) > 1 THEN 'DUPLICATE' ELSE 'ACCEPTED' END AS status FROM r)"""


def arrivals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items in four files: every third comes again in the next one; a few have no cluster."""
    rec = normalize(kernel_events(spark, sf_dir)).withColumn("cluster", F.when(F.col("event_id") % 4000 == 5, "").otherwise(F.col("cluster")))
    items = idempotency_key(rec).select("event_id", "id", "cluster", "node_id", F.col("type").alias("event_type"), "observed_at_ns", "idempotency_key")
    again = items.where("event_id % 3 = 0").withColumn("part", F.expr("(event_id + 1) % 4"))
    return items.withColumn("part", F.expr("event_id % 4")).unionByName(again).withColumn("batch_id", F.concat_ws("/", "node_id", "part"))


@query(KE + f", {_ARRIVALS} SELECT event_id, batch_id, status FROM s")
def k05_ingress_stream(spark, sf_dir):
    """Idempotent ingress over micro-batches: items with their status, keys looked up by the hour of their ids."""
    path = shared_dir(spark)
    items = arrivals(spark, sf_dir)
    for part in range(4):
        items.where(F.col("part") == part).coalesce(1).write.mode("append").parquet(f"{path}/items")
    rows = spark.readStream.schema(items.schema).option("maxFilesPerTrigger", 1).parquet(f"{path}/items")
    streams.run_once(rows, "", f"{path}/state", each=streams.ingress(f"{path}/out"))
    return spark.read.parquet(f"{path}/out/items").select("event_id", "batch_id", "status")


@query(KE + f", {_ARRIVALS} SELECT batch_id, count(*) FILTER (WHERE status IN ('ACCEPTED', 'DUPLICATE')) AS accepted, count(*) FILTER (WHERE status = 'REJECTED') AS rejected, CASE WHEN max(refused) THEN concat('blank cluster or node in the batch: ', count(*)) ELSE '' END AS reasons, false AS retryable FROM s GROUP BY batch_id")
def k05_ingress_results(spark, sf_dir):
    """The same in one batch, by producer batches: what the four files amount to. Of a key's items the first by file counts."""
    from ..operators.loss import delivery_results, ingest

    items = arrivals(spark, sf_dir)
    return delivery_results(ingest(items, items.select("idempotency_key").limit(0)), "batch_id")


@query(KE + "SELECT count(*) AS rows, false AS live, false AS stalled, 4::BIGINT AS epochs FROM ke")
def st07_progress_stream(spark, sf_dir):
    """What a stream reports of itself, as a table: all rows in four epochs, and at its end neither live nor stalled."""
    path = shared_dir(spark)
    for part in range(4):
        kernel_events(spark, sf_dir).where(F.col("event_id") % 4 == part).coalesce(1).write.mode("append").parquet(f"{path}/events")
    progress = Progress()
    spark.streams.addListener(progress)
    try:
        query = streams.event_stream(spark, f"{path}/events", files_per_trigger=1).writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start()
        query.awaitTermination()
        until = time.time() + 20
        while not any(r[0] == query.id and r[2] == "terminated" for r in list(progress.reports)) and time.time() < until:
            time.sleep(0.1)
        reports = progress.table(spark).where(F.col("query") == query.id)
    finally:
        spark.streams.removeListener(progress)
    epochs = reports.where("kind = 'progress' and rows > 0").select("query", "epoch").distinct().groupBy("query").agg(F.count("*").alias("epochs"))
    return readiness(reports, int(time.time() * 1000)).join(epochs, "query").select("rows", "live", "stalled", "epochs")


@query(KE + "SELECT 'written' AS what, count(*) AS n FROM ke WHERE ret < 0 UNION ALL SELECT 'warnings', 1")
def k03_fan_out_stream(spark, sf_dir):
    """The primary sink writes all failures; of two others one fails, which is a warning."""
    path = shared_dir(spark)
    kernel_events(spark, sf_dir).coalesce(1).write.parquet(f"{path}/events")
    rows = streams.event_stream(spark, f"{path}/events").where("ret < 0")

    def primary(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/primary/epoch={epoch}")

    def failing(batch: DataFrame, epoch: int) -> None:
        raise OSError("the sink is away")

    def warn(epoch: int, text: str) -> None:
        spark.range(1).select(F.lit(epoch).cast("long").alias("at_epoch"), F.lit(text).alias("warning")).write.mode("append").parquet(f"{path}/warnings")

    streams.run_once(rows, "", f"{path}/state", each=streams.fan_out(primary, [failing, lambda batch, epoch: None], warn))
    written, warnings = spark.read.parquet(f"{path}/primary"), spark.read.parquet(f"{path}/warnings")
    return written.groupBy().agg(F.lit("written").alias("what"), F.count("*").alias("n")).union(warnings.groupBy().agg(F.lit("warnings").alias("what"), F.count("*").alias("n")))
