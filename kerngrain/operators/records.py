"""Kernel events to records: normalization (N1-N8), projections (P1-P14). All are column expressions over one row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.columns import connection_id, endpoint, errno_name, evidence_class, outcome_code, record_id, severity_code, tcp_state_code
from ..schemas import AGENT_TYPES, IDENTITY_METHOD, PRODUCER, PRODUCER_VERSION, SCHEMA_VERSION, TCP, TYPES
from .knowledge import explain
from .select import event_filter, newest, oldest

CAUSES = ("destination host unreachable", "nothing listens on the port", "a firewall blocks the connection")
SOURCES = dict(zip(TYPES, ("tcp_connect", "tcp_close", "tcp_retransmit", "process_exec", "file_open", "file_open_attempt"), strict=True))
#: Keys of the wire form by the labels that they are copied from (P5), those that are numbers there, and the columns of a binding
#: with the labels that they become (P2); of these the keyed ones also relate records.
WIRE = {
    "node_id": "node_id", "k8s_pod_uid": "pod_uid", "k8s_pod_name": "pod_name", "k8s_container_id": "container_id", "k8s_namespace": "k8s_namespace", "k8s_service_account": "service_account",
    "k8s_owner_kind": "owner_kind", "k8s_owner_name": "owner_name", "k8s_owner_uid": "owner_uid", "cgroup_id": "cgroup_id", "argv_hash": "argv_hash", "tcp_state": "tcp_state", "cluster_id": "cluster_id",
    "kernel_release": "kernel_release", "runtime_subject_id": "runtime_subject_id", "node_identity": "node_identity", "boot_id": "boot_id", "runtime_identity_method": "runtime_identity_method",
    "evidence_level": "evidence_level", "cause": "cause", "requested_path": "requested_path", "path_resolution": "path_resolution", "coverage": "coverage", "flags": "flags",
}
WIRE_NUMBERS = {
    "observed_at_ns": "kernel_time_ns", "dropped_records": "dropped_records", "dropped_reliability": "dropped_reliability", "dropped_attribution": "dropped_attribution", "gap_start_ns": "gap_start_ns",
    "gap_end_ns": "gap_end_ns", "host_tgid": "host_tgid", "host_tid": "host_tid", "leader_start_boottime_ns": "leader_start_boottime_ns", "runtime_canonicalization_version": "runtime_canonicalization_version", "gid": "gid",
}
BINDING = {"container_id": "k8s_container_id", "pod_uid": "k8s_pod_uid", "pod_name": "k8s_pod_name", "namespace": "k8s_namespace", "service_account": "k8s_service_account", "owner_kind": "k8s_owner_kind", "owner_name": "k8s_owner_name", "owner_uid": "k8s_owner_uid"}
KEYED = ("container_id", "pod_uid", "namespace", "owner_uid")
CANONICAL_VERSION = 1


def labels_of(pairs: dict[str, Column]) -> Column:
    """A map of the pairs whose value isn't null."""
    entries = F.array(*[F.struct(F.lit(k).alias("key"), v.cast("string").alias("value")) for k, v in pairs.items()])
    return F.map_from_entries(F.filter(entries, lambda x: x["value"].isNotNull()))


def normalize(events: DataFrame) -> DataFrame:
    """Events of schemas.EVENTS to records, one for each. What an event doesn't tell is null, never zero."""
    t, ret = F.col("event_type"), F.col("ret")
    is_ = lambda *names: t.isin(*[f"kernel.{x}" for x in names])
    tcp, exec_, opened, attempt = t.isin(*TCP), is_("process.exec"), is_("file.open"), is_("file.open_attempt")
    failed = is_("tcp.retransmit") | attempt | (is_("tcp.connect", "process.exec", "file.open") & (ret != 0))
    error = F.struct(
        errno_name(ret).alias("code"),
        F.concat(F.lit("TCP connect by "), F.col("comm"), F.lit(" to "), F.col("dst_ip"), F.lit(":"), F.col("dst_port")).alias("message"),
        F.array(*map(F.lit, CAUSES)).alias("possible_causes"),
    )
    process = F.concat(F.lit("process:"), F.col("pid"))
    known = lambda c, t: F.col(c) if c in events.columns else F.lit(None).cast(t)
    start = known("start_boottime_ns", "long")
    denied = opened & (ret != 0)
    labels = labels_of({
        "cgroup_id": F.col("cgroup_id"),
        "errno_num": F.when((is_("tcp.connect") | opened | attempt) & (ret != 0), ret),
        "errno": F.when((opened | attempt) & (ret != 0), errno_name(ret)),
        "tcp_state": F.when(is_("tcp.retransmit"), F.coalesce("tcp_state", F.lit("UNKNOWN"))),
        "result": F.when(denied, "denied").when(opened, "allowed"),
        "coverage": F.when(opened, "lsm_gated"),
        "flags": F.when(opened | attempt, F.col("flags")),
        "resource_ref_kind": F.when(opened, "file").when(exec_, "executable"),
        "resource_ref_id": F.when(opened, F.col("path")).when(exec_, F.col("filename")),
        "requested_path": F.when(attempt, F.col("path")),
        "path_resolution": F.when(attempt, "unresolved"),
        "path_truncated": F.when((opened | attempt) & known("path_truncated", "boolean"), "true"),
        "gid": F.when(exec_, known("gid", "long")),
        "host_tgid": F.when(exec_, F.col("pid")),
        "host_tid": F.when(exec_, known("tid", "long")),
        "leader_start_boottime_ns": F.when(exec_ & (start != 0), start),
        "runtime_identity_method": F.when(exec_ & (start != 0), known("identity_method", "string")),
        "argv_hash": F.when(exec_, F.concat(F.lit("sha256:"), known("argv_hash", "string"))),
    })
    network = F.when(tcp, F.struct("src_ip", "src_port", "dst_ip", "dst_port", F.lit("tcp").alias("protocol"), F.lit("egress").alias("direction"), "bytes_sent", "bytes_received"))
    proc = F.struct("pid", F.when(F.col("ppid") != 0, F.col("ppid")).alias("ppid"), F.col("comm").alias("command"), F.when(exec_, F.col("filename")).alias("executable"), F.when(~tcp, F.col("uid")).alias("uid"), F.when(exec_ & (ret != 0), ret).alias("exit_code"))
    source = F.coalesce(*[F.when(t == k, v) for k, v in SOURCES.items()], F.split_part(t, F.lit("."), F.lit(-1)))
    key = F.when(tcp, connection_id()).otherwise(process)
    entities = F.array_compact(F.array(process, F.when(tcp, F.concat(F.lit("connection:"), connection_id())), F.when(exec_, F.concat(F.lit("executable:"), F.col("filename"))), F.when(opened, F.concat(F.lit("file:"), F.col("path")))))
    return events.select(
        "event_id", "node_id", "cluster", "observed_at_ns", "pid", "cgroup_id", "ret",
        record_id(F.col("observed_at_ns"), F.col("node_id"), t, F.col("event_id")).alias("id"),
        F.concat(F.lit(f"{PRODUCER}/"), source).alias("source"),
        t.alias("type"),
        F.when((is_("tcp.connect", "tcp.retransmit") | denied | attempt | (exec_ & (ret != 0))) & failed, "warning").otherwise("info").alias("severity"),
        F.when(failed, "failure").otherwise("success").alias("outcome"),
        F.array(key).alias("correlation_keys"),
        F.when(is_("tcp.connect") & (ret != 0), error).alias("error"),
        entities.alias("entity_ids"),
        F.when(is_("tcp.close") & (F.col("duration_ns") > 0), F.expr("duration_ns div 1000")).alias("duration_us"),
        F.lit("raw").alias("enrichment_state"),
        labels.alias("labels"), network.alias("network_data"), proc.alias("process_data"),
    )


def normalize_generic(events: DataFrame) -> DataFrame:
    """Any probe's events as records. An absent ret has no outcome, any but 0 is a failure; network data and its key only with an address;
    fields without a place are entities, if the source gives ``entity_ids``."""
    ret, c = F.col("ret"), F.col
    net = c("src_ip").isNotNull() | c("dst_ip").isNotNull()
    text = lambda x: F.coalesce(c(x), F.lit(""))
    port = lambda x: F.coalesce(c(x), F.lit(0))
    network = F.struct(text("src_ip").alias("src_ip"), port("src_port").alias("src_port"), text("dst_ip").alias("dst_ip"), port("dst_port").alias("dst_port"), F.lit("tcp").alias("protocol"), F.lit("egress").alias("direction"))
    key = F.concat(text("src_ip"), F.lit(":"), port("src_port"), F.lit("->"), text("dst_ip"), F.lit(":"), port("dst_port"))
    entities = c("entity_ids") if "entity_ids" in events.columns else F.array(F.concat(F.lit("process:"), "pid"))
    return events.select(
        "event_id", "node_id", c("event_type").alias("type"),
        F.concat(F.lit(f"{PRODUCER}/"), F.split_part("event_type", F.lit("."), F.lit(-1))).alias("source"),
        F.when(ret == 0, "success").when(ret.isNotNull(), "failure").alias("outcome"),
        F.when(ret != 0, "warning").otherwise("info").alias("severity"),
        entities.alias("entity_ids"), F.array_compact(F.array(F.when(net, key))).alias("correlation_keys"), F.when(net, network).alias("network_data"),
        F.when(c("comm").isNotNull(), F.struct("pid", c("comm").alias("command"))).alias("process_data"),
    )


def with_metadata(records: DataFrame, kernel_release: str = "6.8.0") -> DataFrame:
    """Labels about producer, cluster, node, probe and schema; of equal keys the record's own go."""
    name = F.split_part("source", F.lit("/"), F.lit(2))
    hook = F.when(F.col("type").isin("kernel.tcp.retransmit", "kernel.process.exec"), "fentry").otherwise("fexit")
    more = labels_of({
        "producer": F.lit(PRODUCER), "producer_version": F.lit(PRODUCER_VERSION), "cluster_id": F.col("cluster"), "node_id": F.col("node_id"), "kernel_release": F.lit(kernel_release),
        "probe_id": name, "probe_version": F.lit("1"), "probe_family": F.split_part(name, F.lit("_"), F.lit(1)), "hook_kind": hook, "kernel_function": name,
        "observed_at_ns": F.col("observed_at_ns"), "schema_version": F.lit(SCHEMA_VERSION),
    })
    own = F.map_filter("labels", lambda k, v: ~F.array_contains(F.map_keys(more), k))
    return records.withColumn("labels", F.map_concat(own, more))


def with_binding_labels(bound: DataFrame) -> DataFrame:
    """Labels and correlation keys of a binding, each once and none that is empty; the owner's uid is a key, as it outlives the pod. Unbound rows say why."""
    filled = lambda c: F.when(F.col(c) != "", F.col(c))
    have = [c for c in BINDING if c in bound.columns]
    unbound = F.col("unbound_reason").isNotNull()
    more = {**{BINDING[c]: filled(c) for c in have}, "evidence_level": F.col("provenance"), "runtime_binding": F.when(unbound, "unbound"), "unbound_reason": F.col("unbound_reason")}
    keys = F.array_distinct(F.array_compact(F.concat("correlation_keys", F.array(*[F.concat(F.lit(f"{BINDING[c]}:"), filled(c)) for c in have if c in KEYED]))))
    return bound.withColumns({"labels": overlaid("labels", more), "correlation_keys": keys})


def overlaid(labels: str, more: dict[str, Column]) -> Column:
    """Labels with others in place of those of the same names; null values are left out."""
    return F.map_concat(F.map_filter(labels, lambda k, v: ~k.isin(*more)), labels_of(more))


def with_runtime_subject(records: DataFrame, node_identity: Column, boot: Column, domain: str = "kerngrain.runtime-subject.v1") -> DataFrame:
    """P3 on records: four labels for a process that is told apart for good, where its labels name the method, its number and its
    start, and node and boot are valid; else none of them."""
    label = lambda k: F.col("labels")[k]
    subject = runtime_subject(node_identity, boot, label("host_tgid").try_cast("long"), label("leader_start_boottime_ns").try_cast("long"), domain)
    rows = records.withColumn("subject_", F.when(label("runtime_identity_method") == IDENTITY_METHOD, subject))
    known = F.col("subject_").isNotNull()
    more = {"runtime_subject_id": F.col("subject_"), "node_identity": F.when(known, node_identity), "boot_id": F.when(known, F.lower(boot)), "runtime_canonicalization_version": F.when(known, F.lit(CANONICAL_VERSION))}
    return rows.withColumn("labels", F.when(known, overlaid("labels", more)).otherwise(F.col("labels"))).drop("subject_")


def runtime_subject(node_identity: Column, boot: Column, tgid: Column, start_ns: Column, domain: str = "kerngrain.runtime-subject.v1") -> Column:
    """A digest of what identifies a process for good; null unless all four parts are valid.

    SHA-256 over the domain and then each field behind its length in eight bytes; numbers are big-endian.
    """
    size = lambda x: F.unhex(F.lpad(F.hex(F.octet_length(x)), 16, "0"))
    number = lambda x, digits: F.unhex(F.lpad(F.hex(x), digits, "0"))
    fields = [F.encode(node_identity, "utf-8"), F.encode(F.lower(boot), "utf-8"), number(tgid, 8), number(start_ns, 16), number(F.lit(CANONICAL_VERSION), 4)]
    digest = F.sha2(F.concat(F.encode(F.lit(domain), "utf-8"), *[part for f in fields for part in (size(f), f)]), 256)
    valid = (node_identity != "") & (F.trim(node_identity) == node_identity) & boot.rlike("^[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}$") & (tgid > 0) & (start_ns > 0)
    return F.when(valid, F.concat(F.lit("sha256:"), digest))


def drop_reason(bound: DataFrame) -> DataFrame:
    """why a record isn't delivered: null for agents' own records and for strong bindings."""
    strong = (F.coalesce("container_id", F.lit("")) != "") | (F.coalesce("pod_uid", F.lit("")) != "")
    return bound.withColumn("drop_reason", F.when(F.col("type").isin(*AGENT_TYPES) | strong & F.col("unbound_reason").isNull(), None).otherwise(F.coalesce("unbound_reason", F.lit("unknown"))))


def neutral(bound: DataFrame) -> DataFrame:
    """Bound records without judgement: info, no error; network records refer to the endpoint."""
    ref = labels_of({"resource_ref_kind": F.when(F.col("network_data").isNotNull(), "network_endpoint"), "resource_ref_id": endpoint(F.col("network_data.dst_ip"), F.col("network_data.dst_port"))})
    kept = drop_reason(bound).where("drop_reason is null").drop("drop_reason")
    own = F.map_filter("labels", lambda k, v: ~F.array_contains(F.map_keys(ref), k))
    return kept.withColumns({"severity": F.lit("info"), "error": F.lit(None).cast("string"), "labels": F.map_concat(own, ref)})


def wire(records: DataFrame) -> DataFrame:
    """P5: one flat row of the wire form: renamed labels, numbers as numbers (those that aren't are left out), a list of the probes that a gap
    concerns, files only where their identity is known, a positive errno for negative results."""
    c, p, n = F.col("labels"), F.col("process_data"), F.col("network_data")
    number = c["errno_num"].try_cast("long")
    named = lambda kind: F.when(c["resource_ref_kind"] == kind, c["resource_ref_id"])
    at = F.timestamp_micros(F.expr("try_cast(labels['observed_at_ns'] as bigint) div 1000")) if "timestamp" not in records.columns else F.col("timestamp")
    return records.select(
        F.col("type").alias("occurrence_type"), F.col("id").alias("event_id"), F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'").alias("observed_at"),
        *[c[k].alias(v) for k, v in WIRE.items()], *[c[k].try_cast("long").alias(v) for k, v in WIRE_NUMBERS.items()],
        F.from_json(c["affected_probes"], "array<string>").alias("affected_probes"),
        named("executable").alias("exe"), named("file").alias("path"), F.when(c["path_truncated"] == "true", True).alias("path_truncated"), F.when(number < 0, -number).alias("errno"),
        p["pid"].alias("pid"), p["ppid"].alias("ppid"), p["command"].alias("comm"), p["uid"].alias("uid"),
        n["protocol"].alias("protocol"), n["src_ip"].alias("source_ip"), n["src_port"].alias("source_port"), n["dst_ip"].alias("destination_ip"), n["dst_port"].alias("destination_port"),
        F.col("outcome").alias("state"),
    )


def compact(records: DataFrame, interpreted: bool = False) -> DataFrame:
    """The short row of a feed, twelve positions; the last is what the first rule says that the record meets (J5), if that is asked for."""
    interp = F.lit(None).cast("string")
    if interpreted:
        records = explain(records.withColumns({"event_type": F.col("type"), "tcp_state": F.col("labels")["tcp_state"]}))
        interp = F.col("conclusion")
    n, p = F.col("network_data"), F.col("process_data")
    kinds = F.array(*map(F.lit, TYPES))
    return records.select(
        "id", (F.array_position(kinds, F.col("type")) - 1).cast("int").alias("probe_idx"), F.col("observed_at_ns").alias("ts_ns"),
        severity_code(F.col("severity")).alias("severity"), outcome_code(F.col("outcome")).alias("outcome"),
        endpoint(n["src_ip"], n["src_port"]).alias("src"), endpoint(n["dst_ip"], n["dst_port"]).alias("dst"), n["protocol"].alias("proto"),
        p["pid"].alias("pid"), p["command"].alias("cmd"), F.when(F.size("labels") > 0, F.to_json("labels")).alias("labels"),
        interp.alias("interp"),
    )


def lines(records: DataFrame) -> DataFrame:
    """K1: records as lines of JSON, without nulls, for standard output or a text sink."""
    inner = [c for c in records.columns if c != "event_id"]
    return records.select("event_id", F.to_json(F.struct(*inner)).alias("line"))


def violations(records: DataFrame) -> DataFrame:
    """Records with the rules that they break, none for most."""
    blank = lambda c: F.when(F.coalesce(F.trim(c), F.lit("")) == "", f"{c} is blank")
    long = lambda c: F.when(F.octet_length(c) > 256, f"{c} is longer than 256 bytes")
    rules = [blank(c) for c in ("source", "type", "cluster")] + [long(c) for c in ("id", "source", "type", "cluster")]
    rules.append(F.when(F.size("labels") > 100, "more than 100 labels"))
    rules.append(F.when(F.exists(F.map_entries("labels"), lambda x: (F.octet_length(x["key"]) > 1000) | (F.octet_length(x["value"]) > 1000)), "a label is longer than 1000 bytes"))
    rules.append(F.when(F.size("entity_ids") > 100, "more than 100 entities"))
    return records.withColumn("violations", F.array_compact(F.array(*rules)))


def idempotency_key(records: DataFrame) -> DataFrame:
    """P12."""
    return records.withColumn("idempotency_key", F.concat_ws(":", "source", "cluster", "node_id", "id"))


def approximate_bytes(records: DataFrame) -> DataFrame:
    """The length of the record's JSON, of what tells its probe and its binding, if it has one, and 256 bytes."""
    whole = F.to_json(F.struct("id", "source", "type", "severity", "outcome", "correlation_keys", "entity_ids", "labels", "network_data", "process_data"))
    name = F.split_part("source", F.lit("/"), F.lit(2))
    texts = [name, F.lit("1"), F.split_part(name, F.lit("_"), F.lit(1)), name, *[F.col(c) for c in BINDING if c in records.columns]]
    return records.withColumn("approx_bytes", sum((F.coalesce(F.octet_length(x), F.lit(0)) for x in (whole, *texts)), F.lit(256)).cast("long"))


def batch_bytes(records: DataFrame, *batch: str, kernel_release: str = "6.8.0") -> DataFrame:
    """P13 of batches (columns that name one): their records, what tells the producer, once for each, and 128 bytes."""
    producer = sum((F.octet_length(x) for x in (F.lit(PRODUCER), F.lit(PRODUCER_VERSION), F.lit(kernel_release), F.max("cluster"), F.max("node_id"))), F.lit(128))
    return approximate_bytes(records).groupBy(*batch).agg(F.count("*").alias("n"), (F.sum("approx_bytes") + producer).alias("approx_bytes"))


def get_events(events: DataFrame, now_ns: Column | int, probe: str | None = None, last_seconds: int = 60, limit: int = 100, **equal: object) -> DataFrame:
    """Q3: short rows (P6), interpreted, of events that a filter takes: of one probe the oldest, of all probes the newest; ``total`` is how many there are."""
    found = event_filter(events, now_ns, last_seconds, event_type=probe, **equal)
    rows = compact(normalize((oldest if probe else newest)(found, limit)), interpreted=True)
    return rows.withColumn("total", F.count("*").over(Window.partitionBy(F.lit(0))))  # at most limit rows


def with_class(records: DataFrame) -> DataFrame:
    """P7."""
    return records.withColumn("evidence_class", evidence_class(F.col("type")))


def split_by_class(records: DataFrame, *batch: str) -> DataFrame:
    """U4: batches (columns that name one) parted into those of one class each, two at most, with ``position`` from 0 in the order of time; a class
    without records makes no batch. A batch is what one delivery holds, so that its window is short."""
    order = Window.partitionBy(*batch, "evidence_class").orderBy("observed_at_ns", "event_id")
    return with_class(records).withColumn("position", F.row_number().over(order) - 1)


def tcp_codes(records: DataFrame) -> DataFrame:
    """Ret and the number of the TCP state for an explanation, of typed columns."""
    return records.select("id", "type", F.col("ret"), tcp_state_code(F.col("labels")["tcp_state"]).alias("tcp_state"))
