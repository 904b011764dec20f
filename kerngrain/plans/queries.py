"""Queries over the driver's tables, each with its SQL where SQL can express it. Names begin with the operators' IDs."""

from __future__ import annotations

import json
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import columns as E
from ..operators import binding, knowledge, lineage, loss, metrics, records, rules, select
from ..sources import capture, probes
from . import json_sql as J
from .captures import captures, decoded_sql
from ..sources.adapter import CGROUPS_SQL, EVENTS_SQL, FAST, FAST_EVENTS_SQL, FAST_MORE_SQL, MORE_SQL, PODS_SQL, cgroup_paths, kernel_events, more_events, pods

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
KE, ME = f"WITH {EVENTS_SQL} ", f"WITH {MORE_SQL} "
NODE = "cluster, node_id, boot_id"
TCP_ID = "concat(src_ip, ':', src_port, '->', dst_ip, ':', dst_port)"
STRONG = f"""WITH {EVENTS_SQL}, {CGROUPS_SQL}, {PODS_SQL},
box AS (SELECT cluster, node_id, cgroup_id, path, lower(regexp_extract(path, '([0-9a-fA-F]{{64}})(\\.scope)?$', 1)) AS cid FROM cgroups),
bound AS (SELECT ke.*, CASE WHEN ke.cgroup_id = 0 THEN 'no_cgroup' WHEN box.path IS NULL THEN 'cache_miss' WHEN box.cid = '' THEN 'host_process' WHEN pods.pod_uid IS NULL THEN 'cache_miss' END AS unbound_reason,
  CASE WHEN ke.cgroup_id <> 0 THEN pods.pod_uid END AS pod_uid, pods.namespace, pods.container_id, pods.pod_name, pods.service_account, pods.owner_kind, pods.owner_name, pods.owner_uid FROM ke LEFT JOIN box ON ke.cgroup_id = box.cgroup_id AND ke.node_id = box.node_id AND ke.cluster = box.cluster LEFT JOIN pods ON pods.container_id = box.cid) """


def query(sql: str | None = None, name: str | None = None):
    def add(f):
        QUERIES[name or f.__name__] = f
        if sql:
            ORACLE_SQL[name or f.__name__] = sql
        return f

    return add


def _bound(spark: SparkSession, sf_dir: str) -> DataFrame:
    return binding.bind(kernel_events(spark, sf_dir), cgroup_paths(spark, sf_dir), pods(spark, sf_dir))


def _bound_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return binding.bind(records.normalize(kernel_events(spark, sf_dir)), cgroup_paths(spark, sf_dir), pods(spark, sf_dir))


# --- normalization -------------------------------------------------------------------------------------------------
_ERRNO = "CASE abs(ret) " + " ".join(f"WHEN {k} THEN '{v}'" for k, v in E.ERRNO.items()) + " ELSE concat('E', abs(ret)) END"
_NORMAL = {
    "n04_tcp_connect": ("kernel.tcp.connect", "CASE WHEN ret <> 0 THEN 'warning' ELSE 'info' END", "CASE WHEN ret <> 0 THEN 'failure' ELSE 'success' END", TCP_ID, f"CASE WHEN ret <> 0 THEN {_ERRNO} END", "CAST(NULL AS BIGINT)", "CASE WHEN ret <> 0 THEN CAST(ret AS VARCHAR) END", "CAST(NULL AS VARCHAR)"),
    "n05_tcp_close": ("kernel.tcp.close", "'info'", "'success'", TCP_ID, "CAST(NULL AS VARCHAR)", "CASE WHEN duration_ns > 0 THEN duration_ns // 1000 END", "CAST(NULL AS VARCHAR)", "CAST(NULL AS VARCHAR)"),
    "n06_tcp_retransmit": ("kernel.tcp.retransmit", "'warning'", "'failure'", TCP_ID, "CAST(NULL AS VARCHAR)", "CAST(NULL AS BIGINT)", "CAST(NULL AS VARCHAR)", "tcp_state"),
    "n01_process_exec": ("kernel.process.exec", "'info'", "'success'", "concat('process:', pid)", "CAST(NULL AS VARCHAR)", "CAST(NULL AS BIGINT)", "CAST(NULL AS VARCHAR)", "CAST(NULL AS VARCHAR)"),
    "n02_file_open": ("kernel.file.open", "CASE WHEN ret <> 0 THEN 'warning' ELSE 'info' END", "CASE WHEN ret <> 0 THEN 'failure' ELSE 'success' END", "concat('process:', pid)", "CAST(NULL AS VARCHAR)", "CAST(NULL AS BIGINT)", "CASE WHEN ret <> 0 THEN CAST(ret AS VARCHAR) END", "CAST(NULL AS VARCHAR)"),
}


def _flat(rec: DataFrame) -> DataFrame:
    label = lambda k: F.col("labels")[k].alias(k)
    return rec.select("event_id", "type", "source", "severity", "outcome", F.get("correlation_keys", 0).alias("correlation_key"), F.col("error.code").alias("error_code"), "duration_us", label("errno_num"), label("tcp_state"), F.to_json("labels").alias("labels"), F.to_json("entity_ids").alias("entities"), F.to_json("network_data").alias("network"), F.to_json("process_data").alias("process"))


def _normal(kind: str):
    return lambda spark, sf_dir: _flat(records.normalize(kernel_events(spark, sf_dir).where(F.col("event_type") == kind)))


def _normal_sql(name: str) -> str:
    kind, severity, outcome, key, code, duration, errno, state = _NORMAL[name]
    return f"SELECT event_id, event_type AS type, 'kerngrain/{records.SOURCES[kind]}' AS source, {severity} AS severity, {outcome} AS outcome, {key} AS correlation_key, {code} AS error_code, {duration} AS duration_us, {errno} AS errno_num, {state} AS tcp_state, {J.LABELS} AS labels, {J.ENTITIES} AS entities, {J.NETWORK} AS network, {J.PROCESS_DATA} AS process FROM ke WHERE event_type = '{kind}'"


for _name, (_kind, *_) in _NORMAL.items():
    query(KE + _normal_sql(_name), _name)(_normal(_kind))


@query(KE + " UNION ALL ".join(map(_normal_sql, _NORMAL)))
def n08_normalize_all(spark, sf_dir):
    return _flat(records.normalize(kernel_events(spark, sf_dir)))


@query(KE + """SELECT event_id, path AS requested_path, 'failure' AS outcome, 'unresolved' AS path_resolution, CAST(NULL AS VARCHAR) AS resource_ref_id FROM ke WHERE event_type = 'kernel.file.open' AND ret < 0""")
def n03_file_open_attempt(spark, sf_dir):
    tries = kernel_events(spark, sf_dir).where("event_type = 'kernel.file.open' and ret < 0").withColumn("event_type", F.lit("kernel.file.open_attempt"))
    label = lambda k: F.col("labels")[k].alias(k)
    return records.normalize(tries).select("event_id", label("requested_path"), "outcome", label("path_resolution"), label("resource_ref_id"))


@query(ME + f"""SELECT event_id, node_id, event_type AS type, concat('kerngrain/', split_part(event_type, '.', 3)) AS source, CASE WHEN ret = 0 THEN 'success' WHEN ret IS NOT NULL THEN 'failure' END AS outcome,
  CASE WHEN ret <> 0 THEN 'warning' ELSE 'info' END AS severity, concat('process:', pid) AS entities, CASE WHEN src_ip IS NOT NULL THEN {TCP_ID} END AS key, src_ip, src_port, dst_ip, dst_port, comm AS command FROM me""")
def n07_generic_probe(spark, sf_dir):
    found = records.normalize_generic(more_events(spark, sf_dir))
    net = F.col("network_data")
    return found.select("event_id", "node_id", "type", "source", "outcome", "severity", F.array_join("entity_ids", "|").alias("entities"), F.get("correlation_keys", 0).alias("key"), net["src_ip"].alias("src_ip"), net["src_port"].alias("src_port"), net["dst_ip"].alias("dst_ip"), net["dst_port"].alias("dst_port"), F.col("process_data.command").alias("command"))


# --- projections ---------------------------------------------------------------------------------------------------
@query(KE + f"SELECT event_id, {', '.join(f'CAST({x} AS VARCHAR) AS {k}' for k, x in J.METADATA.items())} FROM ke")
def p01_metadata(spark, sf_dir):
    rows = records.with_metadata(records.normalize(kernel_events(spark, sf_dir)))
    return rows.select("event_id", *[F.col("labels")[k].alias(k) for k in J.METADATA])


_OF_POD = ("container_id", "pod_uid", "pod_name", "namespace", "service_account", "owner_kind", "owner_name", "owner_uid")


@query(STRONG + f"""SELECT event_id, {', '.join(f"CASE WHEN unbound_reason IS NULL THEN nullif({c}, '') END AS k8s_{c}" for c in _OF_POD)}, CASE WHEN unbound_reason IS NULL THEN 'derived' END AS evidence_level, CASE WHEN unbound_reason IS NOT NULL THEN 'unbound' END AS runtime_binding, unbound_reason,
  concat_ws('|', CASE WHEN event_type LIKE 'kernel.tcp.%' THEN {TCP_ID} ELSE concat('process:', pid) END, CASE WHEN unbound_reason IS NULL THEN concat_ws('|', concat('k8s_container_id:', container_id), concat('k8s_pod_uid:', pod_uid), concat('k8s_namespace:', namespace), 'k8s_owner_uid:' || owner_uid) END) AS keys FROM bound""")
def p02_binding_labels(spark, sf_dir):
    label = lambda k: F.col("labels")[k].alias(k)
    return records.with_binding_labels(_bound_records(spark, sf_dir)).select("event_id", *[label(f"k8s_{c}") for c in _OF_POD], label("evidence_level"), label("runtime_binding"), label("unbound_reason"), F.array_join("correlation_keys", "|").alias("keys"))


_BOOT = "550e8400-e29b-41d4-a716-446655440000"
_SUBJECT = f"""concat('sha256:', sha256(unhex(concat(hex('kerngrain.runtime-subject.v1'), lpad(to_hex(octet_length(encode(node_id))), 16, '0'), hex(node_id), lpad(to_hex(36), 16, '0'), hex('{_BOOT}'),
  lpad(to_hex(4), 16, '0'), lpad(to_hex(pid), 8, '0'), lpad(to_hex(8), 16, '0'), lpad(to_hex(start_boottime_ns), 16, '0'), lpad(to_hex(2), 16, '0'), '0001'))))"""
_HAS_SUBJECT = "start_boottime_ns <> 0 AND event_id % 7 <> 0"


def _subjects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of executions, from captures to the digests of their processes; every seventh comes from a node whose boot isn't known."""
    decoded = capture.to_events(capture.decode(captures(kernel_events(spark, sf_dir).where("event_type = 'kernel.process.exec'"))))
    return records.with_runtime_subject(records.normalize(decoded), F.col("node_id"), F.when(F.col("event_id") % 7 == 0, "unknown").otherwise(_BOOT.upper()))


@query(KE + f"""SELECT event_id, CASE WHEN {_HAS_SUBJECT} THEN {_SUBJECT} END AS runtime_subject_id, CASE WHEN {_HAS_SUBJECT} THEN node_id END AS node_identity, CASE WHEN {_HAS_SUBJECT} THEN '{_BOOT}' END AS boot_id, CASE WHEN {_HAS_SUBJECT} THEN '1' END AS runtime_canonicalization_version,
  CAST(gid AS VARCHAR) AS gid, CAST(pid AS VARCHAR) AS host_tgid, CAST(tid AS VARCHAR) AS host_tid, CASE WHEN start_boottime_ns <> 0 THEN CAST(start_boottime_ns AS VARCHAR) END AS leader_start_boottime_ns, identity_method AS runtime_identity_method, concat('sha256:', argv_hash) AS argv_hash
  FROM ke WHERE event_type = 'kernel.process.exec' AND event_id % 17 <> 0""")
def p03_runtime_subject(spark, sf_dir):
    label = lambda k: F.col("labels")[k].alias(k)
    return _subjects(spark, sf_dir).select("event_id", *map(label, ("runtime_subject_id", "node_identity", "boot_id", "runtime_canonicalization_version", "gid", "host_tgid", "host_tid", "leader_start_boottime_ns", "runtime_identity_method", "argv_hash")))


@query(STRONG + """SELECT event_id, 'info' AS severity, CASE WHEN event_type LIKE 'kernel.tcp.%' THEN 'network_endpoint' WHEN event_type = 'kernel.file.open' THEN 'file' ELSE 'executable' END AS ref_kind,
  CASE WHEN event_type LIKE 'kernel.tcp.%' THEN concat(dst_ip, ':', dst_port) ELSE coalesce(path, filename) END AS ref_id, pod_uid FROM bound WHERE unbound_reason IS NULL""")
def p04_neutral(spark, sf_dir):
    return records.neutral(_bound_records(spark, sf_dir)).select("event_id", "severity", F.col("labels")["resource_ref_kind"].alias("ref_kind"), F.col("labels")["resource_ref_id"].alias("ref_id"), "pod_uid")


_BOUND = "unbound_reason IS NULL"
_EXEC = "event_type = 'kernel.process.exec'"


@query(STRONG + f""", w AS (SELECT *, {_EXEC} AND coalesce({_HAS_SUBJECT}, false) AS known FROM bound) SELECT event_type AS occurrence_type, observed_at_ns AS kernel_time_ns, node_id, {', '.join(f"CASE WHEN {_BOUND} THEN nullif({c}, '') END AS {c.replace('namespace', 'k8s_namespace')}" for c in _OF_POD)}, CAST(cgroup_id AS VARCHAR) AS cgroup_id,
  'sha256:' || argv_hash AS argv_hash, tcp_state, cluster AS cluster_id, '6.8.0' AS kernel_release, CASE WHEN known THEN {_SUBJECT} END AS runtime_subject_id, CASE WHEN known THEN node_id END AS node_identity, CASE WHEN known THEN '{_BOOT}' END AS boot_id, identity_method AS runtime_identity_method,
  CASE WHEN {_BOUND} THEN 'derived' END AS evidence_level, CASE WHEN event_type = 'kernel.file.open' THEN 'lsm_gated' END AS coverage, CAST(flags AS VARCHAR) AS flags, CASE WHEN {_EXEC} THEN pid END AS host_tgid, CASE WHEN {_EXEC} THEN tid END AS host_tid, nullif(start_boottime_ns, 0) AS leader_start_boottime_ns,
  CASE WHEN known THEN 1::BIGINT END AS runtime_canonicalization_version, gid, CASE WHEN event_type IN ('kernel.tcp.connect', 'kernel.file.open') AND ret < 0 THEN -ret::BIGINT END AS errno, filename AS exe, path, CASE WHEN path_truncated THEN true END AS path_truncated, pid, nullif(ppid, 0) AS ppid, comm, uid,
  CASE WHEN src_ip IS NOT NULL THEN 'tcp' END AS protocol, src_ip AS source_ip, src_port AS source_port, dst_ip AS destination_ip, dst_port AS destination_port,
  CASE WHEN event_type = 'kernel.tcp.retransmit' OR (event_type IN ('kernel.tcp.connect', 'kernel.file.open') AND ret <> 0) THEN 'failure' ELSE 'success' END AS state, strftime(make_timestamp(observed_at_ns // 1000), '%Y-%m-%dT%H:%M:%S.%fZ') AS observed_at FROM w""")
def p05_wire(spark, sf_dir):
    rec = records.with_binding_labels(records.with_metadata(_bound_records(spark, sf_dir)))
    rec = records.with_runtime_subject(rec, F.col("node_id"), F.when(F.col("event_id") % 7 == 0, "unknown").otherwise(_BOOT))
    return records.wire(rec).drop("event_id", "cause", "requested_path", "path_resolution", "affected_probes", "dropped_records", "dropped_reliability", "dropped_attribution", "gap_start_ns", "gap_end_ns")


@query(STRONG + """, g AS (SELECT node_id, min(observed_at_ns) AS gap_start_ns, max(observed_at_ns) AS gap_end_ns, count(*) AS dropped_records, count(*) FILTER (WHERE event_type IN ('kernel.tcp.close', 'kernel.tcp.retransmit')) AS dropped_reliability,
  count(*) FILTER (WHERE event_type NOT IN ('kernel.tcp.close', 'kernel.tcp.retransmit')) AS dropped_attribution, array_to_string(list_sort(list(DISTINCT event_type)), '|') AS affected_probes, CASE WHEN min(unbound_reason) <> max(unbound_reason) THEN 'multiple' ELSE min(unbound_reason) END AS cause FROM bound WHERE unbound_reason IS NOT NULL GROUP BY node_id)
SELECT node_id, 'agent.gap' AS occurrence_type, cause, gap_start_ns, gap_end_ns, dropped_records, dropped_reliability, dropped_attribution, affected_probes, gap_end_ns AS kernel_time_ns FROM g""")
def p05_wire_of_gaps(spark, sf_dir):
    dropped = _bound(spark, sf_dir).where("unbound_reason is not null")
    found = records.wire(loss.as_records(loss.gaps(dropped, F.col("unbound_reason"), "cluster", "node_id")))
    return found.select("node_id", "occurrence_type", "cause", "gap_start_ns", "gap_end_ns", "dropped_records", "dropped_reliability", "dropped_attribution", F.array_join("affected_probes", "|").alias("affected_probes"), "kernel_time_ns")


@query(KE + f"SELECT {J.ID} AS id, {J.LABELS} AS labels, " + """CAST(CASE event_type WHEN 'kernel.tcp.connect' THEN 0 WHEN 'kernel.tcp.close' THEN 1 WHEN 'kernel.tcp.retransmit' THEN 2 WHEN 'kernel.process.exec' THEN 3 ELSE 4 END AS INT) AS probe_idx, observed_at_ns AS ts_ns,
  CAST(CASE WHEN event_type = 'kernel.tcp.retransmit' OR (event_type IN ('kernel.tcp.connect', 'kernel.file.open') AND ret <> 0) THEN 1 ELSE 0 END AS INT) AS severity, CAST(CASE WHEN event_type = 'kernel.tcp.retransmit' OR (event_type IN ('kernel.tcp.connect', 'kernel.file.open') AND ret <> 0) THEN 1 ELSE 0 END AS INT) AS outcome,
  CASE WHEN src_ip IS NOT NULL THEN concat(src_ip, ':', src_port) END AS src, CASE WHEN dst_ip IS NOT NULL THEN concat(dst_ip, ':', dst_port) END AS dst, CASE WHEN src_ip IS NOT NULL THEN 'tcp' END AS proto, pid, comm AS cmd FROM ke""")
def p06_compact(spark, sf_dir):
    return records.compact(records.normalize(kernel_events(spark, sf_dir))).drop("interp")


@query(KE + "SELECT CASE WHEN event_type IN ('kernel.tcp.close', 'kernel.tcp.retransmit') THEN 'reliability' ELSE 'attribution' END AS evidence_class, count(*) AS n FROM ke GROUP BY 1")
def p07_evidence_class(spark, sf_dir):
    return records.with_class(records.normalize(kernel_events(spark, sf_dir))).groupBy("evidence_class").agg(F.count("*").alias("n"))


@query(ME + "SELECT event_type, split_part(event_type, '.', 1) AS domain, regexp_extract(event_type, '^[^.]*\\.(.*)$', 1) AS action, count(*) AS n FROM me GROUP BY event_type")
def p08_domain_action(spark, sf_dir):
    t = F.col("event_type")
    return more_events(spark, sf_dir).groupBy(t, E.type_domain(t).alias("domain"), E.type_action(t).alias("action")).agg(F.count("*").alias("n"))


_KINDS = [p + x for p, x in zip([p for p, _ in E.CATEGORIES], ["_kill", "", "", "", "", "", "", "", "", "", "dns", "rollout", "reload", "slow", "pending", "", "up", "alert", "deny", "gap"], strict=True)] + ["kernel.tcp.close"]


@query("SELECT kind, CASE " + " ".join(f"WHEN kind LIKE '{p.replace('_', chr(92) + '_')}%' ESCAPE '{chr(92)}' THEN '{c}'" for p, c in E.CATEGORIES) + f" END AS category, count(*) AS n FROM (SELECT list_extract([{', '.join(repr(k) for k in _KINDS)}], CAST(event_id % {len(_KINDS)} + 1 AS INT)) AS kind FROM events) GROUP BY kind")
def p09_category(spark, sf_dir):
    kind = F.element_at(F.array(*map(F.lit, _KINDS)), (F.col("event_id") % len(_KINDS) + 1).cast("int"))
    return kernel_events(spark, sf_dir).select(kind.alias("kind")).groupBy("kind").agg(F.count("*").alias("n")).select("kind", E.category(F.col("kind")).alias("category"), "n")


_STATES = ", ".join(f"'{x}'" for x in E.ENRICHMENT)


@query(f"SELECT list_extract([{_STATES}], CAST(event_id % 5 + 1 AS INT)) AS state, list_extract([{_STATES}], CAST(least(event_id % 5 + 2, 5) AS INT)) AS next_state, count(*) AS n FROM events GROUP BY 1, 2")
def p10_enrichment_state(spark, sf_dir):
    state = F.element_at(F.array(*map(F.lit, E.ENRICHMENT)), (F.col("event_id") % 5 + 1).cast("int"))
    return kernel_events(spark, sf_dir).select(state.alias("state")).withColumn("next_state", E.next_enrichment(F.col("state"))).groupBy("state", "next_state").agg(F.count("*").alias("n"))


@query("""SELECT event_id, concat_ws('; ', CASE WHEN event_id % 7 = 0 THEN 'cluster is blank' END, CASE WHEN event_id % 11 = 0 THEN 'source is longer than 256 bytes' END) AS broken FROM events WHERE event_id % 7 = 0 OR event_id % 11 = 0""")
def p11_validation(spark, sf_dir):
    rec = records.normalize(kernel_events(spark, sf_dir)).withColumns({"cluster": F.when(F.col("event_id") % 7 == 0, " ").otherwise(F.col("cluster")), "source": F.when(F.col("event_id") % 11 == 0, F.repeat(F.lit("x"), 300)).otherwise(F.col("source"))})
    return records.violations(rec).where(F.size("violations") > 0).select("event_id", F.array_join("violations", "; ").alias("broken"))


_ID = J.ID
_SOURCE = "concat('kerngrain/', CASE event_type " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in records.SOURCES.items()) + " END)"


@query(KE + f"SELECT event_id, concat_ws(':', {_SOURCE}, cluster, node_id, {_ID}) AS idempotency_key FROM ke")
def p12_idempotency_key(spark, sf_dir):
    return records.idempotency_key(records.normalize(kernel_events(spark, sf_dir))).select("event_id", "idempotency_key")


@query(STRONG + f"""SELECT node_id, observed_at_ns // 10000000000 AS batch, count(*) AS n, CAST(sum(256 + strlen({J.SHORT}) + 2 * strlen({J.NAME}) + 1 + strlen(split_part({J.NAME}, '_', 1)) + CASE WHEN unbound_reason IS NULL THEN {' + '.join(f"coalesce(strlen({c}), 0)" for c in _OF_POD)} ELSE 0 END)
  + 128 + strlen('kerngrain') + strlen('0.1') + strlen('6.8.0') + any_value(strlen(cluster)) + any_value(strlen(node_id)) AS BIGINT) AS approx_bytes FROM bound GROUP BY ALL""")
def p13_approximate_bytes(spark, sf_dir):
    """Sizes of batches of ten seconds of a node."""
    rec = _bound_records(spark, sf_dir).withColumn("batch", F.expr("observed_at_ns div 10000000000"))
    return records.batch_bytes(rec, "node_id", "batch")


@query(STRONG + """SELECT event_id, node_id, observed_at_ns // 10000000000 AS batch, CASE WHEN event_type IN ('kernel.tcp.close', 'kernel.tcp.retransmit') THEN 'reliability' ELSE 'attribution' END AS evidence_class,
  CAST(row_number() OVER (PARTITION BY node_id, observed_at_ns // 10000000000, event_type IN ('kernel.tcp.close', 'kernel.tcp.retransmit') ORDER BY observed_at_ns, event_id) - 1 AS INT) AS position FROM bound""")
def u04_split_batches(spark, sf_dir):
    rec = records.normalize(kernel_events(spark, sf_dir)).withColumn("batch", F.expr("observed_at_ns div 10000000000"))
    return records.split_by_class(rec, "node_id", "batch").select("event_id", "node_id", "batch", "evidence_class", "position")


# --- filters -------------------------------------------------------------------------------------------------------
@query(KE + "SELECT event_id, observed_at_ns, src_ip, dst_port FROM ke WHERE observed_at_ns >= (SELECT max(observed_at_ns) FROM ke) - 300000000000 AND dst_port = 443 AND dst_ip = '10.42.1.3'")
def f01_event_filter(spark, sf_dir):
    ev = kernel_events(spark, sf_dir)
    now = ev.agg(F.max("observed_at_ns").alias("now_ns")).scalar()  # a scalar subquery, so that the bound reaches the scan
    return select.event_filter(ev, now, 300, dst_port=443, dst_ip="10.42.1.3").select("event_id", "observed_at_ns", "src_ip", "dst_port")


@query(KE + "SELECT event_id, path FROM ke WHERE event_type = 'kernel.file.open' AND (" + " OR ".join(f"regexp_full_match(path, '{E.path_pattern(p)[5:-1]}', 's')" for p in E.SENSITIVE_PATHS) + ")")
def f02_sensitive_paths(spark, sf_dir):
    return kernel_events(spark, sf_dir).where((F.col("event_type") == "kernel.file.open") & E.matches_path(F.col("path"))).select("event_id", "path")


@query(KE + "SELECT event_id, path FROM ke WHERE path LIKE '/etc/%' OR path LIKE '/var/run/secrets/%' OR path LIKE '/proc/_/environ'")
def e12_configured_paths(spark, sf_dir):
    """Paths by patterns as an operator writes them."""
    return kernel_events(spark, sf_dir).where(E.matches_path(F.col("path"), E.parse_patterns(" /etc/* ,, /var/run/secrets/,/proc/?/environ "))).select("event_id", "path")


@query(STRONG + "SELECT event_id, namespace FROM bound WHERE unbound_reason IS NULL AND namespace IN ('NATION_1', 'NATION_4', 'NATION_12')")
def f04_namespaces(spark, sf_dir):
    return select.in_namespaces(_bound_records(spark, sf_dir), ["NATION_1", "NATION_4", "NATION_12"]).select("event_id", "namespace")


@query(KE + "SELECT event_id, node_id, pid FROM ke WHERE NOT EXISTS (SELECT 1 FROM customer WHERE ke.pid = 1000 + c_custkey AND ke.node_id = concat('node-', CAST(c_custkey % 3 AS VARCHAR)) AND c_nationkey < 9)")
def f05_self_filter(spark, sf_dir):
    own = spark.read.parquet(f"{sf_dir}/customer.parquet").where("c_nationkey < 9").selectExpr("1000 + c_custkey as pid", "concat('node-', cast(c_custkey % 3 as string)) as node_id")
    return select.without(kernel_events(spark, sf_dir), own, "node_id", "pid").select("event_id", "node_id", "pid")


@query(KE + "SELECT event_id, node_id, event_type FROM ke QUALIFY row_number() OVER (PARTITION BY node_id, event_type ORDER BY observed_at_ns, event_id) % 10 = 0")
def f06_every_tenth(spark, sf_dir):
    return select.every_nth(kernel_events(spark, sf_dir), 10).select("event_id", "node_id", "event_type")


@query(STRONG + "SELECT unbound_reason AS drop_reason, count(*) AS n FROM bound WHERE unbound_reason IS NOT NULL GROUP BY 1")
def f07_a02_unbound_counts(spark, sf_dir):
    return records.drop_reason(_bound_records(spark, sf_dir)).where("drop_reason is not null").groupBy("drop_reason").agg(F.count("*").alias("n"))


@query(KE + f"SELECT event_id FROM ke WHERE {_ID} > '000000000300000'")
def f08_cursor(spark, sf_dir):
    return select.after(records.normalize(kernel_events(spark, sf_dir)), "000000000300000").select("event_id")


# --- joins ---------------------------------------------------------------------------------------------------------
@query(STRONG + "SELECT event_id, unbound_reason, CASE WHEN unbound_reason IS NULL THEN pod_uid END AS pod_uid, CASE WHEN unbound_reason IS NULL THEN namespace END AS namespace FROM bound")
def j01_j02_bind(spark, sf_dir):
    return _bound(spark, sf_dir).select("event_id", "unbound_reason", "pod_uid", "namespace")


@query(STRONG + """SELECT event_id, CAST(CASE WHEN unbound_reason IS NULL THEN 0 WHEN c_custkey IS NOT NULL THEN 1 END AS INT) AS resolver, CASE WHEN unbound_reason IS NULL THEN container_id END AS container_id,
  CASE WHEN unbound_reason IS NULL THEN pod_uid ELSE 'static-' || c_custkey END AS pod_uid, CASE WHEN unbound_reason IS NULL THEN namespace WHEN c_custkey IS NOT NULL THEN 'static' END AS namespace FROM bound LEFT JOIN customer ON bound.pid = 1000 + c_custkey AND c_nationkey < 9""")
def ud03_resolvers(spark, sf_dir):
    """Bindings by the inventory, and by a list of pids where that knows nothing."""
    static = spark.read.parquet(f"{sf_dir}/customer.parquet").where("c_nationkey < 9").selectExpr("1000 + c_custkey as pid", "concat('static-', c_custkey) as pod_uid", "'static' as namespace", "cast(null as string) as container_id")

    def inventory(keys: DataFrame) -> DataFrame:
        return binding.bind(keys.withColumn("event_id", F.xxhash64(*binding.ASKED)), cgroup_paths(spark, sf_dir), pods(spark, sf_dir)).select(*binding.ASKED, "container_id", "pod_uid", "namespace")

    return binding.resolved(kernel_events(spark, sf_dir), inventory, lambda keys: keys.join(static, "pid")).select("event_id", "resolver", "container_id", "pod_uid", "namespace")


@query(STRONG + "SELECT count(*) FILTER (WHERE unbound_reason IS NULL) AS hits, count(*) FILTER (WHERE unbound_reason IS NOT NULL) AS misses, count(*) FILTER (WHERE unbound_reason IS NULL) / count(*) AS ratio FROM bound")
def a09_binding_coverage(spark, sf_dir):
    return binding.coverage(_bound(spark, sf_dir))


@query(KE + """, e AS (SELECT event_id, node_id, pid, observed_at_ns, event_type, lag(event_type) OVER w AS before, lag(path) OVER w AS path0 FROM (SELECT * FROM ke WHERE event_type IN ('kernel.file.open', 'kernel.process.exec')) WINDOW w AS (PARTITION BY cluster, node_id, boot_id, pid ORDER BY observed_at_ns, event_id))
SELECT event_id, node_id, pid, path0 AS path FROM e WHERE event_type = 'kernel.process.exec' AND before = 'kernel.file.open'""")
def j03_pairing(spark, sf_dir):
    from ..operators.pairing import paired

    ev = kernel_events(spark, sf_dir)
    kind = F.when(F.col("event_type") == "kernel.file.open", "enter").when(F.col("event_type") == "kernel.process.exec", "exit")
    return paired(ev.withColumn("kind", kind).where("kind is not null")).select("event_id", "node_id", "pid", "path")


@query(KE + f""", e AS (SELECT *, lag(event_type) OVER w AS before, lag(path) OVER w AS path0 FROM (SELECT * FROM ke WHERE event_type IN ('kernel.file.open', 'kernel.tcp.connect')) WINDOW w AS (PARTITION BY cluster, node_id, boot_id, pid ORDER BY observed_at_ns, event_id))
SELECT event_id, path0 AS requested_path, {J.ERRNO} AS errno, CAST(ret AS VARCHAR) AS errno_num, 'unresolved' AS path_resolution, 'warning' AS severity, 'failure' AS outcome FROM e WHERE event_type = 'kernel.tcp.connect' AND before = 'kernel.file.open' AND ret < 0""")
def j03_failed_attempts(spark, sf_dir):
    """Enters and exits to records of attempts; a connect stands for the exit, as it has a result."""
    from ..operators.pairing import attempts

    kind = F.when(F.col("event_type") == "kernel.file.open", "enter").when(F.col("event_type") == "kernel.tcp.connect", "exit")
    found = records.normalize(attempts(kernel_events(spark, sf_dir).withColumn("kind", kind).where("kind is not null")))
    return found.select("event_id", *[F.col("labels")[k].alias(k) for k in ("requested_path", "errno", "errno_num", "path_resolution")], "severity", "outcome")


_NEXT = """, e AS (SELECT *, lead(CASE WHEN event_type = '{then}' THEN observed_at_ns END IGNORE NULLS) OVER w AS next_ns, lead(CASE WHEN event_type = '{then}' THEN event_id END IGNORE NULLS) OVER w AS next_id
  FROM (SELECT * FROM {table} WHERE event_type IN ('{first}', '{then}')) WINDOW w AS (PARTITION BY {keys} ORDER BY observed_at_ns, event_id))
SELECT event_id, {keys}, observed_at_ns, next_id, next_ns - observed_at_ns AS after_ns FROM e WHERE event_type = '{first}' AND next_ns - observed_at_ns <= {ns}"""


@query(KE + _NEXT.format(table="ke", first="kernel.tcp.connect", then="kernel.tcp.close", keys=f"{NODE}, src_ip, src_port, dst_ip, dst_port", ns=10**9))
def r07_j04_quick_close(spark, sf_dir):
    return rules.followed(kernel_events(spark, sf_dir), "kernel.tcp.connect", "kernel.tcp.close", rules.CONNECTION, 1)


_LIVES = """, t AS (SELECT *, CASE WHEN event_type = 'kernel.tcp.connect' OR coalesce(lag(event_type = 'kernel.tcp.close') OVER w, true) THEN 1 ELSE 0 END AS new FROM ke WHERE event_type LIKE 'kernel.tcp.%'
  WINDOW w AS (PARTITION BY cluster, node_id, boot_id, src_ip, src_port, dst_ip, dst_port ORDER BY observed_at_ns, event_id)),
u AS (SELECT *, sum(new) OVER (PARTITION BY cluster, node_id, boot_id, src_ip, src_port, dst_ip, dst_port ORDER BY observed_at_ns, event_id) AS n FROM t),
v AS (SELECT cluster, node_id, boot_id, src_ip, src_port, dst_ip, dst_port, n, max(CASE WHEN event_type = 'kernel.tcp.connect' THEN event_id END) AS connect_id, max(CASE WHEN event_type = 'kernel.tcp.connect' THEN observed_at_ns END) AS begin_ns, max(CASE WHEN event_type = 'kernel.tcp.connect' THEN ret END)::BIGINT AS ret,
  max(CASE WHEN event_type = 'kernel.tcp.close' THEN event_id END) AS close_id, max(CASE WHEN event_type = 'kernel.tcp.close' THEN observed_at_ns END) AS end_ns, max(bytes_sent) AS bytes_sent, max(bytes_received) AS bytes_received, count(*) FILTER (WHERE event_type = 'kernel.tcp.retransmit') AS losses FROM u GROUP BY ALL),
v2 AS (SELECT *, lead(n) OVER (PARTITION BY cluster, node_id, boot_id, src_ip, src_port, dst_ip, dst_port ORDER BY n) AS later FROM v),
lives AS (SELECT * EXCLUDE (n, later), end_ns - begin_ns AS lifetime_ns, CASE WHEN ret <> 0 THEN 'failed' WHEN connect_id IS NULL AND close_id IS NULL THEN 'unseen' WHEN connect_id IS NULL THEN 'closed_unseen' WHEN close_id IS NOT NULL THEN 'closed' WHEN later IS NOT NULL THEN 'superseded' ELSE 'open' END AS state FROM v2) """


@query(KE + _LIVES + "SELECT * FROM lives")
def j04_lifetimes(spark, sf_dir):
    return rules.lifetimes(kernel_events(spark, sf_dir)).withColumn("ret", F.col("ret").cast("long"))


@query(KE + _LIVES + """SELECT cluster, node_id, boot_id, dst_ip, dst_port, count(connect_id) AS connections, count(*) FILTER (WHERE state = 'failed') AS failed, count(*) FILTER (WHERE state = 'open') AS open, count(*) FILTER (WHERE state = 'closed') AS closed,
  count(*) FILTER (WHERE state = 'superseded') AS superseded, sum(losses)::BIGINT AS losses, count(*) FILTER (WHERE losses > 0) AS lossy, sum(bytes_sent)::BIGINT AS bytes_sent, CAST(trunc(sum(lifetime_ns)::DOUBLE / count(lifetime_ns)) AS BIGINT) AS mean_lifetime_ns FROM lives GROUP BY ALL""")
def j04_backends(spark, sf_dir):
    return rules.backends(rules.lifetimes(kernel_events(spark, sf_dir)))


@query(ME + _NEXT.format(table="(SELECT * FROM me WHERE event_type <> 'kernel.memory.cgroup_charge' OR ret <> 0)", first="kernel.memory.cgroup_charge", then="kernel.memory.oom_kill", keys=f"{NODE}, cgroup_id", ns=60 * 10**9))
def r30_charge_then_oom(spark, sf_dir):
    return rules.followed(more_events(spark, sf_dir).where("event_type <> 'kernel.memory.cgroup_charge' or ret <> 0"), "kernel.memory.cgroup_charge", "kernel.memory.oom_kill", (*rules.NODE, "cgroup_id"), 60)


@query(ME + _NEXT.replace("SELECT event_id, {keys}, observed_at_ns, next_id, next_ns - observed_at_ns AS after_ns FROM e WHERE event_type = '{first}' AND next_ns - observed_at_ns <= {ns}", "SELECT event_id, {keys}, observed_at_ns FROM e WHERE event_type = '{first}' AND (next_ns IS NULL OR next_ns - observed_at_ns > {ns})").format(table="me", first="kernel.sched.wakeup", then="kernel.sched.switch", keys=f"{NODE}, pid", ns=10**8))
def r38_wakeup_without_switch(spark, sf_dir):
    return rules.unanswered(more_events(spark, sf_dir), "kernel.sched.wakeup", "kernel.sched.switch", rules.PROCESS, 0.1)


# --- rules ---------------------------------------------------------------------------------------------------------
_CAPTURED = {"kernel.tcp.connect", "kernel.tcp.close", "kernel.tcp.retransmit", "kernel.process.exec", "kernel.file.open"}


#: Rules whose windows need more events than the tables have at the usual speed.
_DENSE = {"R06", "R08", "R32", "R33"}


def _rule(rule: rules.Rule):
    source = kernel_events if rule.event_type in _CAPTURED else more_events
    return lambda spark, sf_dir: rules.evaluate(source(spark, sf_dir, *([FAST] if rule.id in _DENSE else [])), rule)


def _rule_with(rule: rules.Rule) -> tuple[str, str]:
    if rule.event_type in _CAPTURED:
        return f"WITH {FAST_EVENTS_SQL} " if rule.id in _DENSE else KE, "ke"
    return f"WITH {FAST_MORE_SQL} " if rule.id in _DENSE else ME, "me"


#: Of rules over single events the conditions once more, written for DuckDB by themselves.
_SINGLE = {
    "R01": "event_type = 'kernel.tcp.connect' AND ret = 0", "R02": "event_type = 'kernel.tcp.connect' AND ret = -111", "R03": "event_type = 'kernel.tcp.connect' AND ret = -110",
    "R04": "event_type = 'kernel.tcp.connect' AND ret = -113", "R05": "event_type = 'kernel.tcp.connect' AND ret = -101", "R09": "event_type = 'kernel.tcp.retransmit' AND tcp_state = 'SYN_SENT'",
    "R10": "event_type = 'kernel.tcp.retransmit' AND tcp_state = 'ESTABLISHED'", "R11": "event_type = 'kernel.tcp.retransmit' AND tcp_state = 'CLOSE_WAIT'", "R27": "event_type = 'kernel.memory.page_alloc' AND ret = 0",
    "R31": "event_type = 'kernel.file.open' AND ret = -13", "R34": "event_type = 'kernel.fs.read' AND ret < 0", "R40": "event_type = 'kernel.process.exit' AND ret = 137", "R42": "event_type = 'kernel.process.clone' AND ret < 0",
}


_PAIR = "src_ip, src_port, dst_ip, dst_port"
#: Of windowed rules: keys beside cluster, node and boot, what is counted of which rows, when it tells, and the window in seconds; written for DuckDB by themselves.
_WINDOWED = {
    "R06": ("dst_ip, dst_port", "count(*) FILTER (WHERE ret <> 0)", "event_type = 'kernel.tcp.connect'", ">= 5", 60),
    "R08": ("dst_ip, dst_port", "count(*)", "event_type = 'kernel.tcp.close'", ">= 20", 60),
    "R13": ("dst_ip", "count(DISTINCT (src_ip, src_port, dst_port))", "event_type = 'kernel.tcp.retransmit'", ">= 2", 60),
    "R14": ("", "count(DISTINCT dst_ip)", "event_type = 'kernel.tcp.retransmit'", ">= 2", 60),
    "R17": ("dst_port, pid", "count(event_id)", "event_type = 'kernel.tcp.accept' AND ret = -11", "> 1", 60),
    "R19": (_PAIR, "count(*) - count(*) FILTER (WHERE ret > 0)", "event_type = 'kernel.tcp.recv'", "= 0", 60),
    "R20": (_PAIR, "count(*)", "event_type = 'kernel.tcp.recv' AND ret = 0", "> 1", 60),
    "R21": ("dst_port", "count(*)", "event_type = 'kernel.tcp.syn_recv' AND ret = 0", "> 1", 60),
    "R22": ("dst_port", "count(*) FILTER (WHERE ret = 0)", "event_type = 'kernel.tcp.syn_recv'", "= 0", 60),
    "R23": ("src_ip, dst_ip", "count(*)", "event_type = 'kernel.tcp.reset'", "> 1", 60),
    "R24": ("dst_port", "count(DISTINCT (src_ip, src_port, dst_ip))", "event_type = 'kernel.tcp.reset'", "> 1", 60),
    "R25": ("cgroup_id", "count(*)", "event_type = 'kernel.memory.oom_kill' AND cgroup_id > 0", "> 1", 3600),
    "R26": ("", "count(DISTINCT comm)", "event_type = 'kernel.memory.oom_kill'", "> 1", 60),
    "R28": ("", "count(*) FILTER (WHERE ret = 0)", "event_type = 'kernel.memory.page_alloc'", "= 0", 60),
    "R29": ("cgroup_id", "count(*)", "event_type = 'kernel.memory.cgroup_charge' AND ret NOT IN (0)", "> 1", 600),
    "R32": ("pid", "sum(ret)", "event_type = 'kernel.fs.write' AND ret > 0", ">= 5000", 60),
    "R33": ("pid", "sum(ret)", "event_type = 'kernel.fs.read' AND ret > 0", ">= 5000", 60),
    "R37": ("pid", "count(*)", "event_type = 'kernel.sched.wakeup'", "> 1", 60),
    "R41": ("comm", "count(*)", "event_type = 'kernel.process.exit' AND ret IS DISTINCT FROM 0", "> 2", 60),
    "R43": ("pid", "count(*)", "event_type = 'kernel.process.clone'", "> 1", 60),
}


def _rule_sql(rule: rules.Rule) -> str:
    clause, table = _rule_with(rule)
    if rule.shape == "filter":
        return clause + f"SELECT '{rule.id}' AS rule_id, event_id, node_id, observed_at_ns FROM {table} WHERE {_SINGLE[rule.id]}"
    keys, measure, where, tells, seconds = _WINDOWED[rule.id]
    keys = f"{NODE}{', ' if keys else ''}{keys}"
    start = f"observed_at_ns - observed_at_ns % {seconds * 10**9}"
    return clause + f"SELECT '{rule.id}' AS rule_id, {keys}, {start} AS window_start_ns, CAST({measure} AS BIGINT) AS n, min(event_id) AS first_id, max(event_id) AS last_id FROM {table} WHERE {where} GROUP BY {keys}, {start} HAVING {measure} {tells}"


for _r in rules.RULES:
    query(_rule_sql(_r), f"r{_r.id[1:]}_{_r.event_type.split('.', 1)[1].replace('.', '_')}")(_rule(_r))


@query(KE + """SELECT event_id, cluster, node_id, boot_id, src_ip, src_port, dst_ip, dst_port, observed_at_ns, count(*) OVER (PARTITION BY cluster, node_id, boot_id, src_ip, src_port, dst_ip, dst_port ORDER BY observed_at_ns RANGE BETWEEN 10000000000 PRECEDING AND CURRENT ROW) AS n
FROM ke WHERE event_type = 'kernel.tcp.retransmit' AND tcp_state = 'ESTABLISHED' QUALIFY n >= 3""")
def r12_repeated_loss(spark, sf_dir):
    return rules.losses(kernel_events(spark, sf_dir))


_RATES = """SELECT {keys}, observed_at_ns // {ns} * {ns} AS window_start_ns, count(*) FILTER (WHERE event_type = '{a}') AS n_first, count(*) FILTER (WHERE event_type = '{b}') AS n_then,
  CAST(coalesce(sum(CASE WHEN event_type = '{a}' AND ret > 0 THEN ret END), 0) AS BIGINT) AS first_bytes FROM {t} WHERE event_type IN ('{a}', '{b}') GROUP BY {keys}, observed_at_ns // {ns}"""


@query(f"WITH {MORE_SQL}, {EVENTS_SQL}, u AS (SELECT * FROM me UNION ALL SELECT * FROM ke), w AS (" + _RATES.format(keys=f"{NODE}, dst_ip", a="kernel.tcp.send", b="kernel.tcp.retransmit", t="u", ns=60 * 10**9) + ") SELECT *, CASE WHEN n_then >= 2 THEN 'R16' ELSE 'R15' END AS rule_id FROM w WHERE first_bytes >= 1000")
def r15_r16_send_and_loss(spark, sf_dir):
    both = more_events(spark, sf_dir).union(kernel_events(spark, sf_dir))
    found = rules.rates(both, ("kernel.tcp.send", "kernel.tcp.retransmit"), (*rules.NODE, "dst_ip")).where("first_bytes >= 1000")
    return found.withColumn("rule_id", F.when(F.col("n_then") >= 2, "R16").otherwise("R15"))


@query(f"WITH {MORE_SQL}, {EVENTS_SQL}, u AS (SELECT * FROM me UNION ALL SELECT * FROM ke), w AS (" + _RATES.format(keys=f"{NODE}, {_PAIR}", a="kernel.tcp.send", b="kernel.tcp.retransmit", t="u", ns=720 * 10**9) + ") SELECT *, CASE WHEN n_then >= 1 THEN 'R16' ELSE 'R15' END AS rule_id FROM w WHERE first_bytes >= 500")
def r15_r16_by_connection(spark, sf_dir):
    both = more_events(spark, sf_dir).union(kernel_events(spark, sf_dir))
    found = rules.rates(both, ("kernel.tcp.send", "kernel.tcp.retransmit"), rules.CONNECTION, 720).where("first_bytes >= 500")
    return found.withColumn("rule_id", F.when(F.col("n_then") >= 1, "R16").otherwise("R15"))


@query(f"WITH {MORE_SQL}, {EVENTS_SQL}, u AS (SELECT * FROM me UNION ALL SELECT * FROM ke), w AS (" + _RATES.format(keys=f"{NODE}, pid", a="kernel.file.open", b="kernel.fs.close", t="u", ns=600 * 10**9) + ") SELECT cluster, node_id, boot_id, pid, window_start_ns, n_first, n_then FROM w WHERE n_first >= 2 AND n_then < 0.5 * n_first")
def r35_descriptor_leak(spark, sf_dir):
    both = more_events(spark, sf_dir).union(kernel_events(spark, sf_dir))
    return rules.rates(both, ("kernel.file.open", "kernel.fs.close"), rules.PROCESS, 600).where("n_first >= 2 and n_then < 0.5 * n_first").drop("first_bytes")


@query(ME + """, w AS (SELECT cluster, node_id, boot_id, dst_port, observed_at_ns // 60000000000 * 60000000000 AS window_start_ns, count(*) AS n FROM me WHERE event_type = 'kernel.tcp.accept' GROUP BY ALL)
SELECT *, lag(n) OVER (PARTITION BY cluster, node_id, boot_id, dst_port ORDER BY window_start_ns) AS n_before FROM w QUALIFY n < 0.5 * n_before""")
def r18_accepts_drop(spark, sf_dir):
    return rules.drops(more_events(spark, sf_dir), "kernel.tcp.accept", (*rules.NODE, "dst_port"), 0.5)


@query(ME + """SELECT cluster, node_id, boot_id, least(pid, 1000 + pid % 97) AS low, greatest(pid, 1000 + pid % 97) AS high, observed_at_ns // 60000000000 * 60000000000 AS window_start_ns, count(*) AS n FROM me WHERE event_type = 'kernel.sched.switch' GROUP BY ALL HAVING count(*) >= 2""")
def r36_fighting_processes(spark, sf_dir):
    rows = more_events(spark, sf_dir).where("event_type = 'kernel.sched.switch'").withColumn("next_pid", F.expr("1000 + pid % 97"))
    return rows.groupBy(*rules.NODE, F.least("pid", "next_pid").alias("low"), F.greatest("pid", "next_pid").alias("high"), F.expr("observed_at_ns div 60000000000 * 60000000000").alias("window_start_ns")).agg(F.count("*").alias("n")).where("n >= 2")


@query(KE + "SELECT event_id, node_id, comm, filename FROM ke WHERE event_type = 'kernel.process.exec' AND (comm, filename) NOT IN (SELECT concat('app', CAST(c_custkey % 10 AS VARCHAR)), CASE WHEN c_custkey % 2 = 0 THEN '/app/server' ELSE '/bin/sh' END FROM customer)")
def r39_unexpected_binary(spark, sf_dir):
    allowed = spark.read.parquet(f"{sf_dir}/customer.parquet").selectExpr("concat('app', cast(c_custkey % 10 as string)) as comm", "case when c_custkey % 2 = 0 then '/app/server' else '/bin/sh' end as filename")
    return rules.unexpected_binaries(kernel_events(spark, sf_dir), allowed)


# --- windows, limits, sets -----------------------------------------------------------------------------------------
@query(KE + "SELECT event_id, event_type, observed_at_ns FROM ke QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY observed_at_ns DESC, event_id DESC) <= 100")
def w01_last_per_probe(spark, sf_dir):
    return select.last_per_probe(kernel_events(spark, sf_dir), 100).select("event_id", "event_type", "observed_at_ns")


@query(KE + "SELECT event_id, observed_at_ns FROM ke WHERE event_type = 'kernel.tcp.connect' AND ret <> 0 ORDER BY observed_at_ns, event_id LIMIT 100")
def t01_q03_oldest_of_probe(spark, sf_dir):
    return select.oldest(kernel_events(spark, sf_dir).where("event_type = 'kernel.tcp.connect' and ret <> 0")).select("event_id", "observed_at_ns")


@query(KE + "SELECT event_id, observed_at_ns FROM ke WHERE dst_port = 443 ORDER BY observed_at_ns DESC, event_id DESC LIMIT 100")
def t02_u01_newest_of_all(spark, sf_dir):
    return select.newest(select.event_filter(kernel_events(spark, sf_dir), dst_port=443)).select("event_id", "observed_at_ns")


@query(KE + """, s AS (SELECT node_id, event_type AS probe_id, observed_at_ns // 60000000000 AS m, count(*) * 7 % 50 AS dropped FROM ke GROUP BY 1, 2, 3),
d AS (SELECT node_id, probe_id, m, dropped, lag(dropped, 1, 0) OVER w AS before, coalesce(lag(m) OVER w, 0) * 60000000000 AS from_ns FROM s WINDOW w AS (PARTITION BY node_id, probe_id ORDER BY m))
SELECT node_id, probe_id, m * 60000000000 AS polled_ns, CASE WHEN dropped < before THEN dropped ELSE dropped - before END AS delta, from_ns FROM d""")
def w03_s09_counter_deltas(spark, sf_dir):
    return loss.counter_deltas(_samples(spark, sf_dir)).select("node_id", "probe_id", "polled_ns", "delta", "from_ns")


def _samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = kernel_events(spark, sf_dir).groupBy("node_id", F.col("event_type").alias("probe_id"), F.expr("observed_at_ns div 60000000000").alias("m")).agg((F.count("*") * 7 % 50).alias("dropped"))
    return counts.select("node_id", "probe_id", (F.col("m") * 60_000_000_000).alias("polled_ns"), "dropped", F.lit(0).cast("long").alias("tracking_start_ns"))


@query("""WITH c AS (SELECT CASE WHEN o_orderkey % 6 = 0 THEN 'delete' ELSE 'apply' END AS op, o_orderkey AS seq, o_custkey % 100 AS pod, o_totalprice FROM orders)
SELECT concat('pod-', CAST(pod AS VARCHAR)) AS pod_uid, seq, concat('ns-', CAST(seq % 7 AS VARCHAR)) AS namespace FROM c QUALIFY row_number() OVER (PARTITION BY pod ORDER BY seq DESC) = 1 AND op <> 'delete'""")
def w04_s04_latest_pods(spark, sf_dir):
    return binding.latest_pods(_changes(spark, sf_dir)).select("pod_uid", "seq", "namespace")


def _changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/orders.parquet").selectExpr("case when o_orderkey % 6 = 0 then 'delete' else 'apply' end as op", "o_orderkey as seq", "concat('pod-', cast(o_custkey % 100 as string)) as pod_uid", "concat('ns-', cast(o_orderkey % 7 as string)) as namespace")


_BACKLOG = "b AS (SELECT cluster, node_id, observed_at_ns // 10000000000 AS batch_id, CASE WHEN event_type IN ('kernel.tcp.close', 'kernel.tcp.retransmit') THEN 'reliability' ELSE 'attribution' END AS class, max(observed_at_ns) // 1000000 AS enqueued_ms, count(*) AS records, count(*) * 300 AS bytes FROM ke GROUP BY 1, 2, 3, 4)"


def _backlog(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = kernel_events(spark, sf_dir).groupBy("cluster", "node_id", F.expr("observed_at_ns div 10000000000").alias("batch_id"), E.evidence_class(F.col("event_type")).alias("class"))
    return rows.agg(F.expr("max(observed_at_ns) div 1000000").alias("enqueued_ms"), F.count("*").alias("records"), (F.count("*") * 300).alias("bytes"))


@query(KE + f""", {_BACKLOG} SELECT node_id, batch_id, class, sum(records) OVER w <= 1000 AND count(*) OVER w <= 40 AND sum(bytes) OVER w <= 200000 AS kept FROM b
WINDOW w AS (PARTITION BY cluster, node_id ORDER BY CASE class WHEN 'attribution' THEN 0 ELSE 1 END, enqueued_ms DESC, batch_id DESC ROWS UNBOUNDED PRECEDING)""")
def w05_shed(spark, sf_dir):
    return loss.shed(_backlog(spark, sf_dir), 1000, 40, 200_000).select("node_id", "batch_id", "class", "kept")


@query(f"WITH {CGROUPS_SQL} SELECT cluster, node_id, cgroup_id, path, cgroup_id % 4 AS node FROM cgroups QUALIFY row_number() OVER (PARTITION BY cgroup_id % 4 ORDER BY cgroup_id DESC) <= 10")
def w06_bounded_dimension(spark, sf_dir):
    rows = cgroup_paths(spark, sf_dir).withColumn("node", F.expr("cgroup_id % 4"))
    return binding.bounded(rows, "node", "cgroup_id", "path", 10)


@query("SELECT DISTINCT concat('pod-', CAST(o_custkey % 100 AS VARCHAR)) AS pod_uid FROM orders WHERE concat('pod-', CAST(o_custkey % 100 AS VARCHAR)) NOT IN (SELECT concat('pod-', CAST(s_suppkey AS VARCHAR)) FROM supplier WHERE s_suppkey % 3 = 0)")
def u02_resync(spark, sf_dir):
    known = _changes(spark, sf_dir).select("pod_uid").distinct()
    return binding.resynced(known, spark.read.parquet(f"{sf_dir}/supplier.parquet").where("s_suppkey % 3 = 0").selectExpr("concat('pod-', cast(s_suppkey as string)) as pod_uid"))


# --- aggregations, loss, delivery ----------------------------------------------------------------------------------
@query(KE + "SELECT node_id, observed_at_ns // 10000000000 AS batch_id, min(observed_at_ns) AS first_ns, max(observed_at_ns) AS last_ns, count(*) AS n FROM ke GROUP BY 1, 2")
def a01_batch_windows(spark, sf_dir):
    return loss.batch_windows(kernel_events(spark, sf_dir).withColumn("batch_id", F.expr("observed_at_ns div 10000000000")), "node_id", "batch_id")


_GAPS = """SELECT {keys}, CASE WHEN min(cause) <> max(cause) THEN 'multiple' ELSE min(cause) END AS cause, array_to_string(list_sort(list(DISTINCT event_type)), ',') AS affected_types, count(*) AS dropped_records,
  count(*) FILTER (WHERE event_type IN ('kernel.tcp.close', 'kernel.tcp.retransmit')) AS dropped_reliability, count(*) FILTER (WHERE event_type NOT IN ('kernel.tcp.close', 'kernel.tcp.retransmit')) AS dropped_attribution,
  min(observed_at_ns) AS gap_start_ns, max(observed_at_ns) AS gap_end_ns FROM {t} GROUP BY {keys}"""


@query(STRONG + _GAPS.format(keys="node_id, minute", t="(SELECT *, unbound_reason AS cause, observed_at_ns // 60000000000 AS minute FROM bound WHERE unbound_reason IS NOT NULL)"))
def a03_a04_gaps(spark, sf_dir):
    dropped = _bound(spark, sf_dir).where("unbound_reason is not null").withColumn("minute", F.expr("observed_at_ns div 60000000000"))
    return loss.gaps(dropped, F.col("unbound_reason"), "node_id", "minute")


@query(STRONG + _GAPS.format(keys="node_id", t="(SELECT *, unbound_reason AS cause FROM bound WHERE unbound_reason IS NOT NULL)"))
def a04_merged_gaps(spark, sf_dir):
    return loss.merge_gaps(a03_a04_gaps(spark, sf_dir), "node_id")


@query(STRONG + "SELECT node_id, 'agent.gap' AS type, 'warning' AS severity, max(observed_at_ns) AS observed_at_ns, CAST(count(*) AS VARCHAR) AS dropped FROM bound WHERE unbound_reason IS NOT NULL GROUP BY node_id")
def a05_gap_records(spark, sf_dir):
    dropped = _bound(spark, sf_dir).where("unbound_reason is not null")
    return loss.gap_records(loss.gaps(dropped, F.col("unbound_reason"), "node_id")).select("node_id", "type", "severity", "observed_at_ns", F.col("labels")["dropped_records"].alias("dropped"))


@query(KE + """, s AS (SELECT node_id, event_type, observed_at_ns // 60000000000 AS m, count(*) * 7 % 50 AS dropped FROM ke GROUP BY 1, 2, 3),
d AS (SELECT node_id, event_type, CASE WHEN dropped < lag(dropped, 1, 0) OVER w THEN dropped ELSE dropped - lag(dropped, 1, 0) OVER w END AS delta FROM s WINDOW w AS (PARTITION BY node_id, event_type ORDER BY m)),
x AS (SELECT node_id, event_type, sum(delta)::BIGINT AS drops FROM d GROUP BY ALL)
SELECT cluster, ke.node_id, replace(substr(event_type, 8), '.', '_') AS probe_id, event_type, count(*) AS events_total, min(observed_at_ns) AS attached_since, any_value(drops) AS drops, CASE event_type WHEN 'kernel.file.open' THEN 4 ELSE 1 END AS sample_rate FROM ke JOIN x USING (node_id, event_type) GROUP BY ALL""")
def a06_q07_m01_status(spark, sf_dir):
    rates = spark.createDataFrame([("kernel.file.open", 4)], "event_type string, sample_rate int")
    samples = _samples(spark, sf_dir).withColumns({"cluster": F.lit("c1"), "event_type": F.col("probe_id")})
    return metrics.status(kernel_events(spark, sf_dir), samples, rates)


@query(KE + f"SELECT {_SOURCE} AS source, count(*) AS n FROM ke WHERE observed_at_ns >= 300000000000 GROUP BY 1")
def a07_by_source(spark, sf_dir):
    return records.normalize(kernel_events(spark, sf_dir).where("observed_at_ns >= 300000000000")).groupBy("source").agg(F.count("*").alias("n"))


@query(KE + f""", {_BACKLOG} SELECT cluster, node_id, count(*) AS batches, CAST(sum(records) AS BIGINT) AS records, CAST(sum(bytes) AS BIGINT) AS bytes, 720000 - min(enqueued_ms) AS oldest_ms, 720000 - min(enqueued_ms) > 60000 AS stalled FROM b GROUP BY 1, 2""")
def a10_st07_backlog(spark, sf_dir):
    return loss.backlog_gauges(_backlog(spark, sf_dir), 720_000)


@query(KE + f", {_BACKLOG} SELECT node_id, batch_id, class, records FROM b WHERE enqueued_ms < 720000 - 300000")
def st06_expired(spark, sf_dir):
    return loss.expired(_backlog(spark, sf_dir), 720_000).select("node_id", "batch_id", "class", "records")


@query(KE + f""", {_BACKLOG} SELECT cluster, node_id, 'retry_buffer_expired' AS cause, array_to_string(list_sort(list(DISTINCT class)), ',') AS affected_classes, sum(records)::BIGINT AS dropped_records, coalesce(sum(CASE WHEN class = 'reliability' THEN records END), 0)::BIGINT AS dropped_reliability,
  coalesce(sum(CASE WHEN class = 'attribution' THEN records END), 0)::BIGINT AS dropped_attribution, min(enqueued_ms) * 1000000 AS gap_start_ns, max(enqueued_ms) * 1000000 AS gap_end_ns FROM b WHERE enqueued_ms < 720000 - 300000 GROUP BY 1, 2""")
def st06_expired_gaps(spark, sf_dir):
    return loss.expired_gaps(_backlog(spark, sf_dir), 720_000)


@query(KE + f"SELECT node_id, {TCP_ID} AS conn_id, observed_at_ns // 1000000000 AS second, count(*) AS n FROM ke WHERE event_type = 'kernel.tcp.retransmit' GROUP BY 1, 2, 3")
def a11_coalesced(spark, sf_dir):
    return kernel_events(spark, sf_dir).where("event_type = 'kernel.tcp.retransmit'").groupBy("node_id", E.connection_id().alias("conn_id"), F.expr("observed_at_ns div 1000000000").alias("second")).agg(F.count("*").alias("n"))


@query(KE + "SELECT event_id, node_id, event_type FROM ke QUALIFY row_number() OVER (PARTITION BY node_id, event_type, observed_at_ns // 1000000000 ORDER BY observed_at_ns, event_id) > 1")
def a12_over_rate(spark, sf_dir):
    return loss.over_rate(kernel_events(spark, sf_dir), 1).select("event_id", "node_id", "event_type")


@query(KE + ", e AS (SELECT DISTINCT node_id FROM ke), t AS (SELECT unnest(['kernel.tcp.connect', 'kernel.tcp.send', 'kernel.memory.oom_kill']) AS event_type) SELECT node_id, event_type FROM e, t WHERE (node_id, event_type) NOT IN (SELECT node_id, event_type FROM ke)")
def a14_uncovered(spark, sf_dir):
    ev = kernel_events(spark, sf_dir)
    return loss.uncovered(ev.select("node_id").distinct(), ["kernel.tcp.connect", "kernel.tcp.send", "kernel.memory.oom_kill"], ev)


@query(STRONG + """, g AS (SELECT node_id, min(observed_at_ns) AS gap_start_ns, max(observed_at_ns) AS gap_end_ns FROM bound WHERE unbound_reason = 'no_cgroup' GROUP BY node_id)
SELECT event_id, node_id FROM ke JOIN g USING (node_id) WHERE observed_at_ns BETWEEN gap_start_ns AND gap_end_ns""")
def j09_during_gaps(spark, sf_dir):
    reports = loss.gaps(_bound(spark, sf_dir).where("unbound_reason = 'no_cgroup'"), "no_cgroup", "node_id").select("node_id", "gap_start_ns", "gap_end_ns")
    return loss.during_gaps(kernel_events(spark, sf_dir), reports).select("event_id", "node_id")


_SPANS = """g AS (SELECT 'c1' AS cluster, concat('node-', o_custkey % 5) AS node_id, o_orderkey AS gap, (o_orderkey * 7919 % 720000) * 1000000 AS gap_start_ns,
  CASE WHEN o_orderkey % 1000 = 7 THEN 31536000000000000 WHEN o_orderkey % 50 = 3 THEN 10000000000 WHEN o_orderkey % 3 = 0 THEN 1000000 WHEN o_orderkey % 3 = 1 THEN 100000000 ELSE 1000000000 END AS length FROM orders)"""


@query(KE + ", " + _SPANS + " SELECT event_id, count(*) AS n, min(gap) AS first_gap, max(gap_end_ns - gap_start_ns) AS longest_ns FROM ke JOIN (SELECT *, gap_start_ns + length AS gap_end_ns FROM g) g USING (cluster, node_id) WHERE observed_at_ns BETWEEN gap_start_ns AND gap_end_ns GROUP BY event_id")
def j09_gaps_of_any_length(spark, sf_dir):
    """Events in gaps from a millisecond to a year."""
    length = "case when o_orderkey % 1000 = 7 then 31536000000000000 when o_orderkey % 50 = 3 then 10000000000 when o_orderkey % 3 = 0 then 1000000 when o_orderkey % 3 = 1 then 100000000 else 1000000000 end"
    start = "(o_orderkey * 7919 % 720000) * 1000000"
    spans = spark.read.parquet(f"{sf_dir}/orders.parquet").selectExpr("'c1' as cluster", "concat('node-', o_custkey % 5) as node_id", "o_orderkey as gap", f"{start} as gap_start_ns", f"{start} + {length} as gap_end_ns")
    found = loss.during_gaps(kernel_events(spark, sf_dir), spans)
    return found.groupBy("event_id").agg(F.count("*").alias("n"), F.min("gap").alias("first_gap"), F.max(F.col("gap_end_ns") - F.col("gap_start_ns")).alias("longest_ns"))


@query(f"WITH {EVENTS_SQL}, {MORE_SQL}, u AS (SELECT * FROM ke UNION ALL SELECT * FROM me) SELECT CASE WHEN event_type NOT IN ({', '.join(repr(t) for t in loss.SUPPORTED)}) THEN 'unsupported' WHEN event_type LIKE 'kernel.file.%' THEN 'gated' ELSE 'deliver' END AS delivery_status, event_type, count(*) AS n FROM u GROUP BY 1, 2")
def k06_gate(spark, sf_dir):
    return loss.gate(kernel_events(spark, sf_dir).union(more_events(spark, sf_dir))).groupBy("delivery_status", "event_type").agg(F.count("*").alias("n"))


_ITEMS = f"""i AS (SELECT {_ID} AS id, observed_at_ns, node_id, CASE WHEN event_id % 13 = 0 THEN '' ELSE cluster END AS cluster, event_id, concat_ws(':', {_SOURCE}, node_id, CAST(event_id // 2 AS VARCHAR)) AS idempotency_key FROM ke),
s AS (SELECT *, CASE WHEN cluster = '' THEN 'REJECTED' WHEN row_number() OVER (PARTITION BY idempotency_key, cluster = '' ORDER BY observed_at_ns, id) > 1 OR event_id // 2 % 10 = 0 THEN 'DUPLICATE' ELSE 'ACCEPTED' END AS status FROM i)"""


def _items(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.concat_ws(":", "source", "node_id", F.expr("event_id div 2").cast("string"))
    rec = records.normalize(kernel_events(spark, sf_dir)).withColumns({"idempotency_key": key, "cluster": F.when(F.col("event_id") % 13 == 0, "").otherwise(F.col("cluster"))})
    return loss.deliver(rec, rec.where("event_id div 2 % 10 = 0"))


@query(KE + f", {_ITEMS} SELECT event_id, status FROM s")
def k05_deliver(spark, sf_dir):
    return _items(spark, sf_dir).select("event_id", "status")


@query(KE + f", {_ITEMS} SELECT node_id, count(*) FILTER (WHERE status <> 'REJECTED') AS accepted, count(*) FILTER (WHERE status = 'REJECTED') AS rejected, CASE WHEN count(*) FILTER (WHERE status = 'REJECTED') > 0 THEN concat('blank cluster or node: ', count(*) FILTER (WHERE status = 'REJECTED')) ELSE '' END AS reasons, false AS retryable FROM s GROUP BY 1")
def a08_delivery_results(spark, sf_dir):
    return loss.delivery_results(_items(spark, sf_dir), "node_id")


_SETTLED = """, t AS (SELECT node_id, observed_at_ns // 10000000000 AS batch, CASE WHEN event_id % 13 = 0 OR event_id % 101 = 0 THEN 'REJECTED' WHEN event_id % 4 = 0 THEN 'DUPLICATE' ELSE 'ACCEPTED' END AS status,
  CASE WHEN event_id % 13 = 0 THEN 'blank cluster' WHEN event_id % 101 = 0 THEN 'queue full' END AS reason FROM ke WHERE event_id % 5 = 0),
c AS (SELECT node_id, batch, count(*) FILTER (WHERE status <> 'REJECTED') AS accepted, count(*) FILTER (WHERE status = 'DUPLICATE') AS duplicates, count(*) FILTER (WHERE status = 'REJECTED') AS rejected,
  count(*) FILTER (WHERE reason = 'blank cluster') AS blank, count(*) FILTER (WHERE reason = 'queue full') AS full_ FROM t GROUP BY ALL)
SELECT node_id, batch, accepted, duplicates, rejected, concat_ws('; ', CASE WHEN blank > 0 THEN 'blank cluster: ' || blank END, CASE WHEN full_ > 0 THEN 'queue full: ' || full_ END) AS reasons, full_ > 0 AS retryable,
  CASE WHEN full_ > 0 THEN 'retry' WHEN rejected > 0 THEN 'partial_failure' ELSE 'delivered' END AS outcome, CASE WHEN rejected = 0 AND duplicates > 0 THEN duplicates || ' duplicate items' END AS warning FROM c"""


@query(KE + _SETTLED)
def a08_settled_batches(spark, sf_dir):
    """Batches of ten seconds of a node by a receiver's answers: some items refused for good, some for the moment."""
    ev = kernel_events(spark, sf_dir).where("event_id % 5 = 0").withColumn("batch", F.expr("observed_at_ns div 10000000000"))
    blank, full = F.col("event_id") % 13 == 0, F.col("event_id") % 101 == 0
    status = F.when(blank | full, "REJECTED").when(F.col("event_id") % 4 == 0, "DUPLICATE").otherwise("ACCEPTED")
    items = ev.withColumns({"status": status, "reason": F.when(blank, "blank cluster").when(full, "queue full"), "retryable": ~blank & full})
    return loss.settled(items, "node_id", "batch")


# --- knowledge and questions ---------------------------------------------------------------------------------------
def _questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions that the tables give: one for each command and type."""
    ev = more_events(spark, sf_dir).union(kernel_events(spark, sf_dir)).select("comm", "event_type").distinct()
    text = F.concat(F.lit("why does "), F.col("comm"), F.lit(" see so many "), F.regexp_replace(F.regexp_replace("event_type", r"^kernel\.", ""), "[._]", " "), F.lit(" events"))
    return ev.select(F.concat_ws("/", "comm", "event_type").alias("question_id"), text.alias("question"))


def _kb_sql() -> str:
    """The knowledge base as rows for DuckDB."""
    texts = lambda xs: "[" + ", ".join("'" + x.replace("'", "''") + "'" for x in xs) + "]"
    probes = [p for layer in knowledge.LAYERS for p in json.loads((Path(knowledge.__file__).parent.parent / "knowledge" / f"{layer}.json").read_text())["probes"]]
    layers = [layer for layer in knowledge.LAYERS for _ in json.loads((Path(knowledge.__file__).parent.parent / "knowledge" / f"{layer}.json").read_text())["probes"]]
    first = {x: layers.index(x) for x in set(layers)}
    at = [knowledge.LAYERS.index(x) * 1000 + 1000 + i - first[x] for i, x in enumerate(layers)]
    rows = ", ".join(f"({i}, '{x}', '{p['function']}', '{p['attachment']}', '{p['event_type']}', {texts(p['answers'])}, {texts(p['keywords'])}, {texts([p['use_when']])}, {texts([f"{x['name']}: {x['meaning']}" for x in p['fields'] if x['important']])}, {texts(p['combine_with'])})" for i, x, p in zip(at, layers, probes, strict=True))
    return f"kb AS (SELECT * FROM (VALUES {rows}) AS t(position, layer, function, attachment, event_type, answers, keywords, use_when, important_fields, combine_with))"


_ASKED = f"""WITH {EVENTS_SQL}, {MORE_SQL}, {_kb_sql()}, u AS (SELECT * FROM ke UNION ALL SELECT * FROM me),
q AS (SELECT DISTINCT concat_ws('/', comm, event_type) AS question_id, concat('why does ', comm, ' see so many ', regexp_replace(regexp_replace(event_type, '^kernel\\.', ''), '[._]', ' ', 'g'), ' events') AS question FROM u),
s AS (SELECT question_id, function, event_type, position, attachment, use_when[1] AS why, array_to_string(important_fields, '; ') AS important_fields, array_to_string(combine_with, ',') AS combine_with, CAST(10 * len(list_filter(answers, lambda a: contains(lower(question), lower(a)) OR contains(lower(a), lower(question)))) + 5 * len(list_filter(keywords, lambda k: contains(lower(question), lower(k)))) + CASE WHEN contains(lower(question), function) THEN 20 ELSE 0 END AS INT) AS score FROM q, kb),
f AS (SELECT *, CAST(row_number() OVER (PARTITION BY question_id ORDER BY score DESC, position) AS INT) AS rank FROM s WHERE score > 0) """


@query(_ASKED + "SELECT question_id, rank, function, event_type, score, attachment, why, important_fields, combine_with FROM f WHERE rank <= 5")
def q01_j06_find(spark, sf_dir):
    found = knowledge.with_reasons(knowledge.find(_questions(spark, sf_dir), knowledge.load(spark)))
    return found.withColumns({"important_fields": F.array_join("important_fields", "; "), "combine_with": F.array_join("combine_with", ",")})


_FIRST = "CASE " + " ".join(f"WHEN {p} THEN '{k}'" for k, p in _SINGLE.items()) + " END"
_TEXTS = "tell(rule_id, severity, conclusion, action) AS (VALUES " + ", ".join(f"('{k}', '{rules.BY_ID[k].severity}', '{rules.BY_ID[k].conclusion}', '{v}')".replace("node's", "node''s") for k, v in rules.ACTIONS.items()) + ")"
_SINCE = 400_000_000_000


@query(_ASKED + f""", {_TEXTS},
e AS (SELECT event_type, observed_at_ns, event_id, {_FIRST} AS rule_id FROM u WHERE observed_at_ns >= {_SINCE}),
t AS (SELECT f.question_id, e.*, row_number() OVER (PARTITION BY f.question_id ORDER BY observed_at_ns DESC, event_id DESC) AS rn FROM f JOIN e ON f.event_type = e.event_type WHERE f.rank <= 3 QUALIFY rn <= 20),
p AS (SELECT question_id, string_agg(function, ',' ORDER BY rank) AS probes_used FROM f WHERE rank <= 3 GROUP BY 1),
v AS (SELECT question_id, string_agg(CAST(event_id AS VARCHAR), ',' ORDER BY rn) AS events FROM t GROUP BY 1),
b AS (SELECT * FROM t JOIN tell USING (rule_id) QUALIFY row_number() OVER (PARTITION BY question_id ORDER BY rn) = 1)
SELECT q.question_id, CASE WHEN p.probes_used IS NULL THEN 'no probe answers this' WHEN v.events IS NULL THEN 'no event tells' WHEN b.rule_id IS NULL THEN 'no event has an interpretation' ELSE b.conclusion END AS answer,
  b.severity, b.action, b.event_id, coalesce(v.events, '') AS events, coalesce(p.probes_used, '') AS probes_used, v.events IS NULL AS kb_only
FROM q LEFT JOIN p USING (question_id) LEFT JOIN v USING (question_id) LEFT JOIN b ON b.question_id = q.question_id""")
def q05_ask(spark, sf_dir):
    ev = more_events(spark, sf_dir).union(kernel_events(spark, sf_dir))
    return knowledge.ask(_questions(spark, sf_dir), knowledge.load(spark), ev, _SINCE, 20)


@query(f"WITH {EVENTS_SQL}, {MORE_SQL}, u AS (SELECT * FROM ke UNION ALL SELECT * FROM me) SELECT event_type, rule_id, place, count(*) AS n FROM (SELECT event_type, 1 AS place, unnest([x for x in [" + ", ".join(f"CASE WHEN {p} THEN '{k}' END" for k, p in _SINGLE.items()) + "] if x IS NOT NULL]) AS rule_id FROM u) GROUP BY ALL")
def j05_all_matches(spark, sf_dir):
    """Conditions on single events exclude each other in this base, so that each match is the first."""
    return knowledge.explain_all(kernel_events(spark, sf_dir).union(more_events(spark, sf_dir))).groupBy("event_type", "rule_id", "place").agg(F.count("*").alias("n"))


_ASKED_VALUES = "asked AS (SELECT function, ret, tcp_state FROM (SELECT DISTINCT CASE event_type WHEN 'kernel.tcp.connect' THEN 'tcp_connect' WHEN 'kernel.tcp.retransmit' THEN 'tcp_retransmit_skb' ELSE 'no_such_function' END AS function, ret, tcp_state FROM ke))"


@query(KE + f""", {_kb_sql()}, {_TEXTS}, {_ASKED_VALUES},
x AS (SELECT a.*, k.event_type, k.attachment, k.answers FROM asked a LEFT JOIN kb k USING (function)),
y AS (SELECT *, {_FIRST} AS rule_id FROM x)
SELECT function, ret, tcp_state, y.rule_id, t.severity AS rule_severity, t.action, CASE WHEN event_type IS NULL THEN 'unknown function' WHEN y.rule_id IS NULL THEN concat(attachment, ' of ', event_type, ': ', array_to_string(answers, '; ')) ELSE t.conclusion END AS answer
FROM y LEFT JOIN tell t ON t.rule_id = y.rule_id""")
def q02_explain_value(spark, sf_dir):
    t = F.col("event_type")
    asked = kernel_events(spark, sf_dir).select(F.when(t == "kernel.tcp.connect", "tcp_connect").when(t == "kernel.tcp.retransmit", "tcp_retransmit_skb").otherwise("no_such_function").alias("function"), "ret", "tcp_state").distinct()
    return knowledge.explain_value(knowledge.load(spark), asked)


@query(KE + f""", {_kb_sql()} SELECT position, layer, function, attachment, k.event_type, array_to_string(answers, '; ') AS answers, count(ke.event_id) AS n FROM kb k LEFT JOIN ke ON ke.event_type = k.event_type WHERE layer IN ('tcp', 'fs') GROUP BY ALL""")
def q06_list(spark, sf_dir):
    kb = knowledge.load(spark)
    both = knowledge.listed(kb, "tcp").union(knowledge.listed(kb, "fs"))
    seen = kernel_events(spark, sf_dir).groupBy("event_type").agg(F.count("*").alias("n"))
    return both.join(seen, "event_type", "left").fillna(0, ["n"])


@query(f"WITH {EVENTS_SQL}, {MORE_SQL}, u AS (SELECT * FROM ke UNION ALL SELECT * FROM me) SELECT event_type, {_FIRST} AS rule_id, count(*) AS n FROM u GROUP BY 1, 2")
def j05_q02_explain(spark, sf_dir):
    return knowledge.explain(kernel_events(spark, sf_dir).union(more_events(spark, sf_dir))).groupBy("event_type", "rule_id").agg(F.count("*").alias("n"))


@query(f"WITH {EVENTS_SQL} SELECT event_id, {_ERRNO.replace('abs(ret)', 'abs(ret)')} AS name, ret AS back FROM ke WHERE ret IN (-111, -110, -113, -101)")
def e01_e02_errno(spark, sf_dir):
    rows = kernel_events(spark, sf_dir).where("ret in (-111, -110, -113, -101)")
    return rows.select("event_id", E.errno_name(F.col("ret")).alias("name")).withColumn("back", E.errno_number(F.col("name")))


@query(f"WITH {CGROUPS_SQL} SELECT cgroup_id, CASE WHEN path LIKE '%cri-containerd-%' THEN 'containerd' WHEN path LIKE '%crio-%' THEN 'cri-o' WHEN path LIKE '/docker/%' THEN 'docker' END AS runtime, nullif(regexp_extract(path, '([0-9a-f]{{64}})(\\.scope)?$', 1), '') AS container_id FROM cgroups")
def e08_s06_container_of_path(spark, sf_dir):
    return cgroup_paths(spark, sf_dir).withColumn("x", E.container_of_path(F.col("path"))).select("cgroup_id", F.col("x.runtime").alias("runtime"), F.col("x.id").alias("container_id"))


# --- sources -------------------------------------------------------------------------------------------------------
@query(KE + decoded_sql())
def s01_s02_decode(spark, sf_dir):
    """Captures of all six families in one table, decoded in one pass."""
    return capture.decode(captures(kernel_events(spark, sf_dir))).drop("cluster", "boot_id")


_HOOKS = (("net.connect", "sk_common_skc_daddr", 32, "u32"), ("net.connect", "sk_common_skc_rcv_saddr", 16, "u32"), ("net.connect", "sk_common_skc_num", 48, "u16"), ("net.connect", "sk_common_skc_dport", 50, "u16"), ("net.connect", "comm", 72, "u64"),
          ("net.connect", "ret", 56, "i32"), ("net.connect", "netns", 88, "u32"), ("net.connect", "ret_wide", 56, "u64"), ("exec", "uid", 16, "u32"), ("exec", "pid", 8, "u32"), ("exec", "low", 344, "u8"), ("exec", "start", 344, "i64"))


@query(KE + """SELECT event_id, CASE WHEN event_type = 'kernel.tcp.connect' THEN 'net.connect' ELSE 'exec' END AS event_type, observed_at_ns, pid, CASE WHEN event_type = 'kernel.tcp.connect' THEN tid ELSE ppid END AS tid, src_ip, dst_ip, src_port, dst_port,
  CASE WHEN event_type = 'kernel.tcp.connect' THEN ret END AS ret, CASE WHEN event_type = 'kernel.tcp.connect' THEN comm END AS comm,
  CASE WHEN event_type = 'kernel.tcp.connect' THEN concat_ws('|', concat('process:', pid), concat('netns:', 4026531840 + event_id % 3), concat('ret_wide:', CASE WHEN ret < 0 THEN 4294967296 + ret ELSE ret END))
    ELSE concat_ws('|', concat('process:', pid), concat('uid:', uid), concat('low:', start_boottime_ns % 256), concat('start:', start_boottime_ns)) END AS entities FROM ke WHERE event_type IN ('kernel.tcp.connect', 'kernel.process.exec') AND event_id % 17 <> 0 AND event_id % 5 <> 0""")
def s02_declared_layouts(spark, sf_dir):
    """Captures by layouts that are declared as rows: names tell addresses, ports, comm and ret, all else becomes entities."""
    rows = captures(kernel_events(spark, sf_dir).where("event_type in ('kernel.tcp.connect', 'kernel.process.exec') and event_id % 17 <> 0 and event_id % 5 <> 0"))
    rows = rows.withColumn("event_type", F.when(F.col("event_type") == "kernel.tcp.connect", "net.connect").otherwise("exec"))
    found = capture.to_declared(rows, capture.declared(_HOOKS, {"net.connect": 96, "exec": 352}))
    return found.select("event_id", "event_type", "observed_at_ns", "pid", "tid", "src_ip", "dst_ip", "src_port", "dst_port", "ret", "comm", F.array_join("entity_ids", "|").alias("entities"))


@query(KE + """, n AS (SELECT concat(event_id, ':', CASE WHEN event_id % 3 = 0 THEN 'x' END) AS d FROM ke)
SELECT node_id, pid, cgroup_id, split_part(comm, 'p', 2) AS tail, octet_length(encode(comm)) AS size, lower(hex(comm)) AS hex_comm, CASE WHEN dst_ip IS NOT NULL THEN concat(dst_ip, ':', dst_port) END AS endpoint, count(*) AS n FROM ke GROUP BY ALL""".replace(""", n AS (SELECT concat(event_id, ':', CASE WHEN event_id % 3 = 0 THEN 'x' END) AS d FROM ke)
""", " "))
def e05_e06_e16_text(spark, sf_dir):
    ev = kernel_events(spark, sf_dir)
    raw = F.concat(F.col("comm"), F.lit("\0junk"))
    rows = ev.select("node_id", "pid", "cgroup_id", F.split_part(E.c_string(raw), F.lit("p"), F.lit(2)).alias("tail"), F.octet_length(E.c_string(raw)).cast("long").alias("size"), E.hex_text(F.encode("comm", "utf-8")).alias("hex_comm"), E.endpoint(F.col("dst_ip"), F.col("dst_port")).alias("endpoint"))
    return rows.groupBy(*rows.columns).agg(F.count("*").alias("n"))


_STATE_CASE = "CASE s " + " ".join(f"WHEN {k} THEN '{v}'" for k, v in E.TCP_STATES.items()) + " ELSE 'UNKNOWN' END"


@query(f"SELECT s AS code, {_STATE_CASE} AS name, CASE WHEN s BETWEEN 1 AND 11 THEN CAST(s AS INT) ELSE 0 END AS back, count(*) AS n FROM (SELECT CAST(event_id % 13 AS INT) AS s FROM events) GROUP BY s")
def e03_tcp_states(spark, sf_dir):
    rows = kernel_events(spark, sf_dir).select((F.col("event_id") % 13).cast("int").alias("code"))
    return rows.groupBy("code").agg(F.count("*").alias("n")).withColumn("name", E.tcp_state_name(F.col("code"))).withColumn("back", E.tcp_state_code(F.col("name")))


@query(KE + f"SELECT node_id, {TCP_ID} AS conn_id, count(*) AS n FROM ke WHERE event_type LIKE 'kernel.tcp.%' GROUP BY 1, 2")
def e07_connection_id(spark, sf_dir):
    return kernel_events(spark, sf_dir).where("event_type like 'kernel.tcp.%'").groupBy("node_id", E.connection_id().alias("conn_id")).agg(F.count("*").alias("n"))


@query(f"WITH {PODS_SQL} SELECT pod_uid, container_id, CASE WHEN length(pod_uid) % 2 = 0 THEN 'docker' ELSE 'containerd' END AS runtime, namespace FROM pods")
def e09_s05_pod_containers(spark, sf_dir):
    rows = pods(spark, sf_dir).withColumn("uri", F.concat(F.when(F.length("pod_uid") % 2 == 0, "docker").otherwise("containerd"), F.lit("://"), F.upper("container_id")))
    flat = binding.flatten_pods(rows.select("pod_uid", "namespace", F.array("uri").alias("containers")))
    kinds = rows.select("pod_uid", E.container_of_uri(F.col("uri"))["runtime"].alias("runtime"))
    return flat.join(kinds, "pod_uid").select("pod_uid", "container_id", "runtime", "namespace")


@query("""WITH p AS (SELECT *, 'pod-' || s_suppkey AS pod_uid, 'app-' || s_suppkey AS pod_name, CASE WHEN s_suppkey % 3 = 0 THEN '' ELSE 'sa' END AS service_account, CASE WHEN s_suppkey % 2 = 0 THEN 'ReplicaSet' END AS owner_kind, CASE WHEN s_suppkey % 2 = 0 THEN 'rs-' || s_nationkey END AS owner_name, CASE WHEN s_suppkey % 2 = 0 THEN 'uid-' || s_nationkey END AS owner_uid FROM supplier WHERE s_suppkey % 11 <> 0),
c AS (SELECT *, sha256('main:' || s_suppkey) AS container_id FROM p UNION ALL SELECT *, sha256('init:' || s_suppkey) FROM p WHERE s_suppkey % 2 = 0 UNION ALL SELECT *, sha256('debug:' || s_suppkey) FROM p WHERE s_suppkey % 5 = 0)
SELECT pod_uid, 'shop' AS namespace, pod_name, service_account, owner_kind, owner_name, owner_uid, container_id FROM c""")
def s05_all_containers(spark, sf_dir):
    """Containers of all three kinds of status with what is told of their pods; pods without a name and addresses that aren't containers go."""
    uri = lambda scheme, name: f"concat('{scheme}://', upper(sha2(concat('{name}:', s_suppkey), 256)))"
    none = "cast(array() as array<string>)"
    rows = spark.read.parquet(f"{sf_dir}/supplier.parquet").selectExpr(
        "concat('pod-', s_suppkey) as pod_uid", "case when s_suppkey % 11 <> 0 then concat('app-', s_suppkey) end as pod_name", "'shop' as namespace", "case when s_suppkey % 3 = 0 then '' else 'sa' end as service_account",
        f"array({uri('containerd', 'main')}, 'containerd://short') as containers", f"case when s_suppkey % 2 = 0 then array({uri('docker', 'init')}) end as init_containers", f"case when s_suppkey % 5 = 0 then array({uri('cri-o', 'debug')}) else {none} end as ephemeral_containers",
        "array(named_struct('controller', false, 'kind', 'Other', 'name', 'x', 'uid', 'y'), named_struct('controller', s_suppkey % 2 = 0, 'kind', 'ReplicaSet', 'name', concat('rs-', s_nationkey), 'uid', concat('uid-', s_nationkey))) as owners",
    )
    return binding.flatten_pods(rows).select("pod_uid", "namespace", *binding.OF_POD, "container_id")


@query("SELECT o_orderkey AS id, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE lower(u) END AS boot, CASE WHEN o_orderkey % 2 = 0 THEN concat('owner-', o_custkey) END AS owner FROM (SELECT *, concat(substr(m, 1, 8), '-', substr(m, 9, 4), '-', substr(m, 13, 4), '-', substr(m, 17, 4), '-', substr(m, 21, 12)) AS u FROM (SELECT *, upper(md5(CAST(o_orderkey AS VARCHAR))) AS m FROM orders))")
def e10_e11_boot_and_owner(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/orders.parquet").withColumn("m", F.upper(F.md5(F.col("o_orderkey").cast("string"))))
    parts = F.concat_ws("-", *[F.substring("m", a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))])
    boot = E.boot_id(F.when(F.col("o_orderkey") % 3 == 0, F.col("m")).otherwise(parts))
    owner = lambda flag, name: F.struct(flag.alias("controller"), F.lit("ReplicaSet").alias("kind"), name.alias("name"), F.lit("u").alias("uid"))
    owners = F.array(owner(F.lit(False), F.lit("other")), owner(F.col("o_orderkey") % 2 == 0, F.concat(F.lit("owner-"), "o_custkey")))
    return rows.select(F.col("o_orderkey").alias("id"), boot.alias("boot"), E.controlling_owner(owners)["name"].alias("owner"))


@query(KE + f"SELECT event_id, {_ID} AS id, {_SOURCE.replace('concat(' + repr('kerngrain/') + ', ', '(')} AS function, strftime(make_timestamp(1704067200000000 + observed_at_ns // 1000), '%Y-%m-%dT%H:%M:%S.%fZ') AS at FROM ke")
def e15_e17_e18_identity(spark, sf_dir):
    rec = records.normalize(kernel_events(spark, sf_dir))
    at = F.timestamp_micros(F.lit(1704067200000000) + F.expr("observed_at_ns div 1000"))
    return rec.select("event_id", "id", E.function_of_source(F.col("source")).alias("function"), E.rfc3339(at).alias("at"))


@query(f"WITH {EVENTS_SQL} SELECT event_type AS type, coalesce(ret, 0) AS ret, CAST(CASE tcp_state WHEN 'ESTABLISHED' THEN 1 WHEN 'SYN_SENT' THEN 2 WHEN 'CLOSE_WAIT' THEN 8 ELSE 0 END AS INT) AS tcp_state, count(*) AS n FROM ke GROUP BY 1, 2, 3")
def e13_e14_explain_fields(spark, sf_dir):
    rows = records.tcp_codes(records.normalize(kernel_events(spark, sf_dir)))
    return rows.groupBy("type", F.coalesce("ret", F.lit(0)).alias("ret"), "tcp_state").agg(F.count("*").alias("n"))


# --- time, lineage, coverage ---------------------------------------------------------------------------------------
@query(KE + """, x AS (SELECT cluster, node_id, boot_id, event_id, pid, observed_at_ns, comm, 1000 + (event_id * 7) % 500 AS ppid FROM ke WHERE event_type = 'kernel.process.exec')
SELECT a.node_id, a.event_id, b.event_id AS parent_event, b.comm AS parent_comm FROM x a ASOF LEFT JOIN x b ON a.node_id = b.node_id AND a.boot_id = b.boot_id AND a.ppid = b.pid AND a.observed_at_ns >= b.observed_at_ns""")
def j10_parents(spark, sf_dir):
    ex = kernel_events(spark, sf_dir).where("event_type = 'kernel.process.exec'").withColumn("ppid", F.expr("1000 + (event_id * 7) % 500"))
    return lineage.parents(ex).select("node_id", "event_id", "parent_event", "parent_comm")


@query(KE + """, m AS (SELECT node_id, pid, observed_at_ns AS valid_from, cgroup_id % 3 AS place, lead(observed_at_ns) OVER (PARTITION BY node_id, pid ORDER BY observed_at_ns, event_id) AS valid_to FROM ke WHERE event_type = 'kernel.process.exec')
SELECT k.event_id, min(m.place) AS place FROM ke k JOIN m ON k.node_id = m.node_id AND k.pid = m.pid AND k.observed_at_ns >= m.valid_from AND (m.valid_to IS NULL OR k.observed_at_ns < m.valid_to) WHERE k.event_type = 'kernel.file.open' GROUP BY 1""")
def j08_placement(spark, sf_dir):
    ev = kernel_events(spark, sf_dir)
    moves = ev.where("event_type = 'kernel.process.exec'").selectExpr("node_id", "pid", "observed_at_ns as valid_from", "event_id as move_id", "cgroup_id % 3 as place")
    return lineage.placed(ev.where("event_type = 'kernel.file.open'").select("node_id", "pid", "event_id", "observed_at_ns"), moves, "node_id", "pid").select("event_id", "place")


@query(KE + """, s AS (SELECT node_id, boot_id, observed_at_ns // 150000000000 * 150000000000 AS boot_ns FROM ke GROUP BY ALL)
SELECT event_id, 1704067200000000 + s.boot_ns // 1000 + 5 + (observed_at_ns - s.boot_ns) // 1000 AS event_time_us FROM ke ASOF LEFT JOIN s ON ke.node_id = s.node_id AND ke.boot_id = s.boot_id AND ke.observed_at_ns >= s.boot_ns""")
def p15_wall_clock(spark, sf_dir):
    ev = kernel_events(spark, sf_dir)
    samples = ev.groupBy(*rules.NODE, F.expr("observed_at_ns div 150000000000 * 150000000000").alias("boot_ns")).agg(F.lit(1).alias("one")).selectExpr(*rules.NODE, "boot_ns", "1704067200000000 + boot_ns div 1000 + 5 as wall_us")
    return lineage.wall_clock(ev.select(*rules.NODE, "event_id", "observed_at_ns"), samples).select("event_id", "event_time_us")


@query(KE + "SELECT entity, min(observed_at_ns) AS first_ns, max(observed_at_ns) AS last_ns, count(*) AS n FROM (SELECT unnest([concat_ws('/', 'process', cluster, node_id, boot_id, pid), concat_ws('/', 'cgroup', cluster, node_id, cgroup_id), concat_ws('/', 'node', cluster, node_id)]) AS entity, observed_at_ns FROM ke) GROUP BY 1")
def x01_entities(spark, sf_dir):
    return lineage.entities(kernel_events(spark, sf_dir))


_LIVES_OF = """, x AS (SELECT cluster, node_id, boot_id, pid, observed_at_ns, start_boottime_ns, event_id * 7919 % 1000 AS ingested, event_id, comm FROM ke WHERE event_type = 'kernel.process.exec' UNION ALL
  SELECT cluster, node_id, boot_id, pid, observed_at_ns, start_boottime_ns, event_id * 7919 % 1000 + 5000, event_id, concat('amended ', comm) FROM ke WHERE event_type = 'kernel.process.exec' AND event_id % 3 = 0),
y AS (SELECT *, CASE WHEN start_boottime_ns > 0 THEN start_boottime_ns ELSE observed_at_ns END AS start_ns FROM x),
b AS (SELECT * FROM y QUALIFY row_number() OVER (PARTITION BY cluster, node_id, boot_id, pid, start_ns ORDER BY ingested DESC, event_id DESC) = 1),
v AS (SELECT node_id, boot_id, pid, concat_ws('/', 'process', cluster, node_id, pid, start_ns) AS entity, comm, event_id, observed_at_ns AS valid_from, lead(observed_at_ns) OVER (PARTITION BY cluster, node_id, boot_id, pid ORDER BY observed_at_ns, start_ns) AS next_from FROM b),
e AS (SELECT node_id, boot_id, 1000 + event_id % 500 AS pid, observed_at_ns AS exit_ns FROM ke WHERE event_type = 'kernel.tcp.close') """


def _execs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Executions, and of every third another row that came later and amends it."""
    ev = kernel_events(spark, sf_dir).where("event_type = 'kernel.process.exec'").withColumn("ingested", F.expr("event_id * 7919 % 1000"))
    more = ev.where("event_id % 3 = 0").withColumns({"ingested": F.col("ingested") + 5000, "comm": F.concat(F.lit("amended "), "comm")})
    return ev.unionByName(more).select("cluster", "node_id", "boot_id", "pid", "observed_at_ns", "start_boottime_ns", "ingested", "event_id", "comm")


@query(KE + _LIVES_OF + "SELECT node_id, boot_id, pid, entity, comm, valid_from, coalesce((SELECT min(exit_ns) FROM e WHERE e.node_id = v.node_id AND e.boot_id = v.boot_id AND e.pid = v.pid AND exit_ns >= valid_from AND (next_from IS NULL OR exit_ns < next_from)), next_from) AS valid_to FROM v")
def x01_process_lives(spark, sf_dir):
    """Processes of pids that are used again, with their ends."""
    exits = kernel_events(spark, sf_dir).where("event_type = 'kernel.tcp.close'").withColumn("pid", F.expr("1000 + event_id % 500"))
    return lineage.process_lives(_execs(spark, sf_dir), exits).select("node_id", "boot_id", "pid", "entity", "comm", "valid_from", "valid_to")


@query(KE + _LIVES_OF + "SELECT node_id, boot_id, pid, entity, comm, valid_from, next_from AS valid_to FROM v")
def x01_amended_lives(spark, sf_dir):
    """The same without ends, in two steps: a quarter of the rows comes late and amends what was known."""
    rows = _execs(spark, sf_dir)
    early, late = rows.where("event_id % 4 <> 0"), rows.where("event_id % 4 = 0")
    return lineage.amended(lineage.process_lives(early), late).select("node_id", "boot_id", "pid", "entity", "comm", "valid_from", "valid_to")


@query(STRONG + """, x AS (SELECT 'process_in_cgroup' AS kind, concat_ws('/', cluster, node_id, boot_id, pid) AS a, concat_ws('/', cluster, node_id, boot_id, cgroup_id) AS b, observed_at_ns FROM bound
  UNION ALL SELECT 'process_in_container', concat_ws('/', cluster, node_id, boot_id, pid), concat_ws('/', cluster, container_id), observed_at_ns FROM bound WHERE unbound_reason IS NULL UNION ALL SELECT 'container_in_pod', concat_ws('/', cluster, container_id), concat_ws('/', cluster, pod_uid), observed_at_ns FROM bound WHERE unbound_reason IS NULL
  UNION ALL SELECT 'pod_on_node', concat_ws('/', cluster, pod_uid), concat_ws('/', cluster, node_id, boot_id), observed_at_ns FROM bound WHERE unbound_reason IS NULL),
m AS (SELECT kind, a, b, observed_at_ns // 60000000000 AS minute, min(observed_at_ns) AS first_ns, max(observed_at_ns) AS last_ns, count(*) AS n FROM x GROUP BY ALL),
l AS (SELECT *, CASE WHEN coalesce(lag(b) OVER (PARTITION BY kind, a ORDER BY first_ns, b) <> b, true) THEN 1 ELSE 0 END AS new FROM m), k AS (SELECT *, sum(new) OVER (PARTITION BY kind, a ORDER BY first_ns, b) AS life FROM l),
g AS (SELECT kind, a, b, life, min(first_ns) AS valid_from, max(last_ns) AS last_ns, sum(n)::BIGINT AS n FROM k GROUP BY ALL) SELECT kind, a, b, valid_from, last_ns, n, lead(valid_from) OVER (PARTITION BY kind, a ORDER BY life) AS valid_to FROM g""")
def x02_edges(spark, sf_dir):
    return lineage.edges(_bound(spark, sf_dir))


_CONCLUSION = "CASE " + " ".join(f"WHEN {p} THEN '{rules.BY_ID[k].conclusion}'" for k, p in _SINGLE.items()) + " END"


@query(KE + f""", m AS (SELECT * FROM ke WHERE observed_at_ns >= (SELECT max(observed_at_ns) FROM ke) - 60000000000), o AS (SELECT 'one' AS asked, * FROM (SELECT * FROM m WHERE event_type = 'kernel.tcp.connect' ORDER BY observed_at_ns, event_id LIMIT 100)
  UNION ALL SELECT 'all', * FROM (SELECT * FROM m WHERE comm = 'app3' ORDER BY observed_at_ns DESC, event_id DESC LIMIT 100))
SELECT asked, {J.ID} AS id, observed_at_ns AS ts_ns, pid, comm AS cmd, {J.LABELS} AS labels, {_CONCLUSION} AS interp, count(*) OVER (PARTITION BY asked) AS total FROM o""")
def q03_get_events(spark, sf_dir):
    """The last minute: one probe's oldest events, and the newest ones of a command of all probes."""
    ev = kernel_events(spark, sf_dir)
    now = ev.agg(F.max("observed_at_ns")).scalar()
    one = records.get_events(ev, now, "kernel.tcp.connect").withColumn("asked", F.lit("one"))
    return one.unionByName(records.get_events(ev, now, comm="app3").withColumn("asked", F.lit("all"))).select("asked", "id", "ts_ns", "pid", "cmd", "labels", "interp", "total")


@query(KE + f"SELECT {_ID} AS id, observed_at_ns AS ts_ns, comm AS cmd, json_object('c', CAST(cgroup_id AS VARCHAR), 's', tcp_state) AS labels, {_CONCLUSION} AS interp FROM ke")
def p06_interpreted(spark, sf_dir):
    """Short rows with what the first rule says of them; of the labels two are compared."""
    rows = records.compact(records.normalize(kernel_events(spark, sf_dir)), interpreted=True)
    label = lambda k: F.get_json_object("labels", f"$.{k}")
    return rows.select("id", "ts_ns", "cmd", F.to_json(F.struct(label("cgroup_id").alias("c"), label("tcp_state").alias("s")), {"ignoreNullFields": "false"}).alias("labels"), "interp")


@query(KE + """, s AS (SELECT node_id, event_type AS probe_id, observed_at_ns // 60000000000 * 60000000000 AS polled_ns, count(*) * 7 % 50 AS dropped FROM ke GROUP BY 1, 2, 3),
f AS (SELECT *, CASE WHEN coalesce(polled_ns - lag(polled_ns) OVER w > 60000000000 OR dropped < lag(dropped) OVER w, true) THEN 1 ELSE 0 END AS new FROM s WINDOW w AS (PARTITION BY node_id, probe_id ORDER BY polled_ns)),
g AS (SELECT *, CAST(sum(new) OVER (PARTITION BY node_id, probe_id ORDER BY polled_ns) AS BIGINT) AS span FROM f)
SELECT node_id, probe_id, span, min(polled_ns) AS from_ns, max(polled_ns) AS to_ns, count(*) AS n FROM g GROUP BY 1, 2, 3""")
def x03_receipts(spark, sf_dir):
    return lineage.receipts(_samples(spark, sf_dir), 60_000_000_000)


# --- knowledge over the tables -------------------------------------------------------------------------------------
@query(f"""WITH {EVENTS_SQL}, {MORE_SQL}, {_kb_sql()}, u AS (SELECT event_type, count(*) AS n FROM (SELECT event_type FROM ke UNION ALL SELECT event_type FROM me) GROUP BY 1),
o AS (SELECT function, unnest(combine_with) AS other FROM kb), d AS (SELECT function, count(*) AS n_dangling FROM o WHERE other NOT IN (SELECT function FROM kb) GROUP BY 1)
SELECT layer, kb.function, kb.event_type, coalesce(n, 0) AS n, coalesce(n_dangling, 0) AS n_dangling FROM kb LEFT JOIN u ON u.event_type = kb.event_type LEFT JOIN d ON d.function = kb.function""")
def j07_a13_s07_knowledge_against_events(spark, sf_dir):
    """Probes of the base with what the tables have of their types, and whether they name only known others."""
    kb = knowledge.load(spark)
    seen = more_events(spark, sf_dir).union(kernel_events(spark, sf_dir)).groupBy("event_type").agg(F.count("*").alias("n"))
    bad = knowledge.dangling(kb).groupBy("function").agg(F.count("*").alias("n_dangling"))
    return kb.join(seen, "event_type", "left").join(bad, "function", "left").select("layer", "function", "event_type", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("n_dangling", F.lit(0)).alias("n_dangling"))


@query(KE + "SELECT event_id, observed_at_ns FROM ke WHERE event_type = 'kernel.tcp.retransmit' AND observed_at_ns BETWEEN 60000000000 AND 120000000000")
def q08_watch(spark, sf_dir):
    ev = select.event_filter(kernel_events(spark, sf_dir), event_type="kernel.tcp.retransmit")
    return ev.where("observed_at_ns between 60000000000 and 120000000000").select("event_id", "observed_at_ns")


# --- metrics, sinks, user-defined probes ---------------------------------------------------------------------------
_DROPS = """s AS (SELECT node_id, event_type AS probe_id, observed_at_ns // 60000000000 AS m, count(*) * 7 % 50 AS dropped FROM ke GROUP BY 1, 2, 3),
d AS (SELECT probe_id, CASE WHEN dropped < lag(dropped, 1, 0) OVER w THEN dropped ELSE dropped - lag(dropped, 1, 0) OVER w END AS delta FROM s WINDOW w AS (PARTITION BY node_id, probe_id ORDER BY m))"""
_M = {
    "events": "SELECT event_type AS label, count(*) AS value FROM ke GROUP BY 1",
    "drops": "SELECT probe_id AS label, CAST(sum(delta) AS BIGINT) AS value FROM d GROUP BY 1",
    "delivery_errors": f"SELECT {_SOURCE} AS label, count(*) FILTER (WHERE event_id % 13 = 0) AS value FROM ke GROUP BY 1",
    "parse_errors": "SELECT event_type AS label, count(*) FILTER (WHERE event_id % 17 = 0 OR event_type = 'kernel.tcp.close' AND event_id % 23 = 0) AS value FROM ke WHERE event_type IN ('kernel.tcp.connect', 'kernel.tcp.close') GROUP BY 1",
}


def _decoded(spark: SparkSession, sf_dir: str, *kinds: str) -> DataFrame:
    """Captures of these types decoded."""
    return capture.decode(captures(kernel_events(spark, sf_dir)).where(F.col("event_type").isin(*kinds)))


@query(KE + f", {_DROPS} " + _M["drops"])
def m02_ring_drops(spark, sf_dir):
    return metrics.drops_per_probe(_samples(spark, sf_dir))


@query(KE + _M["delivery_errors"])
def m03_delivery_errors(spark, sf_dir):
    return metrics.delivery_errors(_items(spark, sf_dir))


def _parse_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.parse_errors(_decoded(spark, sf_dir, "kernel.tcp.connect", "kernel.tcp.close"))


@query(KE + _M["parse_errors"])
def m04_parse_errors(spark, sf_dir):
    return _parse_errors(spark, sf_dir)


@query(KE + f", {_DROPS} " + " UNION ALL ".join(f"SELECT '{k}' AS metric, label, value FROM ({v})" for k, v in _M.items()))
def k07_metrics(spark, sf_dir):
    tables = {"events": metrics.events_per_probe(kernel_events(spark, sf_dir)), "drops": metrics.drops_per_probe(_samples(spark, sf_dir)), "delivery_errors": metrics.delivery_errors(_items(spark, sf_dir)), "parse_errors": _parse_errors(spark, sf_dir)}
    return metrics.exported(**tables)


_DECODED = {
    "kernel.tcp.close": ["observed_at_ns", "pid", "tid", "cgroup_id", "comm", "src_ip", "src_port", "dst_ip", "dst_port", "bytes_sent", "bytes_received", "duration_ns", "netns"],
    "kernel.tcp.retransmit": ["observed_at_ns", "pid", "tid", "cgroup_id", "comm", "src_ip", "src_port", "dst_ip", "dst_port", "state", "netns"],
    "kernel.process.exec": ["observed_at_ns", "pid", "tid", "cgroup_id", "comm", "ppid", "uid", "gid", "ret", "filename", "argv_hash", "start_boottime_ns"],
    "kernel.file.open": ["observed_at_ns", "pid", "cgroup_id", "comm", "flags", "uid", "ret", "path", "path_truncated"],
    "kernel.file.open_attempt": ["observed_at_ns", "pid", "cgroup_id", "comm", "flags", "uid", "ret", "path", "path_truncated"],
}
for _kind, _columns in _DECODED.items():
    query(KE + f"SELECT * FROM ({decoded_sql(_columns)}) WHERE event_type = '{_kind}'", "s01_" + _kind.split(".", 1)[1].replace(".", "_"))(
        lambda spark, sf_dir, kind=_kind, columns=tuple(_columns): _decoded(spark, sf_dir, kind).select("event_id", "node_id", "event_type", *columns, "decode_error")
    )


@query(STRONG + "SELECT node_id, count(*) FILTER (WHERE unbound_reason IS NULL) AS accepted, count(*) FILTER (WHERE unbound_reason IS NOT NULL) AS rejected, CASE WHEN count(*) FILTER (WHERE unbound_reason IS NOT NULL) = 0 THEN 'ok' WHEN count(*) FILTER (WHERE unbound_reason IS NULL) = 0 THEN 'failure' ELSE 'partial_failure' END AS status FROM bound GROUP BY 1")
def k04_append_result(spark, sf_dir):
    return loss.append_result(_bound(spark, sf_dir), "node_id")


@query(KE + f"SELECT event_id, {J.LINE} AS line FROM ke")
def k01_lines(spark, sf_dir):
    """Whole lines, character by character."""
    return records.lines(records.with_metadata(records.normalize(kernel_events(spark, sf_dir))))


_FILTERS = (("kernel.tcp.connect", 443, None, None, None), ("kernel.tcp.connect", None, "10.42.0.3", None, None), ("kernel.file.open", None, None, None, "app1"))


@query(KE + "SELECT event_id FROM ke WHERE CASE event_type WHEN 'kernel.tcp.connect' THEN dst_port = 443 OR src_ip = '10.42.0.3' WHEN 'kernel.file.open' THEN comm = 'app1' ELSE true END")
def f09_probe_filters(spark, sf_dir):
    filters = spark.createDataFrame(_FILTERS, "event_type string, dst_port int, src_ip string, pid long, comm string")
    return select.probe_filters(kernel_events(spark, sf_dir), filters).select("event_id")


@query(KE + f"""SELECT event_id, node_id, event_type AS type, 'kerngrain/close' AS source, CAST(NULL AS VARCHAR) AS outcome, 'info' AS severity, concat('process:', pid) AS entities, concat(src_ip, ':', src_port, '->', dst_ip, ':', dst_port) AS key, comm AS command
  FROM ({decoded_sql(["pid", "src_ip", "src_port", "dst_ip", "dst_port", "comm"])}) WHERE event_type = 'kernel.tcp.close' AND decode_error IS NULL""")
def ud01_probe(spark, sf_dir):
    raw = captures(kernel_events(spark, sf_dir).where("event_type = 'kernel.tcp.close'")).select("event_id", "node_id", "raw")
    layout, size = capture.LAYOUTS["kernel.tcp.close"]
    found = probes.Probe("kernel.tcp.close", layout, size).records(raw)
    return found.select("event_id", "node_id", "type", "source", "outcome", "severity", F.array_join("entity_ids", "|").alias("entities"), F.get("correlation_keys", 0).alias("key"), F.col("process_data.command").alias("command"))


@query(KE + f""", {_kb_sql()}, d AS (SELECT DISTINCT k.function, CASE WHEN length(k.function) % 2 = 0 THEN 'fentry' ELSE 'fexit' END AS attachment, ke.event_type FROM ke JOIN kb k ON k.event_type = ke.event_type
  UNION ALL SELECT DISTINCT concat('no_', comm), 'fexit', event_type FROM ke)
SELECT d.function, d.event_type, concat_ws('; ', CASE WHEN k.function IS NULL THEN 'unknown function' END, CASE WHEN d.attachment <> k.attachment THEN concat('attaches by ', k.attachment) END, CASE WHEN d.event_type <> k.event_type THEN concat('gives ', k.event_type) END,
  CASE WHEN count(*) OVER (PARTITION BY d.function) > 1 THEN 'defined more than once' END) AS problems FROM d LEFT JOIN kb k ON k.function = d.function""")
def ud04_definitions(spark, sf_dir):
    kb = knowledge.load(spark)
    ev = kernel_events(spark, sf_dir).select("event_type", "comm").distinct()
    own = ev.join(kb.select("function", "event_type"), "event_type").select("function", F.when(F.length("function") % 2 == 0, "fentry").otherwise("fexit").alias("attachment"), "event_type").distinct()
    other = ev.select(F.concat(F.lit("no_"), "comm").alias("function"), F.lit("fexit").alias("attachment"), "event_type")
    more = {"sample_rate": F.lit(1), "dst_port": F.lit(None).cast("int"), "src_ip": F.lit(None).cast("string"), "pid": F.lit(None).cast("long"), "comm": F.lit(None).cast("string")}
    return probes.checked(own.union(other).withColumns(more), kb).select("function", "event_type", F.array_join("problems", "; ").alias("problems"))


@query(KE + f"SELECT node_id, count(*) AS dropped FROM (SELECT node_id FROM ke QUALIFY row_number() OVER (PARTITION BY node_id, event_type, observed_at_ns // 1000000000 ORDER BY observed_at_ns, event_id) > 1) GROUP BY 1")
def a12_rate_gap(spark, sf_dir):
    lost = loss.with_gap(loss.over_rate(kernel_events(spark, sf_dir), 1), "rate_limit")
    return lost.where("cause = 'rate_limit'").select("node_id", F.col("labels")["dropped_records"].cast("long").alias("dropped"))


@query(KE + "SELECT event_id, node_id, pid FROM ke WHERE comm <> 'app3' OR event_type <> 'kernel.tcp.retransmit'")
def x04_without_noise(spark, sf_dir):
    ev = kernel_events(spark, sf_dir)
    noise = ev.where("comm = 'app3' and event_type = 'kernel.tcp.retransmit'").select("comm", "event_type").distinct()
    return select.without(ev, noise, "comm", "event_type").select("event_id", "node_id", "pid")


_PARTS = """b AS (SELECT concat('layer', p_partkey % 5) AS layer, concat('f', CASE WHEN p_partkey % 50 = 0 THEN p_partkey - 1 ELSE p_partkey END) AS function, concat('kernel.t', CASE WHEN p_partkey % 60 = 0 THEN p_partkey - 7 ELSE p_partkey END) AS event_type, CASE WHEN p_partkey % 13 = 0 THEN 'kprobe' ELSE 'fexit' END AS attachment,
  p_partkey % 7 = 0 AS no_answers, p_partkey % 11 = 0 AS loud, p_partkey % 19 = 0 AS odd, CASE WHEN p_partkey % 17 = 0 THEN ' ' ELSE 'when' END AS use_when, concat('f', CASE WHEN p_partkey % 23 = 0 THEN -p_partkey ELSE 1 END) AS other FROM part)"""


def _base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A large base of probes, a row for each part, with faults planted by number."""
    k = "p_partkey"
    text = lambda x: f"cast({x} as string)"
    return spark.read.parquet(f"{sf_dir}/part.parquet").selectExpr(
        f"concat('layer', {text(k + ' % 5')}) as layer", f"concat('f', {text(f'case when {k} % 50 = 0 then {k} - 1 else {k} end')}) as function", f"concat('kernel.t', {text(f'case when {k} % 60 = 0 then {k} - 7 else {k} end')}) as event_type",
        f"case when {k} % 13 = 0 then 'kprobe' else 'fexit' end as attachment", f"case when {k} % 7 = 0 then cast(array() as array<string>) else array('a') end as answers", f"array(case when {k} % 11 = 0 then 'Loud' else 'quiet' end) as keywords",
        f"array(case when {k} % 19 = 0 then 'fatal' else 'info' end) as severities", f"case when {k} % 17 = 0 then ' ' else 'when' end as use_when", "array('pid') as fields", f"array(concat('f', {text(f'case when {k} % 23 = 0 then -{k} else 1 end')})) as combine_with",
    )


_BROKEN = """x AS (SELECT *, count(*) OVER (PARTITION BY function) AS nf, count(*) OVER (PARTITION BY event_type) AS nt FROM b),
v AS (SELECT layer, function, unnest(list_filter([CASE WHEN trim(use_when) = '' THEN 'no use_when' END, CASE WHEN no_answers THEN 'no answers' END, CASE WHEN loud THEN 'a keyword is not in lower case' END, CASE WHEN attachment = 'kprobe' THEN 'attaches in no known way' END, CASE WHEN odd THEN 'a severity is unknown' END,
  CASE WHEN nf > 1 THEN 'its function is there more than once' END, CASE WHEN nt > 1 THEN 'its event type is there more than once' END], lambda p: p IS NOT NULL)) AS problem FROM x
  UNION ALL SELECT c.layer, c.function, concat('goes together with nothing: ', b.other) FROM b JOIN b c ON c.function = b.function WHERE b.other NOT IN (SELECT function FROM b))"""


@query(f"WITH {_PARTS}, {_BROKEN} SELECT layer, function, problem, count(*) AS n FROM v GROUP BY ALL")
def a13_j07_violations(spark, sf_dir):
    """What is wrong with a base in which faults were planted."""
    return knowledge.violations(_base(spark, sf_dir)).groupBy("layer", "function", "problem").agg(F.count("*").alias("n"))


@query(f"WITH {_PARTS}, {_BROKEN}, s AS (SELECT layer, count(DISTINCT function) AS n_broken, count(*) AS n_violations FROM v GROUP BY 1) SELECT layer, count(*) AS n_probes, count(DISTINCT function) AS n_functions, coalesce(any_value(n_broken), 0) AS n_broken, coalesce(any_value(n_violations), 0) AS n_violations FROM b LEFT JOIN s USING (layer) GROUP BY layer")
def a13_base_statistics(spark, sf_dir):
    return knowledge.statistics(_base(spark, sf_dir))
