"""Records as JSON in DuckDB's SQL, field by field over events, for queries that compare records whole."""

from __future__ import annotations

from ..functions import columns as E
from ..operators.records import CAUSES, SOURCES

TCP = "event_type LIKE 'kernel.tcp.%'"
CONNECT, CLOSE, LOST, EXEC, OPEN = (f"event_type = '{t}'" for t in ("kernel.tcp.connect", "kernel.tcp.close", "kernel.tcp.retransmit", "kernel.process.exec", "kernel.file.open"))
#: Of the adapter's events executions never fail.
FAILED = f"({LOST} OR ret <> 0 AND ({CONNECT} OR {OPEN}))"
NAME = "CASE event_type " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in SOURCES.items()) + " END"
CONNECTION = "src_ip || ':' || src_port || '->' || dst_ip || ':' || dst_port"
PROCESS = "'process:' || pid"
ERRNO = "CASE abs(ret) " + " ".join(f"WHEN {k} THEN '{v}'" for k, v in E.ERRNO.items()) + " ELSE 'E' || abs(ret) END"
ID = "concat(lpad(CAST(observed_at_ns // 1000000 AS VARCHAR), 15, '0'), '-', substr(sha256(concat_ws('~', node_id, event_type, CAST(event_id AS VARCHAR))), 1, 16))"
SOURCE = f"'kerngrain/' || {NAME}"
SEVERITY = f"CASE WHEN {FAILED} THEN 'warning' ELSE 'info' END"
OUTCOME = f"CASE WHEN {FAILED} THEN 'failure' ELSE 'success' END"
KEY = f"CASE WHEN {TCP} THEN {CONNECTION} ELSE {PROCESS} END"
DURATION = f"CASE WHEN {CLOSE} AND duration_ns > 0 THEN duration_ns // 1000 END"


def when(condition: str, value: str) -> str:
    return f"CASE WHEN {condition} THEN {value} END"


def text(value: str) -> str:
    return f"'\"' || ({value}) || '\"'"


def array(*values: str) -> str:
    return f"'[' || concat_ws(',', {', '.join(values)}) || ']'"


def an_object(fields: dict[str, str]) -> str:
    """An object of the fields that aren't null."""
    parts = ", ".join(f"'\"{k}\":' || ({v})" for k, v in fields.items())
    return f"'{{' || concat_ws(',', {parts}) || '}}'"


def _texts(pairs: dict[str, str]) -> dict[str, str]:
    return {k: text(v) for k, v in pairs.items()}


_OWN = {
    "cgroup_id": "cgroup_id", "errno_num": when(f"ret <> 0 AND ({CONNECT} OR {OPEN})", "ret"), "errno": when(f"ret <> 0 AND {OPEN}", ERRNO), "tcp_state": when(LOST, "tcp_state"),
    "result": when(OPEN, "CASE WHEN ret <> 0 THEN 'denied' ELSE 'allowed' END"), "coverage": when(OPEN, "'lsm_gated'"), "flags": when(OPEN, "flags"),
    "resource_ref_kind": f"CASE WHEN {OPEN} THEN 'file' WHEN {EXEC} THEN 'executable' END", "resource_ref_id": f"CASE WHEN {OPEN} THEN path WHEN {EXEC} THEN filename END",
    "path_truncated": when(f"{OPEN} AND path_truncated", "'true'"), "gid": when(EXEC, "gid"), "host_tgid": when(EXEC, "pid"), "host_tid": when(EXEC, "tid"),
    "leader_start_boottime_ns": when(f"{EXEC} AND start_boottime_ns <> 0", "start_boottime_ns"), "runtime_identity_method": when(f"{EXEC} AND start_boottime_ns <> 0", "identity_method"), "argv_hash": when(EXEC, "'sha256:' || argv_hash"),
}
#: What P1 adds.
METADATA = {
    "producer": "'kerngrain'", "producer_version": "'0.1'", "cluster_id": "cluster", "node_id": "node_id", "kernel_release": "'6.8.0'", "probe_id": NAME, "probe_version": "'1'", "probe_family": f"split_part({NAME}, '_', 1)",
    "hook_kind": f"CASE WHEN {LOST} OR {EXEC} THEN 'fentry' ELSE 'fexit' END", "kernel_function": NAME, "observed_at_ns": "observed_at_ns", "schema_version": "'1'",
}
LABELS = an_object(_texts(_OWN))
NETWORK = when(TCP, an_object({"src_ip": text("src_ip"), "src_port": "src_port", "dst_ip": text("dst_ip"), "dst_port": "dst_port", "protocol": "'\"tcp\"'", "direction": "'\"egress\"'", "bytes_sent": "bytes_sent", "bytes_received": "bytes_received"}))
PROCESS_DATA = an_object({"pid": "pid", "ppid": "nullif(ppid, 0)", "command": text("comm"), "executable": when(EXEC, text("filename")), "uid": when(f"NOT {TCP}", "uid")})
ERROR = when(f"{CONNECT} AND ret <> 0", an_object({"code": text(ERRNO), "message": text("'TCP connect by ' || comm || ' to ' || dst_ip || ':' || dst_port"), "possible_causes": array(*[text(f"'{x}'") for x in CAUSES])}))
ENTITIES = array(text(PROCESS), when(TCP, text(f"'connection:' || {CONNECTION}")), when(EXEC, text("'executable:' || filename")), when(OPEN, text("'file:' || path")))
_TOLD = {"id": text(ID), "source": text(SOURCE), "type": text("event_type"), "severity": text(SEVERITY), "outcome": text(OUTCOME), "correlation_keys": array(text(KEY))}
#: What P13 measures.
SHORT = an_object({**_TOLD, "entity_ids": ENTITIES, "labels": LABELS, "network_data": NETWORK, "process_data": PROCESS_DATA})
#: A line of K1 with the labels of P1.
LINE = an_object({
    "node_id": text("node_id"), "cluster": text("cluster"), "observed_at_ns": "observed_at_ns", "pid": "pid", "cgroup_id": "cgroup_id", "ret": "ret", **_TOLD, "error": ERROR, "entity_ids": ENTITIES, "duration_us": DURATION,
    "enrichment_state": text("'raw'"), "labels": an_object(_texts({**_OWN, **METADATA})), "network_data": NETWORK, "process_data": PROCESS_DATA,
})
