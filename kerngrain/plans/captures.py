"""Events as the bytes that the kernel side writes, for queries and tests: structures field by field with their padding, apart from
the layouts by which they are decoded."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import tcp_state_code

def _le(number: Column, n: int) -> Column:
    """The n lowest bytes as hexadecimal text, the lowest first; null counts as 0."""
    digits = F.lpad(F.hex(F.coalesce(number.cast("long"), F.lit(0))), 16, "0")
    return F.regexp_replace(F.reverse(F.substring(digits, 17 - 2 * n, 2 * n)), "(.)(.)", "$2$1")


def _be2(number: Column) -> Column:
    return F.lpad(F.hex(number.cast("long")), 4, "0")


def _pad(n: int) -> Column:
    return F.lit("00" * n)


def _text(value: Column, n: int) -> Column:
    return F.rpad(F.hex(F.encode(value, "utf-8")), 2 * n, "0")


def _address(ip: Column, six: Column) -> Column:
    """Four bytes and twelve zeros, or as the end of an address of sixteen that begins with fd00."""
    four = F.array_join(F.transform(F.split(ip, r"\."), lambda x: F.lpad(F.hex(x.cast("long")), 2, "0")), "")
    return F.when(six, F.concat(F.lit("fd00" + "00" * 10), four)).otherwise(F.concat(four, F.lit("00" * 12)))


def captures(events: DataFrame) -> DataFrame:
    """Events of schemas.EVENTS as a mixed table (event_id, cluster, node_id, boot_id, event_type, raw).

    Every fifth address is IPv6. Every seventeenth row is cut short, every nineteenth has more than its structure, and of closes every 23rd
    claims more bytes sent than a long holds. Denied opens of odd ids are attempts.
    """
    c = F.col
    six = c("event_id") % 5 == 0
    head = [_le(c("observed_at_ns"), 8), _le(c("pid"), 4)]
    socket = [*head, _le(c("tid"), 4), _address(c("src_ip"), six), _address(c("dst_ip"), six), _le(c("src_port"), 2), _be2(c("dst_port")), _le(F.when(six, 10).otherwise(2), 2)]
    end = [_le(c("cgroup_id"), 8), _text(c("comm"), 16)]
    net = [_le(4026531840 + c("event_id") % 3, 4), _pad(4)]
    sent = F.when(c("event_id") % 23 == 0, -1).otherwise(c("bytes_sent"))
    path = F.when(c("path_truncated"), F.rpad("path", 256, "x")).otherwise(c("path"))
    of = {
        "kernel.tcp.connect": [*socket, _pad(2), _le(c("ret"), 4), _pad(4), *end, *net],
        "kernel.tcp.close": [*socket, _pad(2), _le(sent, 8), _le(c("bytes_received"), 8), _le(c("duration_ns"), 8), *end, *net],
        "kernel.tcp.retransmit": [*socket, _le(tcp_state_code(c("tcp_state")), 1), _pad(1), _pad(4), _pad(4), *end, *net],
        "kernel.process.exec": [*head, _le(c("ppid"), 4), _le(c("uid"), 4), _le(c("gid"), 4), end[0], _le(c("ret"), 4), _le(c("tid"), 4), end[1], _text(c("filename"), 256), c("argv_hash"), _le(c("start_boottime_ns"), 8)],
        "kernel.file.open": [*head, _le(c("uid"), 4), end[0], _le(c("ret"), 4), _le(c("flags"), 4), end[1], _text(path, 256)],
    }
    digits = F.coalesce(*[F.when(c("event_type") == t, F.concat(*parts)) for t, parts in of.items()])
    raw = F.unhex("digits")
    raw = F.when(c("event_id") % 17 == 0, F.substring(raw, 1, 40)).when(c("event_id") % 19 == 0, F.concat(raw, F.encode(F.lit("more"), "utf-8"))).otherwise(raw)
    kind = F.when((c("event_type") == "kernel.file.open") & (c("ret") < 0) & (c("event_id") % 2 == 1), "kernel.file.open_attempt").otherwise(c("event_type"))
    return events.withColumn("digits", digits).select("event_id", "cluster", "node_id", "boot_id", kind.alias("event_type"), raw.alias("raw"))


_GOOD = "event_id % 17 <> 0 AND NOT (event_type = 'kernel.tcp.close' AND event_id % 23 = 0)"
_NET, _EXEC, _FILE = "event_type LIKE 'kernel.tcp.%'", "event_type = 'kernel.process.exec'", "event_type = 'kernel.file.open'"


def _six(column: str) -> str:
    """The canonical text of the address that _address makes of 10.42.a.b."""
    part = lambda i: f"CAST(split_part({column}, '.', {i}) AS INT)"
    return f"CASE WHEN event_id % 5 = 0 AND {column} IS NOT NULL THEN concat('fd00::a2a:', lower(to_hex({part(3)} * 256 + {part(4)}))) ELSE {column} END"


#: What decoding must give, in DuckDB's words over ke.
DECODED_SQL = {
    "observed_at_ns": "observed_at_ns", "pid": "pid", "tid": f"CASE WHEN NOT ({_FILE}) THEN tid END", "src_ip": _six("src_ip"), "dst_ip": _six("dst_ip"), "src_port": "src_port", "dst_port": "dst_port",
    "family": f"CAST(CASE WHEN {_NET} THEN (CASE WHEN event_id % 5 = 0 THEN 10 ELSE 2 END) END AS INT)", "ret": "ret", "cgroup_id": "cgroup_id", "comm": "comm", "netns": f"CASE WHEN {_NET} THEN 4026531840 + event_id % 3 END",
    "bytes_sent": "bytes_sent", "bytes_received": "bytes_received", "duration_ns": "duration_ns",
    "state": "CAST(CASE tcp_state WHEN 'ESTABLISHED' THEN 1 WHEN 'SYN_SENT' THEN 2 WHEN 'CLOSE_WAIT' THEN 8 END AS INT)",
    "ppid": "ppid", "uid": "uid", "gid": "gid", "filename": "filename", "argv_hash": "argv_hash", "start_boottime_ns": "start_boottime_ns", "flags": "flags", "path": "CASE WHEN path_truncated THEN rpad(path, 256, 'x') ELSE path END", "path_truncated": "path_truncated",
}
ERROR_SQL = "CASE WHEN event_id % 17 = 0 THEN 'too short' WHEN event_type = 'kernel.tcp.close' AND event_id % 23 = 0 THEN 'out of range' END"
KIND_SQL = f"CASE WHEN {_FILE} AND ret < 0 AND event_id % 2 = 1 THEN 'kernel.file.open_attempt' ELSE event_type END"


def decoded_sql(columns: list[str] | None = None) -> str:
    """A SELECT of decoded captures: event_id, node_id, event_type, the columns and decode_error."""
    cells = ", ".join(f"CASE WHEN {_GOOD} THEN {DECODED_SQL[c]} END AS {c}" for c in columns or DECODED_SQL)
    return f"SELECT event_id, node_id, {KIND_SQL} AS event_type, {cells}, {ERROR_SQL} AS decode_error FROM ke"
