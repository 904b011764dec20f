"""The driver's tables as kernel events and as inventories of cgroups and pods.

Time is compressed 3600 times, so that rules over seconds have hits. Every column is an expression over one row:
no shuffle, and filters and column pruning reach the scan.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_TYPE = "case event_type when 'click' then 'kernel.tcp.connect' when 'view' then 'kernel.tcp.close' when 'error' then 'kernel.tcp.retransmit' when 'signup' then 'kernel.process.exec' when 'purchase' then 'kernel.file.open' end"
#: How many times faster than in the table time goes, and for rules that need many events in a window.
SPEED, FAST = 3600, 36000
#: Families that the five types don't cover, by event_id modulo their number.
MORE_TYPES = ("kernel.tcp.send", "kernel.tcp.accept", "kernel.tcp.recv", "kernel.tcp.syn_recv", "kernel.tcp.reset", "kernel.memory.oom_kill", "kernel.memory.page_alloc", "kernel.memory.cgroup_charge", "kernel.fs.write", "kernel.fs.read", "kernel.fs.close", "kernel.process.exit", "kernel.process.clone", "kernel.sched.switch", "kernel.sched.wakeup")

#: Columns over k, ns, t (the type) and the columns of events; the same text in Spark and in DuckDB.
COLUMNS = {
    "event_id": "event_id",
    "cluster": "'c1'",
    "node_id": "concat('node-', cast(user_id % 5 as {text}))",
    "boot_id": "case when ns < 360000000000 then 'boot-1' else 'boot-2' end",
    "observed_at_ns": "ns",
    "event_type": "t",
    "pid": "1000 + user_id",
    "cgroup_id": "case when user_id % 25 = 0 then 0 else 90000 + user_id end",
    "comm": "concat('app', cast(user_id % 10 as {text}))",
    "src_ip": "case when t like 'kernel.tcp.%' then concat('10.42.0.', cast(user_id % 200 + 1 as {text})) end",
    "src_port": "cast(case when t like 'kernel.tcp.%' then 40000 + user_id % 3 end as int)",
    "dst_ip": "case when t like 'kernel.tcp.%' then concat('10.42.1.', cast(user_id % 7 + 1 as {text})) end",
    "dst_port": "cast(case when t like 'kernel.tcp.%' then (case user_id % 4 when 0 then 5432 when 1 then 6379 when 2 then 8080 else 443 end) end as int)",
    "ret": """cast(case when t = 'kernel.tcp.connect' then (case cast(floor(value) as bigint) % 10 when 0 then -111 when 1 then -110 when 2 then -113 when 3 then -101 else 0 end)
      when t = 'kernel.process.exec' then 0 when t = 'kernel.file.open' then (case when k % 5 = 0 then -13 else 0 end)
      when t in ('kernel.tcp.send', 'kernel.fs.write', 'kernel.fs.read') then (case when k % 11 = 0 then -5 else cast(floor(value * 10) as bigint) end)
      when t = 'kernel.tcp.accept' then (case when k % 3 = 0 then -11 else 0 end) when t = 'kernel.tcp.recv' then (case when k % 4 = 0 then 0 else k end)
      when t in ('kernel.tcp.syn_recv', 'kernel.memory.page_alloc') then k % 4 when t = 'kernel.memory.cgroup_charge' then (case when k % 2 = 0 then -12 else 0 end)
      when t = 'kernel.process.exit' then (case k % 4 when 0 then 137 when 1 then 1 else 0 end) when t = 'kernel.process.clone' then (case when k % 5 = 0 then -11 else 1 end) end as int)""",
    "tcp_state": "case when t = 'kernel.tcp.retransmit' then (case when k % 13 = 0 then 'CLOSE_WAIT' when k % 4 = 0 then 'SYN_SENT' else 'ESTABLISHED' end) end",
    "bytes_sent": "case when t = 'kernel.tcp.close' then cast(floor(value * 100) as bigint) end",
    "bytes_received": "case when t = 'kernel.tcp.close' then cast(k * 10 as bigint) end",
    "duration_ns": "case when t = 'kernel.tcp.close' then cast(k as bigint) * 1000 end",
    "filename": "case when t = 'kernel.process.exec' then (case k % 3 when 0 then '/bin/sh' when 1 then '/usr/bin/curl' else '/app/server' end) end",
    "path": "case when t = 'kernel.file.open' then (case k % 6 when 0 then '/etc/shadow' when 1 then concat('/home/u', cast(user_id as {text}), '/.ssh/id_rsa') when 2 then '/var/run/secrets/token' when 3 then '/tmp/x' when 4 then '/proc/1/environ' else '/etc/kubernetes/admin.conf' end) end",
    "uid": "cast(case when t in ('kernel.process.exec', 'kernel.file.open') then 1000 end as bigint)",
    "ppid": "case when t = 'kernel.process.exec' then user_id % 2 end",
    "flags": "cast(case when t = 'kernel.file.open' then k % 4 end as bigint)",
    "tid": "1000 + user_id + k % 3",
    "gid": "cast(case when t = 'kernel.process.exec' then 100 + k % 3 end as bigint)",
    "start_boottime_ns": "case when t = 'kernel.process.exec' then (case when k % 9 = 0 then 0 else ns // 7 + user_id end) end",
    "identity_method": "case when t = 'kernel.process.exec' and k % 9 <> 0 then 'task_start_boottime_btf_v1' end",
    "argv_hash": "case when t = 'kernel.process.exec' then {sha} end",
    "path_truncated": "case when t = 'kernel.file.open' then k % 6 = 0 and k % 7 = 0 end",
}


def _columns(text: str) -> list[str]:
    sha = "sha2(cast(event_id as string), 256)" if text == "string" else "sha256(cast(event_id as varchar))"
    return [f"{x.format(text=text, sha=sha)} as {c}".replace("//", "div" if text == "string" else "//") for c, x in COLUMNS.items()]


def _events(spark: SparkSession, sf_dir: str, kind: str, speed: int) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/events.parquet").selectExpr(
        "event_id", "user_id", "value", "cast(get_json_object(props, '$.k') as int) as k",
        f"(timestampdiff(MICROSECOND, TIMESTAMP_NTZ '2024-01-01 00:00:00', cast(ts as timestamp_ntz)) div {speed}) * 1000 as ns", f"{kind} as t")
    return rows.selectExpr(*_columns("string"))


def kernel_events(spark: SparkSession, sf_dir: str, speed: int = SPEED) -> DataFrame:
    """events as the five captured families."""
    return _events(spark, sf_dir, _TYPE, speed)


def more_events(spark: SparkSession, sf_dir: str, speed: int = SPEED) -> DataFrame:
    """The same rows dealt over the families of MORE_TYPES."""
    names = ", ".join(f"'{x}'" for x in MORE_TYPES)
    return _events(spark, sf_dir, f"element_at(array({names}), cast(event_id % {len(MORE_TYPES)} + 1 as int))", speed)


def _sql(kind: str, speed: int = SPEED) -> str:
    base = f"SELECT event_id, user_id, value, CAST(json_extract_string(props, '$.k') AS INT) AS k, ((epoch_us(ts) - 1704067200000000) // {speed}) * 1000 AS ns, {kind} AS t FROM events"
    return f"SELECT {', '.join(_columns('varchar'))} FROM ({base})"


#: WITH clauses for DuckDB.
EVENTS_SQL = f"ke AS ({_sql(_TYPE)})"
_MORE = "list_extract([{}], CAST(event_id % {} + 1 AS INT))".format(", ".join(f"'{x}'" for x in MORE_TYPES), len(MORE_TYPES))
MORE_SQL = f"me AS ({_sql(_MORE)})"
FAST_EVENTS_SQL, FAST_MORE_SQL = f"ke AS ({_sql(_TYPE, FAST)})", f"me AS ({_sql(_MORE, FAST)})"


def cgroup_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Inventory of cgroups: cluster, node_id, cgroup_id and path, one per supplier; every seventh is another node's."""
    return spark.read.parquet(f"{sf_dir}/supplier.parquet").selectExpr("'c1' as cluster", f"{_NODE.format(text='string')} as node_id", "90000 + s_suppkey as cgroup_id", f"{_PATH.format(id=_ID_SPARK)} as path")


def pods(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Inventory of containers and their pods: suppliers whose number isn't 3 modulo 4."""
    nation = spark.read.parquet(f"{sf_dir}/nation.parquet").select("n_nationkey", "n_name")
    rows = spark.read.parquet(f"{sf_dir}/supplier.parquet").where("s_suppkey % 4 <> 3").join(nation, F.expr("s_nationkey = n_nationkey"))
    return rows.selectExpr(f"{_ID_SPARK} as container_id", "concat('pod-', cast(s_suppkey as string)) as pod_uid", "n_name as namespace", *[f"{x.format(text='string')} as {c}" for c, x in OF_POD.items()])


#: What pods tell beside their number, by supplier.
OF_POD = {
    "pod_name": "concat('app-', cast(s_suppkey as {text}))", "service_account": "case when s_suppkey % 3 = 0 then '' else concat('sa-', cast(s_suppkey % 5 as {text})) end",
    "owner_kind": "case when s_suppkey % 2 = 0 then 'ReplicaSet' end", "owner_name": "case when s_suppkey % 2 = 0 then concat('rs-', cast(s_suppkey % 8 as {text})) end", "owner_uid": "case when s_suppkey % 2 = 0 then concat('owner-', cast(s_suppkey % 8 as {text})) end",
}
_NODE = "concat('node-', cast((case when s_suppkey % 7 = 0 then s_suppkey + 1 else s_suppkey end) % 5 as {text}))"
_ID_SPARK = "sha2(concat('container:', cast(s_suppkey as string)), 256)"
_PATH = """case when s_suppkey % 10 = 9 then '/system.slice/sshd.service' when s_suppkey % 3 = 0 then concat('/kubepods.slice/cri-containerd-', {id}, '.scope')
  when s_suppkey % 3 = 1 then concat('/kubepods.slice/crio-', {id}, '.scope') else concat('/docker/', {id}) end"""
_ID_SQL = "sha256(concat('container:', cast(s_suppkey as varchar)))"
CGROUPS_SQL = f"cgroups AS (SELECT 'c1' AS cluster, {_NODE.format(text='varchar')} AS node_id, 90000 + s_suppkey AS cgroup_id, {_PATH.format(id=_ID_SQL)} AS path FROM supplier)"
PODS_SQL = f"pods AS (SELECT {_ID_SQL} AS container_id, concat('pod-', cast(s_suppkey as varchar)) AS pod_uid, n_name AS namespace, {', '.join(f"{x.format(text='varchar')} AS {c}" for c, x in OF_POD.items())} FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE s_suppkey % 4 <> 3)"
