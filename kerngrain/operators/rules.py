"""Interpretation rules over events (R01-R43) as data, and the three shapes that evaluate them.

filter: every event for which the predicate holds. window: keys and a tumbling window of ``seconds``; the measure must
meet the threshold. sequence: an event within ``seconds`` after another with the same keys. A node's monotonic clock orders
its own events of one boot only, so every rule has the cluster, the node and the boot among its keys. Measures are counts, sums and distinct counts, which
combine before the shuffle; a busy key costs one row for each task and window. Evidence is the first and last event's id.
Predicates are SQL that Spark and other engines read alike.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: What a monotonic clock belongs to.
NODE = ("cluster", "node_id", "boot_id")
BACKEND = (*NODE, "dst_ip", "dst_port")
CONNECTION = (*NODE, "src_ip", "src_port", "dst_ip", "dst_port")
PROCESS = (*NODE, "pid")


@dataclass(frozen=True)
class Rule:
    id: str
    event_type: str
    severity: str
    conclusion: str
    predicate: str = "true"
    shape: str = "filter"
    keys: tuple[str, ...] = ()
    measure: str = "count(*)"
    having: str = ""
    seconds: int = 60


def _w(rule: str, kind: str, severity: str, conclusion: str, keys: tuple[str, ...], having: str, predicate: str = "true", measure: str = "count(*)", seconds: int = 60) -> Rule:
    return Rule(rule, kind, severity, conclusion, predicate, "window", keys, measure, having, seconds)


RULES = (
    Rule("R01", "kernel.tcp.connect", "info", "the connection was made", "ret = 0"),
    Rule("R02", "kernel.tcp.connect", "error", "no process listens on the destination port", "ret = -111"),
    Rule("R03", "kernel.tcp.connect", "error", "the destination does not answer", "ret = -110"),
    Rule("R04", "kernel.tcp.connect", "error", "there is no route to the host", "ret = -113"),
    Rule("R05", "kernel.tcp.connect", "error", "the network can not be reached", "ret = -101"),
    _w("R06", "kernel.tcp.connect", "error", "a backend keeps refusing connections", BACKEND, "n >= 5", measure="sum(case when ret <> 0 then 1 else 0 end)"),
    _w("R08", "kernel.tcp.close", "warning", "connections to a backend open and close in quick turn", BACKEND, "n >= 20"),
    Rule("R09", "kernel.tcp.retransmit", "error", "handshakes are lost: remote down or filtered", "tcp_state = 'SYN_SENT'"),
    Rule("R10", "kernel.tcp.retransmit", "warning", "the network loses packets of a live connection", "tcp_state = 'ESTABLISHED'"),
    Rule("R11", "kernel.tcp.retransmit", "warning", "the local application has not closed a connection that the remote closed", "tcp_state = 'CLOSE_WAIT'"),
    _w("R13", "kernel.tcp.retransmit", "error", "all connections to one host lose packets", (*NODE, "dst_ip"), "n >= 2", measure="count(distinct concat(src_ip, ':', src_port, ':', dst_port))"),
    _w("R14", "kernel.tcp.retransmit", "critical", "the node loses packets to many hosts", NODE, "n >= 2", measure="count(distinct dst_ip)"),
    _w("R17", "kernel.tcp.accept", "error", "the accept backlog is full", (*NODE, "dst_port", "pid"), "n >= 2", "ret = -11"),
    _w("R19", "kernel.tcp.recv", "info", "data flows", CONNECTION, "n = 0", measure="sum(case when ret > 0 then 0 else 1 end)"),
    _w("R20", "kernel.tcp.recv", "info", "the peer has closed the connection", CONNECTION, "n >= 2", "ret = 0"),
    _w("R21", "kernel.tcp.syn_recv", "critical", "the SYN backlog is full", (*NODE, "dst_port"), "n >= 2", "ret = 0"),
    _w("R22", "kernel.tcp.syn_recv", "info", "SYNs are handled", (*NODE, "dst_port"), "n = 0", measure="sum(case when ret <> 0 then 0 else 1 end)"),
    _w("R23", "kernel.tcp.reset", "warning", "a server turns one client away", (*NODE, "src_ip", "dst_ip"), "n >= 2"),
    _w("R24", "kernel.tcp.reset", "error", "connections to one port are reset widely", (*NODE, "dst_port"), "n >= 2", measure="count(distinct concat(src_ip, ':', src_port, ':', dst_ip))"),
    _w("R25", "kernel.memory.oom_kill", "critical", "a container's memory limit is too low or it leaks", (*NODE, "cgroup_id"), "n >= 2", "cgroup_id <> 0", seconds=3600),
    _w("R26", "kernel.memory.oom_kill", "critical", "the node is out of memory", NODE, "n >= 2", measure="count(distinct comm)"),
    Rule("R27", "kernel.memory.page_alloc", "critical", "a page could not be allocated", "ret = 0"),
    _w("R28", "kernel.memory.page_alloc", "info", "memory is available", NODE, "n = 0", measure="sum(case when ret <> 0 then 0 else 1 end)"),
    _w("R29", "kernel.memory.cgroup_charge", "error", "a cgroup is at its memory limit", (*NODE, "cgroup_id"), "n >= 2", "ret <> 0", seconds=600),
    Rule("R31", "kernel.file.open", "warning", "a watched path was denied", "ret = -13"),
    _w("R32", "kernel.fs.write", "info", "a heavy writer", PROCESS, "n >= 5000", "ret > 0", "sum(ret)"),
    _w("R33", "kernel.fs.read", "info", "a heavy reader", PROCESS, "n >= 5000", "ret > 0", "sum(ret)"),
    Rule("R34", "kernel.fs.read", "warning", "a read failed", "ret < 0"),
    _w("R37", "kernel.sched.wakeup", "info", "a process sleeps and wakes often", PROCESS, "n >= 2"),
    Rule("R40", "kernel.process.exit", "warning", "killed by SIGKILL", "ret = 137"),
    _w("R41", "kernel.process.exit", "error", "a command keeps crashing", (*NODE, "comm"), "n >= 3", "ret <> 0"),
    Rule("R42", "kernel.process.clone", "error", "no new process can be made", "ret < 0"),
    _w("R43", "kernel.process.clone", "warning", "a process forks quickly", PROCESS, "n >= 2"),
)
BY_ID = {r.id: r for r in RULES}


def evaluate(events: DataFrame, rule: Rule) -> DataFrame:
    """Rows (rule_id, keys, window_start_ns, n, first_id, last_id), or (rule_id, event_id) for filters."""
    rows = events.where((F.col("event_type") == rule.event_type) & F.expr(rule.predicate))
    if rule.shape == "filter":
        return rows.select(F.lit(rule.id).alias("rule_id"), "event_id", "node_id", "observed_at_ns")
    ns = rule.seconds * 1_000_000_000
    rows = rows.withColumn("window_start_ns", F.expr(f"observed_at_ns div {ns} * {ns}"))
    found = rows.groupBy(*rule.keys, "window_start_ns").agg(F.expr(rule.measure).cast("long").alias("n"), F.min("event_id").alias("first_id"), F.max("event_id").alias("last_id"))
    return found.where(rule.having).withColumn("rule_id", F.lit(rule.id))


def losses(events: DataFrame, seconds: int = 10, least: int = 3) -> DataFrame:
    """Retransmits of a live connection with ``least`` of them in the last ``seconds``, itself included.

    Windows are over spans of six times that time, so that no connection's whole history meets in one; a row that the span after its own
    can still see goes there too, and is counted there but not given again.
    """
    ns = seconds * 1_000_000_000
    span = 6 * ns
    own = F.expr(f"(observed_at_ns - pmod(observed_at_ns, {span})) div {span}")
    seen = F.when(F.pmod("observed_at_ns", F.lit(span)) >= span - ns, F.array(own, own + 1)).otherwise(F.array(own))
    rows = events.where("event_type = 'kernel.tcp.retransmit' and tcp_state = 'ESTABLISHED'").select("event_id", *CONNECTION, "observed_at_ns", own.alias("own_"), F.explode(seen).alias("span_"))
    recent = Window.partitionBy(*CONNECTION, "span_").orderBy("observed_at_ns").rangeBetween(-ns, 0)
    return rows.withColumn("n", F.count("*").over(recent)).where((F.col("n") >= least) & (F.col("span_") == F.col("own_"))).drop("own_", "span_")


def _next(events: DataFrame, first: str, then: str, keys: tuple[str, ...]) -> DataFrame:
    """Events of one kind with ``nxt``, the first later event of the other kind with the same keys.

    From the end to the beginning: the last event of the other kind so far, which costs one step for each row.
    """
    back = Window.partitionBy(*keys).orderBy(F.desc("observed_at_ns"), F.desc("event_id")).rowsBetween(Window.unboundedPreceding, -1)
    nxt = F.last(F.when(F.col("event_type") == then, F.struct("observed_at_ns", "event_id")), ignorenulls=True).over(back)
    return events.where(F.col("event_type").isin(first, then)).withColumn("nxt", nxt).where(F.col("event_type") == first)


def followed(events: DataFrame, first: str, then: str, keys: tuple[str, ...], seconds: float) -> DataFrame:
    """Events of one kind whose next of another kind with the same keys comes within the time."""
    after = F.col("nxt.observed_at_ns") - F.col("observed_at_ns")
    rows = _next(events, first, then, keys).where(after <= int(seconds * 1e9))
    return rows.select("event_id", *keys, "observed_at_ns", F.col("nxt.event_id").alias("next_id"), after.alias("after_ns"))


def lifetimes(events: DataFrame) -> DataFrame:
    """A row for each connect and close of a connection: begin, end, lifetime, bytes and retransmits between them, and whether it failed, is still open, was
    superseded by another connect without a close, or was closed without a connect in sight.

    A session of a connection begins with each connect and with the first row after a close; counts within it combine before
    nothing but the connection's own window, which holds that connection's rows of a boot.
    """
    kinds = {"kernel.tcp.connect": "connect", "kernel.tcp.close": "close", "kernel.tcp.retransmit": "retransmit"}
    rows = events.where(F.col("event_type").isin(*kinds)).withColumn("close_", F.col("event_type") == "kernel.tcp.close")
    by = Window.partitionBy(*CONNECTION).orderBy("observed_at_ns", "event_id")
    new = (F.col("event_type") == "kernel.tcp.connect") | F.coalesce(F.lag("close_").over(by), F.lit(True))
    rows = rows.withColumn("session_", F.sum(new.cast("int")).over(by))
    of = lambda kind, value: F.max(F.when(F.col("event_type") == kind, F.col(value)))
    found = rows.groupBy(*CONNECTION, "session_").agg(
        of("kernel.tcp.connect", "event_id").alias("connect_id"), of("kernel.tcp.connect", "observed_at_ns").alias("begin_ns"), of("kernel.tcp.connect", "ret").alias("ret"),
        of("kernel.tcp.close", "event_id").alias("close_id"), of("kernel.tcp.close", "observed_at_ns").alias("end_ns"), of("kernel.tcp.close", "bytes_sent").alias("bytes_sent"), of("kernel.tcp.close", "bytes_received").alias("bytes_received"),
        F.count_if(F.col("event_type") == "kernel.tcp.retransmit").alias("losses"),
    )
    later = F.max("session_").over(Window.partitionBy(*CONNECTION)) > F.col("session_")
    state = F.when(F.col("ret") != 0, "failed").when(F.col("connect_id").isNull() & F.col("close_id").isNull(), "unseen").when(F.col("connect_id").isNull(), "closed_unseen")
    state = state.when(F.col("close_id").isNotNull(), "closed").when(later, "superseded").otherwise("open")
    return found.withColumns({"lifetime_ns": F.col("end_ns") - F.col("begin_ns"), "state": state}).drop("session_")


def backends(lives: DataFrame) -> DataFrame:
    """Connections of a backend by how they ended, with failures, losses and the mean lifetime."""
    return lives.groupBy(*BACKEND).agg(
        F.count("connect_id").alias("connections"), *[F.count_if(F.col("state") == x).alias(x) for x in ("failed", "open", "closed", "superseded")],
        F.sum("losses").alias("losses"), F.count_if(F.col("losses") > 0).alias("lossy"), F.sum("bytes_sent").alias("bytes_sent"), (F.sum("lifetime_ns") / F.count("lifetime_ns")).cast("long").alias("mean_lifetime_ns"),
    )


def rates(events: DataFrame, kinds: tuple[str, str], keys: tuple[str, ...], seconds: int = 60) -> DataFrame:
    """Per keys and window the counts of two kinds and the bytes of the first, in one aggregation."""
    ns = seconds * 1_000_000_000
    rows = events.where(F.col("event_type").isin(*kinds)).withColumn("window_start_ns", F.expr(f"observed_at_ns div {ns} * {ns}"))
    is_ = lambda k: F.col("event_type") == kinds[k]
    return rows.groupBy(*keys, "window_start_ns").agg(F.count_if(is_(0)).alias("n_first"), F.count_if(is_(1)).alias("n_then"), F.coalesce(F.sum(F.when(is_(0) & (F.col("ret") > 0), F.col("ret"))), F.lit(0)).alias("first_bytes"))


def drops(events: DataFrame, kind: str, keys: tuple[str, ...], ratio: float, seconds: int = 60) -> DataFrame:
    """Windows whose count fell below ratio of the window's before it (windows of counts, not of events)."""
    ns = seconds * 1_000_000_000
    counts = events.where(F.col("event_type") == kind).groupBy(*keys, F.expr(f"observed_at_ns div {ns} * {ns}").alias("window_start_ns")).agg(F.count("*").alias("n"))
    before = F.lag("n").over(Window.partitionBy(*keys).orderBy("window_start_ns"))
    return counts.withColumn("n_before", before).where(F.col("n") < ratio * F.col("n_before"))


def unanswered(events: DataFrame, first: str, then: str, keys: tuple[str, ...], seconds: float) -> DataFrame:
    """Events of one kind that no event of the other kind follows in time."""
    late = F.coalesce(F.col("nxt.observed_at_ns") - F.col("observed_at_ns") > int(seconds * 1e9), F.lit(True))
    return _next(events, first, then, keys).where(late).select("event_id", *keys, "observed_at_ns")


def unexpected_binaries(events: DataFrame, allowed: DataFrame) -> DataFrame:
    """Executions of files that the allow-list (comm, filename) doesn't name."""
    return events.where("event_type = 'kernel.process.exec'").join(allowed.distinct(), ["comm", "filename"], "left_anti").select("event_id", "node_id", "comm", "filename")


#: What to do about what single events tell.
ACTIONS = {
    "R01": "nothing", "R02": "start the service on that port, or correct the port", "R03": "look for a filter or a dead host on the way", "R04": "look at routes to the host", "R05": "look at the node's network and its default route",
    "R09": "see whether the remote host is up and not filtered", "R10": "look at the network between the two hosts", "R11": "make the application close its connections",
    "R27": "free memory on the node, or move work away", "R31": "see whether the process should read the path", "R34": "look at the disk and the file system", "R40": "see who sent the signal; look at memory limits", "R42": "look at the limits on processes",
}
