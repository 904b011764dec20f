"""Time, placement, lineage and coverage."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .intervals import points_in


def as_of(left: DataFrame, right: DataFrame, keys: list[str], left_time: str, right_time: str, values: list[str], bucket: int | None = None) -> DataFrame:
    """Left rows with the values of the latest right row at or before them: one window over both sides, no range join.

    A row of the right side at the same time counts as before; of several at one time the largest values go. Without one the values are
    null. With a bucket, a span of whole units of time, windows are over keys and spans, and each span begins with the last row of those
    before: for keys of many rows.
    """
    mine = [c for c in left.columns if c not in keys]
    l = left.select(*keys, F.col(left_time).alias("at_"), F.lit(1).alias("side_"), F.struct(*mine).alias("row_"), F.lit(None).cast(right.select(F.struct(*values)).schema[0].dataType).alias("value_"))  # noqa: E741
    r = right.select(*keys, F.col(right_time).alias("at_"), F.lit(0).alias("side_"), F.lit(None).cast(l.schema["row_"].dataType).alias("row_"), F.struct(*values).alias("value_"))
    by = list(keys)
    if bucket is not None:
        by.append("span_")
        span = F.expr(f"(at_ - pmod(at_, {bucket})) div {bucket}")  # in whole numbers, as a double can't hold every nanosecond
        l, r = l.withColumn("span_", span), r.withColumn("span_", span)
        last = l.select(*by).distinct().join(r.groupBy(*by).agg(F.max_by("value_", F.struct("at_", "value_")).alias("last_")), by, "full")
        before = Window.partitionBy(*keys).orderBy("span_").rowsBetween(Window.unboundedPreceding, -1)
        carried = last.withColumn("value_", F.last("last_", ignorenulls=True).over(before)).where("value_ is not null")
        at = F.col("span_") * F.lit(bucket) - 1
        r = r.unionByName(carried.select(*keys, at.cast("long").alias("at_"), F.lit(0).alias("side_"), F.lit(None).cast(l.schema["row_"].dataType).alias("row_"), "value_", "span_"))
    before = Window.partitionBy(*by).orderBy("at_", "side_", "value_").rowsBetween(Window.unboundedPreceding, 0)
    both = l.unionByName(r).withColumn("found_", F.last("value_", ignorenulls=True).over(before)).where("side_ = 1")
    return both.select(*keys, *[F.col(f"row_.{c}").alias(c) for c in mine], *[F.col(f"found_.{v}").alias(v) for v in values])


def placements(moves: DataFrame, *keys: str) -> DataFrame:
    """Moves (keys, valid_from, value ...) with valid_to, the next move's begin or null: intervals closed on the left."""
    return moves.withColumn("valid_to", F.lead("valid_from").over(Window.partitionBy(*keys).orderBy("valid_from")))


def placed(events: DataFrame, moves: DataFrame, *keys: str) -> DataFrame:
    """Events with the value of the placement that held at their time: from the move on, until before the next one. Moves of one time last no time but the last."""
    spans = placements(moves, *keys).withColumn("last_ns", F.col("valid_to") - 1)
    return points_in(events, spans, list(keys), "observed_at_ns", "valid_from", "last_ns").drop("last_ns")


def parents(execs: DataFrame) -> DataFrame:
    """Executions with their parent's command: the last execution of that pid on the node at or before, minute by minute, as one parent starts much."""
    node = ["cluster", "node_id", "boot_id"]
    other = execs.select(*node, F.col("pid").alias("parent"), F.col("observed_at_ns").alias("since"), F.col("comm").alias("parent_comm"), F.col("event_id").alias("parent_event"))
    mine = execs.select(*node, F.col("ppid").alias("parent"), "event_id", "pid", "observed_at_ns", "comm").where("parent is not null")
    return as_of(mine, other, [*node, "parent"], "observed_at_ns", "since", ["parent_comm", "parent_event"], 60_000_000_000)


def wall_clock(events: DataFrame, samples: DataFrame) -> DataFrame:
    """event_time by the last clock sample (cluster, node_id, boot_id, boot_ns, wall_us) of the node, minute by minute."""
    found = as_of(events, samples, ["cluster", "node_id", "boot_id"], "observed_at_ns", "boot_ns", ["boot_ns", "wall_us"], 60_000_000_000)
    return found.withColumn("event_time_us", F.col("wall_us") + F.expr("(observed_at_ns - boot_ns) div 1000"))


NODE = ("cluster", "node_id", "boot_id")


def process_lives(execs: DataFrame, exits: DataFrame | None = None) -> DataFrame:
    """A process for each execution: its name by cluster, node, pid and start, and from when to when it was that pid's.

    execs: NODE, pid, observed_at_ns, start_boottime_ns, ingested, event_id and anything else that describes it. Of rows about one process (one start, or one time where the start isn't
    known) the one that was ingested last is right. A process ends with its exit (exits: NODE, pid, observed_at_ns) or with the next one of its pid.
    """
    start = F.coalesce(F.when(F.col("start_boottime_ns") > 0, F.col("start_boottime_ns")), F.col("observed_at_ns"))
    name = F.concat_ws("/", F.lit("process"), "cluster", "node_id", "pid", start)
    more = [c for c in execs.columns if c not in (*NODE, "pid", "start_boottime_ns")]
    best = execs.groupBy(*NODE, "pid", start.alias("start_ns"), name.alias("entity")).agg(F.max_by(F.struct(*more), F.struct("ingested", "event_id")).alias("row"))
    lives = best.select(*NODE, "pid", "entity", "start_ns", F.col("row.observed_at_ns").alias("valid_from"), *[F.col(f"row.{c}").alias(c) for c in more if c != "observed_at_ns"])
    by = Window.partitionBy(*NODE, "pid").orderBy("valid_from", "start_ns")
    lives = lives.withColumn("valid_to", F.lead("valid_from").over(by))
    if exits is None:
        return lives
    ends = exits.select(*NODE, "pid", F.col("observed_at_ns").alias("exit_ns"))
    ended = points_in(ends, lives.select(*NODE, "pid", "entity", "valid_from", (F.col("valid_to") - 1).alias("until")), [*NODE, "pid"], "exit_ns", "valid_from", "until")
    first = ended.groupBy("entity", "boot_id").agg(F.min("exit_ns").alias("exit_ns"))
    return lives.join(first, ["entity", "boot_id"], "left").withColumn("valid_to", F.coalesce("exit_ns", "valid_to")).drop("exit_ns")


def amended(lives: DataFrame, late: DataFrame) -> DataFrame:
    """Lives with rows that came later (execs as above): only pids that these name are made again, all others stay as they are."""
    touched = late.select(*NODE, "pid").distinct()
    keys = [*NODE, "pid"]
    old = lives.join(touched, keys, "left_semi").withColumn("observed_at_ns", F.col("valid_from")).withColumn("start_boottime_ns", F.col("start_ns"))
    again = process_lives(old.select(*late.columns).unionByName(late))
    return lives.join(touched, keys, "left_anti").unionByName(again.select(*lives.columns))


def entities(events: DataFrame) -> DataFrame:
    """Processes, cgroups and nodes with their first and last observation. A process here is a pid of a boot; process_lives tells its lives apart."""
    node = F.concat_ws("/", "cluster", "node_id")
    ids = F.array(F.concat(F.lit("process/"), node, F.lit("/"), "boot_id", F.lit("/"), "pid"), F.concat(F.lit("cgroup/"), node, F.lit("/"), "cgroup_id"), F.concat(F.lit("node/"), node))
    return events.select(F.explode(ids).alias("entity"), "observed_at_ns").groupBy("entity").agg(F.min("observed_at_ns").alias("first_ns"), F.max("observed_at_ns").alias("last_ns"), F.count("*").alias("n"))


def edges(bound: DataFrame) -> DataFrame:
    """What is in what: a row for each stable lifetime of a relation within a boot, from its first observation until what has it is seen elsewhere."""
    node = F.concat_ws("/", "cluster", "node_id", "boot_id")
    has_pod = F.col("pod_uid").isNotNull()
    edge = lambda kind, a, b: F.struct(F.lit(kind).alias("kind"), a.alias("a"), b.alias("b"))
    process, pod = F.concat(node, F.lit("/"), F.col("pid")), F.concat_ws("/", "cluster", "pod_uid")
    box = F.concat_ws("/", "cluster", "container_id")
    found = F.array_compact(F.array(
        edge("process_in_cgroup", process, F.concat(node, F.lit("/"), "cgroup_id")), F.when(has_pod, edge("process_in_container", process, box)),
        F.when(has_pod, edge("container_in_pod", box, pod)), F.when(has_pod, edge("pod_on_node", pod, node)),
    ))
    rows = bound.select(F.explode(found).alias("x"), "observed_at_ns", "event_id").select("x.*", "observed_at_ns", "event_id")
    # what is seen at the same place within a minute is one row before the window, so that a busy process is no long window
    rows = rows.groupBy("kind", "a", "b", F.expr("observed_at_ns div 60000000000").alias("minute")).agg(F.min("observed_at_ns").alias("first_ns"), F.max("observed_at_ns").alias("last_ns"), F.count("*").alias("n"))
    by = Window.partitionBy("kind", "a").orderBy("first_ns", "b")
    rows = rows.withColumn("life", F.sum((F.coalesce(F.lag("b").over(by) != F.col("b"), F.lit(True))).cast("int")).over(by))
    lives = rows.groupBy("kind", "a", "b", "life").agg(F.min("first_ns").alias("valid_from"), F.max("last_ns").alias("last_ns"), F.sum("n").alias("n"))
    return lives.withColumn("valid_to", F.lead("valid_from").over(Window.partitionBy("kind", "a").orderBy("life"))).drop("life")


def receipts(samples: DataFrame, most_ns: int) -> DataFrame:
    """Spans of unbroken coverage of a node's probe: split where polls are farther apart or a counter went back."""
    key = [c for c in ("cluster", "node_id", "probe_id") if c in samples.columns]
    by = Window.partitionBy(*key).orderBy("polled_ns")
    new = F.coalesce((F.col("polled_ns") - F.lag("polled_ns").over(by) > most_ns) | (F.col("dropped") < F.lag("dropped").over(by)), F.lit(True))
    spans = samples.withColumn("new", new.cast("int")).withColumn("span", F.sum("new").over(by))
    return spans.groupBy(*key, "span").agg(F.min("polled_ns").alias("from_ns"), F.max("polled_ns").alias("to_ns"), F.count("*").alias("n"))
