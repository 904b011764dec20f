"""Accounting for loss and delivery (A1-A12, A14, W3, W5, ST6, K3-K6, J9)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.columns import evidence_class, record_id
from ..schemas import PRODUCER
from .intervals import points_in

#: Types that the receiver takes (K6); those of the file family only with a flag.
SUPPORTED = ("kernel.tcp.connect", "kernel.tcp.close", "kernel.tcp.retransmit", "kernel.process.exec", "kernel.file.open", "kernel.file.open_attempt", "agent.gap")
GATED = ("kernel.file.open", "kernel.file.open_attempt")


def batch_windows(events: DataFrame, *keys: str) -> DataFrame:
    """A1: first and last observation and the count of each batch."""
    return events.groupBy(*keys).agg(F.coalesce(F.min("observed_at_ns"), F.lit(0)).alias("first_ns"), F.coalesce(F.max("observed_at_ns"), F.lit(0)).alias("last_ns"), F.count("*").alias("n"))


def gaps(dropped: DataFrame, cause: Column | str, *keys: str) -> DataFrame:
    """A3 and A4: what a set of dropped events amounts to, per keys. Different causes are "multiple"; types are a small set."""
    reliability = evidence_class(F.col("event_type")) == "reliability"
    rows = dropped.withColumn("cause_", F.lit(cause) if isinstance(cause, str) else cause)
    return rows.groupBy(*keys).agg(
        F.when(F.min("cause_") != F.max("cause_"), "multiple").otherwise(F.min("cause_")).alias("cause"),
        F.array_join(F.array_sort(F.collect_set("event_type")), ",").alias("affected_types"),
        F.count("*").alias("dropped_records"),
        F.count_if(reliability).alias("dropped_reliability"),
        F.count_if(~reliability).alias("dropped_attribution"),
        F.min("observed_at_ns").alias("gap_start_ns"),
        F.max("observed_at_ns").alias("gap_end_ns"),
    )


def merge_gaps(reports: DataFrame, *keys: str) -> DataFrame:
    """A4: gap reports of the same keys as one."""
    return reports.groupBy(*keys).agg(
        F.when(F.min("cause") != F.max("cause"), "multiple").otherwise(F.min("cause")).alias("cause"),
        F.array_join(F.array_sort(F.array_distinct(F.flatten(F.collect_set(F.split("affected_types", ","))))), ",").alias("affected_types"),
        *[F.sum(c).alias(c) for c in ("dropped_records", "dropped_reliability", "dropped_attribution")],
        F.min("gap_start_ns").alias("gap_start_ns"), F.max("gap_end_ns").alias("gap_end_ns"),
    )


def gap_records(reports: DataFrame) -> DataFrame:
    """A5: a warning of the agent about itself for each gap, observed at its end."""
    labels = F.map_from_arrays(F.array(*[F.lit(c) for c in ("cause", "affected_types", "dropped_records", "dropped_reliability", "dropped_attribution", "gap_start_ns", "gap_end_ns")]),
                               F.array("cause", "affected_types", *[F.col(c).cast("string") for c in ("dropped_records", "dropped_reliability", "dropped_attribution", "gap_start_ns", "gap_end_ns")]))
    return reports.select("*", F.lit("agent.gap").alias("type"), F.lit("warning").alias("severity"), F.col("gap_end_ns").alias("observed_at_ns"), labels.alias("labels"))


def as_records(reports: DataFrame) -> DataFrame:
    """A5 for the wire form: gap reports (cluster, node_id and what gaps gives) as whole records, whose labels also list the affected probes as JSON."""
    rows = gap_records(reports)
    more = F.create_map(F.lit("affected_probes"), F.to_json(F.split("affected_types", ",")), F.lit("observed_at_ns"), F.col("gap_end_ns").cast("string"), F.lit("node_id"), F.col("node_id"), F.lit("cluster_id"), F.col("cluster"))
    none = lambda t: F.lit(None).cast(t)
    return rows.select(
        record_id(F.col("gap_end_ns"), F.col("node_id"), F.col("type"), F.col("gap_start_ns")).alias("id"), "cluster", "node_id", F.lit(f"{PRODUCER}/agent").alias("source"), "type", "severity", none("string").alias("outcome"), "observed_at_ns",
        F.map_concat("labels", more).alias("labels"),
        none("struct<src_ip:string,src_port:int,dst_ip:string,dst_port:int,protocol:string>").alias("network_data"), none("struct<pid:long,ppid:long,command:string,uid:long>").alias("process_data"),
    )


def counter_deltas(samples: DataFrame) -> DataFrame:
    """What a counter grew by since the poll before; a counter that went back counts from zero."""
    by = Window.partitionBy(*[c for c in ("cluster", "node_id", "probe_id") if c in samples.columns]).orderBy("polled_ns")
    before, at = F.lag("dropped", 1, 0).over(by), F.coalesce(F.lag("polled_ns").over(by), F.col("tracking_start_ns"))
    return samples.withColumns({"delta": F.when(F.col("dropped") < before, F.col("dropped")).otherwise(F.col("dropped") - before), "from_ns": at})


def shed(backlog: DataFrame, records: int, batches: int, size: int) -> DataFrame:
    """Queued batches (cluster, node_id, batch_id, class, enqueued_ms, records, bytes) with whether they are kept.

    Newest first within a node, attribution before reliability; a batch is kept while all running totals are within the
    bounds. Nodes are the partitions; there is no global window.
    """
    by = Window.partitionBy("cluster", "node_id").orderBy(F.when(F.col("class") == "attribution", 0).otherwise(1), F.desc("enqueued_ms"), F.desc("batch_id")).rowsBetween(Window.unboundedPreceding, 0)
    return backlog.withColumn("kept", (F.sum("records").over(by) <= records) & (F.count("*").over(by) <= batches) & (F.sum("bytes").over(by) <= size))


def expired(backlog: DataFrame, now_ms: int, most_ms: int = 300_000) -> DataFrame:
    """ST6: batches past their age."""
    return backlog.where(F.col("enqueued_ms") < now_ms - most_ms)


def expired_gaps(backlog: DataFrame, now_ms: int, most_ms: int = 300_000) -> DataFrame:
    """ST6: per node a gap report with the cause retry_buffer_expired of the batches past their age; classes sum to the records."""
    of = lambda x: F.coalesce(F.sum(F.when(F.col("class") == x, F.col("records"))), F.lit(0))
    return expired(backlog, now_ms, most_ms).groupBy("cluster", "node_id").agg(
        F.lit("retry_buffer_expired").alias("cause"), F.array_join(F.array_sort(F.collect_set("class")), ",").alias("affected_classes"), F.sum("records").alias("dropped_records"),
        of("reliability").alias("dropped_reliability"), of("attribution").alias("dropped_attribution"),
        (F.min("enqueued_ms") * 1_000_000).alias("gap_start_ns"), (F.max("enqueued_ms") * 1_000_000).alias("gap_end_ns"),
    )


def over_rate(events: DataFrame, most: int) -> DataFrame:
    """Events beyond ``most`` per node, type and second, in order of time."""
    second = F.expr("observed_at_ns div 1000000000")
    by = Window.partitionBy("cluster", "node_id", "event_type", second).orderBy("observed_at_ns", "event_id")
    return events.withColumn("rn", F.row_number().over(by)).where(F.col("rn") > most).drop("rn")


def uncovered(nodes: DataFrame, expected: list[str], seen: DataFrame) -> DataFrame:
    """(node_id, event_type) that a node should have but doesn't: no coverage, which isn't the same as no events."""
    key = [c for c in ("cluster", "node_id") if c in nodes.columns]
    wanted = nodes.select(*key, F.explode(F.array(*map(F.lit, expected))).alias("event_type"))
    return wanted.join(seen.select(*key, "event_type").distinct(), [*key, "event_type"], "left_anti")


def during_gaps(events: DataFrame, reports: DataFrame) -> DataFrame:
    """Events and the gaps of their node that they fall into, gaps of any length. Cluster and boot count where both sides have them."""
    keys = [c for c in ("cluster", "node_id", "boot_id") if c in events.columns and c in reports.columns]
    return points_in(events, reports, keys, "observed_at_ns", "gap_start_ns", "gap_end_ns")


def gate(events: DataFrame, files: bool = False) -> DataFrame:
    """K6: delivery_status of each event: deliver, unsupported, or gated."""
    t = F.col("event_type")
    status = F.when(~t.isin(*SUPPORTED), "unsupported").when(t.isin(*GATED) & ~F.lit(files), "gated").otherwise("deliver")
    return events.withColumn("delivery_status", status)


def deliver(batch: DataFrame, delivered: DataFrame) -> DataFrame:
    """K5: items with idempotency_key and status: ACCEPTED once, DUPLICATE if delivered before or earlier in the batch, REJECTED without cluster or node."""
    blank = (F.coalesce(F.trim("cluster"), F.lit("")) == "") | (F.coalesce(F.trim("node_id"), F.lit("")) == "")
    first = Window.partitionBy("idempotency_key", "blank_").orderBy("observed_at_ns", "id")  # what is rejected precedes nothing
    rows = batch.withColumn("blank_", blank).withColumn("rn", F.row_number().over(first)).join(delivered.select("idempotency_key", F.lit(True).alias("before")).distinct(), "idempotency_key", "left")
    return rows.withColumn("status", F.when(F.col("blank_"), "REJECTED").when((F.col("rn") > 1) | F.col("before"), "DUPLICATE").otherwise("ACCEPTED")).drop("rn", "before", "blank_")


def ingest(items: DataFrame, delivered: DataFrame, files: bool = False) -> DataFrame:
    """K5 with K6 and P12: items (batch_id, idempotency_key, cluster, node_id, event_type, observed_at_ns, event_id) with status, reason and retryable.

    A batch with an item without cluster or node is refused whole; of the others unsupported and gated items are dropped and counted, the
    first of a key is ACCEPTED, and what was delivered before or repeats in the batch is a DUPLICATE, which is a success. Nothing of that
    can be helped by trying again.
    """
    blank = (F.coalesce(F.trim("cluster"), F.lit("")) == "") | (F.coalesce(F.trim("node_id"), F.lit("")) == "")
    refused = items.groupBy("batch_id").agg(F.max(blank).alias("refused_"))  # combines before the shuffle: a batch of any size is one row
    rows = gate(items, files).join(refused, "batch_id").withColumn("open_", ~F.col("refused_") & (F.col("delivery_status") == "deliver"))
    first = Window.partitionBy("idempotency_key", "open_").orderBy("observed_at_ns", "event_id")
    rows = rows.withColumn("rn_", F.row_number().over(first)).join(delivered.select("idempotency_key", F.lit(True).alias("before_")).distinct(), "idempotency_key", "left")
    status = F.when(F.col("refused_"), "REJECTED").when(~F.col("open_"), F.upper("delivery_status")).when((F.col("rn_") > 1) | F.col("before_"), "DUPLICATE").otherwise("ACCEPTED")
    rows = rows.withColumns({"status": status, "reason": F.when(F.col("refused_"), "blank cluster or node in the batch"), "retryable": F.lit(False)})
    return rows.drop("refused_", "open_", "rn_", "before_", "delivery_status")


def _results(items: DataFrame, *keys: str) -> DataFrame:
    """A row for each batch: accepted, duplicates, rejected, reasons, retryable. Items combine to a row for each reason first."""
    reason = F.col("reason") if "reason" in items.columns else F.lit("blank cluster or node")
    again = F.coalesce(F.col("retryable"), F.lit(False)) if "retryable" in items.columns else F.lit(False)
    bad, twice = F.col("status") == "REJECTED", F.col("status") == "DUPLICATE"
    counts = items.groupBy(*keys, F.when(bad, reason).alias("reason_")).agg(
        F.count_if((F.col("status") == "ACCEPTED") | twice).alias("good"), F.count_if(twice).alias("twice"), F.count_if(bad).alias("bad"), F.max(bad & again).alias("again")
    )
    said = F.when(F.col("bad") > 0, F.concat("reason_", F.lit(": "), F.col("bad")))
    reasons = F.array_join(F.array_sort(F.collect_list(said)), "; ").alias("reasons")
    return counts.groupBy(*keys).agg(F.sum("good").alias("accepted"), F.sum("twice").alias("duplicates"), F.sum("bad").alias("rejected"), reasons, F.max("again").alias("retryable"))


def delivery_results(items: DataFrame, *keys: str) -> DataFrame:
    """Accepted (duplicates too) and rejected items of each batch, what was rejected for which reason, and whether trying again can help.

    A rejected item says why in ``reason``, where there is such a column; only one that is ``retryable`` makes its batch so.
    """
    return _results(items, *keys).drop("duplicates")


def settled(items: DataFrame, *keys: str) -> DataFrame:
    """delivery_results with what each batch comes to: ``retry``, all of it, if a rejected item can be taken later (what was accepted is a
    duplicate then), ``partial_failure`` if others were rejected, else ``delivered``; and ``warning``, which tells duplicates of a delivered batch."""
    outcome = F.when(F.col("retryable"), "retry").when(F.col("rejected") > 0, "partial_failure").otherwise("delivered")
    warning = F.when((outcome == "delivered") & (F.col("duplicates") > 0), F.concat("duplicates", F.lit(" duplicate items")))
    return _results(items, *keys).withColumns({"outcome": outcome, "warning": warning})


def backlog_gauges(backlog: DataFrame, now_ms: int, stalled_ms: int = 60_000) -> DataFrame:
    """A10: queued batches, records and bytes, the oldest one's age, and whether a node is stalled."""
    oldest = F.lit(now_ms) - F.min("enqueued_ms")
    return backlog.groupBy("cluster", "node_id").agg(F.count("*").alias("batches"), F.sum("records").alias("records"), F.sum("bytes").alias("bytes"), oldest.alias("oldest_ms"), (oldest > stalled_ms).alias("stalled"))


def with_gap(lost: DataFrame, cause: str) -> DataFrame:
    """A12, ST6: the gap records of events that a limit (rate_limit) or an age (retry_buffer_expired) took."""
    return gap_records(gaps(lost, cause, "cluster", "node_id"))


def append_result(bound: DataFrame, *keys: str) -> DataFrame:
    """K4: of a batch for the neutral pipeline what went on, what was unbound, and the status of the whole."""
    out = bound.groupBy(*keys).agg(F.count_if(F.col("unbound_reason").isNull()).alias("accepted"), F.count_if(F.col("unbound_reason").isNotNull()).alias("rejected"))
    return out.withColumn("status", F.when(F.col("rejected") == 0, "ok").when(F.col("accepted") == 0, "failure").otherwise("partial_failure"))
