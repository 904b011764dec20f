"""Filters, limits, samples and set operations on records or events."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def event_filter(events: DataFrame, now_ns: Column | int | None = None, last_seconds: int | None = None, **equal: object) -> DataFrame:
    """a conjunction of what is given: src_ip, dst_ip, src_port, dst_port, pid, comm, ret, ... and a time window.

    A row without a value, such as an address, is rejected by a condition on it. Conditions reach the scan.
    """
    conditions = [F.col(k) == v for k, v in equal.items() if v is not None]
    if last_seconds is not None:
        conditions.append(F.col("observed_at_ns") >= (now_ns if isinstance(now_ns, Column) else F.lit(now_ns)) - last_seconds * 1_000_000_000)
    return events.where(reduce(Column.__and__, conditions)) if conditions else events


def in_namespaces(records: DataFrame, allowed: list[str]) -> DataFrame:
    """bound records of listed namespaces; gap records always pass."""
    return records.where(F.col("namespace").isin(allowed) | (F.col("type") == "agent.gap"))


def without(events: DataFrame, excluded: DataFrame, *on: str) -> DataFrame:
    """Events that excluded, such as an agent's own (node_id, pid) or annotated noise, doesn't name."""
    return events.join(excluded.select(*on).distinct(), list(on), "left_anti")


def every_nth(events: DataFrame, n: int) -> DataFrame:
    """F6, exact: every n-th event of each node and type in order of time.

    Rows are numbered by time buckets, so that no node's whole history meets in one window: counts of the buckets before
    are added to a row's place in its bucket.
    """
    if n <= 1:
        return events
    keys = ["node_id", "event_type"]
    rows = events.withColumn("bucket", F.expr("observed_at_ns div 60000000000"))
    counts = rows.groupBy(*keys, "bucket").count()
    before = Window.partitionBy(*keys).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select(*keys, "bucket", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("before"))
    place = F.row_number().over(Window.partitionBy(*keys, "bucket").orderBy("observed_at_ns", "event_id"))
    return rows.withColumn("place", place).join(counts, [*keys, "bucket"]).where((F.col("place") + F.col("before")) % n == 0).select(*events.columns)


def probe_filters(events: DataFrame, filters: DataFrame) -> DataFrame:
    """filters (event_type, dst_port, src_ip, pid, comm), nulls for no condition; of a type that has filters the events stay
    that meet all conditions of one. The filters are gathered to a row per type, so that no event is multiplied."""
    given = ("dst_port", "src_ip", "pid", "comm")
    per_type = filters.groupBy("event_type").agg(F.collect_list(F.struct(*given)).alias("filters_"))  # as many as an operator writes
    meets = lambda f: reduce(Column.__and__, [F.coalesce(F.col(c) == f[c], f[c].isNull()) for c in given])
    return events.join(per_type, "event_type", "left").where(F.col("filters_").isNull() | F.exists("filters_", meets)).select(*events.columns)


def sampled(events: DataFrame, n: int) -> DataFrame:
    """F6 for streams: the same rate without state."""
    return events.where(F.pmod(F.xxhash64("event_id"), F.lit(n)) == 0)


def after(records: DataFrame, last_id: str) -> DataFrame:
    """F8: records after a cursor; ids sort by time."""
    return records.where(F.col("id") > last_id)


def last_per_probe(events: DataFrame, n: int) -> DataFrame:
    """The newest n of each type. Spark keeps n per task and type before the shuffle."""
    newest = Window.partitionBy("event_type").orderBy(F.desc("observed_at_ns"), F.desc("event_id"))
    return events.withColumn("rn", F.row_number().over(newest)).where(F.col("rn") <= n).drop("rn")


def oldest(events: DataFrame, limit: int = 100) -> DataFrame:
    """One probe's matches, oldest first."""
    return events.orderBy("observed_at_ns", "event_id").limit(limit)


def newest(events: DataFrame, limit: int = 100) -> DataFrame:
    """All probes' matches, newest first, and then the limit."""
    return events.orderBy(F.desc("observed_at_ns"), F.desc("event_id")).limit(limit)
