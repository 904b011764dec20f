"""Metrics as tables (K7, M1-M4): one row for each metric and label, from aggregations that combine before the shuffle.

``observed`` gives the same numbers of a batch or stream while it runs, without another pass.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from .loss import counter_deltas


def events_per_probe(events: DataFrame) -> DataFrame:
    """M1."""
    return events.groupBy(F.col("event_type").alias("label")).agg(F.count("*").alias("value"))


def status(events: DataFrame, samples: DataFrame, rates: DataFrame) -> DataFrame:
    """A row for each probe of a node: its events, since when, what its counters say was dropped, and of how many events it keeps one.

    samples (cluster, node_id, event_type, probe_id, polled_ns, dropped, tracking_start_ns) are polls of counters; rates (event_type, sample_rate) name the probes that are sampled.
    """
    key = ["cluster", "node_id", "event_type"]
    drops = counter_deltas(samples).groupBy(*key).agg(F.sum("delta").alias("drops"))
    seen = events.groupBy(*key).agg(F.count("*").alias("events_total"), F.min("observed_at_ns").alias("attached_since"))
    rows = seen.join(drops, key, "left").join(rates, "event_type", "left")
    probe = F.regexp_replace(F.regexp_replace("event_type", r"^kernel\.", ""), r"\.", "_").alias("probe_id")
    return rows.select("cluster", "node_id", probe, "event_type", "events_total", "attached_since", F.coalesce("drops", F.lit(0)).alias("drops"), F.coalesce("sample_rate", F.lit(1)).alias("sample_rate"))


def drops_per_probe(samples: DataFrame) -> DataFrame:
    """M2: what the probes' ring buffers dropped, from polls of their counters."""
    return counter_deltas(samples).groupBy(F.col("probe_id").alias("label")).agg(F.sum("delta").alias("value"))


def delivery_errors(items: DataFrame) -> DataFrame:
    """M3: rejected items by source."""
    return items.groupBy(F.col("source").alias("label")).agg(F.count_if(F.col("status") == "REJECTED").alias("value"))


def parse_errors(decoded: DataFrame) -> DataFrame:
    """M4: captures that could not be decoded, by probe (event_type)."""
    return decoded.groupBy(F.col("event_type").alias("label")).agg(F.count_if(F.col("decode_error").isNotNull()).alias("value"))


def exported(**tables: DataFrame) -> DataFrame:
    """K7: tables of (label, value) as one of (metric, label, value)."""
    named = [t.select(F.lit(name).alias("metric"), F.col("label").cast("string").alias("label"), F.col("value").cast("long").alias("value")) for name, t in tables.items()]
    return reduce(DataFrame.union, named)


def observed(events: DataFrame, observation: Observation) -> DataFrame:
    """K7: events as they are; once they have been read, observation.get has their count, failures and last time."""
    return events.observe(observation, F.count("*").alias("events"), F.count_if(F.col("ret") < 0).alias("failures"), F.max("observed_at_ns").alias("last_ns"))
