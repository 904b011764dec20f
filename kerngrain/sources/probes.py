"""Probes that users define: as a layout with a rate (UD1), and as rows that are held against the knowledge base (UD4)."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.records import normalize_generic
from ..operators.select import sampled
from .capture import decode

DEFINITIONS = "function string, attachment string, event_type string, sample_rate int, dst_port int, src_ip string, pid long, comm string"


@dataclass(frozen=True)
class Probe:
    """UD1: what a probe captures and how. layout and size as in capture.LAYOUTS; one of sample_rate events is kept."""

    event_type: str
    layout: tuple
    size: int
    sample_rate: int = 1

    def events(self, captures: DataFrame) -> DataFrame:
        """captures (event_id, node_id, raw and anything else) decoded; what can't be is left to decode's own output."""
        rows = decode(captures.withColumn("event_type", F.lit(self.event_type)), {self.event_type: (self.layout, self.size)}).where("decode_error is null").drop("decode_error")
        missing = {c: F.lit(None).cast(t) for c, t in (("ret", "int"), ("src_ip", "string"), ("src_port", "int"), ("dst_ip", "string"), ("dst_port", "int"), ("comm", "string")) if c not in rows.columns}
        rows = rows.withColumns(missing)
        return sampled(rows, self.sample_rate) if self.sample_rate > 1 else rows

    def records(self, captures: DataFrame) -> DataFrame:
        """N7 over the decoded events."""
        return normalize_generic(self.events(captures))


def checked(definitions: DataFrame, kb: DataFrame) -> DataFrame:
    """UD4: definitions (DEFINITIONS) with ``problems``: a function that the base doesn't have, an attachment or event type other
    than the base's, a rate below one, and a function that is defined more than once."""
    known = kb.select("function", F.col("attachment").alias("attachment_"), F.col("event_type").alias("event_type_"))
    counts = definitions.groupBy("function").agg(F.count("*").alias("n_"))
    rows = definitions.join(known, "function", "left").join(counts, "function")
    problems = [
        F.when(F.col("attachment_").isNull(), "unknown function"),
        F.when(F.col("attachment") != F.col("attachment_"), F.concat(F.lit("attaches by "), "attachment_")),
        F.when(F.col("event_type") != F.col("event_type_"), F.concat(F.lit("gives "), "event_type_")),
        F.when(F.col("sample_rate") < 1, "the rate is below one"),
        F.when(F.col("n_") > 1, "defined more than once"),
    ]
    return rows.withColumn("problems", F.array_compact(F.array(*problems))).drop("attachment_", "event_type_", "n_")
