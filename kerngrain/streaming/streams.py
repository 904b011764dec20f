"""Streams of events (S8, Q4, ST1-ST6, K3, K4): the batch operators under a watermark.

Event time is wall time. The watermark is taken from all events, before any filter, so that it moves on where a type is rare.
Windows are emitted in append mode, when they are closed. Rows later than the watermark are not lost without a trace:
late_gaps writes a report of them. Sources are bounded per trigger by files or offsets.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import connection_id
from ..operators.loss import delivery_results, gaps, ingest
from ..operators.records import compact, normalize
from ..operators.rules import NODE
from ..operators.select import after
from ..schemas import EVENTS

WATERMARK = "5 minutes"


def event_stream(spark: SparkSession, path: str, files_per_trigger: int = 16) -> DataFrame:
    """Events of schemas.EVENTS from Parquet files as they come, with event_time."""
    rows = spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", files_per_trigger).parquet(path)
    return with_event_time(rows)


def with_event_time(rows: DataFrame) -> DataFrame:
    return rows.withColumn("event_time", F.timestamp_micros(F.expr("observed_at_ns div 1000")))


def _of(rows: DataFrame, condition: str) -> DataFrame:
    """Rows that meet the condition, under a watermark of all rows: Spark moves a filter below the watermark, unless it is one on
    the time, as here (no time is before the first)."""
    return rows.withWatermark("event_time", WATERMARK).where(F.col("event_time") >= F.expr(f"case when {condition} then timestamp_micros(-62135596800000000) end"))


def losses(rows: DataFrame, seconds: int = 10, least: int = 3) -> DataFrame:
    """R12 by sliding windows: connections with at least so many retransmits of a live connection in a window."""
    hits = _of(rows, "event_type = 'kernel.tcp.retransmit' and tcp_state = 'ESTABLISHED'")
    windows = hits.groupBy(F.window("event_time", f"{seconds} seconds", "1 second"), *NODE, connection_id().alias("conn_id"))
    return windows.agg(F.count("*").alias("n"), F.min("event_id").alias("first_id"), F.max("event_id").alias("last_id")).where(F.col("n") >= least)


def failing_backends(rows: DataFrame, seconds: int = 60, least: int = 5) -> DataFrame:
    """R06 by tumbling windows."""
    hits = _of(rows, "event_type = 'kernel.tcp.connect' and ret <> 0")
    return hits.groupBy(F.window("event_time", f"{seconds} seconds"), *NODE, "dst_ip", "dst_port").agg(F.count("*").alias("n")).where(F.col("n") >= least)


def coalesced(rows: DataFrame) -> DataFrame:
    """Retransmits of a connection within a second as one row."""
    hits = _of(rows, "event_type = 'kernel.tcp.retransmit'")
    return hits.groupBy(F.window("event_time", "1 second"), *NODE, connection_id().alias("conn_id")).agg(F.count("*").alias("n"))


def crash_bursts(rows: DataFrame, gap: str = "30 seconds") -> DataFrame:
    """R41 by sessions: a command's failing exits without a longer pause between them."""
    hits = _of(rows, "event_type = 'kernel.process.exit' and ret <> 0")
    return hits.groupBy(F.session_window("event_time", gap), *NODE, "comm").agg(F.count("*").alias("n"))


def once(records: DataFrame) -> DataFrame:
    """ST5, K5: each idempotency key once within the watermark. records: idempotency_key and event_time."""
    return records.withWatermark("event_time", WATERMARK).dropDuplicatesWithinWatermark(["idempotency_key"])


def subscribe(rows: DataFrame, interpreted: bool = False, after_id: str | None = None, **equal: object) -> DataFrame:
    """Q4: the short rows of events that meet all conditions, from behind an id on (F8), with what the first rule says of each, if that is asked for."""
    for k, v in equal.items():
        rows = rows.where(F.col(k) == v)
    found = normalize(rows)
    return compact(found if after_id is None else after(found, after_id), interpreted)


def late_gaps(path: str) -> Callable[[DataFrame, int], None]:
    """ST3 for foreachBatch, of rows with ``late``: on-time rows below path/events, and per node a gap report with the cause late_data of the others
    below path/gaps, by epoch: a batch that is tried again replaces its own. Both together are the input."""

    def write(batch: DataFrame, epoch: int) -> None:
        batch = batch.persist()
        try:
            batch.where("not late").drop("late").write.mode("overwrite").parquet(f"{path}/events/epoch={epoch}")
            gaps(batch.where("late"), "late_data", "cluster", "node_id").write.mode("overwrite").parquet(f"{path}/gaps/epoch={epoch}")
        finally:
            batch.unpersist()

    return write


def ingress(path: str, files: bool = False) -> Callable[[DataFrame, int], None]:
    """K5 for foreachBatch: items (idempotency_key, id, batch_id and the columns of loss.ingest) with their status, once over all micro-batches.

    Keys of accepted items are below path/keys by the hour that their id begins with, and by epoch. A micro-batch reads the hours of its own
    items alone, of epochs before its own, so that the table of keys is never scanned whole and a batch that is tried again decides as
    before and replaces its own keys, items (path/items) and counts (path/results).
    """

    def write(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        items = batch.withColumn("hour", F.expr("try_cast(split_part(id, '-', 1) as bigint) div 3600000")).persist()
        try:
            hours = [r[0] for r in items.select("hour").distinct().collect()]
            spark.range(0).selectExpr("'' as idempotency_key", "0L as hour", "0 as epoch").write.mode("append").partitionBy("hour", "epoch").parquet(f"{path}/keys")
            keys = spark.read.schema("idempotency_key string, hour long, epoch int").parquet(f"{path}/keys")
            before = keys.where(F.col("hour").isin(*[h for h in hours if h is not None]) & (F.col("epoch") < epoch))
            done = ingest(items, before, files=files).persist()
            done.write.mode("overwrite").parquet(f"{path}/items/epoch={epoch}")
            delivery_results(done, "batch_id").write.mode("overwrite").parquet(f"{path}/results/epoch={epoch}")
            accepted = done.where("status = 'ACCEPTED'").select("idempotency_key", "hour", F.lit(epoch).alias("epoch"))
            accepted.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("hour", "epoch").parquet(f"{path}/keys")
            done.unpersist()
        finally:
            items.unpersist()

    return write


def fan_out(primary: Callable[[DataFrame, int], None], secondary: list[Callable[[DataFrame, int], None]], warn: Callable[[int, str], None]) -> Callable[[DataFrame, int], None]:
    """K3 for foreachBatch: the primary must succeed, or nothing else is written; what others raise is a warning."""

    def write(batch: DataFrame, epoch: int) -> None:
        batch = batch.persist()
        try:
            primary(batch, epoch)
            for sink in secondary:
                try:
                    sink(batch, epoch)
                except Exception as e:  # noqa: BLE001
                    warn(epoch, repr(e)[:300])
        finally:
            batch.unpersist()

    return write


def run_once(stream: DataFrame, path: str, checkpoint: str, mode: str = "append", each: Callable[[DataFrame, int], None] | None = None) -> None:
    """All that is there now, to Parquet or to ``each``, and then the end."""
    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True)
    query = writer.foreachBatch(each).start() if each else writer.format("parquet").option("path", path).start()
    query.awaitTermination()
