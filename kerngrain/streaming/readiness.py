"""Readiness of streams (ST7): what they report of their progress as a table, and whether they are stalled."""

from __future__ import annotations

import time
from collections import deque

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

PROGRESS = "query string, name string, kind string, at_ms long, epoch long, rows long, behind long, watermark string, state_rows long, took_ms long"
#: Metrics by which sources tell how much lies before them, offsets or files; those that don't leave ``behind`` null.
BEHIND = ("maxOffsetsBehindLatest", "numFilesOutstanding")


class Progress(StreamingQueryListener):
    """Keeps the last ``most`` reports of the streams of a session. Register it by spark.streams.addListener."""

    def __init__(self, most: int = 10_000) -> None:
        self.reports: deque = deque(maxlen=most)

    def _add(self, query: object, name: str | None, kind: str, **more: object) -> None:
        row = {c.split()[0]: None for c in PROGRESS.split(", ")} | {"query": str(query), "name": name, "kind": kind, "at_ms": int(time.time() * 1000)} | more
        self.reports.append(tuple(row.values()))

    def onQueryStarted(self, event) -> None:  # noqa: ANN001
        self._add(event.id, event.name, "started")

    def onQueryProgress(self, event) -> None:  # noqa: ANN001
        p = event.progress
        told = [int(float(x.metrics[k])) for x in p.sources for k in BEHIND if x.metrics and k in x.metrics]
        self._add(p.id, p.name, "progress", epoch=p.batchId, rows=p.numInputRows, behind=sum(told) if told else None, watermark=(p.eventTime or {}).get("watermark"),
                  state_rows=sum(x.numRowsTotal for x in p.stateOperators), took_ms=int((p.durationMs or {}).get("triggerExecution", 0)))

    def onQueryIdle(self, event) -> None:  # noqa: ANN001
        self._add(event.id, None, "idle")

    def onQueryTerminated(self, event) -> None:  # noqa: ANN001
        self._add(event.id, None, "failed" if event.exception else "terminated")

    def table(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(list(self.reports), PROGRESS)


def readiness(progress: DataFrame, now_ms: int, stalled_ms: int = 60_000) -> DataFrame:
    """A row for each stream: its rows so far, what it is behind, and whether it is live, stalled and ready.

    A stream is stalled if its last report (a start, a progress or an idle trigger) is older than ``stalled_ms`` while it runs: one
    that has nothing to do says so. Liveness is only whether it runs and does not look at what it is behind.
    """
    last = F.max_by(F.struct("kind", "at_ms"), F.struct("at_ms", F.col("kind").isin("terminated", "failed"))).alias("last")
    latest = lambda c: F.max_by(c, F.when(F.col("kind") == "progress", F.col("epoch"))).alias(c)
    rows = progress.groupBy("query").agg(last, F.coalesce(F.sum("rows"), F.lit(0)).alias("rows"), latest("behind"), latest("state_rows"))
    live = ~F.col("last.kind").isin("terminated", "failed")
    age = F.lit(now_ms) - F.col("last.at_ms")
    stalled = live & (age > stalled_ms)
    return rows.select("query", "rows", "behind", "state_rows", age.alias("age_ms"), live.alias("live"), stalled.alias("stalled"), (live & ~stalled).alias("ready"))
