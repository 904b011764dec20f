"""Operators that keep state in a stream: counters (W3), pods (W4, S4), pairs of enter and exit (J3), loss by lateness (ST3).

Each is a stateful processor with typed state in Spark's state store, which needs the RocksDB provider (``stateful`` sets it for a
query). Where order matters, rows wait in state until the watermark has passed them and are then taken in order, so that the result does not
depend on how rows are dealt over files and batches; a timer of each key wakes it at its earliest waiting row. A row that is
later than the watermark is dropped by Spark, and counted by ``lateness`` ahead of it.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from typing import Any

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import BinaryType, BooleanType, DataType, LongType, StringType, StructType

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_SETTING = "spark.sql.streaming.stateStore.providerClass"
_TYPES: dict[str, DataType] = {"long": LongType(), "string": StringType(), "boolean": BooleanType(), "binary": BinaryType()}
_ARROW = {"long": pa.int64(), "string": pa.string(), "boolean": pa.bool_()}


def columns(ddl: str) -> StructType:
    """A schema of names and types, without a session, as workers have none."""
    out = StructType()
    for name, kind in (x.split() for x in ddl.split(", ")):
        out = out.add(name, _TYPES[kind])
    return out


def _cells(column: pa.ChunkedArray) -> list:
    """A column's values. NumPy's list is quicker, but makes floating-point numbers of longs with nulls."""
    return column.to_pylist() if column.null_count and not pa.types.is_string(column.type) else column.to_numpy().tolist()


@contextmanager
def stateful(spark: SparkSession) -> Iterator[None]:
    """Queries that are started in here keep their state where typed state can be kept."""
    before = spark.conf.get(_SETTING, None)
    spark.conf.set(_SETTING, PROVIDER)
    try:
        yield
    finally:
        spark.conf.unset(_SETTING) if before is None else spark.conf.set(_SETTING, before)


class InOrder(StatefulProcessor):
    """Rows of a key in order of (order, tie), once the watermark has passed their ``at_ms``; a row that comes twice counts once. Subclasses name the columns that rows keep
    while they wait (``row``), the columns that they give (``out``), and take one row at a time.

    Rows wait in blocks of at most ``block`` rows, those of one time together, as Arrow's bytes: one call to the state store for each block. Its name holds its first
    time and its least (order, tie), so that blocks which the watermark has not reached aren't read.
    """

    row: str
    out: str
    quiet_ms: int | None = None  # after so long without a row, in event time, a key is finished
    block = 1 << 14

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        kinds = dict(x.split() for x in ("order long, tie long, at_ms long, " + self.row).split(", "))
        self.kept = pa.schema([(name, _ARROW[kind]) for name, kind in kinds.items()])
        self.given = [x.split()[0] for x in self.out.split(", ")]
        self.waiting = handle.getMapState("waiting", columns("at_ms long, order long, tie long, number long"), columns("rows binary"))
        self.wake = handle.getValueState("wake", columns("at_ms long, blocks long"))
        self.latest = handle.getValueState("latest", columns("at_ms long"))
        self.opened(handle)

    def opened(self, handle: StatefulProcessorHandle) -> None:
        raise NotImplementedError

    def begin(self) -> None:
        """Before rows are taken."""

    def take(self, key: tuple, order: int, row: dict[str, Any]) -> list[tuple]:
        raise NotImplementedError

    def end(self) -> None:
        """After rows were taken."""

    def finish(self, key: tuple) -> list[tuple]:
        """What a quiet key leaves."""
        return []

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        wake, blocks = self.wake.get() or (None, 0)
        first = None
        for pdf in rows:
            if len(pdf):
                # longs with nulls come as floating-point numbers
                part = pa.table([pa.array(pdf[x.name], x.type, from_pandas=True) for x in self.kept], schema=self.kept)
                at, blocks = self._keep(part, blocks)
                first = at if first is None else min(first, at)
        if first is not None:
            self._wake_at(wake, first, blocks)
        yield pd.DataFrame(columns=self.given)

    def _keep(self, rows: pa.Table, blocks: int) -> tuple[int, int]:
        """Rows as further blocks; the first time among them, and the number of blocks so far."""
        rows = rows.sort_by("at_ms")
        for i in range(0, rows.num_rows, self.block):
            (part,) = rows.slice(i, self.block).combine_chunks().to_batches()
            at, order, tie = (part[c].to_numpy() for c in ("at_ms", "order", "tie"))
            least, blocks = order.min(), blocks + 1
            self.waiting.updateValue((int(at[0]), int(least), int(tie[order == least].min()), blocks), (part.serialize().to_pybytes(),))
        return rows["at_ms"][0].as_py(), blocks

    def _wake_at(self, known: int | None, at_ms: int, blocks: int) -> None:
        """A timer at the time, unless there is an earlier one."""
        if known is None or at_ms < known:
            if known is not None:
                self.handle.deleteTimer(known)
            self.handle.registerTimer(at_ms)
            known = at_ms
        self.wake.update((known, blocks))

    def _due(self, until: int, blocks: int) -> tuple[pa.Table, int | None, int]:
        """Of rows in order, those before the first that the watermark has not passed; when the next is due, and the number of blocks so far. The rows given wait no longer."""
        names = sorted((tuple(k) for k in self.waiting.keys()), key=lambda k: k[3])
        later = [k for k in names if k[0] > until]
        found = []
        for k in names:
            if k[0] <= until:
                found.append(pa.ipc.read_record_batch(pa.py_buffer(bytes(self.waiting.getValue(k)[0])), self.kept))
                self.waiting.removeKey(k)
        rows = pa.Table.from_batches(found, self.kept).combine_chunks()
        order, tie, at = (rows[c].to_numpy() for c in ("order", "tie", "at_ms"))
        place = np.lexsort((tie, order))  # of equal ones the first that came stays first
        order, tie = order[place], tie[place]
        new = np.ones(len(place), bool)
        new[1:] = (order[1:] != order[:-1]) | (tie[1:] != tie[:-1])
        place, order, tie = place[new], order[new], tie[new]
        waits = at[place] > until
        if later:
            held = min(k[1:3] for k in later)
            waits |= (order > held[0]) | ((order == held[0]) & (tie >= held[1]))
        n = int(waits.argmax()) if waits.any() else len(place)
        left = min((k[0] for k in later), default=None)
        if n < len(place):
            first, blocks = self._keep(rows.take(place[n:]), blocks)
            left = first if left is None else min(left, first)
        return rows.take(place[:n]), left, blocks

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        until = timerValues.getCurrentWatermarkInMs()
        rows, left, blocks = self._due(until, self.wake.get()[1])
        names = self.kept.names[2:]
        if rows.num_rows:
            self.begin()
            for i in range(0, rows.num_rows, self.block):
                made: list[tuple] = []
                order, _, *cells = (_cells(c) for c in rows.slice(i, self.block).columns)
                for o, *values in zip(order, *cells, strict=True):
                    made += self.take(tuple(key), o, dict(zip(names, values, strict=True)))
                yield pd.DataFrame(made, columns=self.given)
            self.end()
            if self.quiet_ms is not None:
                self.latest.update((rows["at_ms"][-1].as_py(),))
        self.wake.clear()
        made = []
        if left is not None:
            self._wake_at(None, max(left, until + 1), blocks)
        elif self.quiet_ms is not None and self.latest.exists():
            due = self.latest.get()[0] + self.quiet_ms
            if due <= until:
                made = self.finish(tuple(key))
                self.latest.clear()
            else:
                self._wake_at(None, due, blocks)
        yield pd.DataFrame(made, columns=self.given)

    def close(self) -> None:
        pass


class CounterDeltas(InOrder):
    """What a counter grew by; one that went back counts from zero."""

    row = "polled_ns long, dropped long, tracking_start_ns long"
    out = "cluster string, node_id string, probe_id string, polled_ns long, delta long, from_ns long"

    def opened(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", columns("polled_ns long, dropped long"))

    def take(self, key: tuple, order: int, row: dict[str, Any]) -> list[tuple]:
        before = self.last.get()
        dropped, polled = row["dropped"], row["polled_ns"]
        self.last.update((polled, dropped))
        from_ns, had = (row["tracking_start_ns"], 0) if before is None else before
        return [(*key, polled, dropped if dropped < had else dropped - had, from_ns)]


class PodWatch(InOrder):
    """The changes of a cluster's pods by its watch: apply and delete, and listings from init over init_apply to init_done. Pods that a whole listing
    doesn't name are deleted at its end, once; a listing that begins anew before its end deletes nothing. A key is a cluster's share of pods, with all its listings."""

    row = "op string, pod_uid string, pod string"
    out = "cluster string, seq long, op string, pod_uid string, pod string"

    def opened(self, handle: StatefulProcessorHandle) -> None:
        self.pods = handle.getMapState("pods", columns("pod_uid string"), columns("listing long"))
        self.listing = handle.getValueState("listing", columns("number long, open boolean"))

    def begin(self) -> None:
        self.before = {k[0]: v[0] for k, v in self.pods.iterator()}
        self.now = dict(self.before)
        self.number, self.is_open = self.listing.get() or (0, False)

    def take(self, key: tuple, order: int, row: dict[str, Any]) -> list[tuple]:
        op, uid, cluster = row["op"], row["pod_uid"], key[0]
        if op == "init":
            self.number, self.is_open = self.number + 1, True
        elif op in ("apply", "init_apply"):
            self.now[uid] = self.number
            return [(cluster, order, "apply", uid, row["pod"])]
        elif op == "delete":
            if self.now.pop(uid, None) is not None:
                return [(cluster, order, "delete", uid, None)]
        elif op == "init_done" and self.is_open:
            self.is_open = False
            gone = sorted(x for x, listed in self.now.items() if listed < self.number)
            for x in gone:
                del self.now[x]
            return [(cluster, order, "delete", x, None) for x in gone]
        return []

    def end(self) -> None:
        for x in self.before.keys() - self.now.keys():
            self.pods.removeKey((x,))
        for x, listed in self.now.items():
            if self.before.get(x) != listed:
                self.pods.updateValue((x,), (listed,))
        self.listing.update((self.number, self.is_open))


class Pairing(InOrder):
    """An enter keeps its path, an exit takes and clears it."""

    row = "event_id long, kind string, path string"
    out = "cluster string, node_id string, boot_id string, pid long, event_id long, path string"

    def opened(self, handle: StatefulProcessorHandle) -> None:
        self.path = handle.getValueState("path", columns("path string"))

    def take(self, key: tuple, order: int, row: dict[str, Any]) -> list[tuple]:
        kept = self.path.get()
        if row["kind"] == "enter":
            self.path.update((row["path"],))
            return []
        self.path.clear()
        return [(*key, row["event_id"], kept[0])] if kept is not None and kept[0] is not None else []


class Connections(InOrder):
    """A connection from connect to close with its retransmits; one that is quiet for so long is given as open."""

    row = "event_id long, observed_at_ns long, event_type string, ret long, bytes_sent long, bytes_received long"
    out = (
        "cluster string, node_id string, boot_id string, src_ip string, src_port long, dst_ip string, dst_port long, connect_id long, begin_ns long, ret long, "
        "close_id long, end_ns long, bytes_sent long, bytes_received long, losses long, lifetime_ns long, state string"
    )
    _none = (None, None, None, 0)

    def __init__(self, quiet_ms: int) -> None:
        self.quiet_ms = quiet_ms

    def opened(self, handle: StatefulProcessorHandle) -> None:
        self.now = handle.getValueState("now", columns("connect_id long, begin_ns long, ret long, losses long"))

    @staticmethod
    def _row(key: tuple, now: tuple, close: dict[str, Any] | None, state: str) -> tuple:
        connect_id, begin, ret, losses = now
        end = close["observed_at_ns"] if close else None
        state = "failed" if ret else state
        return (*key, connect_id, begin, ret, close["event_id"] if close else None, end, close["bytes_sent"] if close else None, close["bytes_received"] if close else None, losses, end - begin if close and begin is not None else None, state)

    def take(self, key: tuple, order: int, row: dict[str, Any]) -> list[tuple]:
        known = self.now.get()
        now = tuple(known) if known is not None else None
        kind = row["event_type"]
        if kind not in ("kernel.tcp.connect", "kernel.tcp.close", "kernel.tcp.retransmit"):
            return []
        if kind == "kernel.tcp.retransmit":
            now = now or self._none
            self.now.update((*now[:3], now[3] + 1))
            return []
        if kind == "kernel.tcp.close":
            self.now.clear()
            now = now or self._none
            return [self._row(key, now, row, "closed" if now[0] is not None else "closed_unseen")]
        out = [self._row(key, now, None, "superseded" if now[0] is not None else "unseen")] if now else []
        if kind == "kernel.tcp.connect":
            self.now.update((row["event_id"], row["observed_at_ns"], row["ret"], 0))
        return out

    def finish(self, key: tuple) -> list[tuple]:
        known = self.now.get()
        self.now.clear()
        return [self._row(key, tuple(known), None, "open" if known[0] is not None else "unseen")] if known is not None else []


class Lateness(StatefulProcessor):
    """ST3: rows with whether they are late: older by more than ``delay_ns`` than the newest row of their node in the batches before. One number is kept for each node."""

    def __init__(self, delay_ns: int) -> None:
        self.delay_ns = delay_ns

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.newest = handle.getValueState("newest", columns("ns long"))

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        before = self.newest.get()
        mark = None if before is None else before[0]
        newest = mark
        for pdf in rows:
            last = int(pdf["observed_at_ns"].max())
            newest = last if newest is None else max(newest, last)
            yield pdf[["row"]].assign(late=False if mark is None else pdf["observed_at_ns"] < mark - self.delay_ns)
        if newest is not None:
            self.newest.update((newest,))

    def close(self) -> None:
        pass


def with_lateness(rows: DataFrame, delay_ns: int = 300_000_000_000) -> DataFrame:
    """ST3: rows (cluster, node_id, observed_at_ns and anything else) with ``late``; none is dropped, as no watermark is involved.

    The row itself passes as JSON, as pandas would make doubles of longs with nulls among them.
    """
    exact = {"timestampFormat": "yyyy-MM-dd HH:mm:ss.SSSSSS"}
    thin = rows.select("cluster", "node_id", "observed_at_ns", F.to_json(F.struct(*rows.columns), exact).alias("row"))
    flagged = thin.groupBy("cluster", "node_id").transformWithStateInPandas(Lateness(delay_ns), columns("row string, late boolean"), "Append", "None")
    return flagged.select(F.from_json("row", rows.schema.simpleString(), exact).alias("row"), "late").select("row.*", "late")


def run_in_order(rows: DataFrame, processor: InOrder, keys: list[str], order: str, tie: str, delay: str) -> DataFrame:
    """Rows with event_time through a processor, by keys."""
    timed = rows.withWatermark("event_time", delay).withColumns({"order": F.col(order).cast("long"), "tie": F.col(tie).cast("long"), "at_ms": F.unix_millis("event_time")})
    needed = dict.fromkeys(["event_time", *keys, "order", "tie", "at_ms", *[x.split()[0] for x in processor.row.split(", ")]])
    return timed.select(*needed).groupBy(*keys).transformWithStateInPandas(processor, columns(processor.out), "Append", "EventTime")


def counter_deltas(samples: DataFrame, delay: str = "5 minutes") -> DataFrame:
    """W3 as a stream: samples (cluster, node_id, probe_id, polled_ns, dropped, tracking_start_ns, event_time); a poll that is seen twice counts once."""
    return run_in_order(samples, CounterDeltas(), ["cluster", "node_id", "probe_id"], "polled_ns", "polled_ns", delay)


def pod_changes(watch: DataFrame, delay: str = "5 minutes", shares: int = 16) -> DataFrame:
    """S4 and W4 as a stream: watch (cluster, seq, op, pod_uid, pod, event_time) to applies and deletes, in order of seq within a cluster.

    A cluster's pods are dealt over ``shares`` keys, and the begin and end of its listings go to each of these, so that a cluster's rows don't meet in one task.
    """
    own = F.array(F.pmod(F.xxhash64("pod_uid"), F.lit(shares)))
    dealt = watch.withColumn("share", F.explode(F.when(F.col("op").isin("init", "init_done"), F.expr(f"sequence(0L, {shares - 1}L)")).otherwise(own)))
    return run_in_order(dealt, PodWatch(), ["cluster", "share"], "seq", "seq", delay)


def paired(rows: DataFrame, delay: str = "5 minutes") -> DataFrame:
    """J3 as a stream: rows (cluster, node_id, boot_id, pid, event_id, observed_at_ns, kind, path, event_time)."""
    return run_in_order(rows, Pairing(), ["cluster", "node_id", "boot_id", "pid"], "observed_at_ns", "event_id", delay)


def lifetimes(rows: DataFrame, delay: str = "5 minutes", quiet_ms: int = 3_600_000) -> DataFrame:
    """J4 as a stream: connects, closes and retransmits of schemas.EVENTS with event_time, in order of time; a connection
    without a row for ``quiet_ms`` is given as open and forgotten. Other rows move the watermark alone."""
    return run_in_order(rows, Connections(quiet_ms), ["cluster", "node_id", "boot_id", "src_ip", "src_port", "dst_ip", "dst_port"], "observed_at_ns", "event_id", delay)
