"""Raw capture rows of all families to event columns in one pass, by declared layouts (S1, S2), and NDJSON (S3).

A layout is rows of (event_type, field, offset, kind) with a size for each type. Kinds are NumPy's little- and big-endian numbers; ``s<n>``, text
up to the first NUL; ``ip``, an address whose family another field of that name tells; ``ip4``, its first four bytes; ``h<n>``, bytes as hexadecimal text; ``full<n>``,
whether a text fills its field, so that it may be cut short. Decoding is one map over Arrow batches of a mixed table: rows of a type become
one matrix of bytes, taken from the batch's own buffer, and a field of all of them is one array. Addresses and other texts
are made once for each distinct value of a batch, or by Arrow alone. Columns other than the bytes pass through, so that nothing is joined back.

Rows shorter than their layout, of a type without one, or with an unsigned number beyond a long have a decode_error and
nulls, and are never dropped; longer rows are fine.
"""

from __future__ import annotations

import ipaddress
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import tcp_state_name
from ..schemas import EVENTS, IDENTITY_METHOD, OCCURRENCE

Layout = tuple[tuple[str, int, str], ...]

#: The structures that the kernel side writes, fields by their offsets; gaps are padding.
_SOCKET = (("observed_at_ns", 0, "<u8"), ("pid", 8, "<u4"), ("tid", 12, "<u4"), ("src_ip", 16, "ip"), ("dst_ip", 32, "ip"), ("src_port", 48, "<u2"), ("dst_port", 50, ">u2"), ("family", 52, "<u2"))
_OPEN = (("observed_at_ns", 0, "<u8"), ("pid", 8, "<u4"), ("uid", 12, "<u4"), ("cgroup_id", 16, "<u8"), ("ret", 24, "<i4"), ("flags", 28, "<u4"), ("comm", 32, "s16"), ("path", 48, "s256"), ("path_truncated", 48, "full256"))
LAYOUTS: dict[str, tuple[Layout, int]] = {
    "kernel.tcp.connect": ((*_SOCKET, ("ret", 56, "<i4"), ("cgroup_id", 64, "<u8"), ("comm", 72, "s16"), ("netns", 88, "<u4")), 96),
    "kernel.tcp.close": ((*_SOCKET, ("bytes_sent", 56, "<u8"), ("bytes_received", 64, "<u8"), ("duration_ns", 72, "<u8"), ("cgroup_id", 80, "<u8"), ("comm", 88, "s16"), ("netns", 104, "<u4")), 112),
    "kernel.tcp.retransmit": ((*_SOCKET, ("state", 54, "<u1"), ("cgroup_id", 64, "<u8"), ("comm", 72, "s16"), ("netns", 88, "<u4")), 96),
    "kernel.process.exec": (
        (("observed_at_ns", 0, "<u8"), ("pid", 8, "<u4"), ("ppid", 12, "<u4"), ("uid", 16, "<u4"), ("gid", 20, "<u4"), ("cgroup_id", 24, "<u8"), ("ret", 32, "<i4"), ("tid", 36, "<u4"),
         ("comm", 40, "s16"), ("filename", 56, "s256"), ("argv_hash", 312, "h32"), ("start_boottime_ns", 344, "<u8")), 352),
    "kernel.file.open": (_OPEN, 304),
    "kernel.file.open_attempt": (_OPEN, 304),
}

_INT = ("u1", "i1", "u2", "i2", "i4")
_DIGITS = np.frombuffer("".join(f"{x:02x}" for x in range(256)).encode(), dtype=np.uint8).reshape(256, 2)


def width(kind: str) -> int:
    """Bytes of a kind."""
    return {"ip": 16, "ip4": 4}.get(kind) or int(kind.lstrip("<>fulshi"))


def width_of_number(kind: str) -> int:
    return int(kind[2:])


def type_of(kind: str) -> pa.DataType:
    if kind[0] in "<>":
        return pa.int32() if kind[1:] in _INT else pa.int64()
    return pa.bool_() if kind.startswith("full") else pa.string()


def fields_of(layouts: dict[str, tuple[Layout, int]]) -> dict[str, pa.DataType]:
    """Names and types of all layouts' fields. Numbers of at most two bytes and signed ones of four are int, other numbers long."""
    out: dict[str, pa.DataType] = {}
    for layout, _ in layouts.values():
        for name, _, kind in layout:
            if out.setdefault(name, type_of(kind)) != type_of(kind):
                raise ValueError(f"field {name} has two types")
    return out


def layouts_of(rows: Iterable[tuple[str, str, int, str]], sizes: dict[str, int] | None = None) -> dict[str, tuple[Layout, int]]:
    """Layouts declared as rows (event_type, field, offset, kind); a size is the end of the last field unless it is given."""
    found: dict[str, list[tuple[str, int, str]]] = {}
    for event_type, field, offset, kind in rows:
        found.setdefault(event_type, []).append((field, offset, kind))
    end = lambda x: x[1] + (width_of_number(x[2]) if x[2][0] in "<>" else width(x[2]))
    return {t: (tuple(f), (sizes or {}).get(t) or max(map(end, f))) for t, f in found.items()}


def texts(block: np.ndarray) -> pa.Array:
    """E5 for rows of bytes: up to the first NUL; bytes that aren't UTF-8 give the empty text."""
    zero = block == 0
    ends = np.where(zero.any(axis=1), zero.argmax(axis=1), block.shape[1]).astype(np.int32)
    data = block[np.arange(block.shape[1]) < ends[:, None]].tobytes()
    raw = pa.Array.from_buffers(pa.binary(), len(block), [None, pa.py_buffer(np.concatenate([[0], np.cumsum(ends)]).astype(np.int32)), pa.py_buffer(data)])
    try:
        return raw.cast(pa.string())
    except pa.ArrowInvalid:
        whole = raw.dictionary_encode()
        return pa.array([_text(x) for x in whole.dictionary.to_pylist()], pa.string()).take(whole.indices)


def _text(raw: bytes) -> str:
    try:
        return raw.decode()
    except UnicodeDecodeError:
        return ""


def address(raw: bytes, family: int) -> str:
    """Family 10 is IPv6 in its canonical text; else the first four bytes."""
    return str(ipaddress.IPv6Address(raw) if family == 10 else ipaddress.IPv4Address(raw[:4]))


def addresses(block: np.ndarray, family: np.ndarray) -> pa.Array:
    """E4 for rows of bytes, each distinct address once."""
    keys = block.copy()
    keys[family != 10, 4:] = 0
    keys = np.concatenate([keys, (family == 10)[:, None].astype(np.uint8)], axis=1)
    found, at = np.unique(keys.view(f"V{keys.shape[1]}").ravel(), return_inverse=True)
    return pa.array([address(bytes(x)[:-1], 10 if bytes(x)[-1] else 2) for x in found], pa.string()).take(pa.array(at))


def _values(rows: np.ndarray, at: int, kind: str, family: np.ndarray) -> pa.Array:
    if kind[0] in "<>":
        n = width_of_number(kind)
        return pa.array(np.ascontiguousarray(rows[:, at : at + n]).view(kind).ravel().astype(np.int64)).cast(type_of(kind))
    block = rows[:, at : at + width(kind)]
    if kind in ("ip", "ip4"):
        return addresses(block, family if kind == "ip" else np.zeros(len(rows), dtype=np.int64))
    if kind[0] == "s":
        return texts(block)
    if kind[0] == "h":
        return texts(_DIGITS[block].reshape(len(rows), -1))
    return pa.array((block != 0).all(axis=1))


def decode(captures: DataFrame, layouts: dict[str, tuple[Layout, int]] | None = None) -> DataFrame:
    """captures (event_type, raw and anything else) with every field of the layouts, null where a type has no such field, and decode_error."""
    layouts = layouts or LAYOUTS
    fields = fields_of(layouts)
    kept = [c for c in captures.columns if c not in fields and c not in ("raw", "decode_error")]
    beyond = np.uint64(2**63 - 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, raw, kinds = batch.num_rows, batch.column("raw"), batch.column("event_type").dictionary_encode()
            ends = np.frombuffer(raw.buffers()[1], dtype=np.int32)[raw.offset : raw.offset + n + 1].astype(np.int64) if n else np.zeros(1, dtype=np.int64)
            data = np.frombuffer(raw.buffers()[2], dtype=np.uint8) if raw.buffers()[2] is not None else np.zeros(0, dtype=np.uint8)
            sizes = np.where(raw.is_null().to_numpy(zero_copy_only=False), -1, np.diff(ends))
            codes = kinds.indices.fill_null(-1).to_numpy(zero_copy_only=False)
            errors = np.full(n, "no layout", dtype=object)
            pieces: dict[str, list[pa.Array]] = {f: [] for f in fields}
            places: dict[str, list[np.ndarray]] = {f: [] for f in fields}
            for code, name in enumerate(kinds.dictionary.to_pylist()):
                if name not in layouts:
                    continue
                layout, size = layouts[name]
                mine = codes == code
                errors[mine] = "too short"
                at = np.flatnonzero(mine & (sizes >= size))
                rows = data[ends[at][:, None] + np.arange(size)] if len(at) else np.zeros((0, size), dtype=np.uint8)
                large = np.zeros(len(at), dtype=bool)
                for _, offset, kind in layout:
                    if kind[1:] == "u8":
                        large |= np.ascontiguousarray(rows[:, offset : offset + 8]).view(kind).ravel().astype(np.uint64) > beyond
                errors[at] = np.where(large, "out of range", None)
                at, rows = at[~large], rows[~large]
                if not len(at):
                    continue
                family = next((np.ascontiguousarray(rows[:, o : o + 2]).view("<u2").ravel() for f, o, _ in layout if f == "family"), np.zeros(len(at), dtype=np.uint16))
                for field, offset, kind in layout:
                    pieces[field].append(_values(rows, offset, kind, family))
                    places[field].append(at)
            out = []
            for field, t in fields.items():
                one = pa.concat_arrays([*pieces[field], pa.nulls(1, t)])
                order = np.full(n, len(one) - 1)
                if places[field]:
                    found = np.concatenate(places[field])
                    order[found] = np.arange(len(found))
                out.append(one.take(pa.array(order)))
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in kept], *out, pa.array(errors, pa.string())], names=[*kept, *fields, "decode_error"])

    text = {pa.string(): "string", pa.int32(): "int", pa.int64(): "long", pa.bool_(): "boolean"}
    ddl = [f"`{f.name}` {f.dataType.simpleString()}" for f in captures.select(*kept).schema] + [f"`{f}` {text[t]}" for f, t in fields.items()] + ["decode_error string"]
    needed = [c for c in ("event_type", "raw") if c not in kept]
    return captures.select(*kept, *needed).mapInArrow(run, ", ".join(ddl))


def to_events(decoded: DataFrame) -> DataFrame:
    """Decoded rows without an error as events of schemas.EVENTS and other columns that they bring: state by name, and
    how a process is told apart from later ones of its number, where its start is known."""
    rows = decoded.where("decode_error is null").drop("decode_error")
    if "state" in rows.columns:
        rows = rows.withColumn("tcp_state", F.when(F.col("event_type") == "kernel.tcp.retransmit", tcp_state_name(F.col("state"))))
    if "start_boottime_ns" in rows.columns:
        rows = rows.withColumn("identity_method", F.when(F.col("start_boottime_ns") != 0, IDENTITY_METHOD))
    types = dict(x.split() for x in EVENTS.split(", "))
    mine = [(F.col(c) if c in rows.columns else F.lit(None)).cast(t).alias(c) for c, t in types.items()]
    return rows.select(*mine, *[c for c in rows.columns if c not in types and c not in ("state", "family")])


#: Parts of names that declared fields are known by (S2), first match first.
ROLES = (("skc_rcv_saddr", "src_ip"), ("src_addr", "src_ip"), ("skc_daddr", "dst_ip"), ("dst_addr", "dst_ip"), ("skc_num", "src_port"), ("src_port", "src_port"), ("skc_dport", "dst_port"), ("dst_port", "dst_port"))
DECLARED = {"u8": "<u1", "u16": "<u2", "u32": "<u4", "u64": "<u8", "i32": "<i4", "i64": "<i8"}


def declared(rows: Iterable[tuple[str, str, int, str]], sizes: dict[str, int]) -> dict[str, tuple[Layout, int]]:
    """Layouts of (event_type, field, offset, type u8 to i64), behind the common head of time, pid and tid. Names tell addresses,
    ports, comm and ret; every other field keeps its own name, which to_declared makes an entity."""
    out: dict[str, list[tuple[str, int, str]]] = {t: [("observed_at_ns", 0, "<u8"), ("pid", 8, "<u4"), ("tid", 12, "<u4")] for t in sizes}
    for event_type, field, offset, kind in rows:
        role = next((r for part, r in ROLES if part in field), None)
        if field in ("pid", "tid", "timestamp_ns"):
            continue
        if role:
            out[event_type].append((role, offset, "ip4" if role.endswith("ip") else "<u2" if role == "src_port" else ">u2"))
        else:
            out[event_type].append((field, offset, "s16" if field == "comm" else "<i4" if field == "ret" else DECLARED[kind]))
    return {t: (tuple(f), sizes[t]) for t, f in out.items()}


def to_declared(captures: DataFrame, layouts: dict[str, tuple[Layout, int]]) -> DataFrame:
    """Captures by declared layouts: network, process and result columns, and ``entity_ids`` with process:<pid> and name:value of every other field."""
    known = {"observed_at_ns", "pid", "tid", "comm", "ret", "src_ip", "dst_ip", "src_port", "dst_port"}
    rows = decode(captures, layouts)
    other = [f for f in fields_of(layouts) if f not in known]
    entities = F.array_compact(F.array(F.concat(F.lit("process:"), "pid"), *[F.concat(F.lit(f"{f}:"), F.col(f).cast("string")) for f in other]))
    types = dict(x.split() for x in EVENTS.split(", "))
    missing = {c: F.lit(None).cast(types.get(c, "long")) for c in known if c not in rows.columns}
    return rows.withColumns({**missing, "entity_ids": entities}).drop(*other)


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """S3: one record of JSON per line; what can't be read is in _corrupt_record."""
    return spark.read.schema(OCCURRENCE + ", _corrupt_record string").option("mode", "PERMISSIVE").json(path)


def write_records(records: DataFrame, path: str) -> None:
    """K2: appends records as lines of JSON, without nulls."""
    records.write.mode("append").json(path)
