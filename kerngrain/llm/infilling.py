"""Fill-in-the-middle form of texts: cut at two line boundaries, told apart by sentinels, and rebuilt exactly.

A text of n lines is cut after the smaller and the larger of two draws from 0 to n; the draws are digests of seed and id.
Lines are counted by content-defined chunks: a rolling hash of the last ``WINDOW`` bytes cuts the text, so that a passage is cut
alike wherever it occurs. Each worker keeps the summary of every chunk it has met, by the chunk's bytes, so that two chunks
share a summary only if they are the same: its line ends, its code points, and where its line ends lie. Running sums
over a text's chunks find the chunk that holds a cut, its line ends the cut itself, and code points are summed the same way;
chunks met before are not counted again. What is kept is emptied at a bounded size (``KEEP``, in bytes), which changes no result.

A text that is empty or holds a sentinel stays plain, as do those beyond ``rate``; of the others a share of ``spm`` percent has the
suffix first. ``restored`` rebuilds the text from output and form; a sentinel can't arise across a join, as it begins with its only "<".

Edge cases: null texts count as empty. A null id is drawn for as the empty text. Repeated rows are alike. Very long texts are
used whole, also without any line end or chunk cut. Line ends are "\\n" alone; "\\r" belongs to its line. No rows: no rows. Further columns stay, if they are
carried; result columns replace columns of their own names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._shared import free_name

SENTINELS = ("<P>", "<S>", "<M>")
SEED, RATE, SPM = 7, 100, 50
WINDOW, BITS, KEEP, BLOCK = 16, 9, 64_000_000, 1 << 22
_BASE = 0x9E3779B97F4A7C15


def cut_places(data: bytes) -> list[int]:
    """Where chunks end: after every byte at which the polynomial of the last WINDOW bytes, modulo 2**64, begins with BITS zero bits.

    By doubling: the polynomial of 2k bytes is that of the first k times a power and that of the last k, so that four steps make a
    window of 16; in blocks, so that memory is bounded for texts of any length."""
    out: list[int] = []
    for begin in range(0, len(data), BLOCK):
        codes = np.frombuffer(data[max(0, begin - WINDOW + 1) : begin + BLOCK], dtype=np.uint8).astype(np.uint64)
        if len(codes) < WINDOW:
            continue
        h, power, width = (codes + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93), _BASE, 1
        h ^= h >> np.uint64(32)
        while width < WINDOW:
            h = h[:-width] * np.uint64(power) + h[width:]
            power, width = power * power % 2**64, 2 * width
        out += (np.flatnonzero(h >> np.uint64(64 - BITS) == 0) + (max(0, begin - WINDOW + 1) + WINDOW)).tolist()
    return [x for x in out if x < len(data)]


class Lines:
    """Line ends of texts by chunks that are summarized once."""

    def __init__(self, keep: int = KEEP) -> None:
        self.known: dict[bytes, tuple[int, int, np.ndarray]] = {}
        self.kept, self.keep, self.met, self.made = 0, keep, 0, 0

    def summary(self, chunk: bytes) -> tuple[int, int, np.ndarray]:
        """Line ends, code points, and the places after the line ends of a chunk."""
        self.met += 1
        found = self.known.get(chunk)
        if found is None:
            codes = np.frombuffer(chunk, dtype=np.uint8)
            ends = np.flatnonzero(codes == 10).astype(np.int32) + 1
            found = len(ends), int(np.count_nonzero(codes & 0xC0 != 0x80)), ends
            self.made += 1
            if self.kept > self.keep:
                self.known, self.kept = {}, 0
            self.known[chunk] = found
            self.kept += len(chunk) + ends.nbytes + 200
        return found

    def of(self, data: bytes) -> Counted:
        bounds = [0, *cut_places(data), len(data)]
        return Counted(data, bounds, [self.summary(data[a:b]) for a, b in zip(bounds, bounds[1:], strict=False)])


class Counted:
    """A text as chunks with running sums of their counts."""

    def __init__(self, data: bytes, bounds: list[int], parts: list[tuple[int, int, np.ndarray]]) -> None:
        self.data, self.bounds, self.parts = data, bounds, parts
        self.ends = np.cumsum([0, *[p[0] for p in parts]])
        self.points = np.cumsum([0, *[p[1] for p in parts]])
        self.n = int(self.ends[-1]) + (1 if data and data[-1:] != b"\n" else 0)

    def after(self, lines: int) -> tuple[int, int]:
        """The byte and the code point after so many lines."""
        if lines <= 0:
            return 0, 0
        if lines > self.ends[-1]:
            return len(self.data), int(self.points[-1])
        at = int(np.searchsorted(self.ends, lines)) - 1  # the chunk that holds the line end
        begin = self.bounds[at]
        byte = begin + int(self.parts[at][2][lines - int(self.ends[at]) - 1])
        inside = np.frombuffer(self.data[begin:byte], dtype=np.uint8)
        return byte, int(self.points[at]) + int(np.count_nonzero(inside & 0xC0 != 0x80))


_LINES: list[Lines] = []


def draws(doc_id: Column, seed: int) -> list[Column]:
    """The first four groups of eight hexadecimal digits of the digest of seed and id, as numbers."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long") for i in range(4)]


def fill_in_middle(docs: DataFrame, seed: int = SEED, rate: int = RATE, spm: int = SPM, sentinels: tuple[str, str, str] = SENTINELS, carry: list[str] | None = None) -> DataFrame:
    """The carried columns of docs (all, by default) with n, form (plain, psm, spm), prefix_chars, middle_chars and output.

    docs: doc_id, text and anything else. Of the texts that could be cut, ``rate`` percent are, and of these ``spm`` percent suffix first.
    """
    ours = {"n": "long", "form": "string", "prefix_chars": "long", "middle_chars": "long", "output": "string"}
    carried = [c for c in (docs.columns if carry is None else carry) if c.lower() not in ours]
    hashes = [free_name(docs, f"h{i}") for i in range(1, 5)]
    whole = free_name(docs, "whole")
    rows = docs.select(*carried, *[h.alias(x) for h, x in zip(draws(F.col("doc_id"), seed), hashes, strict=True)], F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary").alias(whole))
    p, s, m = (x.encode() for x in sentinels)

    def one(lines: Lines, data: bytes, h: tuple[int, ...]) -> tuple[int, str, int | None, int | None, bytes]:
        text = lines.of(data)
        if not data or any(x in data for x in (p, s, m)) or h[2] % 100 >= rate:
            return text.n, "plain", None, None, data
        first, second = sorted(x % (text.n + 1) for x in h[:2])
        (a, a_points), (b, b_points) = text.after(first), text.after(second)
        prefix, middle, suffix = data[:a], data[a:b], data[b:]
        form = "spm" if h[3] % 100 < spm else "psm"
        out = [s, suffix, p, prefix, m, middle] if form == "spm" else [p, prefix, s, suffix, m, middle]
        return text.n, form, a_points, b_points - a_points, b"".join(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not _LINES:
            _LINES.append(Lines())
        kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string()]
        for batch in batches:
            ids = list(zip(*(batch.column(len(carried) + i).to_pylist() for i in range(4)), strict=True))
            made = [one(_LINES[0], x.as_py(), h) for x, h in zip(batch.column(batch.num_columns - 1), ids, strict=True)]
            columns = [pa.array([x[i] for x in made], pa.binary() if t == pa.string() else t).cast(t) for i, t in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(carried)], *columns], names=[*batch.schema.names[: len(carried)], *ours])

    schema = [f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*carried).schema]
    return rows.mapInArrow(run, ", ".join([*schema, *[f"{n} {t}" for n, t in ours.items()]]))


def restored(output: Column, form: Column, sentinels: tuple[str, str, str] = SENTINELS) -> Column:
    """The text that an output was made from."""
    p, s, m = map(F.lit, sentinels)
    front, middle = F.split_part(output, m, F.lit(1)), F.split_part(output, m, F.lit(2))
    psm = F.concat(F.split_part(F.split_part(front, p, F.lit(2)), s, F.lit(1)), middle, F.split_part(front, s, F.lit(2)))
    spm = F.concat(F.split_part(front, p, F.lit(2)), middle, F.split_part(F.split_part(front, s, F.lit(2)), p, F.lit(1)))
    return F.when(form == "plain", output).when(form == "psm", psm).otherwise(spm)
