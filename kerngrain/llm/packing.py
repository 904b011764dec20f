"""Packing documents into token windows by deficit round-robin over the queues of their sources.

Every source is a queue of its documents' tokens. Each window takes from every queue its share, the queue's target
proportion of the window; what a queue gets too little or too much by rounding is its deficit, which goes on to the next
window. As all tokens are to be packed, the target proportions are the sources' shares of all tokens, and every window of
the run holds that mixture, instead of one source after the other.

To run in parallel, all tokens are cut into blocks: block k of K holds of a queue of T tokens those from (T*k+p)//K to
(T*(k+1)+p)//K, where p is the queue's own phase below K. That is the deficit's closed form at block boundaries, exact in integers, so that a task can enter a block
without the blocks before it. Inside a block of about 2048 windows the round-robin itself runs over token counts alone.
What a block has left over, less than a window, is cut into sequences whose lengths are powers of two: no padding.

Two passes: (1) encode once and write ids with each document's place among its task's tokens of its queue; (2) add the
places of tasks (one row per task and queue) and cut. Token ids are never shuffled unless that table is beyond the
broadcast threshold, and no group of rows ever meets in one task.

A source with less than ``least_share`` of all tokens, which is under a five-hundredth of a token per window, shares one of
``rest_queues`` queues with others like it, at every number of sources: so there are 1 / least_share + rest_queues queues
at most, 16 bytes each are broadcast, and every larger source has its own.

Edge cases: null or empty text is one token (the end id). Null source is the queue of the empty name. Repeated rows and
null doc_ids are packed as they are, each by itself. No rows: no pieces. Further columns are not looked at.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ._shared import written
from .tokenizing import byte_bpe_ids, public_path

#: Parts of windows in the blocks that a task keeps.
KEPT = 8_000_000
PIECES = "doc_id string, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, sequence_length long"


def encode(docs: DataFrame, json_path: str, ranks_path: str | None, end_id: int) -> DataFrame:
    """(doc_id, queue, text) to (doc_id, queue, chunk, place, n, ids): place counts the tokens of the queue before it in the chunk."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        chunk, place = TaskContext.get().partitionId(), {}
        for whole in batches:
            for k in range(0, len(whole), 500):
                pdf = whole.iloc[k : k + 500]
                ids, n, places = [], [], []
                for text, queue in zip(pdf["text"], pdf["queue"], strict=True):
                    x = np.append(byte_bpe_ids(text, json_path, ranks_path), np.uint32(end_id)).astype("<u4")
                    ids.append((x.astype("<u2") if x.max() < 65536 else x).tobytes())
                    n.append(len(x))
                    places.append(place.get(queue, 0))
                    place[queue] = places[-1] + len(x)
                yield pd.DataFrame({"doc_id": pdf["doc_id"].to_numpy(), "queue": pdf["queue"].to_numpy(), "chunk": chunk, "place": places, "n": n, "ids": ids})

    return docs.mapInPandas(run, "doc_id string, queue string, chunk long, place long, n long, ids binary")


class Block:
    """The windows of one block, from the numbers of tokens (one at least) it has of each queue."""

    def __init__(self, have: np.ndarray, window: int) -> None:
        total = int(have.sum())
        full = total // window
        credit = np.zeros(len(have), dtype=np.int64)
        queues, takes, offsets, windows = [], [], [], []
        for w in range(full):
            credit += have * window  # in units of one token / total
            quota = np.maximum(credit // total, 0)
            rest = window - int(quota.sum())
            if rest > 0:  # the largest deficits get the tokens that rounding left
                quota[np.argsort(-(credit - quota * total), kind="stable")[:rest]] += 1
            elif rest < 0:
                order = np.argsort(credit - quota * total, kind="stable")
                for q in order[quota[order] > 0][: -rest]:
                    quota[q] -= 1
            credit -= quota * total
            some = np.flatnonzero(quota)
            queues.append(some)
            takes.append(quota[some])
            offsets.append(np.cumsum(quota[some]) - quota[some])  # where a queue's part begins in the window
            windows.append(np.full(len(some), w))
        blank = [np.zeros(0, dtype=np.int64)]
        queue, take, offset, win = (np.concatenate(blank + x) for x in (queues, takes, offsets, windows))
        order = np.argsort(queue, kind="stable")  # the parts of each queue, in order of windows
        take = take[order]
        self.offset, self.win = offset[order].astype(np.int32), win[order].astype(np.int32)
        self.first = np.searchsorted(queue[order], np.arange(len(have) + 1))
        taken = np.bincount(queue, weights=take[np.argsort(order)], minlength=len(have)).astype(np.int64) if len(queue) else np.zeros(len(have), dtype=np.int64)
        upto = np.cumsum(take)
        self.stop = (upto - np.repeat(np.cumsum(taken) - taken, np.diff(self.first))).astype(np.int64)  # of a queue's tokens
        self.taken, self.full, self.window = taken, full, window
        left = have - taken
        self.tail = np.cumsum(left) - left
        size = total - full * window
        self.tail_lengths = [1 << b for b in range(window.bit_length(), -1, -1) if size >> b & 1]
        self.tail_ends = np.cumsum(self.tail_lengths) if size else np.zeros(0, dtype=np.int64)

    def cuts(self, q: int, begin: int, end: int) -> tuple[np.ndarray, ...]:
        """Of the queue's tokens begin to end: begins, ends, sequences (in the block), offsets, sequence lengths."""
        low, high, whole, parts = self.first[q], self.first[q + 1], int(self.taken[q]), []
        if begin < whole:
            stop = self.stop[low:high]
            i = np.arange(np.searchsorted(stop, begin, "right"), np.searchsorted(stop, min(end, whole), "left") + 1)
            start = np.concatenate([[0], stop[:-1]])[i]
            a, b = np.maximum(start, begin), np.minimum(stop[i], end)
            parts.append((a, b, self.win[low + i].astype(np.int64), self.offset[low + i] + a - start, np.full(len(i), self.window)))
        if end > whole:
            shift = int(self.tail[q]) - whole  # from the queue's count to the tail's
            a, b = max(begin, whole) + shift, end + shift
            for s, (stop, size) in enumerate(zip(self.tail_ends, self.tail_lengths, strict=True)):
                x, y = max(a, int(stop) - size), min(b, int(stop))
                if y > x:
                    parts.append(tuple(np.array([v]) for v in (x - shift, y - shift, self.full + s, x - (int(stop) - size), size)))
        return tuple(np.concatenate(x) for x in zip(*parts, strict=True))


def upto(t: np.ndarray | int, k: int, blocks: int, phase: np.ndarray | int) -> np.ndarray | int:
    """(t * k + phase) // blocks, the tokens before block k, without a product of more than 64 bits."""
    return t // blocks * k + (t % blocks * k + phase) // blocks


def phases(numbers: np.ndarray, blocks: int) -> np.ndarray:
    """Of each queue a number below that of blocks, so that queues of few tokens aren't all in the same blocks."""
    x = (numbers.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    return ((x ^ (x >> np.uint64(32))) % np.uint64(blocks)).astype(np.int64)


def cut(encoded: DataFrame, totals_at, window: int, block_tokens: int) -> DataFrame:
    """Rows of encode() with ``number``, their queue's, and ``base``, their place in it but for ``place``, to pieces.

    totals_at: broadcast numbers of queues, ascending, and their tokens.
    """
    numbers, t = totals_at.value
    total = int(t.sum())
    blocks = max(1, -(-total // block_tokens))
    stride = (block_tokens + len(t)) // window + window.bit_length() + 2

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        numbers, t = totals_at.value
        phase = phases(numbers, blocks)
        plans: dict[int, tuple[np.ndarray, Block]] = {}
        size = 0

        def plan(k: int) -> tuple[np.ndarray, Block]:
            """The block's queues, and its windows. Blocks are kept up to a bounded size."""
            nonlocal size
            if k not in plans:
                have = upto(t, k + 1, blocks, phase) - upto(t, k, blocks, phase)
                some = np.flatnonzero(have)
                plans[k] = (some, Block(have[some], window))
                size += len(plans[k][1].win) + len(some)
                while size > KEPT and len(plans) > 1:
                    queues, first = plans.pop(next(iter(plans)))
                    size -= len(first.win) + len(queues)
            return plans[k]

        for whole in batches:
            for i in range(0, len(whole), 200):
                pdf = whole.iloc[i : i + 200]
                doc, begins, sizes, crcs, n_all, seqs, offsets, lengths = [], [], [], [], [], [], [], []
                for row, (q, base, place, n, raw) in enumerate(zip(np.searchsorted(numbers, pdf["number"].to_numpy()).tolist(), pdf["base"], pdf["place"], pdf["n"], pdf["ids"], strict=True)):
                    ids = memoryview(np.frombuffer(raw, dtype="<u2" if len(raw) == 2 * n else "<u4").astype("<u4").tobytes())
                    at = first = int(base) + int(place)
                    have, late = int(t[q]), int(phase[q])
                    while at < first + n:
                        k = ((at + 1) * blocks - 1 - late) // have
                        low, high = upto(have, k, blocks, late), upto(have, k + 1, blocks, late)
                        stop = min(first + int(n), high)
                        queues, windows = plan(k)
                        a, b, s, o, sequence = windows.cuts(int(np.searchsorted(queues, q)), at - low, stop - low)
                        a, b = a + (low - first), b + (low - first)
                        doc.append(np.full(len(a), row))
                        begins.append(a)
                        sizes.append(b - a)
                        crcs.extend(zlib.crc32(ids[4 * x : 4 * y]) for x, y in zip(a.tolist(), b.tolist(), strict=True))
                        n_all.append(np.full(len(a), n))
                        seqs.append(s + k * stride)
                        offsets.append(o)
                        lengths.append(sequence)
                        at = stop
                if doc:
                    ids_of = pdf["doc_id"].to_numpy()[np.concatenate(doc)]
                    cols = {"start": begins, "length": sizes, "ids_crc32": [np.array(crcs, dtype=np.int64)], "doc_tokens": n_all, "sequence_id": seqs, "offset": offsets, "sequence_length": lengths}
                    yield pd.DataFrame({"doc_id": ids_of} | {x: np.concatenate(y).astype(np.int64) for x, y in cols.items()})

    return encoded.select("doc_id", "number", "base", "place", "n", "ids").mapInPandas(run, PIECES).withColumn("doc_id", F.col("doc_id").cast("long"))


def pack(docs: DataFrame, json_path: str | None = None, ranks_path: str | None = None, end_id: int = 1, window: int = 2048, block_tokens: int = 1 << 22, least_share: float = 2.0**-20, rest_queues: int = 1024) -> DataFrame:
    """docs with doc_id, text and source to the pieces of all windows; see the module's text.

    Without a path the public byte-level vocabulary of 50,257 ids is used.
    """
    if json_path is None:
        json_path, ranks_path = public_path("byte_bpe_50k.json"), public_path("byte_bpe_50k.tiktoken")
    # ids go through Python as text: pandas would make doubles of integers with nulls among them
    rows = docs.select(F.col("doc_id").cast("long").cast("string").alias("doc_id"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("queue"), F.col("text").cast("string").alias("text"))
    encoded = written(encode(rows, json_path, ranks_path, end_id), "encoded")
    sums = written(encoded.groupBy("queue", "chunk").agg(F.sum("n").alias("n")), "sums")  # a row per task and source
    total = sums.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    name = F.when(F.col("n") >= F.lit(total * least_share), F.concat(F.lit("own "), "queue")).otherwise(F.concat(F.lit("rest "), F.pmod(F.xxhash64("queue"), F.lit(rest_queues))))
    sources = written(sums.groupBy("queue").agg(F.sum("n").alias("n")).select("queue", "n", name.alias("name")), "sources")
    queues = written(sources.groupBy("name").agg(F.sum("n").alias("n")).withColumn("number", F.monotonically_increasing_id()), "queues")
    numbered = sources.select("queue", "name").join(queues.select("name", "number"), "name").select("queue", "number")
    before = Window.partitionBy("number").orderBy("chunk", "queue").rowsBetween(Window.unboundedPreceding, -1)
    bases = written(sums.join(numbered, "queue").select("queue", "chunk", "number", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base")), "bases")
    t = queues.select("number", "n").toPandas().sort_values("number")  # 1 / least_share + rest_queues rows at most
    totals_at = docs.sparkSession.sparkContext.broadcast((t["number"].to_numpy(dtype=np.int64), t["n"].to_numpy(dtype=np.int64)))
    return cut(encoded.join(bases, ["queue", "chunk"]), totals_at, window, block_tokens)
