"""Importance resampling of documents toward a target: weights by hashed n-grams, a cutoff by bisection, ranks by ranges.

1. n-grams of 1 to ``ngrams`` words are hashed into buckets; each task counts its documents' in one array, and arrays are
summed by bucket. 2. A bucket's gain is the log ratio of its smoothed shares in the target and in all documents, in thousandths, floored;
a document's weight is the floored mean of the gains of its n-grams, looked up in one array. Its score is the weight
and a Gumbel number drawn from the digest of seed and id, so that the highest scores are a draw without replacement by weight.
3. Scores are written with a row number. The cutoff for a share of the eligible documents is found by bisection over these
numbers: each job counts exactly how many rows lie at or beyond each of ``ways`` thresholds between two bounds, and
the bounds close in until they meet; first over the score, then over the ids of the rows that tie at it, then over row numbers of equal
ids. 4. Selected rows are dealt by ranges of (score, id, row), which are unique so that ties spread, and sorted; a rank is the
place in a range and the sizes of the ranges before.

The driver sees one number for each bucket, each threshold and each range. No window or sort spans all rows.

Edge cases: null and empty texts have no n-grams, weight 0 and no part in the draw unless ``least_words`` is 0. A null id is drawn for
as the empty text and comes after all ids among equal scores. Repeated rows are drawn each; of equal score and id the first row. Very
long texts are used whole. An empty target or table: gains of the smoothing alone; no rows: no rows. Further columns stay, if they are carried.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._shared import free_name, written

BUCKETS, SEED, WAYS = 10_000, 2024, 64
#: Bytes to word characters in lower case, or to a space.
_TABLE = bytes(x + 32 if 65 <= x <= 90 else x if x >= 128 or 48 <= x <= 57 or 97 <= x <= 122 else 32 for x in range(256))


def hashed(text: str | None, ngrams: int, buckets: int) -> tuple[np.ndarray, int]:
    """The buckets of a text's n-grams, repeats counted, and the number of its words."""
    words = (text or "").encode("utf-8", "surrogatepass").translate(_TABLE).split()
    runs = list(words)
    for n in range(2, ngrams + 1):
        runs += [b" ".join(x) for x in zip(*(words[i:] for i in range(n)), strict=False)]
    return np.fromiter(map(zlib.crc32, runs), dtype=np.int64, count=len(runs)) % buckets, len(words)


def bucket_counts(texts: DataFrame, ngrams: int = 1, buckets: int = BUCKETS) -> np.ndarray:
    """How many n-grams of all texts fall into each bucket. One array for each task, summed by bucket."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, dtype=np.int64)
        for batch in batches:
            for text in batch.column(0):
                total += np.bincount(hashed(text.as_py(), ngrams, buckets)[0], minlength=buckets)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], names=["bucket", "n"])

    out = np.zeros(buckets, dtype=np.int64)
    for x in texts.select(F.col("text").cast("string")).mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[x.bucket] = x.n
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """The floored thousandfold log ratio of each bucket's smoothed shares."""
    s_all, t_all, buckets = int(source.sum()), int(target.sum()), len(source)
    ratio = lambda s, t: float(t + 1) * float(s_all + buckets) / (float(s + 1) * float(t_all + buckets))
    return np.array([math.floor(1000 * math.log(ratio(s, t))) for s, t in zip(source.tolist(), target.tolist(), strict=True)], dtype=np.int64)


def weighted(docs: DataFrame, gain: np.ndarray, ngrams: int, carried: list[str]) -> DataFrame:
    """The carried columns with n_words, n_features and weight."""
    out = [("n_words", "long"), ("n_features", "long"), ("weight", "long")]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*carried).schema)
    held = docs.sparkSession.sparkContext.broadcast(gain)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = np.zeros((len(out), batch.num_rows), dtype=np.int64)
            for i, text in enumerate(batch.column(batch.num_columns - 1)):
                found, words = hashed(text.as_py(), ngrams, len(held.value))
                made[:, i] = words, len(found), int(held.value[found].sum()) // len(found) if len(found) else 0
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *map(pa.array, made)], names=[*batch.schema.names[:-1], *[n for n, _ in out]])

    return docs.select(*carried, F.col("text").cast("string").alias(free_name(docs, "whole"))).mapInArrow(run, ", ".join([schema, *[f"{n} {t}" for n, t in out]]))


def gumbel(doc_id: Column, seed: int) -> Column:
    """A floored thousandfold Gumbel number, by 32 bits of the digest of seed and id."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("long")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))


def cutoff(rows: DataFrame, keys: list[str], n: int, ways: int = WAYS) -> list[int] | None:
    """The keys of the n-th row in ascending order of the keys, longs whose last one is unique; None if there are fewer rows or n is 0.

    For each key in turn its value at the n-th row by bisection: jobs that count the rows at or below each of ``ways``
    thresholds, within the rows that equal the values found before.
    """
    if n < 1:
        return None
    found: list[int] = []
    for key in keys:
        low, high, all_rows = rows.agg(F.min(key), F.max(key), F.count(F.lit(1))).first()
        if all_rows < n:
            return None
        below = 0
        while low < high:  # the value lies in low..high, and ``below`` rows are below low
            steps = sorted({low + (high - low) * i // ways for i in range(ways)})
            counts = rows.agg(*[F.count_if(F.col(key) <= F.lit(x)) for x in steps]).first()
            at = next((i for i, c in enumerate(counts) if c >= n), len(steps))
            if at < len(steps):
                high = steps[at]
            if at > 0:
                low, below = steps[at - 1] + 1, counts[at - 1]
        n -= below
        found.append(low)
        rows = rows.where(F.col(key) == low)
    return found


def resample(docs: DataFrame, target: DataFrame, share: Fraction, least_words: int = 20, ngrams: int = 1, buckets: int = BUCKETS, seed: int = SEED, carry: list[str] | None = None, ranges: int | None = None) -> DataFrame:
    """The carried columns of docs (all, by default) with n_words, n_features, weight, score and rank; rank is null for what is not drawn.

    docs: doc_id, text and anything else; target: text. Of the documents with ``least_words`` words that ``share`` is drawn, rounded down.
    """
    ours = ("n_words", "n_features", "weight", "score", "rank")
    carried = [c for c in (docs.columns if carry is None else carry) if c.lower() not in ours]
    ids = docs.withColumn(free_name(docs, "id"), F.col("doc_id").cast("long"))
    row, by_id, by_score = free_name(docs, "row"), ids.columns[-1], free_name(docs, "down")
    gain = gains(bucket_counts(docs, ngrams, buckets), bucket_counts(target, ngrams, buckets))
    scored = weighted(ids, gain, ngrams, [*carried, by_id])
    scored = written(scored.withColumn("score", F.col("weight") + gumbel(F.col(by_id), seed)).withColumn(row, F.monotonically_increasing_id()), "scores")

    # ascending order of longs: falling scores, ids with nulls last, rows
    last = F.coalesce(by_id, F.lit(2**63 - 1))
    placed = scored.withColumns({by_score: -F.col("score"), by_id: last})
    eligible = placed.where(F.col("n_words") >= least_words)
    keys = [by_score, by_id, row]
    end = cutoff(eligible.select(*keys), keys, math.floor(share * eligible.count()))
    result = [*carried, "n_words", "n_features", "weight", "score"]
    unranked = F.lit(None).cast("long").alias("rank")
    if end is None:
        return scored.select(*result, unranked)
    s, i, r = (F.lit(x) for x in end)
    taken = (F.col(by_score) < s) | ((F.col(by_score) == s) & ((F.col(by_id) < i) | ((F.col(by_id) == i) & (F.col(row) <= r))))
    chosen = F.coalesce(taken & (F.col("n_words") >= least_words), F.lit(False))
    part, place, start = (free_name(docs, x) for x in ("part", "place", "start"))
    n = ranges or int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = placed.where(chosen).repartitionByRange(n, *keys).sortWithinPartitions(*keys)
    ranged = written(dealt.select(*result, F.spark_partition_id().alias(part), F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)).alias(place)), "ranges")
    before, offsets = 0, []
    for p, size in sorted(map(tuple, ranged.groupBy(part).count().collect())):
        offsets.append((p, before))
        before += size
    starts = docs.sparkSession.createDataFrame(offsets, f"{part} int, {start} long")
    ranked = ranged.join(F.broadcast(starts), part).select(*result, (F.col(start) + F.col(place) + 1).alias("rank"))
    return placed.where(~chosen).select(*result, unranked).unionByName(ranked)
