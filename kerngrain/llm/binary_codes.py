"""Nearest neighbours by cosine from randomly rotated binary codes of two levels, with error bounds and exact reranking.

A unit vector v is rotated by a random orthogonal matrix R; its code is the signs of Rv, packed in bits, and its
correction scalar is <x, Rv>, where x is the code as a unit vector of +-1/sqrt(d). For a unit query q the inner product
is estimated as <x, Rq> / <x, Rv>, and with high probability it is off by at most
epsilon * sqrt((1 - <x, Rv>^2) / <x, Rv>^2) / sqrt(d - 1). <x, Rq> comes from the bits, unpacked as signs, in one product
with many queries. The second level keeps eight bits of each component of Rv, as steps of one size: with these the inner product is
off by at most the length of what the steps leave of Rv, which holds for every query and is far less (0.006 against 0.38
at 64 dimensions).

1. All vectors are encoded once, into a table of bits, steps, scalars and vectors. 2. Queries are dealt to blocks of about ``query_block``;
each block, whose size is therefore bounded, is broadcast, and every task compares it with the codes of its own part of the
table: candidates are never shuffled or copied. A task keeps the k best of each query so far; the candidates of the
largest estimates are reranked by the exact cosine in double precision, and then every other one whose upper bounds of both
levels reach the k-th best; the second level is looked at where the first lets a candidate through. 3. The tasks' k best of each query meet in a window. Every query is compared with all codes;
no candidate is capped: bounds alone decide.

The exact cosine sums products in the order of the components, so that equal vectors get equal scores; vectors are first
scaled by a power of two, which changes no digit but keeps the squares of very small and very large components finite.

Edge cases: vectors null, empty, zero, or with null or non-finite components take no part, as query or candidate; vectors of
different lengths are not compared. Fewer candidates than k: all. Ties go to the smaller id. Rows that repeat an id: each is a
candidate, but not of a query with the same id; as queries, each has its ranks among those of the id. Null ids take no part.
No rows: no rows. Further columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ._shared import written

ENCODED = "vec_id long, q boolean, d int, v array<double>, bits binary, correction double, steps binary, step double, left double"
#: The second level is one product over a block of pairs where the first lets more than this share of them through.
DENSE = 1 / 16
FOUND = "query_id long, vec_id long, score double"


def rotation(d: int, seed: int = 42) -> np.ndarray:
    """A random orthogonal matrix, the same in every task."""
    q, r = np.linalg.qr(np.random.default_rng(seed + d).standard_normal((d, d)))
    return q * np.sign(np.diag(r))


def encode(unit: np.ndarray, rotate: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Packed sign bits and correction scalars of unit vectors."""
    turned = unit @ rotate.T
    return np.packbits(turned > 0, axis=1), np.abs(turned).sum(1) / np.sqrt(unit.shape[1])


def signs_of(codes: np.ndarray, d: int) -> np.ndarray:
    """The codes of a block as -1 and 1."""
    return np.unpackbits(codes, axis=1, count=d).astype(np.float32) * 2 - 1


def estimates(codes: np.ndarray, correction: np.ndarray, query: np.ndarray, rotate: np.ndarray) -> np.ndarray:
    """Estimated inner products of unit queries (rows) with the coded vectors."""
    d = len(rotate)
    return (query @ rotate.T).astype(np.float32) @ signs_of(codes, d).T / (np.sqrt(d) * correction).astype(np.float32)


def refined(unit: np.ndarray, rotate: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The second level of unit vectors: components in steps of -127 to 127, the size of a step, the length of what these leave."""
    turned = unit @ rotate.T
    step = np.abs(turned).max(1) / 127
    steps = np.rint(turned / step[:, None]).astype(np.int8)
    return steps, step, np.sqrt(((turned - steps * step[:, None]) ** 2).sum(1))


def margin(correction: np.ndarray, d: int, epsilon: float) -> np.ndarray:
    c = np.minimum(correction, 1.0)
    return epsilon * np.sqrt((1 - c * c) / (c * c)) / np.sqrt(max(1, d - 1))


def dots(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row by row, in double precision, summed in the order of the components."""
    out = np.zeros(len(a))
    for j in range(a.shape[1]):
        out += a[:, j] * b[:, j]
    return out


def scaled(x: np.ndarray) -> np.ndarray:
    """Vectors times a power of two, so that the largest component is about one."""
    return np.ldexp(x, -np.frexp(np.abs(x).max(1, keepdims=True))[1]) if len(x) else x


def cosines(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    a, b = scaled(a), scaled(b)
    return dots(a, b) / (np.sqrt(dots(a, a)) * np.sqrt(dots(b, b)))


def usable(vector: Column) -> Column:
    """Whether a vector has a direction."""
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(vector.isNotNull() & fine & F.exists(vector, lambda x: x != 0), F.lit(False))


def encoded(rows: DataFrame) -> DataFrame:
    """(vec_id, q, d, v) with bits and correction."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for d, part in pdf.groupby("d"):
                x = scaled(np.stack(part["v"].to_numpy()))
                unit, rotate = x / np.sqrt((x * x).sum(1, keepdims=True)), rotation(int(d))
                bits, correction = encode(unit, rotate)
                steps, step, left = refined(unit, rotate)
                yield part.assign(bits=[b.tobytes() for b in bits], correction=correction, steps=[b.tobytes() for b in steps], step=step, left=left)

    return rows.mapInPandas(run, ENCODED)


@dataclass
class Codes:
    """Candidates of one length, as encoded."""

    ids: np.ndarray
    vectors: np.ndarray
    bits: np.ndarray
    correction: np.ndarray
    steps: np.ndarray
    step: np.ndarray
    left: np.ndarray

    @classmethod
    def of(cls, part: pd.DataFrame) -> Codes:
        packed = lambda name, kind: np.frombuffer(b"".join(part[name]), dtype=kind).reshape(len(part), -1)
        return cls(part["vec_id"].to_numpy(), np.stack(part["v"].to_numpy()), packed("bits", np.uint8), part["correction"].to_numpy(), packed("steps", np.int8), part["step"].to_numpy(), part["left"].to_numpy())


@dataclass
class Queries:
    """A block of queries of one length, as broadcast."""

    ids: np.ndarray
    vectors: np.ndarray  # scaled


class Search:
    """The k nearest so far of a block of queries, in one task."""

    def __init__(self, queries: Queries, k: int, epsilon: float) -> None:
        self.q, self.k, self.epsilon = queries, k, epsilon
        self.rotate = rotation(queries.vectors.shape[1])
        self.length = np.sqrt(dots(queries.vectors, queries.vectors))
        self.turned = (queries.vectors / self.length[:, None] @ self.rotate.T).astype(np.float32)
        n = len(queries.ids)
        self.scores, self.near = np.full((n, k), -np.inf), np.full((n, k), np.iinfo(np.int64).max)

    def _merge(self, rows: np.ndarray, x: np.ndarray, ids: np.ndarray, score: np.ndarray) -> None:
        """Candidates (row, id, score) of some rows into these rows' k best."""
        x = np.concatenate([x, np.repeat(np.arange(len(rows)), self.k)])
        ids = np.concatenate([ids, self.near[rows].ravel()])
        score = np.concatenate([score, self.scores[rows].ravel()])
        order = np.lexsort((ids, -score, x))
        x, ids, score = x[order], ids[order], score[order]
        rank = np.arange(len(x)) - np.searchsorted(x, x)
        best = rank < self.k
        self.scores[rows] = score[best].reshape(len(rows), self.k)
        self.near[rows] = ids[best].reshape(len(rows), self.k)

    def add(self, codes: Codes, step: int = 256) -> None:
        d, ids, c = len(self.rotate), codes.ids, scaled(codes.vectors)
        length = np.sqrt(dots(c, c))
        rounding = np.float32(1e-5 + 2.0**-22 * d)  # of the products in single precision
        upper = margin(codes.correction, d, self.epsilon).astype(np.float32) + rounding
        signs = signs_of(codes.bits, d).T / (np.sqrt(d) * codes.correction).astype(np.float32)
        fine, left = codes.steps * codes.step[:, None].astype(np.float32), codes.left.astype(np.float32) + rounding

        def exact(rows: np.ndarray, b: np.ndarray) -> np.ndarray:
            parts = [dots(self.q.vectors[rows[i : i + 100_000]], c[b[i : i + 100_000]]) for i in range(0, len(rows), 100_000)]
            return np.concatenate([np.zeros(0), *parts]) / (self.length[rows] * length[b])

        probes = min(8 * self.k, len(ids))
        for at in range(0, len(self.q.ids), step):
            rows = np.arange(at, min(at + step, len(self.q.ids)))
            turned = self.turned[rows]
            g = turned @ signs
            g[self.q.ids[rows][:, None] == ids[None, :]] = -np.inf
            best = np.argpartition(g, len(ids) - probes, axis=1)[:, -probes:]
            x, b = np.repeat(np.arange(len(rows)), probes), best.ravel()
            known = np.isfinite(g[x, b])
            x, b = x[known], b[known]
            self._merge(rows, x, ids[b], exact(rows[x], b))
            g[x, b] = -np.inf
            # what else may reach the k-th best so far, by either level
            least = self.scores[rows, -1].astype(np.float32)
            through = (g + upper >= least[:, None]) & (g > -np.inf)
            if np.count_nonzero(through) > DENSE * through.size:
                h = turned @ fine.T + left
                # k candidates are as near as the k-th largest lower bound says
                low = np.where(through, h - 2 * left, -np.inf)
                if len(ids) > self.k:
                    least = np.maximum(least, np.partition(low, len(ids) - self.k, axis=1)[:, -self.k])
                x, b = np.nonzero(through & (h >= least[:, None]))
            else:
                x, b = np.nonzero(through)
                h = np.concatenate([np.zeros(0), *(np.einsum("ij,ij->i", turned[x[i : i + 100_000]], fine[b[i : i + 100_000]]) for i in range(0, len(x), 100_000))]) + left[b]
                x, b = x[h >= least[x]], b[h >= least[x]]
            self._merge(rows, x, ids[b], exact(rows[x], b))

    def found(self) -> pd.DataFrame:
        x, j = np.nonzero(np.isfinite(self.scores))
        return pd.DataFrame({"query_id": self.q.ids[x], "vec_id": self.near[x, j], "score": self.scores[x, j]})


def _search(codes: DataFrame, block_at, k: int, epsilon: float) -> DataFrame:
    """block_at: a broadcast dict of Queries by their length. (query, query_id, vec_id, score): the k best of each task."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        searches = {d: Search(q, k, epsilon) for d, q in block_at.value.items()}
        for pdf in batches:
            for d, part in pdf.groupby("d"):
                if d in searches:
                    searches[d].add(Codes.of(part))
        for s in searches.values():
            yield s.found()

    return codes.drop("q").mapInPandas(run, FOUND)


def nearest(vectors: DataFrame, query: Column, k: int = 5, epsilon: float = 4.0, query_block: int = 16384) -> DataFrame:
    """vectors (vec_id, embedding) and which of them are queries, to (query_id, rank, vec_id, score)."""
    spark = vectors.sparkSession
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.coalesce(query, F.lit(False)).alias("q"), F.size("embedding").alias("d"), F.col("embedding").cast("array<double>").alias("v"))
    codes = written(encoded(rows.where(F.col("vec_id").isNotNull() & usable(F.col("v")))), "codes")
    # rows that repeat a query would each find the same
    queries = written(codes.where("q").select("vec_id", "d", "v").distinct(), "queries")
    blocks = max(1, -(-queries.count() // query_block))
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    parts = []
    for i in range(blocks):
        own = queries.where(F.pmod(F.xxhash64("vec_id"), F.lit(blocks)) == i).toPandas()  # query_block rows, about
        block = {int(d): Queries(x["vec_id"].to_numpy(), scaled(np.stack(x["v"].to_numpy()))) for d, x in own.groupby("d")}
        found = _search(codes, spark.sparkContext.broadcast(block), k, epsilon).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
        parts.append(found.select("query_id", "rank", "vec_id", "score") if blocks == 1 else written(found.select("query_id", "rank", "vec_id", "score"), "found"))
    out = parts[0]
    for x in parts[1:]:
        out = out.union(x)
    return out
