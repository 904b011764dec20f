"""Toxicity by the nearest labelled examples: exact TF-IDF cosine over a block-max inverted index.

Terms are words and the 3- and 4-grams of words with their ends marked. The vectors span every term whose share of
labelled examples differs between the classes beyond chance (a log-likelihood ratio of ``least_evidence``; 15.14 is one in
ten thousand), however many these are: vectors of all terms find fewer of the toxic texts, see the README. Weights are
(1 + ln tf) * idf with document frequencies over all documents, divided by the length. The index has for each term
postings in blocks of examples with each block's largest weight, so that a block whose bound is below the k-th best cosine
so far is skipped: the k neighbours are exact, ties to the smaller id. Votes weigh the squared cosine; a pseudo-vote against
keeps little evidence little. The vote is calibrated by a logistic curve on the examples themselves, each left out of
its own neighbours, at the class shares of all training labels. Neighbours are found in tasks; the driver gathers the
examples' terms as arrays and makes the index, a block at a time.

Bounded parts (parameters): ``examples`` labelled rows per class, those with the smallest hash of their id; k. The
examples bound the terms and the index, which is broadcast. Document frequencies and class shares cover all rows.

Edge cases: null or empty texts and texts without any of the terms get the curve's value for no evidence. Labels that
are null are left out; of several labels of a doc_id the largest counts, of several texts of an example's doc_id the
greatest. No usable examples, or of one class only, or no term beyond chance: every score is the class share (0 without
labels). Very long texts are used whole. Further columns stay as they are; result columns replace columns of their own names.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import ahocorasick
import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._shared import discard, free_name, written

WORD = re.compile(r"[^\W\d_]+")
RESULT = ("score", "predicted", "neighbours", "similarities", "neighbour_labels")


Row = tuple[np.ndarray, np.ndarray]  # a text's terms, ascending, and how often each occurs


def marked(text: str | None) -> str:
    """The words of a text with their ends marked."""
    words = WORD.findall(text.lower()) if text else []
    return "^" + "$^".join(words) + "$" if words else ""


def word_terms(word: str) -> set[str]:
    x = f"^{word}$"
    return {x, *(x[i : i + n] for n in (3, 4) for i in range(len(x) - n + 1))}


class Terms:
    """Texts to the terms of a list that they hold: all occurrences in one run over the text."""

    def __init__(self, terms: list[str]) -> None:
        self.automaton = ahocorasick.Automaton()
        for i, x in enumerate(terms):
            self.automaton.add_word(x, i)
        if terms:
            self.automaton.make_automaton()

    def row(self, text: str | None) -> Row:
        x = marked(text)
        found = np.fromiter((v for _, v in self.automaton.iter(x)), dtype=np.int64) if x and len(self.automaton) else np.zeros(0, dtype=np.int64)
        return np.unique(found, return_counts=True)


def _ranges(start: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All positions of the ranges one after another, and which range each is of."""
    size = stop - start
    which = np.repeat(np.arange(len(size)), size)
    return np.arange(len(which)) + np.repeat(start - np.cumsum(size) + size, size), which


def _flat(rows: list[Row], idf: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, term, weight) of all rows' unit vectors."""
    row = np.repeat(np.arange(len(rows)), [len(x) for x, _ in rows])
    term, tf = (np.concatenate([np.zeros(0, dtype=np.int64), *x]) for x in zip(*rows, strict=True))
    w = (1 + np.log(np.maximum(tf, 1))) * idf[term]
    norm = np.sqrt(np.bincount(row, weights=w * w, minlength=len(rows)))
    return row, term, w / np.maximum(norm[row], 1e-12)


@dataclass
class Index:
    """The examples' vectors, one after another, and the largest weight of each term in each block of examples."""

    ids: np.ndarray
    labels: np.ndarray
    idf: np.ndarray
    begin: np.ndarray = field(default=None)  # each example's first entry, with one more for the end
    term: np.ndarray = field(default=None)  # ascending within an example
    weight: np.ndarray = field(default=None)
    top: np.ndarray = field(default=None)  # terms by blocks: the block's largest weight
    size: int = 256

    @classmethod
    def of(cls, ids: np.ndarray, labels: np.ndarray, rows: list[Row], idf: np.ndarray, size: int = 256) -> Index:
        """The entries are made a block of examples at a time, as this runs on the driver."""
        top = np.zeros((len(idf), -(-len(ids) // size)))
        terms, weights = [np.zeros(0, dtype=np.int32)], [np.zeros(0)]
        for i in range(top.shape[1]):
            _, term, w = _flat(rows[i * size : (i + 1) * size], idf)
            np.maximum.at(top[:, i], term, w)
            terms.append(term.astype(np.int32))
            weights.append(w)
        begin = np.cumsum([0, *(len(x) for x, _ in rows)])
        return cls(ids, labels, idf, begin, np.concatenate(terms), np.concatenate(weights), top, size)

    def place(self, ids: np.ndarray) -> np.ndarray:
        """The examples' positions; ids: of examples alone."""
        order = np.argsort(self.ids)
        return order[np.searchsorted(self.ids, ids, sorter=order)]

    def nearest(self, rows: list[Row], k: int, but: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """The k examples of the largest cosine for each row, exactly, ties to the smaller id: positions (-1: none) and cosines.

        but: for each row an example that takes no part.
        """
        near, cosines = np.full((len(rows), k), -1), np.zeros((len(rows), k))
        row, term, w = _flat(rows, self.idf)
        ends, postings = np.searchsorted(row, np.arange(len(rows) + 1)), Postings(self)
        for at in range(0, len(rows), 128):
            n = min(128, len(rows) - at)
            own = slice(ends[at], ends[at + n])
            which, example = postings.may_be_near(row[own] - at, term[own], w[own], n, k, None if but is None else but[at : at + n])
            cos = self._cosines(row[own] - at, term[own], w[own], n, which, example)
            which, example, cos = which[cos > 0], example[cos > 0], cos[cos > 0]
            order = np.lexsort((self.ids[example], -cos, which))
            which, example, cos = which[order], example[order], cos[order]
            rank = np.arange(len(which)) - np.searchsorted(which, which)
            best = rank < k
            near[at + which[best], rank[best]], cosines[at + which[best], rank[best]] = example[best], np.minimum(cos[best], 1.0)
        return near, cosines

    def _cosines(self, row: np.ndarray, term: np.ndarray, w: np.ndarray, n: int, which: np.ndarray, example: np.ndarray, step: int = 2048) -> np.ndarray:
        """Of pairs of a row and an example, summed in the order of the terms, so that equal examples get equal cosines."""
        q, out = np.zeros((n, len(self.idf))), [np.zeros(0)]
        q[row, term] = w
        for i in range(0, len(which), step):
            x, e = which[i : i + step], example[i : i + step]
            entry, of = _ranges(self.begin[e], self.begin[e + 1])
            out.append(np.bincount(of, weights=q[x[of], self.term[entry]] * self.weight[entry], minlength=len(x)))
        return np.concatenate(out)


class Postings:
    """An index by term, then block of examples: of frequent terms every weight, in single precision, of others the postings.

    Blocks are scored for many rows at once, each for the rows whose bound reaches it.
    """

    def __init__(self, index: Index, frequent: float = 1 / 32) -> None:
        """frequent: the share of examples from which on a term's weights are kept for all of them."""
        self.index, (terms, self.blocks) = index, index.top.shape
        example = np.repeat(np.arange(len(index.ids)), np.diff(index.begin))
        counts = np.bincount(index.term, minlength=terms)
        dense = counts > frequent * len(index.ids)
        self.place = np.where(dense, np.cumsum(dense) - 1, -1)  # of frequent terms
        self.all = np.zeros((self.blocks, np.count_nonzero(dense), index.size), dtype=np.float32)
        own = dense[index.term]
        self.all[example[own] // index.size, self.place[index.term[own]], example[own] % index.size] = index.weight[own]
        rare = np.flatnonzero(~own)
        rare = rare[np.argsort(index.term[rare], kind="stable")]
        self.example, self.weight = example[rare], index.weight[rare]
        self.begin = np.searchsorted(index.term[rare], np.arange(terms + 1))
        self.rounding = (terms + 8) * 2.0**-24  # the most that a sum of products of unit vectors is off in single precision

    def may_be_near(self, row: np.ndarray, term: np.ndarray, w: np.ndarray, n: int, k: int, but: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
        """(row, example) of all that may be among the k nearest of n rows. The blocks of a row's largest bounds are scored first, and
        their k-th best is what the bounds of its other blocks must reach."""
        size, blocks, off = self.index.size, self.blocks, 2 * self.rounding
        ends, width = np.searchsorted(row, np.arange(n + 1)), self.blocks * self.index.size
        bound = np.stack([w[a:b] @ self.index.top[term[a:b]] for a, b in zip(ends, ends[1:], strict=False)])
        dense = self.place[term] >= 0
        q = np.zeros((n, self.all.shape[1]), dtype=np.float32)
        q[row[dense], self.place[term[dense]]] = w[dense]
        posting, of = _ranges(self.begin[term[~dense]], self.begin[term[~dense] + 1])
        scores = np.bincount(row[~dense][of] * width + self.example[posting], weights=w[~dense][of] * self.weight[posting], minlength=n * width)
        scores = scores.astype(np.float32).reshape(n, blocks, size)
        if but is not None:
            scores[np.arange(n), but // size, but % size] = -np.inf

        def add(needed: np.ndarray) -> None:
            for i in np.flatnonzero(needed.any(0)):
                x = np.flatnonzero(needed[:, i])
                scores[x, i] += q[x] @ self.all[i]

        def kth(x: np.ndarray) -> np.ndarray:
            return np.partition(x, x.shape[1] - k, axis=1)[:, -k] if x.shape[1] > k else np.zeros(n)

        first = np.argsort(-bound, axis=1, kind="stable")[:, : -(-k // size) + 1]
        lead = np.zeros((n, blocks), dtype=bool)
        np.put_along_axis(lead, first, True, axis=1)
        add(lead)
        least = kth(scores[np.arange(n)[:, None], first].reshape(n, -1))
        add(~lead & (bound > np.maximum(least - off, 0)[:, None]))
        scores = scores.reshape(n, -1)
        return np.nonzero((scores > 0) & (scores >= (kth(scores) - off)[:, None]))


def votes(labels: np.ndarray, near: np.ndarray, cosines: np.ndarray, doubt: float) -> np.ndarray:
    w = np.where(near >= 0, cosines**2, 0.0)
    return (w * labels[np.maximum(near, 0)]).sum(1) / (w.sum(1) + doubt)


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1e-3) -> tuple[float, float]:
    """Slope and intercept of a weighted logistic curve, by Newton steps."""
    a = np.stack([x, np.ones_like(x)], axis=1)
    beta = np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a @ beta, -30, 30)))
        g = a.T @ (weight * (p - y)) + ridge * beta * [1, 0]
        h = (a * (weight * p * (1 - p))[:, None]).T @ a + np.diag([ridge, 1e-9])
        step = np.linalg.solve(h, g)
        beta -= np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-9:
            break
    return float(beta[0]), float(beta[1])


@dataclass
class Model:
    index: Index | None
    k: int
    doubt: float
    slope: float
    intercept: float
    share: float

    def score(self, rows: list[Row]) -> pd.DataFrame:
        n, blank = len(rows), np.zeros(0, dtype=np.int64)
        score, near = np.full(n, self.share), np.full((n, self.k), -1)
        ids, cosines, labels = [blank] * n, [blank.astype(float)] * n, [blank] * n
        if self.index is not None:
            near, found = self.index.nearest(rows, self.k)
            score = np.clip(1 / (1 + np.exp(-(self.slope * votes(self.index.labels, near, found, self.doubt) + self.intercept))), 0.0, 1.0)
            for i, (x, c) in enumerate(zip(near, found, strict=True)):
                own = x[x >= 0]
                ids[i], cosines[i], labels[i] = self.index.ids[own], c[x >= 0], self.index.labels[own]
        return pd.DataFrame({"score": score, "predicted": (score >= 0.5).astype(np.int32), "neighbours": ids, "similarities": cosines, "neighbour_labels": labels})


def _examples(docs: DataFrame, labels: DataFrame, examples: int) -> tuple[DataFrame | None, float]:
    """(doc_id, toxic, text) of the examples, None without both classes, and the toxic share of all labels."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where("doc_id is not null and toxic in (0, 1)").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    known = written(known, "labels")  # a row per label
    sizes = {r["toxic"]: r["count"] for r in known.groupBy("toxic").count().collect()}
    share = sizes.get(1, 0) / max(1, sum(sizes.values()))
    if len(sizes) < 2:
        return None, share
    order = [F.xxhash64(F.lit("example"), "doc_id"), F.col("doc_id")]
    chosen = known.where("toxic = 1").orderBy(*order).limit(examples).union(known.where("toxic = 0").orderBy(*order).limit(examples))
    text = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    # 2 * examples rows of ids and labels
    chosen = text.join(F.broadcast(written(chosen, "chosen")), "doc_id").where("text is not null").groupBy("doc_id").agg(F.max("text").alias("text"), F.max("toxic").alias("toxic"))
    return written(chosen.repartition(64), "examples"), share


def _terms(chosen: DataFrame | None, least_docs: int, least_evidence: float) -> list[str]:
    """Terms of the examples whose shares of the classes differ beyond chance."""
    sized = {r["toxic"]: r["count"] for r in chosen.groupBy("toxic").count().collect()} if chosen is not None else {}
    if len(sized) < 2:
        return []

    def term_counts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        found: tuple[Counter, Counter] = (Counter(), Counter())
        of: dict[str, set[str]] = {}
        for pdf in batches:
            for x, y in zip(pdf["text"], pdf["toxic"], strict=True):
                words = set(WORD.findall(x.lower()))
                of.update((w, word_terms(w)) for w in words.difference(of))
                found[y].update(set().union(*map(of.__getitem__, words)))
        names = sorted(found[0].keys() | found[1].keys())
        if names:
            yield pd.DataFrame({"term": names, "toxic": [found[1][x] for x in names], "clean": [found[0][x] for x in names]})

    counted = chosen.select("text", "toxic").mapInPandas(term_counts, "term string, toxic long, clean long").groupBy("term").agg(F.sum("toxic").alias("a"), F.sum("clean").alias("b"))
    counted = counted.where(f"a + b >= {int(least_docs)}").where(_evidence(F.col("a"), F.col("b"), sized[1], sized[0]) >= least_evidence)
    return sorted(r["term"] for r in counted.select("term").collect())  # these are bounded by the examples


def _pairs(at: pd.Series, tf: pd.Series) -> list[Row]:
    return [(np.asarray(x, dtype=np.int64), np.asarray(n)) for x, n in zip(at, tf, strict=True)]


def _index(held: pa.Table, idf: np.ndarray) -> Index:
    """held: doc_id, toxic, at, tf of the examples. Terms and counts stay arrays of Arrow's: as lists of Python's integers they take a
    hundred bytes an entry."""
    at, tf = (held[x].combine_chunks() for x in ("at", "tf"))
    ends, at, tf = at.offsets.to_numpy(), at.values.to_numpy(), tf.values.to_numpy()
    rows = [(at[a:b], tf[a:b]) for a, b in zip(ends, ends[1:], strict=False)]
    ids, toxic = held["doc_id"].to_numpy(), held["toxic"].to_numpy()
    rarest = np.array([x[np.argmax(idf[x])] if len(x) else -1 for x, _ in rows])  # the first of several, as terms ascend
    order = np.lexsort((ids, rarest, toxic))  # alike examples share blocks
    return Index.of(ids[order].astype(np.int64), toxic[order].astype(np.int32), [rows[i] for i in order], idf)


def _model(chosen: DataFrame | None, share: float, terms: list[str], rows: DataFrame, column: str, k: int, doubt: float) -> Model:
    """rows: all documents with their terms in the column."""
    if not terms:
        return Model(None, k, doubt, 0.0, 0.0, share)
    sc = chosen.sparkSession.sparkContext
    counts = {r["term"]: r["n"] for r in rows.select(F.explode(f"{column}.at").alias("term")).groupBy("term").agg(F.count("*").alias("n")).collect()}
    idf = np.log((1 + rows.count()) / (1 + np.array([counts.get(i, 0) for i in range(len(terms))]))) + 1
    held = written(chosen.select("doc_id", "toxic", term_rows(sc.broadcast(terms), F.col("text")).alias("x")), "held")
    index = _index(held.select("doc_id", "toxic", "x.at", "x.tf").toArrow(), idf)  # 2 * examples rows
    index_at = sc.broadcast(index)

    @F.pandas_udf("double")
    def vote(doc_id: pd.Series, at: pd.Series, tf: pd.Series) -> pd.Series:
        index = index_at.value
        near, cosines = index.nearest(_pairs(at, tf), k, but=index.place(doc_id.to_numpy()))
        return pd.Series(votes(index.labels, near, cosines, doubt))

    found = held.select("doc_id", vote("doc_id", "x.at", "x.tf").alias("vote")).toArrow()
    own, y = np.zeros(len(index.ids)), index.labels.astype(float)
    own[index.place(found["doc_id"].to_numpy())] = found["vote"].to_numpy()
    index_at.destroy()
    discard(held)
    weight = np.where(y == 1, share / max(1, y.sum()), (1 - share) / max(1, (1 - y).sum())) * len(y)
    slope, intercept = logistic(own, y, weight)
    return Model(index, k, doubt, slope, intercept, share)


def _evidence(a: Column, b: Column, toxic: int, clean: int) -> Column:
    """The log-likelihood ratio of a term in a of the toxic and b of the clean examples against one share in both."""
    part = lambda n, of, row: F.when(n > 0, n * F.log(n * (toxic + clean) / (row * of))).otherwise(0.0)
    without = F.lit(toxic + clean) - a - b
    return 2 * (part(a, toxic, a + b) + part(b, clean, a + b) + part(toxic - a, toxic, without) + part(clean - b, clean, without))


def term_rows(terms_at, text: Column) -> Column:
    """A struct of at and tf, the terms of each text by their place in the list, and their counts; terms_at: the broadcast list."""

    @F.pandas_udf("at array<int>, tf array<int>")
    def rows(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        terms = Terms(terms_at.value)
        for x in batches:
            at, tf = zip(*map(terms.row, x), strict=True) if len(x) else ((), ())
            yield pd.DataFrame({"at": at, "tf": tf})

    return rows(text.cast("string"))


def with_toxicity(docs: DataFrame, labels: DataFrame, name: str, examples: int = 4000, k: int = 15, doubt: float = 0.25, least_docs: int = 3, least_evidence: float = 15.14, carry: list[str] | None = None) -> DataFrame:
    """docs with a struct of RESULT as the column ``name``. labels: doc_id, toxic; only rows to learn from.

    carry: the columns of docs to return, all if not given.

    Texts are read once for their terms, and docs with these are written: frequencies and scores come from that table.
    """
    sc = docs.sparkSession.sparkContext
    chosen, share = _examples(docs, labels, examples)
    terms = _terms(chosen, least_docs, least_evidence)
    of = free_name(docs, "terms")
    rows = written(docs.select(*(docs.columns if carry is None else carry), term_rows(sc.broadcast(terms), F.col("text")).alias(of)), "rows")
    model_at = sc.broadcast(_model(chosen, share, terms, rows, of, k, doubt))
    if chosen is not None:
        discard(chosen)

    @F.pandas_udf("score double, predicted int, neighbours array<long>, similarities array<double>, neighbour_labels array<int>")
    def score(at: pd.Series, tf: pd.Series) -> pd.DataFrame:
        return model_at.value.score(_pairs(at, tf))

    return rows.withColumn(name, score(F.col(f"{of}.at"), F.col(f"{of}.tf"))).drop(of)


def score_toxicity(docs: DataFrame, labels: DataFrame, **parameters: object) -> DataFrame:
    """docs with the columns RESULT; neighbours and their cosines are the evidence."""
    found = free_name(docs, "found")
    return with_toxicity(docs, labels, found, **parameters).withColumns({x: F.col(f"{found}.{x}") for x in RESULT}).drop(found)
