"""Language identification by nearest centroids of TF-IDF character n-grams.

Texts become counts of their letters' 1- to 3-grams (lower case, other characters are word ends), hashed to a fixed
number of dimensions, 1 + log of counts times idf, divided by the length. Every language has up to ``k`` centroids from
spherical k-means; the nearest centroid by cosine names the language. A text is rejected if it has no letter, or
if its cosine is below half of what all but five per cent of the language's training texts of its length have. A length of
few texts takes in its neighbours, a language of few texts all languages'; fewer than that reject nothing.

Fit: document frequencies over all training rows; centroids on a sample of at most about ``sample`` rows per
language (chosen by a hash of id and text), each language in a group of its own; limits of rejection from exact counts of
finely binned cosines over all training rows. The model is languages * k * dims floats.

Edge cases: null text, empty text and text without letters: ``und``, score 0, rejected. Training rows with
null lang or text are left out. Very long texts are used whole. No training rows: every text is ``und``. Repeated rows count
each in frequencies and limits, and once in the sample. Rows without an id, or with one id among them, are rows like others. Further columns of any name stay as they are; result columns replace columns of their own names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LENGTHS = (32, 128, 512)  # letters; rejection is learned for each class of lengths
BINS = 100  # of cosines from 0 to 1
_MIX = np.uint64(0x9E3779B97F4A7C15)


class Letters:
    """Which code points are letters, as str.isalpha says; 64 K at a time, as they occur."""

    def __init__(self) -> None:
        self.planes: dict[int, np.ndarray] = {}

    def of(self, codes: np.ndarray) -> np.ndarray:
        out = np.zeros(len(codes), dtype=bool)
        for p in np.unique(codes >> 16) if len(codes) and codes.max() >= 65536 else [0]:
            p = int(p)
            if p not in self.planes:
                self.planes[p] = np.array([chr(p << 16 | i).isalpha() for i in range(65536)])
            some = (codes >> 16) == p
            out[some] = self.planes[p][codes[some] & 0xFFFF]
        return out


def ngram_counts(texts: list[str], dims: int, letters: Letters) -> tuple[np.ndarray, np.ndarray]:
    """Counts (texts by dims) and the number of letters of each text."""
    whole = " ".join([*[x.lower() for x in texts], ""])
    ends = np.cumsum([len(x.lower()) + 1 for x in texts])
    codes = np.frombuffer(whole.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    alpha = letters.of(codes)
    doc = np.repeat(np.arange(len(texts)), np.diff(np.concatenate([[0], ends])))
    n_letters = np.bincount(doc, weights=alpha, minlength=len(texts)).astype(np.int64)
    c = np.where(alpha, codes, 0).astype(np.uint64)
    keep = alpha | np.concatenate([[True], alpha[:-1]])  # one 0 after each word
    c, doc, alpha = c[keep], doc[keep], alpha[keep]
    shift = np.uint64(64 - int(dims).bit_length() + 1)
    before, after = np.concatenate([[np.uint64(0)], c[:-1]]), np.concatenate([c[1:], [np.uint64(0)]])
    one = (c + np.uint64(1)) * _MIX
    two = (one ^ (before + np.uint64(7)) * np.uint64(0xD6E8FEB86659FD93)) * _MIX
    three = (two ^ (after + np.uint64(13)) * np.uint64(0xBF58476D1CE4E5B9)) * _MIX
    at = doc[alpha] * dims
    out = np.zeros(len(texts) * dims, dtype=np.float32)
    for h in (one, two, three):
        out += np.bincount(at + (h[alpha] >> shift).astype(np.int64), minlength=len(out))
    return out.reshape(len(texts), dims), n_letters


def unit_rows(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.sqrt((x * x).sum(1, keepdims=True)), 1e-12)


def vectors(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    out = np.zeros_like(counts)
    np.log(counts, out=out, where=counts > 0)
    return unit_rows((out + (counts > 0)) * idf)


def clusters(x: np.ndarray, k: int, rounds: int = 8) -> np.ndarray:
    """Spherical k-means from the farthest points; k centroids at most."""
    picked = [int((x @ unit_rows(x.mean(0, keepdims=True))[0]).argmax())]
    near = x @ x[picked[0]]
    while len(picked) < min(k, len(x)):
        picked.append(int(near.argmin()))
        near = np.maximum(near, x @ x[picked[-1]])
    c = x[picked]
    for _ in range(rounds):
        own = (x @ c.T).argmax(1)
        c = unit_rows(np.stack([x[own == i].mean(0) if (own == i).any() else c[i] for i in range(len(c))]))
    return c.astype(np.float32)


def limits(seen: np.ndarray, low: float = 0.05, part: float = 0.5, part_widened: float = 0.3, enough: int = 20) -> np.ndarray:
    """seen: counts of training texts, languages by length classes by bins of cosine. Cosines below which a text is rejected.

    Short texts have smaller cosines, so that a class which takes in its neighbours has the smaller part.
    """
    classes = seen.shape[1]

    def limit(own: np.ndarray, kind: int) -> float | None:
        for wide in range(classes):
            counts = own[max(0, kind - wide) : kind + wide + 1].sum(0)
            if counts.sum() >= enough:
                # more than the share: of 20 texts an odd one doesn't count
                at = int(np.searchsorted(np.cumsum(counts), low * counts.sum(), "right"))
                return (part_widened if wide else part) * at / BINS
        return None

    every = [limit(seen.sum(0), k) for k in range(classes)]
    out = [[limit(own, k) for k in range(classes)] for own in seen]
    return np.array([[next((v for v in (x, e) if v is not None), -1.0) for x, e in zip(own, every, strict=True)] for own in out]).reshape(len(seen), classes)


@dataclass
class Model:
    langs: list[str]  # of each centroid
    centroids: np.ndarray
    least: np.ndarray  # cosine below which a text is rejected: centroids by length classes
    idf: np.ndarray
    sharpness: float = 25.0

    def predict(self, texts: list[str | None], letters: Letters) -> pd.DataFrame:
        n, names = len(texts), sorted(set(self.langs))
        lang, score, cosine, rejected = ["und"] * n, np.zeros(n), np.zeros(n), np.ones(n, dtype=bool)
        group = np.array([names.index(x) for x in self.langs], dtype=np.int64)
        for part in _parts(texts):
            at = [i for i in part if texts[i]]
            if not at or not names:
                continue
            counts, n_letters = ngram_counts([texts[i] for i in at], len(self.idf), letters)
            near = vectors(counts, self.idf) @ self.centroids.T
            by_lang = np.stack([near[:, group == g].max(1) for g in range(len(names))], axis=1)
            best, low = by_lang.argmax(1), near.argmax(1)
            e = np.exp(self.sharpness * (by_lang - by_lang.max(1, keepdims=True)))
            for j, i in enumerate(at):
                if n_letters[j]:
                    lang[i], score[i], cosine[i] = names[best[j]], 1 / e[j].sum(), by_lang[j, best[j]]
                    rejected[i] = cosine[i] < self.least[low[j], np.searchsorted(LENGTHS, n_letters[j], "right")]
        return pd.DataFrame({"lang_pred": lang, "score": np.clip(score, 0.0, 1.0), "cosine": cosine, "rejected": rejected})


def _parts(texts: list[str | None], chars: int = 400_000, rows: int = 128) -> Iterator[list[int]]:
    part, size = [], 0
    for i, x in enumerate(texts):
        part.append(i)
        size += len(x or "")
        if size >= chars or len(part) >= rows:
            yield part
            part, size = [], 0
    if part:
        yield part


def fit(training: DataFrame, dims: int = 4096, k: int = 4, sample: int = 1000) -> Model:
    """training: doc_id, text, lang. See the module's text for what is counted over all rows and what on a sample."""
    rows = training.select(F.col("doc_id").cast("string").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang")).where("lang is not null and text is not null")

    def frequencies(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        letters, df, n = Letters(), np.zeros(dims, dtype=np.int64), 0
        for pdf in batches:
            texts = pdf["text"].tolist()
            for part in _parts(texts):
                counts, some = ngram_counts([texts[i] for i in part], dims, letters)
                df += (counts > 0).sum(0)
                n += int((some > 0).sum())
        yield pd.DataFrame({"dim": np.arange(-1, dims), "n": np.concatenate([[n], df])})

    counted = rows.select("text").mapInPandas(frequencies, "dim int, n long").groupBy("dim").agg(F.sum("n").alias("n")).collect()  # dims + 1 rows
    df = np.zeros(dims + 1)
    for r in counted:
        df[r["dim"] + 1] = r["n"]
    idf = (np.log((1 + df[0]) / (1 + df[1:])) + 1).astype(np.float32)

    def centroids(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("h").head(2 * sample)
        letters, texts, xs = Letters(), pdf["text"].tolist(), []
        for part in _parts(texts):
            counts, n = ngram_counts([texts[i] for i in part], dims, letters)
            xs.append(vectors(counts[n > 0], idf))
        x = np.concatenate(xs)
        if not len(x):
            return pd.DataFrame({c: pd.Series(dtype=object) for c in ("lang", "centroid")})
        return pd.DataFrame({"lang": pdf["lang"].iloc[0], "centroid": list(clusters(x, k))})

    # the sample is taken where the rows are, before they are dealt by language: by a hash of id and text, so that rows without an id or with one
    # id among them are drawn apart, and of rows that are alike in both one, so that neither copies nor ids decide whether a language is learnt
    h = F.xxhash64(F.lit("sample"), "doc_id", "text")
    hashed = rows.withColumn("h", h)
    sizes = hashed.groupBy("lang").agg(F.approx_count_distinct("h", 0.02).alias("n")).select("lang", F.least(F.lit(1.0), F.lit(float(sample)) / F.greatest("n", F.lit(1))).alias("rate"))
    drawn = hashed.join(F.broadcast(sizes), "lang").where(F.pmod("h", F.lit(1 << 30)) < F.col("rate") * (1 << 30))
    chosen = drawn.groupBy("lang", "h").agg(F.first("text").alias("text"))
    found = sorted(chosen.groupBy("lang").applyInPandas(centroids, "lang string, centroid array<float>").collect(), key=lambda r: (r["lang"], r["centroid"]))
    c = np.array([r["centroid"] for r in found], dtype=np.float32).reshape(len(found), dims)
    langs = [r["lang"] for r in found]
    names = sorted(set(langs))
    place = {x: i for i, x in enumerate(names)}
    model_at = training.sparkSession.sparkContext.broadcast((c, np.array([place[x] for x in langs], dtype=np.int64), idf, place))

    def closeness(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        c, group, idf, place = model_at.value
        letters, seen = Letters(), np.zeros((len(place), len(LENGTHS) + 1, BINS + 1), dtype=np.int64)
        for pdf in batches:
            pdf = pdf[pdf["lang"].isin(place)]
            texts, own = pdf["text"].tolist(), pdf["lang"].map(place).to_numpy(dtype=np.int64)
            for part in _parts(texts):
                counts, n = ngram_counts([texts[i] for i in part], len(idf), letters)
                mine, x = own[part][n > 0], vectors(counts[n > 0], idf) @ c.T
                x = np.where(group == mine[:, None], x, 0.0).max(1, initial=0.0)
                np.add.at(seen, (mine, np.searchsorted(LENGTHS, n[n > 0], "right"), np.clip(x * BINS, 0, BINS).astype(np.int64)), 1)
        at = np.nonzero(seen)
        yield pd.DataFrame({"g": at[0], "kind": at[1], "bin": at[2], "n": seen[at]})

    seen = np.zeros((len(names), len(LENGTHS) + 1, BINS + 1), dtype=np.int64)
    # languages * lengths * bins rows
    for r in rows.select("text", "lang").mapInPandas(closeness, "g int, kind int, bin int, n long").groupBy("g", "kind", "bin").agg(F.sum("n").alias("n")).collect():
        seen[r["g"], r["kind"], r["bin"]] = r["n"]
    least = limits(seen)
    return Model(langs, c, least[[place[x] for x in langs]].reshape(len(langs), len(LENGTHS) + 1), idf)


def language(model_at, text: Column) -> Column:
    """A struct of lang_pred, score, cosine and rejected; model_at: the broadcast model."""

    @F.pandas_udf("lang_pred string, score double, cosine double, rejected boolean")
    def predict(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        letters = Letters()
        for x in batches:
            yield model_at.value.predict(x.tolist(), letters)

    return predict(text.cast("string"))


def identify(docs: DataFrame, training: DataFrame, **parameters: int) -> DataFrame:
    """docs with the columns lang_pred, score, cosine and rejected."""
    model_at = docs.sparkSession.sparkContext.broadcast(fit(training, **parameters))
    found = language(model_at, F.col("text"))
    return docs.withColumns({x: found[x] for x in ("lang_pred", "score", "cosine", "rejected")})
