"""Quality rules by tokeniser fertility, after a base of counts on words and lines.

Public vocabularies (a parameter) encode every whole text: one of pieces with byte fallback and one of bytes. Three measures follow
for each: characters per token, the share of tokens that fall back to bytes, and the entropy of the text's tokens in
bits, relative to the most that its number of tokens allows, log2(min(tokens, vocabulary)). A vocabulary of pieces falls back where it has
none for a character; in one of bytes a token falls back if its bytes are not whole characters. Columns of all but the first vocabulary end in
its name. Each group of texts, by language or
else by the script of most letters, has a band for each measure: the quartiles of the group's texts that pass the base,
widened by ``width`` times the distance between them (three: far outliers only) and by a least margin. Texts outside a band
are not kept. Quartiles come from exact counts of finely binned values over all texts; a text is kept if every vocabulary's measures are within. A language of fewer than ``least_group``
texts has, for each of its scripts, the band of that script's texts in all languages; where the script has fewer too, that
of its own few texts with spread and margins times ``widen``. Texts of other scripts never judge it.

Words are runs of bytes other than ASCII white space. Edge cases: null text has no words and fails the base, as does
empty text; a text without tokens has null measures. Null language: the script's group. Very long texts are used whole. Repeated
rows count each. No rows: no rows. Further columns stay as they are; result columns replace columns of their own names.
"""

from __future__ import annotations

import functools
import unicodedata
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ._shared import written
from .tokenizing import public_path, ranked

SYMBOLS = "#*$%&|<>"
MEASURES = {"chars_per_token": 0.02, "byte_share": 0.002, "entropy": 0.005}  # with the widths of their bins
MARGINS = {"chars_per_token": 0.1, "byte_share": 0.02, "entropy": 0.02}
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def columns(vocabularies: dict[str, str]) -> dict[str, str]:
    """Names of the columns that measured() finds, with their types."""
    own = {f"{x}{name}": kind for name in vocabularies for x, kind in {"n_tokens": "long", **dict.fromkeys(MEASURES, "double")}.items()}
    return dict.fromkeys(COUNTS, "long") | own | {"script": "string"}


def measures(names: list[str]) -> dict[str, tuple[float, float]]:
    """Of each measure's column the width of its bins and its margin."""
    return {f"{m}{name}": (step, MARGINS[m]) for name in names for m, step in MEASURES.items()}


def whole(token: bytes) -> bool:
    """Whether the bytes are whole characters."""
    try:
        token.decode()
    except UnicodeDecodeError:
        return False
    return True


@functools.lru_cache(maxsize=4)
def vocabulary(path: str) -> tuple[Callable[[str], list[int]], np.ndarray]:
    """Texts to ids, and which ids are fallbacks to bytes: of pieces (.model) or of ranks of bytes (.tiktoken)."""
    if path.endswith(".tiktoken"):
        coder = ranked(path)
        return coder.encode_ordinary, np.array([not whole(coder.decode_single_token_bytes(i)) for i in range(coder.n_vocab)])
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    return model.encode, np.array([model.is_byte(i) for i in range(model.get_piece_size())])


def fertility(text: str, encode: Callable[[str], list[int]], is_byte: np.ndarray) -> tuple[int, float | None, float | None, float | None]:
    """Tokens, and the measures."""
    ids = np.array(encode(text), dtype=np.int64)
    n = len(ids)
    if not n:
        return 0, None, None, None
    p = np.unique(ids, return_counts=True)[1] / n
    return n, len(text) / n, float(is_byte[ids].mean()), float(-(p * np.log2(p)).sum() / np.log2(min(n, len(is_byte)))) if n > 1 else 1.0


@functools.lru_cache(maxsize=65536)
def script_of(letter: str) -> str:
    """The first word of a letter's Unicode name, which names its script."""
    return unicodedata.name(letter, "UNKNOWN").split()[0].split("-")[0].lower()


def repeated_words(words: list[bytes], window: int = 3) -> int:
    """Words in windows that occur at least twice in the text."""
    if len(words) <= window:
        return 0
    codes: dict[bytes, int] = {}
    x = np.fromiter((codes.setdefault(w, len(codes)) for w in words), dtype=np.int64, count=len(words))
    key = x[: len(x) - window + 1]
    for k in range(1, window):
        # pairs renumbered, so that the product can't overflow
        key = np.unique(key, return_inverse=True)[1] * len(codes) + x[k : len(x) - window + 1 + k]
    _, at, n = np.unique(key, return_inverse=True, return_counts=True)
    twice = np.flatnonzero(n[at] > 1)
    covered = np.zeros(len(words) + 1, dtype=np.int64)
    np.add.at(covered, twice, 1)
    np.add.at(covered, twice + window, -1)
    return int((np.cumsum(covered) > 0).sum())


def base_counts(text: str) -> tuple[int, int, int, int, int]:
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()
    chars = len(text) - sum(text.count(x) for x in " \t\n\v\f\r")
    seen: set[str] = set()
    duplicates = 0
    for line in text.split("\n"):
        if line.strip(" \t\v\f\r"):
            duplicates += line in seen
            seen.add(line)
    return len(words), chars, sum(text.count(x) for x in SYMBOLS), duplicates, repeated_words(words)


def main_script(text: str) -> str:
    """Of the letters' scripts the most frequent, ties to the first by name; without letters: none."""
    found: dict[str, int] = {}
    for x in set(text):
        if x.isalpha():
            s = script_of(x)
            found[s] = found.get(s, 0) + text.count(x)
    return min(found, key=lambda s: (-found[s], s)) if found else "none"


def measured(vocabularies: dict[str, str], text: Column) -> Column:
    """A struct of columns() for each text."""
    names = columns(vocabularies)

    @F.pandas_udf(", ".join(f"{x} {kind}" for x, kind in names.items()))
    def measure(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        models = [vocabulary(x) for x in vocabularies.values()]
        for batch in batches:
            texts = [x or "" for x in batch]
            rows = [(*base_counts(x), *[v for m in models for v in fertility(x, *m)], main_script(x)) for x in texts]
            yield pd.DataFrame(rows, columns=list(names))

    return measure(text.cast("string"))


def bands(passed: DataFrame, names: list[str], width: float, least_group: int, widen: float) -> DataFrame:
    """passed: band_group, script and the measures of vocabularies of these names. A row (band_group, script, low_*, high_*) for each pair of these."""
    every = measures(names)
    long = passed.select("band_group", "script", F.explode(F.array(*[F.struct(F.lit(m).alias("measure"), F.floor(F.col(m) / step).alias("bin")) for m, (step, _) in every.items()])).alias("x")).select("band_group", "script", "x.*").where("bin is not null")
    each = written(long.groupBy("band_group", "script", "measure", "bin").agg(F.count("*").alias("n")), "bins")  # bins, not texts

    def edges(by: list[str], width: float, margin: float, name: str) -> DataFrame:
        within = Window.partitionBy(*by, "measure")
        counts = each.groupBy(*by, "measure", "bin").agg(F.sum("n").alias("n"))
        ranked = counts.withColumn("upto", F.sum("n").over(within.orderBy("bin"))).withColumn("total", F.sum("n").over(within))
        at = lambda q: F.min(F.when(F.col("upto") >= F.col("total") * q, F.col("bin")))
        quart = ranked.groupBy(*by, "measure").agg(at(0.25).alias("q1"), at(0.75).alias("q3"), F.max("total").alias("total"))
        of = lambda m, x: F.max(F.when(F.col("measure") == m, F.col(x)))
        out = [F.max("total").alias("texts")]
        for m, (step, least) in every.items():
            spread = F.greatest((of(m, "q3") - of(m, "q1")) * step * width, F.lit(least * margin))
            out += [(of(m, "q1") * step - spread).alias(f"low_{m}"), ((of(m, "q3") + 1) * step + spread).alias(f"high_{m}")]
        band = quart.groupBy(*by).agg(*out)
        return band.select(*by, F.struct(*[c for c in band.columns if c not in by]).alias(name))

    pairs = each.select("band_group", "script").distinct()
    joined = pairs.join(edges(["band_group"], width, 1.0, "of_group"), "band_group").join(edges(["script"], width, 1.0, "of_script"), "script")
    joined = joined.join(edges(["band_group", "script"], width * widen, widen, "of_few"), ["band_group", "script"])
    enough = lambda x: F.col(f"{x}.texts") >= least_group
    band = F.when(enough("of_group"), F.col("of_group")).when(enough("of_script"), F.col("of_script")).otherwise(F.col("of_few"))
    return joined.select("band_group", "script", band.alias("band")).select("band_group", "script", "band.*").drop("texts")


def quality(docs: DataFrame, vocabularies: dict[str, str] | None = None, carry: list[str] | None = None, width: float = 3.0, least_group: int = 100, widen: float = 2.0, least_words: int = 50, most_repeated: int = 50) -> DataFrame:
    """docs with text and, if there is one, lang, to the same rows with columns(), base_failed, band_group and kept.

    vocabularies: of each the end of its columns' names, and its file. Without them the 32,000 pieces with byte fallback, and the byte-level one for many
    languages as ``_bytes``.
    carry: the columns of docs to return, all if not given; they are written once between the two passes.
    most_repeated: per cent of the words.
    """
    models = vocabularies or {"": public_path("piece_bpe_32k.model"), "_bytes": public_path("byte_bpe_multi_50k.tiktoken")}
    found = measured(models, F.col("text"))
    names = list(columns(models))
    failed = (F.col("n_words") < least_words) | (F.col("n_repeat_words") * 100 > F.col("n_words") * most_repeated)
    lang = F.col("lang").cast("string") if "lang" in docs.columns else F.lit(None).cast("string")
    group = F.coalesce(lang, F.concat(F.lit("script "), F.col("script")))
    kept = [c for c in (docs.columns if carry is None else carry) if c not in (*names, "base_failed", "band_group", "kept")]
    out = docs.withColumns({x: found[x] for x in names}).withColumns({"base_failed": failed, "band_group": group})
    out = written(out.select(*kept, *names, "base_failed", "band_group"), "measured")
    limits = written(bands(out.where("not base_failed"), list(models), width, least_group, widen), "bands")  # a row for each language and script
    edges = [c for c in limits.columns if c not in ("band_group", "script")]
    within = F.lit(True)
    joined = out.join(limits, ["band_group", "script"], "left")
    for m in measures(list(models)):
        within = within & F.coalesce(F.col(m).between(F.col(f"low_{m}"), F.col(f"high_{m}")), F.lit(False))
    return joined.withColumn("kept", ~F.col("base_failed") & within).drop(*edges)
