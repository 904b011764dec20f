"""BPE encoding and decoding of whole texts with content-defined chunks shared across documents, equal to the library's own.

A text is cut where a rolling hash of its last ``WINDOW`` characters ends in ``BITS`` zero bits, so that a passage is cut alike
wherever it occurs. What a chunk holds between its first and its last white space, its inside, encodes alike in any
context, as no token of a vocabulary that drops white space reaches across it.

1. Digests of all insides are counted over all documents; of those that more than one row holds a filter is made, of
``SPARSE`` bits for each of them: ``filter_words`` words of 64 bits or more, ``most_filter_words`` (128 MB) at most. Where the corpus shares more than
fit, those go in that the most rows hold, by powers of two of that number, and the rest is encoded in each document, so that the filter neither
outgrows memory nor fills up until everything passes it. 2. Insides that pass it go by digest, each text once,
to be encoded once: a table of digest and ids. What passes by chance is in that table too, so that the filter only
decides how much is shared, never a result. 3. Every document of which shared insides are a good part (``least_shared``) encodes what else it holds,
and leaves holes where these are; others encode all, as moving their ids would cost more than it saves. 4. Holes are joined with the table by digest, ids are put in, and the ids decoded. Documents without holes skip this.

What is left about a cut, the end of one chunk and the beginning of the next, is the join: it is encoded by itself and
again together with the nearest words of both neighbours; where the ids disagree, twice as many words are taken, until
they agree exactly, and where nothing is left to take the library encodes the document whole. Words that a worker has met
before are not encoded again; what is kept of these is emptied at a bounded size (``KEEP``, in characters), which changes no result.

Only space, tab, newline and carriage return count as white space here; other characters of that kind stay inside words and go to the
library. The tokenizer must drop white space before it makes words (``whitespace_free`` tests that); any other is refused.

Edge cases: null and empty texts have no ids and decode to the empty text. Strings of special tokens are theirs, as in the library.
Very long texts are used whole, also without any cut or white space. Repeated rows and null ids stay as they are. No rows: no rows.
Further columns stay as they are; result columns replace columns of their own names.
"""

from __future__ import annotations

import functools
import hashlib
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import discard, free_name, written
from .tokenizing import public_path, tokenizer

WINDOW, BITS, KEEP = 16, 8, 32_000_000
SPARSE = 16  # bits of the filter for each digest in it: one of sixteen others passes by chance
BLOCK = 4096  # words of the filter that one row brings to the driver
ROWS = 100  # documents whose new words are encoded together
STOPS = ".,;:!?"
_FIRST = re.compile(r"[ \t\n\r]")
_BASE = 0x9E3779B97F4A7C15
_DOWN = pow(_BASE, -1, 2**64)


class Cutter:
    """Cuts by a rolling hash: a polynomial in the last characters' codes modulo 2**64."""

    def __init__(self) -> None:
        self.up = self.down = np.empty(0, dtype=np.uint64)

    def cuts(self, text: str) -> list[int]:
        codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)
        n = len(codes)
        if n <= WINDOW:
            return []
        if len(self.up) < n:
            self.up, self.down = (np.multiply.accumulate(np.concatenate([np.ones(1, dtype=np.uint64), np.full(n, np.uint64(x))])) for x in (_BASE, _DOWN))
        x = codes * np.uint64(0xD6E8FEB86659FD93)
        x = (x ^ (x >> np.uint64(32))) * self.down[:n]
        total = np.cumsum(x, dtype=np.uint64)
        last = total[WINDOW:] - total[:-WINDOW]
        h = last * self.up[WINDOW:n]
        return (np.flatnonzero(h >> np.uint64(64 - BITS) == 0) + WINDOW + 1).tolist()


def whitespace_free(path: str) -> bool:
    """Whether white space around and between words leaves their ids as they are."""
    t = tokenizer(path)
    ids = lambda x: t.encode(x, add_special_tokens=False).ids
    words = ["one", "Two,", "3's", "#*", "naïve"]
    return all(ids(sep.join(words)) == [i for w in words for i in ids(w)] for sep in (" ", "\n", "\t \r\n"))


def pieces(text: str, cutter: Cutter) -> list[str]:
    """The text as insides of chunks and the joins between them, in turn; first a join."""
    out, begin, join = [], 0, ""
    for end in [*cutter.cuts(text), len(text)]:
        chunk, begin = text[begin:end], end
        first = _FIRST.search(chunk)
        if first is None:
            join += chunk
            continue
        last = max(chunk.rfind(x) for x in " \t\n\r")
        out += [join + chunk[: first.start()], chunk[first.start() : last + 1]]
        join = chunk[last + 1 :]
    return [*out, join]


def digest(inside: str) -> bytes:
    return xxhash.xxh3_128_digest(inside.encode("utf-8", "surrogatepass"))


class Filter:
    """A set of digests, and some others by chance, in a given number of bits."""

    def __init__(self, words: np.ndarray) -> None:
        self.words, self.n = words, len(words)

    def has(self, key: bytes) -> bool:
        word, bit = place(key, self.n)
        return bool(int(self.words[word]) >> bit & 1)


def place(key: bytes, n: int) -> tuple[int, int]:
    """The word and the bit of a digest."""
    x = int.from_bytes(key[:8], "little")
    return (x >> 6) % n, x & 63


def shared_keys(row: list[str], shared: Filter | None, least: float) -> list[bytes | None]:
    """Of a document's joins and insides the digests of the insides to take from the table, if these hold its ``least`` share."""
    none: list[bytes | None] = [None] * len(row)
    if shared is None:
        return none
    keys = [k if i % 2 and shared.has(k := digest(x)) else None for i, x in enumerate(row)]
    return keys if sum(len(x) for x, k in zip(row, keys, strict=True) if k) >= least * sum(map(len, row)) else none


def words_of(text: str) -> list[str]:
    return text.replace("\n", " ").replace("\t", " ").replace("\r", " ").split(" ")


class Encoder:
    """Texts to ids and decoded texts; keeps words it has met."""

    def __init__(self, path: str) -> None:
        self.tokenizer, self.cutter = tokenizer(path), Cutter()
        self.strings = None
        if self.tokenizer.decoder is None:  # decoding then puts spaces between the ids' strings
            self.strings = np.array([self.tokenizer.id_to_token(i) or "" for i in range(self.tokenizer.get_vocab_size())], dtype=object)
        ids = lambda x: self.tokenizer.encode(x, add_special_tokens=False).ids
        self.plain = all(ids(w + x) == ids(w.lower()) + ids(x) for w in ("Word", "ANOTHER", "x") for x in ("", *STOPS, ".,", "?!", "..."))
        self.small = self.tokenizer.get_vocab_size() <= 1 << 16  # ids are then kept and moved as 16 bits each
        self._forget()

    def _forget(self) -> None:
        self.words: dict[str, bytes] = {"": b""}
        self.kept = 0

    def _library(self, texts: list[str]) -> list[bytes]:
        kind = "H" if self.small else "I"
        return [array(kind, x.ids).tobytes() for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def wide(self, ids: bytes) -> bytes:
        """Ids as little-endian 32-bit integers."""
        return np.frombuffer(ids, dtype="<u2" if self.small else "<u4").astype("<u4").tobytes()

    def _learn(self, words: set[str]) -> None:
        """Ids of words. Letters of ASCII with stops after them go by their small letters and stops, if the tokenizer's do."""
        split = {}
        for w in words if self.plain else ():
            core = w.rstrip(STOPS)
            if core.isascii() and core.isalpha() and (len(core) < len(w) or not w.islower()):
                split[w] = (core.lower(), w[len(core) :])
        unknown = sorted(({x for pair in split.values() for x in pair} | words.difference(split)).difference(self.words))
        self.words.update(zip(unknown, self._library(unknown), strict=True))
        for w, (core, stops) in split.items():
            self.words[w] = self.words[core] + self.words[stops]
        self.kept += 40 * (len(unknown) + len(split))

    def ids(self, texts: list[str]) -> list[bytes]:
        """Of each text, such as a chunk's inside or a join, the ids by its words."""
        if self.kept > KEEP:
            self._forget()
        split = [words_of(x) for x in texts]
        self._learn(set().union(*split).difference(self.words))
        return [b"".join(map(self.words.__getitem__, x)) for x in split]

    def _disagreeing(self, rows: list[list[str]]) -> list[int]:
        """The rows whose joins don't agree with the library in any context. A row: joins and insides in turn.

        First all joins with a word on either side are encoded as one text; only where that differs, each by itself.
        """
        todo = [(k, i) for k, p in enumerate(rows) for i in range(0, len(p), 2) if p[i]]
        about = []
        for k, i in todo:
            p = rows[k]
            before, after = (p[i - 1].rsplit(None, 1)[-1:] if i else []), (p[i + 1].split(None, 1)[:1] if i + 1 < len(p) else [])
            about += [*before, p[i], *after]
        text = " ".join(about)
        if not text or self.ids([text]) == self._library([text]):
            return []
        out, n = set(), 1
        while todo:
            texts, last = [], []
            for k, i in todo:
                left, right = (rows[k][i - 1] if i else "").split(), (rows[k][i + 1] if i + 1 < len(rows[k]) else "").split()
                texts.append(" ".join([*left[-n:], rows[k][i], *right[:n]]))
                last.append(n >= max(len(left), len(right)))
            bad = [x != y for x, y in zip(self.ids(texts), self._library(texts), strict=True)]
            out |= {k for (k, _), b, end in zip(todo, bad, last, strict=True) if b and end}
            todo, n = [at for at, b, end in zip(todo, bad, last, strict=True) if b and not end], 2 * n
        return sorted(out)

    def parts(self, texts: list[str | None], shared: Filter | None = None, least: float = 0.0) -> list[list[tuple[bytes | None, bytes | None]]]:
        """Of each text runs of ids, and digests of shared insides in place of their ids."""
        rows = [pieces(x, self.cutter) if x else [] for x in texts]
        keys = [shared_keys(p, shared, least) for p in rows]
        own = iter(self.ids([x for p, held in zip(rows, keys, strict=True) for x, k in zip(p, held, strict=True) if k is None]))
        out = []
        for p, held in zip(rows, keys, strict=True):
            runs: list[tuple[bytes | None, bytes | None]] = []
            for k in held:
                if k is not None:
                    runs.append((None, k))
                elif runs and runs[-1][1] is None:
                    runs[-1] = (runs[-1][0] + next(own), None)
                else:
                    runs.append((next(own), None))
            out.append(runs)
        for k in self._disagreeing(rows):
            out[k] = [(self._library([texts[k]])[0], None)]
        return out

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Of each text the ids as little-endian 32-bit integers."""
        return [self.wide(b"".join(x for x, _ in p)) for p in self.parts(texts)]

    def decode(self, ids: bytes) -> str:
        """ids: little-endian 32-bit integers."""
        x = np.frombuffer(ids, dtype="<u4")
        if self.strings is not None:
            return " ".join(self.strings[x].tolist())
        return self.tokenizer.decode(x.tolist(), skip_special_tokens=False)


@functools.lru_cache(maxsize=2)
def encoder_of(path: str) -> Encoder:
    """One for each Python worker, so that words which a task has met are known to the next."""
    return Encoder(path)


def _result(encoder: Encoder, ids: bytes, digests: bool) -> tuple:
    ids = encoder.wide(ids)
    text = encoder.decode(ids)
    if digests:
        return len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest()
    return ids, text


def _slices(n: int) -> Iterator[slice]:
    return (slice(i, i + ROWS) for i in range(0, n, ROWS))


def shared_insides(texts: DataFrame) -> DataFrame:
    """texts (text) to (low, n): the first eight bytes of the digests that more than one row holds."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cutter = Cutter()
        for pdf in batches:
            found: dict[bytes, int] = {}
            for text in pdf["text"]:
                for x in {digest(p)[:8] for p in pieces(text, cutter)[1::2]} if text else ():
                    found[x] = found.get(x, 0) + 1
            if found:
                yield pd.DataFrame({"low": np.frombuffer(b"".join(found), dtype="<i8"), "n": list(found.values())})

    counted = texts.mapInPandas(count, "low long, n long").groupBy("low").agg(F.sum("n").alias("n"))
    return written(counted.where("n > 1"), "shared")


def sized(shared: DataFrame, least_words: int, most_words: int) -> tuple[int, int]:
    """Of shared_insides() the number of rows that a digest must be in to go into the filter, and the filter's words.

    A row for each power of two comes to the driver. The digests of the most rows go in even if they alone are too many.
    """
    power = F.floor(F.log2(F.col("n"))).cast("int")
    n_of = sorted(((r["power"], r["n"]) for r in shared.groupBy(power.alias("power")).agg(F.count("*").alias("n")).collect()), reverse=True)
    least, total = 2, 0
    for k, n in n_of:
        if total and (total + n) * SPARSE > most_words * 64:
            break
        least, total = 2**k, total + n
    words = least_words
    while words * 64 < total * SPARSE and words < most_words:
        words *= 2
    return least, min(words, most_words)


def filter_of(shared: DataFrame, words: int) -> Filter:
    """The filter of shared_insides(), made in tasks of BLOCK words each; the driver puts these together."""
    size = min(BLOCK, words)

    def block(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        x = pdf["low"].to_numpy(dtype=np.int64).view(np.uint64)
        bits = np.zeros(size, dtype=np.uint64)
        word = (x >> np.uint64(6)) % np.uint64(words) - np.uint64(key[0] * size)
        np.bitwise_or.at(bits, word.astype(np.int64), np.uint64(1) << (x & np.uint64(63)))
        return pd.DataFrame({"block": [key[0]], "bits": [bits.tobytes()]})

    at = F.floor(F.pmod(F.expr("shiftrightunsigned(low, 6)"), F.lit(words)) / size).alias("block")
    out = np.zeros(-(-words // size) * size, dtype=np.uint64)
    for r in shared.select("low", at).groupBy("block").applyInPandas(block, "block long, bits binary").toLocalIterator():
        out[r["block"] * size : (r["block"] + 1) * size] = np.frombuffer(r["bits"], dtype=np.uint64)
    return Filter(out[:words])


def table_of(texts: DataFrame, filter_at, path: str, least: float = 0.0) -> DataFrame:
    """(digest, inside_ids) of all insides that documents take from it, each encoded once."""

    def pick(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cutter, shared = Cutter(), filter_at.value
        for pdf in batches:
            found = {}
            for text in pdf["text"]:
                row = pieces(text, cutter) if text else []
                found.update((k, x) for x, k in zip(row, shared_keys(row, shared, least), strict=True) if k)
            if found:
                yield pd.DataFrame({"digest": list(found), "inside": list(found.values())})

    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder = encoder_of(path)
        for pdf in batches:
            for at in _slices(len(pdf)):
                part = pdf.iloc[at]
                yield pd.DataFrame({"digest": part["digest"].to_numpy(), "inside_ids": encoder.ids(part["inside"].tolist())})

    found = texts.mapInPandas(pick, "digest binary, inside string").groupBy("digest").agg(F.any_value("inside").alias("inside"))
    return written(found.mapInPandas(encode, "digest binary, inside_ids binary"), "insides")


def encode_documents(docs: DataFrame, path: str | None = None, digests: bool = False, carry: list[str] | None = None, filter_words: int = 1 << 18, least_shared: float = 0.5, most_filter_words: int = 1 << 24) -> DataFrame:
    """docs with ids (little-endian 32-bit integers) and decoded, or with their number and digests.

    carry: the columns of docs to return, all if not given. Without a path by the public vocabulary of 49,408 words and parts.
    """
    path = path or public_path("word_bpe_49k.json")
    if not whitespace_free(path):
        raise ValueError(f"{path}: this tokenizer does not drop white space")
    results = ("n_tokens", "ids_sha256", "decoded_sha256") if digests else ("ids", "decoded")
    kind = "n_tokens long, ids_sha256 string, decoded_sha256 string" if digests else "ids binary, decoded string"
    texts = docs.select(F.col("text").cast("string").alias("text"))
    counted = shared_insides(texts)
    least_rows, words = sized(counted, filter_words, max(filter_words, most_filter_words))
    shared = filter_of(counted.where(F.col("n") >= least_rows), words)
    discard(counted)
    filter_at = docs.sparkSession.sparkContext.broadcast(shared)

    @F.pandas_udf(f"{kind}, parts array<struct<ids:binary,digest:binary>>")
    def encode(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        encoder = encoder_of(path)
        for batch in batches:
            rows: list[tuple] = []
            for at in _slices(len(batch)):
                for parts in encoder.parts(batch.iloc[at].tolist(), filter_at.value, least_shared):
                    if any(k is not None for _, k in parts):
                        rows.append((*[None] * len(results), [{"ids": x, "digest": k} for x, k in parts]))
                    else:
                        rows.append((*_result(encoder, b"".join(x for x, _ in parts), digests), None))
            out = pd.DataFrame(rows, columns=[*results, "parts"])
            yield out.assign(n_tokens=pd.array(out["n_tokens"], dtype="Int64")) if digests else out

    kept = [c for c in (docs.columns if carry is None else carry) if c not in results]
    x, row = free_name(docs, "encoded"), free_name(docs, "row")
    rows = written(docs.select(*kept, encode(F.col("text").cast("string")).alias(x), F.monotonically_increasing_id().alias(row)), "encoded")
    whole = rows.where(F.col(f"{x}.parts").isNull()).select(*kept, *[F.col(f"{x}.{c}").alias(c) for c in results])
    if not shared.words.any():
        return whole
    insides = table_of(texts, filter_at, path, least_shared)
    holes = rows.where(F.col(f"{x}.parts").isNotNull()).select(F.col(row).alias("row"), F.posexplode(f"{x}.parts").alias("at", "part")).where("part.digest is not null")
    holes = written(holes.select("row", "at", F.col("part.digest").alias("digest")), "holes")
    ids = holes.join(insides, "digest").groupBy("row").agg(F.sort_array(F.collect_list(F.struct("at", "inside_ids"))).alias("insides"))  # of one document

    @F.pandas_udf(kind)
    def fill(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        encoder = encoder_of(path)
        for parts, insides in batches:
            rows = []
            for p, found in zip(parts, insides, strict=True):
                at = {r["at"]: r["inside_ids"] for r in found}
                rows.append(_result(encoder, b"".join(r["ids"] if r["digest"] is None else at[i] for i, r in enumerate(p)), digests))
            yield pd.DataFrame(rows, columns=list(results))

    filled = rows.where(F.col(f"{x}.parts").isNotNull()).join(ids.withColumnRenamed("row", row), row)
    filled = filled.withColumn(x, fill(F.col(f"{x}.parts"), F.col("insides"))).select(*kept, *[F.col(f"{x}.{c}").alias(c) for c in results])
    return whole.union(filled)
