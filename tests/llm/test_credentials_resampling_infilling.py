"""Credentials, importance resampling and fill-in-the-middle against brute force, and on odd rows."""

import bisect
import hashlib
import math
import random
import re
import zlib
from fractions import Fraction

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from kerngrain.llm import infilling, resampling
from kerngrain.llm.credentials import ASSIGN_LEAST, BASE, BREAK, COMPLEMENT, KINDS, REACH, find_secrets, redacted

DOCS = "doc_id long, text string"
KEY = "AKIA" + "ABCD1234" * 2
HEX = "0123456789abcdef" * 2


# --- credentials ---------------------------------------------------------------------------------------------------
def brute_spans(text, reach=REACH):
    text = text or ""
    order = {k: i for i, k in enumerate(KINDS)}
    found = [(m.start(), k, m.end()) for k, p in KINDS.items() for m in re.finditer(p, text) if k != "assign" or len(m.group(2)) >= ASSIGN_LEAST]
    breaks = [m.start() for m in re.finditer(BREAK, text)]
    base = [x for x in found if x[1] in BASE]
    parts = base + [x for x in found if x[1] not in BASE and not any(x[0] < b[2] and b[0] < x[2] for b in base)]
    scope = lambda x: bisect.bisect_right(breaks, x[0])
    gap = lambda x, y: max(x[0] - y[2], y[0] - x[2])
    near = lambda x: any(gap(x, y) <= reach and y[1] in COMPLEMENT[x[1]] and scope(x) == scope(y) for y in parts)
    return sorted((x for x in parts if x[1] in BASE or near(x)), key=lambda x: (x[0], order[x[1]]))


def spans(spark, texts, **more):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], DOCS)
    return {r.doc_id: [tuple(x) for x in r.spans] for r in find_secrets(df, **more).collect()}


def test_parts_count_only_together(spark):
    texts = [
        "user: bob\npwd = hunter2\n",  # both
        "user: bob\n\npwd = hunter2\n",  # two scopes
        "user: bob " + "x y " * 110 + "pwd = hunter2",  # too far
        "see https://a.example/x and nothing else",
        f"https://a.example/x token = {HEX}",
        f"{KEY} and secret: abcd",
        "PassWord='longenoughvalue1' login=mel",
        "token=short token==also-short-but-12",
        "AKIA12 deadbeef",
        None,
        "",
        f"é漢\U0001f600 {KEY}",
    ]
    got = spans(spark, texts)
    kinds = {i: [k for _, k, _ in x] for i, x in got.items()}
    assert kinds[0] == ["id", "key"] and kinds[1] == kinds[2] == kinds[3] == [] and kinds[4] == ["endpoint", "assign", "hex"]
    assert kinds[5] == ["access", "key"] and kinds[6] == ["assign", "id"] and kinds[7] == ["assign"] and kinds[8] == kinds[9] == kinds[10] == []
    assert got[11] == [(4, "access", 24)]
    assert got == {i: brute_spans(t) for i, t in enumerate(texts)}


def test_random_texts_as_brute_force(spark):
    rng = random.Random(3)
    bits = [KEY, "AKIA", HEX, "deadbeef", "password", "API_KEY", "toKen", " = ", ":", "'", '"', "abcdefghijkl", "x", " ", "\n", "\n\n", "\n \t\n", "user: ann", "client_id=7a7a7a", "pwd: s3cret!", "https://h.example/p", "host: db.example", "é", "ſ", "K", "=", "A" * 40, "word " * 30]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randrange(1, 60))) for _ in range(300)]
    texts.append("".join(rng.choice(bits) for _ in range(3000)))  # one very long text
    assert spans(spark, texts) == {i: brute_spans(t) for i, t in enumerate(texts)}


def test_a_text_of_many_parts_takes_one_sweep(spark):
    text = f"user: ann {HEX} token: abcd\n" * 60000
    (found,) = spans(spark, [text]).values()
    assert len(found) == 3 * 60000


def test_credentials_on_odd_rows_without_python(spark):
    df = spark.createDataFrame([(None, f"x {KEY}", "a"), (None, f"x {KEY}", "a"), (1, None, None)], DOCS + ", row string").withColumn("spans", F.lit(5)).withColumn("parts", F.lit(1))
    got = find_secrets(df)
    assert got.columns == ["doc_id", "text", "row", "parts", "spans"] and sorted(len(r.spans) for r in got.collect()) == [0, 1, 1]
    assert "Python" not in got._jdf.queryExecution().toString() and "Arrow" not in got._jdf.queryExecution().toString()
    assert find_secrets(df.limit(0)).count() == 0
    out = {r.doc_id: r.text for r in redacted(spark.createDataFrame([(1, f"é {KEY}, {HEX}."), (2, None), (3, "clean")], DOCS)).collect()}
    assert out == {1: "é " + "*" * 20 + ", " + "*" * 32 + ".", 2: None, 3: "clean"}


# --- importance resampling -----------------------------------------------------------------------------------------
def grams(text, n):
    words = [w for w in re.split("[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")) if w]
    return [" ".join(words[i : i + k]) for k in range(1, n + 1) for i in range(len(words) - k + 1)], len(words)


def brute_resample(rows, target, share, least, n=1, buckets=10_000, seed=2024):
    count = lambda texts: np.bincount([zlib.crc32(x.encode()) % buckets for t in texts for x in grams(t, n)[0]], minlength=buckets)
    s, t = count([x for _, x in rows]), count(target)
    gain = [math.floor(1000 * math.log((int(b) + 1) * (int(s.sum()) + buckets) / ((int(a) + 1) * (int(t.sum()) + buckets)))) for a, b in zip(s, t, strict=True)]
    out = []
    for i, (doc, text) in enumerate(rows):
        found, words = grams(text, n)
        weight = sum(gain[zlib.crc32(x.encode()) % buckets] for x in found) // len(found) if found else 0
        h = int(hashlib.sha256(f"{seed}:{'' if doc is None else doc}".encode()).hexdigest()[:8], 16)
        out.append([i, doc, len(found), words, weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32)))])
    order = sorted((x for x in out if x[3] >= least), key=lambda x: (-x[5], x[1] is None, x[1] or 0, x[0]))
    rank = {x[0]: k + 1 for k, x in enumerate(order[: math.floor(share * len(order))])}
    return sorted(((x[1], x[2], x[4], x[5], rank.get(x[0])) for x in out), key=repr)


@pytest.mark.parametrize("ngrams", [1, 2])
def test_resampling_as_brute_force(spark, ngrams):
    rng = random.Random(ngrams)
    words = ["alpha", "Beta", "gamma9", "é漢", "it's", "x" * 300, "THE", "the"]
    rows = [(i if i % 9 else 5, " ,.\n".join(rng.choice(words[: 2 + i % 7]) for _ in range(rng.randrange(0, 60)))) for i in range(300)]
    rows += [(None, "alpha beta " * 20), (None, "alpha beta " * 20), (1000, None), (1001, ""), (1002, "Alpha " * 30000)]
    target = [(1, "alpha beta the the"), (2, None), (3, "")]
    docs = spark.createDataFrame(rows, DOCS).repartition(5).withColumn("score", F.lit("clash")).withColumn("part", F.lit(1))
    for share in (Fraction(1, 10), Fraction(1), Fraction(0), Fraction(1, 100000)):
        got = resampling.resample(docs, spark.createDataFrame(target, "item_id long, text string"), share, 20, ngrams, 97, ranges=7).collect()
        want = brute_resample(rows, [t for _, t in target], share, 20, ngrams, 97)
        assert sorted(((r.doc_id, r.n_features, r.weight, r.score, r["rank"]) for r in got), key=repr) == want and all(r.part == 1 for r in got)


def test_resampling_of_nothing(spark):
    empty, target = spark.createDataFrame([], DOCS), spark.createDataFrame([], "item_id long, text string")
    assert resampling.resample(empty, target, Fraction(1, 2)).count() == 0
    got = resampling.resample(spark.createDataFrame([(i, "one two") for i in range(4)], DOCS), target, Fraction(1, 2), least_words=1).collect()
    assert sorted(r["rank"] or 9 for r in got) == [1, 2, 9, 9]


@settings(max_examples=8, deadline=None)
@given(st.lists(st.tuples(st.integers(-(2**62), 2**62) | st.integers(-2, 2), st.integers(-1, 1) | st.just(2**63 - 1)), min_size=1, max_size=30), st.integers(1, 30), st.sampled_from([2, 5, 64]))
def test_cutoff_is_the_nth_row(keys, n, ways):
    from pyspark.sql import SparkSession

    spark = SparkSession.getActiveSession()
    rows = [(a, b, i) for i, (a, b) in enumerate(keys)]
    got = resampling.cutoff(spark.createDataFrame(rows, "a long, b long, r long").coalesce(1), ["a", "b", "r"], n, ways)
    assert got == (list(sorted(rows)[n - 1]) if n <= len(rows) else None)


# --- fill in the middle --------------------------------------------------------------------------------------------
def brute_middle(doc, text, seed=7, rate=100, spm=50):
    text = text or ""
    units = re.findall(r"[^\n]*\n|[^\n]+", text)
    digest = hashlib.sha256(f"{seed}:{'' if doc is None else doc}".encode()).hexdigest()
    h = [int(digest[8 * i : 8 * i + 8], 16) for i in range(4)]
    if not text or any(x in text for x in infilling.SENTINELS) or h[2] % 100 >= rate:
        return len(units), "plain", None, None, text
    a, b = sorted(x % (len(units) + 1) for x in h[:2])
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    spm_ = h[3] % 100 < spm
    return len(units), "spm" if spm_ else "psm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}" if spm_ else f"<P>{p}<S>{s}<M>{m}"


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from("\n\n\r <SPM>é漢"), st.characters(codec="utf-8")), max_size=60), st.integers(0, 12))
def test_line_ends_of_any_text(text, k):
    lines = infilling.Lines(keep=50)
    counted = lines.of((text * k).encode())
    units = re.findall(r"[^\n]*\n|[^\n]+", text * k)
    assert counted.n == len(units)
    for i in range(len(units) + 1):
        before = "".join(units[:i])
        assert counted.after(i) == (len(before.encode()), len(before))


def test_shared_chunks_are_summarized_once_and_cut_alike():
    rng = np.random.default_rng(5)
    passage = "\n".join(f"line {i} é" for i in rng.integers(0, 10**6, 4000)).encode()
    lines = infilling.Lines()
    lines.of(passage)
    made = lines.made
    assert made > 20
    lines.of(b"something else\n" * 9 + passage)
    assert lines.made - made <= 3  # but for what is about the front
    small, large = infilling.BLOCK, infilling.cut_places(passage)
    try:
        infilling.BLOCK = 1000
        assert infilling.cut_places(passage) == large
    finally:
        infilling.BLOCK = small
    for size in (0, 1, 15, 16, 17):
        assert all(0 < x < size for x in infilling.cut_places(passage[:size]))


@pytest.mark.parametrize("rate,spm", [(100, 50), (60, 0), (0, 50)])
def test_middles_as_brute_force(spark, rate, spm):
    rng = random.Random(rate)
    bits = ["\n", "a", "é", "<", "S>", "<M", "\r\n", "漢字 text", "word " * 200, "P", ">"]
    rows = [(i, "".join(rng.choice(bits) for _ in range(rng.randrange(0, 40)))) for i in range(300)]
    rows += [(None, "x\ny\n"), (None, "x\ny\n"), (7, "x\ny"), (8, None), (9, ""), (10, "\n"), (11, "<M>"), (12, "line\n" * 200000), (13, "no end " * 200000)]
    docs = spark.createDataFrame(rows, DOCS).withColumn("n", F.lit("clash")).withColumn("h1", F.lit(2)).withColumn("whole", F.lit(None).cast("int"))
    got = infilling.fill_in_middle(docs, rate=rate, spm=spm).withColumn("back", infilling.restored(F.col("output"), F.col("form")))
    assert got.columns == ["doc_id", "text", "h1", "whole", "n", "form", "prefix_chars", "middle_chars", "output", "back"]
    made = [(r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, r.output, r.back) for r in got.collect()]
    assert sorted(made, key=repr) == sorted(((i, *brute_middle(i, t, rate=rate, spm=spm), t or "") for i, t in rows), key=repr)
    assert infilling.fill_in_middle(docs.limit(0)).count() == 0
