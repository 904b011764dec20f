"""BPE by chunks, licences, page text and the pipeline: exact agreement, brute force, and odd rows."""

import hashlib
import time
from fractions import Fraction

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import corpus_pipeline
from kerngrain.llm import dom, licences, op07, wrappers
from kerngrain.llm.chunk_bpe import Cutter, Encoder, Filter, digest, encode_documents, filter_of, pieces, place, shared_insides, sized, table_of, whitespace_free
from kerngrain.llm.tokenizing import public_path, tokenizer
from tests.llm.test_dedup_pack import brute

PATH = public_path("word_bpe_49k.json")
DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def encoder():
    return Encoder(PATH)


def library(text):
    ids = tokenizer(PATH).encode(text, add_special_tokens=False).ids
    return np.array(ids, dtype="<u4").tobytes(), tokenizer(PATH).decode(ids, skip_special_tokens=False)


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from(" \n\t\r.,'!?<|>sStTaÉé1́\u0085\x1c Σ"), st.characters(codec="utf-8")), max_size=80))
def test_any_text_as_the_library(text):
    encoder = Encoder(PATH)
    ids = encoder.encode([text * 3])[0]
    assert (ids, encoder.decode(ids)) == library(text * 3)


def test_long_and_repeated_texts_as_the_library(encoder):
    rng = np.random.default_rng(0)
    passage = " ".join(f"Word{i}, " for i in rng.integers(0, 900, 3000))
    texts = ["a" * 20000, passage, "x" + passage, passage[7:] + "\n" + passage, "<|startoftext|> It's 123!" * 50, "word " * 9000, "", None, " ", "日本" * 3000]
    for text, ids in zip(texts, encoder.encode(texts), strict=True):
        assert (ids, encoder.decode(ids)) == library(text or "")


def test_joins_that_disagree_go_to_the_library(encoder):
    passage = " ".join(f"Word{i}, " for i in range(3000))
    rows = [pieces(passage, encoder.cutter)]
    assert len(rows[0]) > 20 and "".join(rows[0]) == passage and encoder._disagreeing(rows) == []
    other = Encoder(PATH)
    word = rows[0][2].split()[0].lower() if rows[0][2].split() else "x"
    other.ids([word])
    other.plain, other.words[rows[0][2]] = False, b"\0\0"  # a join whose ids are wrong in every context
    assert other._disagreeing(rows) == [0] and other.encode([passage])[0] == library(passage)[0]


def test_shared_chunks_are_encoded_once(spark):
    rng = np.random.default_rng(1)
    passage = " ".join(f"shared{i}" for i in rng.integers(0, 9999, 2000))
    texts = [f"own{i} " * 5 + passage + f" end{i}" for i in range(6)] + ["alone " + " ".join(f"w{i}" for i in rng.integers(0, 9999, 500)), None, ""]
    docs = spark.createDataFrame([(i, x) for i, x in enumerate(texts)], "doc_id long, text string").repartition(4)
    counted = shared_insides(docs.select("text"))
    assert counted.agg(F.min("n"), F.max("n")).first() == (6, 6)
    held = filter_of(counted, 1 << 12)
    insides = {digest(x) for x in pieces(passage, Cutter())[3:-3:2]}
    assert insides and all(held.has(x) for x in insides)
    one = np.zeros(8, dtype=np.uint64)
    word, bit = place(b"abcdefghijklmnop", 8)
    one[word] = np.uint64(1 << bit)
    assert Filter(one).has(b"abcdefghijklmnop") and not Filter(np.zeros(8, dtype=np.uint64)).has(b"abcdefghijklmnop")
    table = table_of(docs.select("text"), spark.sparkContext.broadcast(held), PATH)
    assert insides <= {bytes(r.digest) for r in table.collect()} and table.count() < len(insides) + 20
    for words, least in ((1 << 18, 0.5), (1 << 18, 0.0), (1, 0.0), (1, 1.1)):  # all or no documents with holes give the same
        got = {r.doc_id: (bytes(r.ids), r.decoded) for r in encode_documents(docs, filter_words=words, most_filter_words=words, least_shared=least).collect()}
        assert got == {i: library(x or "") for i, x in enumerate(texts)}


def test_filter_grows_with_what_is_shared_and_is_bounded(spark):
    rng = np.random.default_rng(2)
    low = rng.integers(-(2**63), 2**63 - 1, 40_000)
    shared = spark.createDataFrame([(int(x), 2 + (i % 8 == 0) * 9) for i, x in enumerate(low)], "low long, n long")  # 5,000 are in eleven rows
    assert sized(shared, 1 << 6, 1 << 20) == (2, 1 << 14) and sized(shared, 1 << 18, 1 << 24) == (2, 1 << 18)
    assert sized(shared, 1 << 6, 1 << 12) == (8, 1 << 11)  # not all fit: those of the most rows
    assert sized(shared, 1 << 6, 1 << 6) == (8, 1 << 6) and sized(shared.limit(0), 1 << 6, 1 << 12) == (2, 1 << 6)
    keys = [int(x).to_bytes(8, "little", signed=True) + b"12345678" for x in low]
    for words in (1, 1 << 7, 1 << 14, 5000):
        bits = np.zeros(words, dtype=np.uint64)
        for word, bit in (place(k, words) for k in keys):
            bits[word] |= np.uint64(1 << bit)
        assert (filter_of(shared, words).words == bits).all()
    held = filter_of(shared, 1 << 14)
    assert all(map(held.has, keys)) and sum(held.has(rng.bytes(16)) for _ in range(10_000)) < 1000


def test_encoding_query_against_the_library(spark):
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in op07.op7_chunked_bpe(spark, DATA).collect()}
    rows = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect()
    assert len(got) == len(rows)
    for r in rows:
        ids, text = library(r.text or "")
        assert got[r.doc_id] == (len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(text.encode()).hexdigest())


def test_encoding_of_odd_rows(spark):
    docs = spark.createDataFrame([(None, "One two"), (1, None), (1, None), (2, "")], "doc_id long, text string").withColumn("n_tokens", F.lit("clash"))
    rows = sorted(encode_documents(docs, digests=True).collect(), key=lambda r: (r.doc_id is not None, r.doc_id))
    assert [r.n_tokens for r in rows] == [2, 0, 0, 0] and rows[1].ids_sha256 == hashlib.sha256(b"").hexdigest()
    assert {r.decoded for r in encode_documents(docs).collect()} == {"one</w> two</w>", ""} and encode_documents(docs.limit(0)).count() == 0
    assert not whitespace_free(public_path("byte_bpe_50k.json"))
    with pytest.raises(ValueError):
        encode_documents(docs, public_path("byte_bpe_50k.json"))


def test_licences(spark):
    mit = dict(licences.KNOWN)["MIT"]
    full = next(t for n, t in licences.KNOWN if n == "MIT" and t.startswith("Permission"))
    rows = {
        1: "Copyright (c) 2020 Some One\n\n" + full.upper().replace(" ", "\n   "),
        2: "prose\nReleased under the M.I.T. licence\nmore",
        3: "prose\n** released under the mit licence **\nLicensed under CC BY-NC 4.0",
        4: None,
        5: "",
        6: "permission to speak",
        7: full + " and more",
        8: full.replace("NONINFRINGEMENT", "NON-INFRINGEMENT").replace("sublicense", "sub-license"),
        9: "text " * 50000 + "\nLicensed under the Apache License, Version 2.0.",
    }
    docs = spark.createDataFrame([(k, v) for k, v in rows.items()] + [(None, rows[3]), (3, rows[3])], "doc_id long, text string").withColumn("licences", F.lit(1))
    got = sorted((str(r.doc_id), r.licences, r.whole_text_licence, r.n_lines) for r in licences.scan_licences(docs).collect())
    assert mit and got == sorted([("1", "MIT", "MIT", 0), ("2", None, None, 0), ("3", "CC-BY-NC-4.0,MIT", None, 4), ("3", "CC-BY-NC-4.0,MIT", None, 4), ("4", None, None, 0), ("5", None, None, 0), ("6", None, None, 0), ("7", None, None, 0), ("8", "MIT", "MIT", 0), ("9", "Apache-2.0", None, 1), ("None", "CC-BY-NC-4.0,MIT", None, 2)])
    assert licences.scan_licences(docs.limit(0)).count() == 0
    assert all(any(m in x.canon for m in licences.MARKERS) for x in spark.createDataFrame(list(licences.KNOWN), "n string, t string").select(licences.canonical(F.col("t")).alias("canon")).collect())
    plan = licences.scan_licences(docs)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_entire_licences_and_given_texts(spark):
    full = dict(licences.full_texts())
    rows = [(i, "Copyright 2024 Someone\n\n" + " ".join(text.split(" "))) for i, text in enumerate(full.values())]
    gpl = "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."
    rows += [(100, "code\n# " + gpl), (101, "all mine,  always")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r for r in licences.scan_licences(docs).collect()}
    assert [got[i].whole_text_licence for i in range(len(full))] == list(full)
    assert got[100].licences == "GPL-2.0-or-later" and got[101].licences is None
    given = spark.createDataFrame([("own", "All mine. Always!"), ("empty", "...")], "licence string, text string")
    got = {r.doc_id: r.licences for r in licences.scan_licences(docs, given).collect()}
    assert got.pop(101) == "own" and set(got.values()) == {None}
    assert all(any(m in x.canon for m in licences.MARKERS) for x in spark.createDataFrame([*licences.later_notices(), *licences.full_texts()], "n string, t string").select(licences.canonical(F.col("t")).alias("canon")).collect())


def tree_match(a, b):
    """Simple tree matching by definition."""
    if a.key != b.key:
        return 0
    p, q = a.elements(), b.elements()
    m = [[0] * (len(q) + 1) for _ in range(len(p) + 1)]
    for i in range(len(p)):
        for j in range(len(q)):
            m[i + 1][j + 1] = max(m[i][j + 1], m[i + 1][j], m[i][j] + tree_match(p[i], q[j]))
    return m[-1][-1] + 1


def test_matching_is_largest():
    rng = np.random.default_rng(4)

    def page(depth=0):
        tag = ["div", "span", "ul", "b"][rng.integers(0, 4)]
        return f"<{tag}>x" + "".join(page(depth + 1) for _ in range(rng.integers(0, 4) if depth < 4 else 0)) + f"</{tag}>"

    for _ in range(60):
        a, b = dom.parse(page()), dom.parse(page())
        pairs = dom.match(a, b)
        assert len(pairs) == tree_match(a, b) and all(x.key == y.key for x, y in pairs)


@pytest.mark.parametrize("cells", [1 << 22, 100])
def test_matching_of_long_lists_is_largest(monkeypatch, cells):
    monkeypatch.setattr(dom, "CELLS", cells)
    rng = np.random.default_rng(8)
    kinds = ["<p>x</p>", "<div><b>a</b><i>b</i></div>", "<div><b>a</b></div>", "<ul><li>1<li>2<li>3</ul>", "<div><i>b</i><b>a</b><i>c</i></div>", "<h2>t</h2>"]
    for n, m in ((70, 60), (130, 90), (3, 1000), (90, 91)):
        a, b = (dom.parse("<body>" + "".join(kinds[i] for i in rng.integers(0, len(kinds), k)) + "</body>") for k in (n, m))
        pairs = dom.match(a, b)
        assert len(pairs) == tree_match(a, b) and all(x.key == y.key for x, y in pairs)
        assert len({x.at for x, _ in pairs}) == len({y.at for _, y in pairs}) == len(pairs)


def test_markup_that_never_ends_is_read_in_time():
    began = time.time()
    for n in (30, 10_000):
        attributes = ' '.join(f'x{i}="1"' for i in range(n))
        for end in (" < ", "", " <b", ' x="', " <!-- ", " </", " <p>text</p>"):
            dom.parse(f"<div><a {attributes}{end}")
    assert dom.blocks(dom.parse(f"<p>before</p><a {attributes} < after"), dom.Node.apart)[0] == "before"
    dom.parse("<a b='" * 20000), dom.parse("<" * 50000), dom.parse("</a" * 50000), dom.parse("<a x=\"1\" " * 20000 + "<p>")
    assert dom.blocks(dom.parse('<p title="a>b">one</p><p title="x>two</p><!-- <p>no</p>'), dom.Node.apart) == ["one", "two"]
    assert time.time() - began < 20


def test_tables_of_thousands_of_rows_are_matched_in_time():
    began = time.time()
    row = "<tr><td>a</td><td>b</td><td>c</td></tr>"
    odd = "<tr><td>a</td><td>b<i>!</i></td></tr>"
    a = dom.parse("<table>" + row * 5000 + "</table>")
    assert len(dom.match(a, dom.parse("<table>" + row * 2000 + odd + row * 3000 + "</table>"))) == 2 + 4 * 5000
    # no end alike, and no run of equal rows
    rng = np.random.default_rng(2)
    some = lambda: "".join((row, odd)[i] for i in rng.integers(0, 2, 5000))
    x, y = dom.parse("<table>" + odd + some() + row + "</table>"), dom.parse("<table>" + row + some() + odd + "</table>")
    pairs = dom.match(x, y)
    assert len(pairs) > 4 * 4000 and [p.at for p, _ in pairs if p.tag == "td"] != []
    assert time.time() - began < 30


def site(rng, host, pages):
    """Pages of one layout without article, main or telling names: constant lines about and inside the part that varies."""
    word = lambda: "".join(rng.choice(list("abcdefghij"), 6))
    fixed = [" ".join(word() for _ in range(6)) for _ in range(5)]
    out = []
    for i in range(pages):
        paragraphs = [" ".join(word() for _ in range(20)) for _ in range(rng.integers(2, 6))]
        body = "".join(f"<p>{p}</p>" for p in paragraphs)
        html = f"<html><body><div class='c1'><ul><li>{fixed[0]}</li><li>{fixed[1]}</li></ul></div><div class='c2'><div class='c3'><div class='t'>{fixed[2]}</div><h2>{paragraphs[0][:30]}</h2>{body}</div><div class='c4'>{fixed[3]}</div></div><div class='c5'>{fixed[4]}</div></body></html>"
        out.append((f"http://{host}/{i}", html, [paragraphs[0][:30].strip(), *paragraphs], fixed))
    return out


def test_wrappers_of_sites_without_telling_names(spark):
    """What is constant over a site's pages goes, what varies stays, by a wrapper that can only come from the pages themselves."""
    rng = np.random.default_rng(6)
    pages = [x for h in range(4) for x in site(rng, f"h{h}.example", 6 + h)]
    rows = [(i, url, html) for i, (url, html, _, _) in enumerate(pages)]
    got = {r.page_id: r.text for r in wrappers.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    # brute force: of a page's blocks those that not every page of the host has
    for i, (url, html, lines, fixed) in enumerate(pages):
        host = url.split("/")[2]
        blocks = dom.blocks(dom.parse(html), lambda x: False)
        others = [set(dom.blocks(dom.parse(h), lambda x: False)) for u, h, _, _ in pages if u.split("/")[2] == host]
        want = [b for b in blocks if not all(b in o for o in others)]
        assert want == lines and got[i] == "\n".join(want) and not any(f in got[i] for f in fixed)


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body><header><h1>Site</h1></header><nav><ul><li><a>Home</a></ul></nav>
<div class="cookie-notice">We use cookies</div><div class="ad">Buy {n}</div><div id="content"><h2>Title {n} &amp; more</h2><p>First <b>bold</b>&nbsp;words {n}.<p>Second<br>line {n}
<form>Search</form><p class="read">Read our other pages</p></div><aside>Related</aside><div class="comments"><p>Nice!</p></div><footer>&copy; us</footer></body></html>"""


def test_page_text(spark):
    rows = [(i, f"https://h.example/{i}", PAGE.replace("{n}", f"number{i}")) for i in range(14)]
    art = "<body><nav>x</nav><article><h1>A &lt;b&gt;</h1><p>one<aside>no</aside></p><p>two  three</article><p>tail</p>"
    rows += [(20, "http://one.example/", art), (21, None, None), (22, "", ""), (23, "http://one.example/x", art[:-30]), (None, "http://one.example/", "plain &am"), (24, "http://deep.example", "<div>" * 3000 + "deep")]
    got = {r.page_id: (r.text, r.n_chars) for r in wrappers.extract(spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit(1))).collect()}
    for i in range(14):
        want = f"Title number{i} & more\nFirst bold words number{i}.\nSecond line number{i}"
        assert got[i] == (want, len(want))  # the constant line is template
    assert got[20][0] == "A <b>\none\ntwo three" and got[21] == ("", 0) and got[22] == ("", 0)
    assert got[23][0].startswith("A <b>\none") and got[None][0] == "plain &am" and got[24][0] == "deep"
    assert wrappers.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def texts_of(spark, rows):
    return {r.page_id: r.text for r in wrappers.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}


def test_copies_share_a_vote_and_varying_children_stay(spark):
    one = "<body><article><h1>One title</h1><p>Its only text, a long line.</p></article></body>"
    rows = [(i, "http://copies.example/", one.replace("<body>", f"<body><script>visit({i})</script>")) for i in range(12)]
    rows += [(12, "http://copies.example/b", "<body><article><h1>Other</h1><p>Something else.</p></article></body>")]
    page = "<body><div><p>By <a>Author{n}</a></p><p>Text of page {n} is here, all its words.</p><section>Update:<p>News {n}.</p></section><p><span>Read our</span> <b>terms</b></p><p>An <b>inline</b> word, {n}</p></div></body>"
    rows += [(100 + i, "http://parts.example/", page.replace("{n}", f"n{i}")) for i in range(14)]
    got = texts_of(spark, rows)
    assert all(got[i] == "One title\nIts only text, a long line." for i in range(12)) and got[12] == "Other\nSomething else."
    for i in range(14):
        assert got[100 + i] == f"Authorn{i}\nText of page n{i} is here, all its words.\nNews n{i}.\nAn inline word, n{i}"


def test_wrappers_of_few_pages_and_of_two_layouts(spark):
    page = "<body><p>All prices without tax.</p><div class=text><h2>Title {n}</h2><p>Words of {n} and more.</p><article>Short {n}</article></div></body>"
    rows = [(i, "http://few.example/", page.replace("{n}", f"n{i}")) for i in range(2)]
    other = "<body><table class=other><tr><td class=cell>Sold by us alone.<td class=cell>Item {n}, so good a thing.</table></body>"
    rows += [(10 + i, "http://mixed.example/", page.replace("{n}", f"n{i}")) for i in range(9)]
    rows += [(30 + i, "http://mixed.example/", other.replace("{n}", f"n{i}")) for i in range(9)]
    rows += [(50, "http://single.example/", page.replace("{n}", "alone"))]
    got = texts_of(spark, rows)
    for i, n in [(0, 0), (1, 1), *((10 + i, i) for i in range(9))]:
        assert got[i] == f"Title n{n}\nWords of n{n} and more.\nShort n{n}"  # the induced slot stands, though it isn't an article
    for i in range(9):
        assert got[30 + i] == f"Item n{i}, so good a thing."
    assert got[50] == "Short alone"  # tags decide


def test_pipeline_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").withColumn("rank", F.lit(1)).withColumn("text_hash", F.lit(2))
    docs = docs.union(spark.createDataFrame([(900, None, "en", "s", 0, 1, 2), (901, "!!", None, None, None, 1, 2), (902, "", "en", None, None, 1, 2)], docs.schema))
    columns, kept = docs.columns, {}
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, DATA).write.parquet(f"file://{tmp_path}/{i}")
        before, docs = docs, spark.read.parquet(f"file://{tmp_path}/{i}")
        kept[name] = docs.count()
        if name == "near_duplicates":
            rows = [(r.doc_id, r.text) for r in before.select("doc_id", "text").collect()]
            want = {i for i, (_, _, stays) in brute(rows, 5, Fraction(4, 5)).items() if stays}
            assert {r.doc_id for r in docs.select("doc_id").collect()} == want
        assert (docs.columns == columns) == (name != "packing")
    assert kept["language_id"] == 200 and 150 < kept["toxicity"] < 200 and kept["near_duplicates"] < kept["toxicity"]
    assert docs.select("doc_id").distinct().count() == kept["near_duplicates"]
    assert corpus_pipeline.run(spark, DATA).count() == kept["packing"]


def test_pipeline_keeps_one_of_each_group_whatever_the_ids(spark):
    rows = [(None, "a b c d e f"), (1, "a b c d e f"), (5, "a b c d e f"), (5, "g h i j k l"), (5, "g h i j k l"), (None, "m n o p q r"), (7, None), (None, "m n o p q r")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"row": F.lit("x"), "group": F.lit(1)})
    kept = corpus_pipeline.near_duplicate_stage(spark, docs, DATA)
    assert kept.columns == docs.columns
    got = sorted((str(r.doc_id), str(r.text)) for r in kept.collect())
    assert got == sorted([("1", "a b c d e f"), ("5", "g h i j k l"), ("None", "m n o p q r"), ("7", "None")])


def test_pipeline_of_no_rows(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, DATA).count() == 0
