"""Near-duplicates, packing and WARC against brute force, and on odd rows."""

import gzip
import struct
import zlib
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from kerngrain.llm import op04
from kerngrain.llm.near_duplicates import near_duplicates
from kerngrain.llm.packing import Block, pack
from kerngrain.llm.tokenizing import public_path, tokenizer
from kerngrain.llm.warc import checked_revisits, read_warc, resolve_revisits, write_warc

DATA = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string"


def shingles(text, n):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().split()
    return {tuple(words[i : i + n]) for i in range(max(1, len(words) - n + 1))} if words else set()


def brute(rows, n, limit):
    sets = {i: shingles(t, n) for i, t in rows}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b]:
                common = len(sets[a] & sets[b])
                if common * limit.denominator >= (len(sets[a]) + len(sets[b]) - common) * limit.numerator:
                    x, y = sorted((find(a), find(b)))
                    root[y] = x
    return {i: (len(sets[i]), find(i), find(i) == i) for i in sets}


def test_near_duplicates_against_brute_force(spark):
    rng = np.random.default_rng(1)
    vocabulary = [f"w{i}" for i in range(400)]
    rows, base = [], [rng.choice(vocabulary, 120) for _ in range(4)]
    for i in range(160):
        words = base[i % 4].copy()
        for _ in range(rng.integers(0, 9)):  # around the threshold
            words[rng.integers(0, len(words))] = rng.choice(vocabulary)
        rows.append((i, " ".join(words)))
    rows += [(200, None), (201, ""), (202, " \n\t"), (203, "one two"), (204, "ONE  two"), (205, "x " * 5000), (206, "x " * 5000), (207, rows[3][1].upper())]
    for n, limit in ((4, Fraction(4, 5)), (5, Fraction(4, 5))):
        docs = spark.createDataFrame([(i, t, None, None) for i, t in rows], DOCS).repartition(3)
        got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in near_duplicates(docs, n, limit).collect()}
        assert got == brute(rows, n, limit)


def test_near_duplicates_of_odd_rows(spark):
    rows = [(1, "a b c d e f"), (1, "a b c d e f"), (2, "a b c d e f"), (None, "a b c d e f"), (None, "q r s t u v"), (3, "a")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as node", "2 as component_id")
    got = sorted((str(r.doc_id), r.n_shingles, str(r.component_id), r.kept) for r in near_duplicates(docs, 5).collect())
    assert got == sorted([("1", 2, "1", True), ("1", 2, "1", True), ("2", 2, "1", False), ("None", 2, "1", False), ("None", 2, "None", True), ("3", 1, "3", True)])
    assert near_duplicates(docs.limit(0)).count() == 0


@pytest.mark.parametrize("have", [[5000, 1, 300], [2048], [1], [7], [100_000, 50_000, 3, 3, 3]])
def test_round_robin_gives_every_token_one_place(have):
    block, places = Block(np.array(have), 2048), {}
    for q, n in enumerate(have):
        for begin in range(0, n, 700):
            for a, b, s, o, size in zip(*block.cuts(q, begin, min(n, begin + 700)), strict=True):
                for i in range(b - a):
                    assert (s, o + i) not in places and o + i < size
                    places[s, o + i] = (q, a + i)
    assert sorted(places.values()) == [(q, i) for q, n in enumerate(have) for i in range(n)]
    for w in range(block.full):
        share = np.bincount([places[w, o][0] for o in range(2048)], minlength=len(have)) / 2048
        assert abs(share - np.array(have) / sum(have)).max() < 2 / 2048 * len(have)


def test_packing_round_trip(spark):
    texts = {1: "Hello there, world", 2: None, 3: "", 4: "word " * 9000, 5: "<|endoftext|> in a text"}
    rows = [(i, t, "en", s) for (i, t), s in zip(texts.items(), ["a", "b", None, "a", "b"], strict=True)] + [(None, "no id", None, None)]
    found = pack(spark.createDataFrame(rows, DOCS).selectExpr("*", "7 as n", "'q' as queue"), block_tokens=4096).toPandas()
    coder = tokenizer(public_path("byte_bpe_50k.json"))
    for i, t in texts.items():
        ids, at = coder.encode(t or "", add_special_tokens=False).ids + [1], 0
        for x in found[found.doc_id == i].sort_values("start").itertuples():
            assert x.start == at and x.doc_tokens == len(ids)
            assert x.ids_crc32 == zlib.crc32(struct.pack(f"<{x.length}I", *ids[at : at + x.length]))
            at += x.length
        assert at == len(ids)
    for _, g in found.sort_values("offset").groupby("sequence_id"):
        assert list(g.offset) == [0, *g.length.cumsum()[:-1]] and g.length.sum() == g.sequence_length.iloc[0]
        assert g.length.sum() & (g.length.sum() - 1) == 0
    assert pack(spark.createDataFrame([], DOCS)).count() == 0


def round_robin(have, order, window):
    """The windows of one block and what is left, as lists of (queue, tokens): deficits as fractions, a window at a time."""
    total, out, credit, left = sum(have.values()), [], dict.fromkeys(order, Fraction(0)), dict(have)
    for _ in range(total // window):
        for q in order:
            credit[q] += Fraction(window * have[q], total)
        take = {q: max(0, int(credit[q] // 1)) for q in order}
        while sum(take.values()) < window:  # to the largest deficit, each queue once
            take[max((q for q in order if take[q] <= credit[q] // 1 or credit[q] < 0), key=lambda q: credit[q] - take[q])] += 1
        while sum(take.values()) > window:
            take[min((q for q in order if take[q] > 0), key=lambda q: credit[q] - take[q])] -= 1
        for q in order:
            credit[q] -= take[q]
            left[q] -= take[q]
        out.append([(q, take[q]) for q in order if take[q]])
    rest, size = [q for q in order for _ in range(left[q])], sum(left.values())
    for b in range(window.bit_length(), -1, -1):
        if size >> b & 1:
            out.append(list(Counter(rest[: 1 << b]).items()))  # in order of queues
            rest = rest[1 << b :]
    return out


@pytest.mark.parametrize("block_tokens", [None, 1 << 14])
def test_packing_query_against_brute_force(spark, block_tokens):
    """Ids by the library, each source's tokens in the table's order, and a plain round-robin give the very pieces."""
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    found = (pack(docs, block_tokens=block_tokens) if block_tokens else op04.op4_mixture_packing(spark, DATA)).toPandas()
    block_tokens, coder = block_tokens or 1 << 22, tokenizer(public_path("byte_bpe_50k.json"))
    ids, queue = {}, defaultdict(list)  # of each queue its tokens as (doc_id, place in the document)
    source = {}
    for r in docs.select("doc_id", "text", "source").collect():
        ids[r.doc_id] = coder.encode(r.text or "", add_special_tokens=False).ids + [1]
        source[r.doc_id] = r.source or ""
        queue[source[r.doc_id]] += [(r.doc_id, i) for i in range(len(ids[r.doc_id]))]
    total = sum(map(len, queue.values()))
    blocks, stride = max(1, -(-total // block_tokens)), (block_tokens + len(queue)) // 2048 + 14
    found["queue"], found["block"] = found.doc_id.map(source), found.sequence_id // stride
    assert len(ids) == docs.count() and sorted(found.block.unique()) == list(range(blocks)) and (blocks > 3 or block_tokens == 1 << 22)
    first = found.sort_values(["sequence_id", "offset"]).queue.drop_duplicates().tolist()
    order = [q for q in first if len(queue[q]) * 2048 > total] + [q for q in first if len(queue[q]) * 2048 <= total]
    assert len(order) == len(queue)
    at, want = dict.fromkeys(queue, 0), []
    for k, part in found.groupby("block"):
        have = {q: int(n) for q, n in part.groupby("queue").length.sum().items()}
        for s, row in enumerate(round_robin({q: have.get(q, 0) for q in order}, order, 2048)):
            offset = 0
            for q, n in row:
                while n:
                    doc, start = queue[q][at[q]]
                    m = min(n, len(ids[doc]) - start)
                    crc = zlib.crc32(struct.pack(f"<{m}I", *ids[doc][start : start + m]))
                    want.append((doc, start, m, crc, len(ids[doc]), k * stride + s, offset))
                    at[q], offset, n = at[q] + m, offset + m, n - m
        for q in queue:  # a block holds each queue's share to a token
            assert abs(at[q] - Fraction(len(queue[q]) * (k + 1), blocks)) < 1
    got = found[["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]].itertuples(index=False)
    assert sorted(map(tuple, got)) == sorted(want)


def test_packing_of_repeated_rows_and_null_ids(spark):
    rows = [(1, "the same words " * 300, "en", "a")] * 5 + [(None, "no id " * 300, "en", "a")] * 2 + [(2, None, None, None)] * 3
    found = pack(spark.createDataFrame(rows, DOCS).repartition(3), block_tokens=2048).toPandas()
    coder = tokenizer(public_path("byte_bpe_50k.json"))
    for ids, some, n in ((coder.encode(rows[0][1], add_special_tokens=False).ids + [1], found[found.doc_id == 1], 5), (coder.encode(rows[5][1], add_special_tokens=False).ids + [1], found[found.doc_id.isna()], 2), ([1], found[found.doc_id == 2], 3)):
        times = np.zeros(len(ids), dtype=int)  # each token of each copy in exactly one piece
        for x in some.itertuples():
            times[x.start : x.start + x.length] += 1
            assert x.doc_tokens == len(ids) and x.ids_crc32 == zlib.crc32(struct.pack(f"<{x.length}I", *ids[x.start : x.start + x.length]))
        assert (times == n).all()
    for _, g in found.sort_values("offset").groupby("sequence_id"):
        assert list(g.offset) == [0, *g.length.cumsum()[:-1]]


def test_packing_of_many_sources(spark):
    many = spark.range(3000).selectExpr("id as doc_id", "case when id < 1500 then repeat('x y ', 40) else 'x y' end as text", "case when id < 1500 then concat('large', id % 3) else cast(id as string) end as source")
    for share in (2.0**-20, 0.01):  # every source its own queue, and small ones together
        found = pack(many, least_share=share, rest_queues=4, block_tokens=1 << 15).toPandas()
        first = pack(many.where("id < 1500"), least_share=share).toPandas()
        assert found.length.sum() == found.groupby("doc_id").doc_tokens.first().sum() and len(found.doc_id.unique()) == 3000
        full = found[found.sequence_length == 2048]
        part = full[full.doc_id < 1500].assign(source=full.doc_id % 3).groupby(["sequence_id", "source"]).length.sum()
        want = first.length.sum() / 3 / found.length.sum() * 2048
        assert (part - want).abs().max() <= 4  # every window holds the mixture


def test_archives_round_trip(spark, tmp_path):
    nasty = b"a\r\n\r\nWARC/1.1\r\nContent-Length: 3\r\n\r\nabc\r\n\r\nWARC/1.1\r\n\r\n\xff\x00"
    rows = [(5, "u5", nasty), (3, "u3", nasty), (4, "u\r\n4", None), (6, None, b""), (7, "u7", b"only"), (None, "n", b"only"), (3, "u3", nasty)]
    records = resolve_revisits(spark.createDataFrame(rows, "record_id long, target_uri string, payload binary"))
    path = f"file://{tmp_path}/warc"
    write_warc(records.coalesce(1), path)
    back = read_warc(spark, path).collect()
    got = sorted((str(r.record_id), r.record_type, r.payload_bytes, str(r.refers_to), bytes(r.payload) if r.payload is not None else None) for r in back)
    n = len(nasty)
    assert got == sorted([("3", "response", n, "None", nasty), ("3", "response", n, "None", nasty), ("5", "revisit", n, "3", None), ("4", "response", 0, "None", b""), ("6", "revisit", 0, "4", None), ("7", "response", 4, "None", b"only"), ("None", "revisit", 4, "7", None)])
    with pytest.raises(Exception, match="no response with the payload"):
        checked_revisits(read_warc(spark, path).where("record_id <> 3 or record_id is null")).collect()
    file = next((tmp_path / "warc").glob("*.gz"))
    plain = gzip.decompress(file.read_bytes())
    for name, damaged in (("other", plain.replace(b"only", b"0nly", 1)), ("short", plain[: plain.rindex(b"only") + 2])):
        (tmp_path / name).mkdir()
        (tmp_path / name / "a.warc.gz").write_bytes(gzip.compress(damaged))
        with pytest.raises(Exception, match="the payload is not|ends within a record"):
            read_warc(spark, f"file://{tmp_path}/{name}", payloads=False).collect()
    clash = spark.createDataFrame(rows, "record_id long, target_uri string, payload binary").withColumn("original", F.lit(1))
    assert resolve_revisits(clash).where("original = 1").count() == len(rows)
    small = resolve_revisits(spark.createDataFrame(rows, "record_id long, target_uri string, payload binary"), min_bytes=5).collect()
    assert sorted(str(r.record_id) for r in small if r.record_type == "revisit") == ["5"]
    assert resolve_revisits(spark.createDataFrame([], "record_id long, target_uri string, payload binary")).count() == 0
