"""Near-duplicate documents by minhash with tensored banding, every link confirmed on full shingle sets.

Banding with b tables of 2t hashes needs 2tb hashes. Here two collections of m sub-keys, of t hashes each, give m*m
tables: table (i, j) is keyed by sub-key i of the first collection and sub-key j of the second, so that 2tm hashes
serve m*m tables. A pair of similarity s shares a table with probability (1 - (1 - s^t)^m)^2: with m = 10 and
t = 2, 0.99993 at s = 0.8.

Steps, each over all documents:

1. Sets and sub-keys per document; documents with equal sets are one class, which goes on as one node. Equal means a digest
   of 128 bits and the size: the node is 64 of the bits, and two sets that differ in the rest are an error, not a link.
2. Tables: keys are counted, and those of more than one node are joined with their nodes again: a table of members, small
   beside all keys. Every member of a bucket is paired with the bucket's smallest node and confirmed. That is one pair per
   member, whatever the size of the bucket.
3. Buckets whose members other than the smallest are still of several components may hide links between these. Their
   nodes go through an exact prefix filter: of a set of n shingles ordered by rarity, two sets that meet the threshold
   share one of the first n - ceil(threshold * n) + 1, and at the first they share both must have enough left for sets of
   their two sizes. Tokens whose holders are all in one component are done;
   elsewhere the nodes outside the token's largest component meet the others. All are confirmed on full sets.
4. Connected components of the confirmed links.

Edge cases: null or empty text, and text without words: empty set, linked with nothing, kept. Fewer words than
a shingle: the whole sequence is the one shingle. Rows that repeat a document are in its class and each get a row; null
doc_id: the row takes part, component_id is the smallest non-null doc_id of its component or null, and kept is true
only where no row of its component has an id. Other columns of the input are not looked at. No rows: no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction
from functools import reduce

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._shared import discard, written
from .components import connected_components
from .shingles import Powers, hash_family, minhashes, mix, parts, shingle_sets

#: Of the parities that rule pairs out before their sets are compared.
BITS = 1024
SIGNATURE = "doc_id string, text_hash long, n_shingles long, node long, more_digest long, u array<long>, v array<long>"


def _texts(docs: DataFrame) -> DataFrame:
    text = F.col("text").cast("string")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("text_hash"), text.alias("text"))


def _digest(codes: np.ndarray) -> tuple[int, int]:
    """The node of a set, and 64 bits more."""
    x = xxhash.xxh3_128_intdigest(codes.tobytes())
    return (x >> 64) - 2**63, x % 2**64 - 2**63


def signatures(docs: DataFrame, size: int, m: int, t: int) -> DataFrame:
    """Per document: size and hash of its set, and two collections of m sub-keys of t minhashes each."""
    a, b = hash_family(2 * m * t)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        powers = Powers()
        for whole in batches:
            for part in parts(whole["text"]):
                pdf = whole.iloc[part]
                sets = shingle_sets(pdf["text"].tolist(), size, powers)
                some = [i for i, x in enumerate(sets) if len(x)]
                rows: list[tuple] = [(0, None, None, None, None)] * len(sets)
                if some:
                    low = minhashes([sets[i] for i in some], a, b).reshape(len(some), 2 * m, t)
                    sub = np.zeros((len(some), 2 * m), dtype=np.uint64)
                    for k in range(t):
                        sub = mix(sub + low[:, :, k])
                    sub = sub.view(np.int64)
                    for i, x in zip(some, sub, strict=True):
                        rows[i] = (len(sets[i]), *_digest(sets[i]), x[:m], x[m:])
                n, node, more, u, v = zip(*rows, strict=True)
                # pandas would make doubles of integers with nulls among them: hence Int64 here, and ids as text
                yield pd.DataFrame({"doc_id": pdf["doc_id"].to_numpy(), "text_hash": pdf["text_hash"].to_numpy(), "n_shingles": n, "node": pd.array(node, dtype="Int64"), "more_digest": pd.array(more, dtype="Int64"), "u": u, "v": v})

    rows = _texts(docs).withColumn("doc_id", F.col("doc_id").cast("string"))
    return rows.mapInPandas(run, SIGNATURE).withColumn("doc_id", F.col("doc_id").cast("long"))


def full_sets(wanted: DataFrame, size: int) -> DataFrame:
    """(node, text) to (node, codes)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        powers = Powers()
        for whole in batches:
            for part in parts(whole["text"]):
                pdf = whole.iloc[part]
                sets = shingle_sets(pdf["text"].tolist(), size, powers)
                good = [i for i, (x, n) in enumerate(zip(sets, pdf["node"], strict=True)) if len(x) and _digest(x)[0] == n]
                yield pd.DataFrame({"node": pdf["node"].to_numpy()[good], "codes": [sets[i].view(np.int64) for i in good], "bits": [parities(sets[i]) for i in good]})

    return wanted.select("node", "text").mapInPandas(run, "node long, codes array<long>, bits array<long>")


def parities(codes: np.ndarray) -> np.ndarray:
    """BITS bits: whether an odd number of the codes falls on each."""
    odd = np.bincount((codes % np.uint64(BITS)).astype(np.int64), minlength=BITS) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def _keys(nodes: DataFrame, m: int, *more: str) -> DataFrame:
    """A row (key, node, more) for each of a node's m*m tables."""
    each = F.sequence(F.lit(0), F.lit(m - 1))
    keys = F.flatten(F.transform(each, lambda i: F.transform(each, lambda j: F.xxhash64(F.get("u", i), F.get("v", j), i * m + j))))
    return nodes.select(F.explode(keys).alias("key"), "node", *more)


def _may_meet(x: str, y: str, limit: Fraction) -> Column:
    """False only where two sets can't meet the threshold: bits that differ are no more than codes that only one has."""
    differ = reduce(lambda p, q: p + q, [F.bit_count(F.get(f"bits_{x}", i).bitwiseXOR(F.get(f"bits_{y}", i))) for i in range(BITS // 64)])
    both = F.col(f"n_{x}") + F.col(f"n_{y}")
    return (both - differ) * (limit.numerator + limit.denominator) >= both * 2 * limit.numerator


def _confirm(pairs: DataFrame, sets: DataFrame, limit: Fraction) -> DataFrame:
    """The pairs (a, b) whose full sets meet the threshold."""
    side = lambda x: sets.select(F.col("node").alias(x), F.col("codes").alias(f"codes_{x}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b")
    common = F.size(F.array_intersect("codes_a", "codes_b"))
    union = F.size("codes_a") + F.size("codes_b") - common
    return both.where(common * limit.denominator >= union * limit.numerator).select(*pairs.columns)


def _hidden_pairs(sets: DataFrame, open_nodes: DataFrame, limit: Fraction) -> DataFrame:
    """Pairs of open nodes (node, root, n_shingles) from different components that may meet the threshold, exactly.

    Returns (a, b, root_a, root_b).
    """
    tokens = sets.select("node", "codes").join(open_nodes, "node").select(F.explode("codes").alias("token"), "node", "root", "n_shingles")
    held = written(tokens.groupBy("token").agg(F.count("*").alias("holders"), (F.min("root") != F.max("root")).alias("mixed")).where("holders > 1"), "tokens")
    shared = tokens.join(held, "token").groupBy("node", "root", "n_shingles").agg(F.sort_array(F.collect_list(F.struct("holders", "token", "mixed"))).alias("by_rarity"))
    # the tokens that only this node holds come first in its order
    alone = F.col("n_shingles") - F.size("by_rarity")
    need = F.ceil(F.col("n_shingles") * limit.numerator / limit.denominator - F.lit(1e-9)).cast("long")
    left = (F.col("n_shingles") - need + 1 - alone).cast("int")
    ahead = shared.where(left > 0).select("node", "root", "n_shingles", alone.alias("alone"), F.slice("by_rarity", 1, left).alias("ahead"))
    ahead = written(ahead.where(F.exists("ahead", lambda z: z["mixed"])), "ahead")
    # what is left of the set from this token on, the most that a set may share whose first common token it is
    rest = (F.col("n_shingles") - F.col("alone") - F.col("i")).alias("rest")
    prefix = ahead.select("node", "root", "n_shingles", "alone", F.posexplode("ahead").alias("i", "z")).where("z.mixed").select(F.col("z.token").alias("token"), "node", "root", "n_shingles", rest, "i")
    by_root = prefix.groupBy("token", "root").count()
    top = written(by_root.groupBy("token").agg(F.max_by("root", F.struct("count", "root")).alias("top"), F.count("*").alias("roots")).where("roots > 1").select("token", "top"), "largest")
    flagged = prefix.join(top, "token").withColumn("other", F.col("root") != F.col("top")).drop("top")
    more = ahead.select("node", F.col("ahead.token").alias("tokens")).join(sets.select("node", "bits"), "node")
    flagged = written(flagged.join(more, "node").withColumn("earlier", F.slice("tokens", 1, F.col("i"))).drop("tokens", "i"), "flagged")
    x = flagged.where("other").select("token", F.col("node").alias("x"), F.col("root").alias("root_x"), F.col("n_shingles").alias("n_x"), F.col("rest").alias("rest_x"), F.col("bits").alias("bits_x"), F.col("earlier").alias("earlier_x"))
    y = flagged.select("token", F.col("node").alias("y"), F.col("root").alias("root_y"), F.col("n_shingles").alias("n_y"), F.col("rest").alias("rest_y"), F.col("bits").alias("bits_y"), F.col("earlier").alias("earlier_y"), "other")
    least = (F.col("n_x") + F.col("n_y")) * limit.numerator  # over numerator + denominator: what two such sets must share
    enough = F.least("rest_x", "rest_y") * (limit.numerator + limit.denominator) >= least
    first = ~F.arrays_overlap("earlier_x", "earlier_y")  # a pair comes at the first token of its common ones alone
    pairs = x.join(y, "token").where((F.col("root_x") != F.col("root_y")) & (~F.col("other") | (F.col("x") < F.col("y"))) & enough & _may_meet("x", "y", limit) & first)
    swap = F.col("x") > F.col("y")
    pick = lambda p, q, name: F.when(swap, F.col(q)).otherwise(F.col(p)).alias(name)
    return written(pairs.select(pick("x", "y", "a"), pick("y", "x", "b"), pick("root_x", "root_y", "root_a"), pick("root_y", "root_x", "root_b")).distinct(), "hidden")


def near_duplicates(docs: DataFrame, size: int = 5, threshold: Fraction = Fraction(4, 5), m: int = 10, t: int = 2) -> DataFrame:
    """docs with doc_id and text to (doc_id, n_shingles, component_id, kept); see the module's text."""
    limit = Fraction(threshold)
    sig = written(signatures(docs, size, m, t), "signatures")
    first = F.struct(F.coalesce("doc_id", F.lit(2**63 - 1)).alias("at"), "text_hash")
    nodes = sig.where("node is not null").groupBy("node").agg(
        F.min("doc_id").alias("first_id"), F.min_by(F.struct("doc_id", "text_hash", "n_shingles", "u", "v"), first).alias("s"),
        (F.min("more_digest") == F.max("more_digest")).alias("same"), (F.min("n_shingles") == F.max("n_shingles")).alias("same_size"),
    )
    node = F.when(F.col("same") & F.col("same_size"), F.col("node")).otherwise(F.raise_error(F.lit("two sets of one node")))
    nodes = written(nodes.select(node.alias("node"), "first_id", "s.*"), "nodes")

    held = written(_keys(nodes, m).groupBy("key").agg(F.count("*").alias("members")).where("members > 1"), "held")
    members = written(_keys(nodes, m).join(held, "key"), "members")
    lowest = members.groupBy("key").agg(F.min("node").alias("low"))
    starred = written(members.join(lowest, "key").where("node <> low"), "starred")
    discard(members, held)
    pairs = written(starred.select(F.col("low").alias("a"), F.col("node").alias("b")).distinct(), "stars")
    met = written(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct(), "met")  # every node of a bucket with others
    stands = nodes.join(met, "node").select("node", F.coalesce("doc_id", F.lit(-(2**63))).alias("at"), "text_hash")
    texts = _texts(docs).withColumn("at", F.coalesce("doc_id", F.lit(-(2**63)))).drop("doc_id")
    sets = written(full_sets(texts.join(stands, ["at", "text_hash"]), size), "sets")
    if sets.count() != met.count():  # rows that repeat an id and its text
        sets = written(sets.dropDuplicates(["node"]), "sets")
    brief = written(sets.select("node", F.size("codes").alias("n"), "bits"), "brief")
    of = lambda x: brief.select(F.col("node").alias(x), F.col("n").alias(f"n_{x}"), F.col("bits").alias(f"bits_{x}"))
    likely = pairs.join(of("a"), "a").join(of("b"), "b").where(_may_meet("a", "b", limit)).select("a", "b")
    links = written(_confirm(likely, sets, limit), "links")
    labels = connected_components(links)

    rooted = nodes.join(met, "node").join(labels, "node", "left").select("node", "n_shingles", F.coalesce("root", "node").alias("root"))
    rooted = written(rooted, "rooted")
    # in a bucket all pairs with its smallest node are done; what may hide is between the others, if they are of several components
    others = written(starred.where("members > 2").select("key", "node").join(rooted, "node"), "others")
    mixed = written(others.groupBy("key").agg(F.min("root").alias("one"), F.max("root").alias("two")).where("one <> two").select("key"), "mixed")
    open_nodes = written(others.join(mixed, "key").select("node", "root", "n_shingles").distinct(), "open")
    hidden = _confirm(_hidden_pairs(sets, open_nodes, limit), sets, limit)
    joined = connected_components(hidden.select(F.col("root_a").alias("a"), F.col("root_b").alias("b")))

    final = rooted.select("node", "root").join(joined.select(F.col("node").alias("root"), F.col("root").alias("upper")), "root", "left").select("node", F.coalesce("upper", "root").alias("root"))
    final = written(nodes.select("node", "first_id").join(final, "node", "left").select("node", "first_id", F.coalesce("root", "node").alias("root")), "final")
    ids = written(final.groupBy("root").agg(F.min("first_id").alias("component_id")), "ids")
    of_node = written(final.join(ids, "root").select("node", "component_id"), "of_node")
    discard(nodes, starred, pairs, met, sets, brief, links, rooted, others, mixed, open_nodes, final, ids)
    # rows without a set, which may be many, take no part in the join
    found = sig.where("node is not null").join(of_node, "node").select("doc_id", "n_shingles", "component_id")
    out = found.union(sig.where("node is null").select("doc_id", "n_shingles", "doc_id"))
    component = F.col("component_id")
    kept = F.when(component.isNull(), F.lit(True)).otherwise(F.coalesce(F.col("doc_id") == component, F.lit(False)))
    return out.select("doc_id", "n_shingles", "component_id", kept.alias("kept"))
