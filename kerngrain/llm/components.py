"""Connected components of a graph of hashed node ids, by repeated contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import written


def connected_components(edges: DataFrame) -> DataFrame:
    """edges(a, b): long node ids whose order has nothing to do with the graph, such as hashes.

    Every round each node joins its smallest neighbour and edges between the joined nodes go on to the next
    round; as ids are hashes, a constant share of the nodes goes in each round. A node of high degree is split by
    AQE: either side of each join is a written table. Returns (node, root) for nodes with an edge; no edges: no rows.
    """
    edges = written(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    maps = []
    while not edges.isEmpty():
        both = edges.union(edges.select("b", "a"))
        parent = written(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("parent")), "parents")
        maps.append(parent)
        of = lambda side, p=parent: p.select(F.col("node").alias(side), F.col("parent").alias(f"p{side}"))
        left = edges.join(of("a"), "a").join(of("b"), "b").where("pa <> pb")
        edges = written(left.select(F.least("pa", "pb").alias("a"), F.greatest("pa", "pb").alias("b")).distinct(), "edges")
    if not maps:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    labels = maps[0].select("node", F.col("parent").alias("root"))
    for m in maps[1:]:
        step = m.select(F.col("node").alias("root"), "parent")
        labels = labels.join(step, "root", "left").select("node", F.coalesce("parent", "root").alias("root"))
    return written(labels, "components")
