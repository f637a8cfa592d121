"""Connected components of an edge table, by alternating stars."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docquorum.session import cut_lineage

#: So many edges, checked by a count, are a few megabytes: one task follows them faster than rounds of jobs.
FEW = 100_000


def _in_one_task(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while parent.setdefault(x, x) != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for frame in frames:
        for a, b in zip(frame["a"].tolist(), frame["b"].tolist()):
            low, high = sorted((root(a), root(b)))
            parent[high] = low
    yield pd.DataFrame([(x, root(x)) for x in list(parent)], columns=["node", "component"], dtype="int64")


def components(edges: DataFrame, few: int = FEW) -> DataFrame:
    """``node, component`` for every node of the edges ``a, b``; a component is named by its smallest node.

    Every round joins each node's larger neighbours to its smallest one, then all of its smaller neighbours (Kiveris
    et al., 2014). The number of rounds grows with the logarithm of the number of nodes, not with the length of paths.
    Minima are folded before they are shuffled; a node with very many neighbours meets them by a plain join, which
    adaptive execution splits. Self-loops and repeated edges are harmless, null ends are dropped. Up to ``few`` distinct
    edges are followed in one task instead, with the same result; ends are 64-bit numbers.
    """
    pairs = edges.select("a", "b").filter("a <> b")
    both = F.struct(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    now = cut_lineage(pairs.select(both.alias("e")).select("e.*").distinct())
    if now.count() <= few:
        return now.coalesce(1).mapInPandas(_in_one_task, "node long, component long")
    mark = None
    while True:
        # Large star: every neighbour above the node goes to the smallest of node and neighbours.
        around = now.select("a", "b").union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = around.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("low"))
        large = around.filter("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("low").alias("b")).distinct()
        large = cut_lineage(large)
        # Small star: node and its smaller neighbours go to the smallest of them.
        least = large.groupBy("a").agg(F.min("b").alias("low"))
        small = large.join(least, "a").select(F.col("b").alias("a"), F.col("low").alias("b")).union(
            least.select("a", F.col("low").alias("b"))).filter("a <> b").distinct()
        now = cut_lineage(small)
        row = now.agg(F.count("*").alias("n"), F.expr("bit_xor(xxhash64(a, b))").alias("x")).first()
        if (row["n"], row["x"]) == mark:
            break
        mark = (row["n"], row["x"])
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).union(
        now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
