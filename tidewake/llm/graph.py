"""Connected components: of a few rows in memory, and of a graph given by its links without gathering it anywhere."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common


class UnionFind:
    """Union-find over node numbers, for whole arrays of links at a time."""

    def __init__(self, n: int):
        self.root = np.arange(n)

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        while len(a):
            x, y = self.root[a], self.root[b]
            apart = x != y
            a, b, x, y = a[apart], b[apart], x[apart], y[apart]
            if len(a):
                np.minimum.at(self.root, np.maximum(x, y), np.minimum(x, y))
                while True:
                    up = self.root[self.root]
                    if (up == self.root).all():
                        break
                    self.root = up


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node, component: the smallest node reachable, for every node that has a link to another.

    Alternates two steps until nothing changes: each node passes the smallest of its neighbours and
    itself to its larger neighbours, then to its smaller ones. Minima are aggregated before the
    shuffle and met by joins that split skewed keys, so a node with very many links is no single
    task's burden. Each round is written to the shared folder; rounds grow with the logarithm of
    the number of nodes. Links with a null end are ignored.
    """
    x, y = F.col(a).cast("long"), F.col(b).cast("long")
    edges = links.filter(x.isNotNull() & y.isNotNull() & (x != y)).select(F.greatest(x, y).alias("u"), F.least(x, y).alias("v")).distinct()
    edges = common.materialize(edges, "links")
    last = None
    while True:
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.count_distinct("u")).first()
        # Done when a round changed nothing; or at once when every node has one link, to a node that has none.
        if state[0] == 0 or state == last:
            break
        last = state
        if state[0] == state[2] and edges.join(edges.select(F.col("u").alias("w")), F.col("v") == F.col("w"), "left_semi").limit(1).count() == 0:
            break
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = common.join_skewed(both, least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        met = common.join_skewed(large, least, "u")
        small = met.select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
        earlier, edges = edges, common.materialize(small.select("e.u", "e.v").filter("u <> v").distinct(), "links")
        common.discard(earlier)
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
