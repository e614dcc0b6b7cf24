"""Connected components of links, on the cluster and inside one task."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chartloom.llm.runtime import cut, sized_broadcast

#: Nodes whose minima are broadcast; some 30 bytes each.
FEW = 1_000_000


def _minima(edges: DataFrame) -> DataFrame:
    """(u, m): the least of each u and its v."""
    least = cut(edges.groupBy("u").agg(F.min(F.least("u", "v")).alias("m")))
    return sized_broadcast(least, least.count(), FEW)


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of links(a, b); root is the smallest node that links reach.

    Alternates large-star and small-star steps until the edge set stops changing, so the number of rounds
    grows with the logarithm of the longest chain. Nothing but counts reaches the driver, and each step is checkpointed.
    Minima are aggregated before they are shuffled and then joined from a table of their own: broadcast where they are few,
    else by a join whose skewed side Spark can split, so a node of very many links isn't one task's. Loops (a = b) and repeated links are dropped; rows with nulls link nothing;
    no links gives an empty result. Nodes can be of any type that orders.
    """
    edges = cut(links.where(F.col("a").isNotNull() & F.col("b").isNotNull() & (F.col("a") != F.col("b"))).select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    before = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        edges = cut(both.join(_minima(both), "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
        edges = edges.join(_minima(edges), "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.*").where("u != v").distinct()
        edges = cut(edges)
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if now == before:
            break
        before = now
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def local_components(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest index that each of n points reaches over the links a-b."""
    label = np.arange(n)
    while len(a):
        low = np.minimum(label[a], label[b])
        np.minimum.at(label, label[a], low)
        np.minimum.at(label, label[b], low)
        while (label[label] != label).any():
            label = label[label]
        open_ = label[a] != label[b]
        a, b = a[open_], b[open_]
    return label
