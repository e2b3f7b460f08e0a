"""Connected components of a distributed edge list, by alternating star contractions.

Each round links every node's larger neighbours to its smallest one (large star) and then every
node's smaller neighbours to the smallest (small star), until nothing changes; the number of
rounds grows with the logarithm of the longest path. Per node only minima are aggregated, so no
task holds a node's neighbours in memory. The join of the large star streams the edges of a node
with very many neighbours through one task, unless adaptive execution splits it. The edges are
written to the shared folder after each round.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quantloom.llm.common import durable


def forest(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest connected index of each of n items, for edges (a, b) inside one task."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[a], label[b])
        before = label.copy()
        np.minimum.at(label, label[a], low)
        np.minimum.at(label, label[b], low)
        while (label[label] != label).any():
            label = label[label]
        if (label == before).all():
            return label


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    linked = edges.join(least, "u")
    return linked.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").union(least.select("u", F.col("m").alias("v"))).distinct()


def components(edges: DataFrame) -> DataFrame:
    """node, component (smallest node reachable) of every node of the edges (columns a, b)."""
    now = durable(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    seen = None
    while True:
        mark = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if mark == seen or not mark[0]:
            return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(now.select(F.col("v").alias("node"), F.col("v").alias("component"))).distinct()
        seen = mark
        now = durable(_small_star(_large_star(now)))
