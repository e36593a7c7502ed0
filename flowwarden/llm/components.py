"""Connected components of a graph kept as a table of edges."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, functions as F

from ..session import ship_functions
from .common import staged

ship_functions(__name__)


def forest(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The same components as edges (u, v), with one edge less than nodes in each: node -> smallest node."""
    if not len(u):
        return u, v
    nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = at[:len(u)], at[len(u):]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        new = new[new]
        if np.array_equal(new, label):
            break
        label = new
    moved = label != np.arange(len(nodes))
    return nodes[moved], nodes[label[moved]]


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """``u, v`` (bigint) to ``node, root``: every node but the smallest of its component, with that smallest node.

    Rounds of large star (neighbours above a node move to its smallest neighbour) and small
    star (neighbours below it do), each round written to the shared folder. Rounds grow with
    the logarithm of the longest path. Joins are on nodes against one row for each node.
    """
    now, seen = staged(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges"), None
    for _ in range(max_rounds):
        sign = now.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first()
        if sign == seen or not sign[0]:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
        seen = sign
        both = now.union(now.select("v", "u"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low)
        now = staged(small.distinct(), "edges")
    raise RuntimeError(f"components not settled in {max_rounds} rounds")
