"""A boosted forest as a table of nodes: scoring, loss by round and importance.

The table is that of ``model.model_trees``. Trees are bounded by the model (500 of depth 8 are some 4 MB), so they go to
the workers as arrays; rows are walked down all trees at once, a level at a time, and never move.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F, types as T

from ..session import ship_functions
from .tree_shap import Nodes

ship_functions(__name__)

#: Rows walked down the trees at once: rows x trees positions are held.
ROWS = 1024


@dataclass
class Packed:
    """Nodes of all trees in one row of arrays; children are positions, a leaf leads to itself."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    roots: np.ndarray
    depth: int


def _depth(nodes: Nodes, at: int = 0) -> int:
    feature, _, left, right, _, _ = nodes[at]
    return 0 if feature < 0 else 1 + max(_depth(nodes, left), _depth(nodes, right))


def packed(forest: list[Nodes]) -> Packed:
    """Arrays of a forest whose leaf values add up to the log-odds."""
    rows, roots = [], []
    for nodes in forest:
        at = {n: len(rows) + i for i, n in enumerate(sorted(nodes))}
        roots.append(at[0])
        for n in sorted(nodes):
            feature, threshold, left, right, value, _ = nodes[n]
            leaf = feature < 0
            rows.append((0, np.inf, at[n], at[n], value) if leaf else (feature, threshold, at[left], at[right], 0.0))
    feature, threshold, left, right, value = (np.array(c) for c in zip(*rows))
    return Packed(feature, threshold, left, right, value, np.array(roots), max(map(_depth, forest)))


def steps(block: np.ndarray, trees: Packed) -> Iterator[np.ndarray]:
    """Positions (rows x trees) of a block's rows at each level, from the roots to the leaves. Missing values go right."""
    rows = np.arange(len(block))[:, None]
    at = np.broadcast_to(trees.roots, (len(block), len(trees.roots)))
    yield at
    for _ in range(trees.depth):
        goes_left = block[rows, trees.feature[at]] <= trees.threshold[at]
        at = np.where(goes_left, trees.left[at], trees.right[at])
        yield at


def leaf_values(x: np.ndarray, trees: Packed) -> Iterator[tuple[int, np.ndarray]]:
    """(first row, value of the leaf that each row reaches in each tree), a block of rows at a time."""
    for begin in range(0, len(x), ROWS):
        for at in steps(x[begin:begin + ROWS], trees):
            pass
        yield begin, trees.value[at]


def margin_column(spark: SparkSession, forest: list[Nodes], x: str = "x") -> Column:
    """Log-odds of a row from its feature array."""
    shared = spark.sparkContext.broadcast(packed(forest))

    @F.pandas_udf(T.DoubleType())
    def margin(rows: pd.Series) -> pd.Series:
        if not len(rows):
            return pd.Series([], dtype=float)
        return pd.Series(np.concatenate([v.sum(1) for _, v in leaf_values(np.stack(rows), shared.value)]))

    return margin(x)


def probability(margin: Column) -> Column:
    return 1.0 / (1.0 + F.exp(-margin))


def loss_by_round(df: DataFrame, forest: list[Nodes], x: str = "x", label: str = "y") -> DataFrame:
    """Mean log loss of a labelled table after each boosting round, in one pass whatever the number of rounds.

    A task adds up the losses of its rows for all rounds, so a row for each task and round is shuffled. Rows without
    a label do not count; an empty table has no rounds.
    """
    shared = df.sparkSession.sparkContext.broadcast(packed(forest))
    rounds = len(forest)

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        losses, n = np.zeros(rounds), 0
        for batch in batches:
            if not batch.num_rows:
                continue
            sign = 1.0 - 2.0 * batch.column(1).to_numpy()                 # +1 for label 0, -1 for label 1
            rows = np.stack(batch.column(0).to_numpy(zero_copy_only=False))
            for begin, values in leaf_values(rows, shared.value):
                upto = np.cumsum(values, axis=1) * sign[begin:begin + len(values), None]
                losses += np.logaddexp(0.0, upto).sum(0)
            n += batch.num_rows
        if n:
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.arange(1, rounds + 1), pa.int32()), pa.array(losses), pa.array(np.full(rounds, n))], ["iteration", "loss", "n"])

    known = df.where(F.col(label).isNotNull()).select(x, F.col(label).cast("double").alias(label))
    return known.mapInArrow(partial, "iteration int, loss double, n bigint").groupBy("iteration").agg(
        (F.sum("loss") / F.sum("n")).alias("loss"))


def with_statistics(nodes: DataFrame, df: DataFrame, x: str = "x", label: str = "y") -> DataFrame:
    """The node table with ``cover`` and ``gain`` measured on a labelled table: rows that reach a node, and by how much its
    split lowers the variance of the label. Nodes that no row reaches have cover 0 and gain 0.

    A task adds up its rows for all nodes and passes on those reached, so what is shuffled is bounded by tasks x nodes.
    """
    forest = forest_of(nodes.collect())
    ids = [(t, n) for t, tree in enumerate(forest) for n in sorted(tree)]
    shared = df.sparkSession.sparkContext.broadcast((packed(forest), np.array(ids, dtype=np.int32)))

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees, names = shared.value
        rows, ones = np.zeros(len(names), np.int64), np.zeros(len(names), np.int64)
        for batch in batches:
            if not batch.num_rows:
                continue
            held, y = np.stack(batch.column(0).to_numpy(zero_copy_only=False)), batch.column(1).to_numpy()
            for begin in range(0, len(held), ROWS):
                positive, last = y[begin:begin + ROWS] == 1, None
                for at in steps(held[begin:begin + ROWS], trees):
                    new = np.ones(at.shape, bool) if last is None else at != last       # a row stays in the leaf it reached
                    rows += np.bincount(at[new], minlength=len(rows))
                    ones += np.bincount(at[positive][new[positive]], minlength=len(ones))
                    last = at
        seen = np.flatnonzero(rows)
        if len(seen):
            yield pa.RecordBatch.from_arrays(
                [pa.array(names[seen, 0]), pa.array(names[seen, 1]), pa.array(rows[seen]), pa.array(ones[seen])], ["t", "n", "rows", "ones"])

    known = df.where(F.col(label).isNotNull()).select(x, F.col(label).cast("int").alias(label))
    counted = known.mapInArrow(partial, "t int, n int, rows bigint, ones bigint").groupBy("t", "n").agg(
        F.sum("rows").alias("rows"), F.sum("ones").alias("ones"))
    # variance times rows; a split lowers it by what its two sides no longer hold
    spread = F.col("ones") - F.col("ones") * F.col("ones") / F.col("rows")
    measured = counted.select("t", "n", F.col("rows").cast("double").alias("rows"), spread.alias("spread"))
    order = {t: i for i, t in enumerate(sorted({r["tree_id"] for r in nodes.select("tree_id").distinct().collect()}))}
    numbers = df.sparkSession.createDataFrame(list(order.items()), "tree_id int, t int")
    numbered = nodes.drop("cover", "gain").join(F.broadcast(numbers), "tree_id")
    side = lambda c: measured.select("t", F.col("n").alias(f"{c}_child"), F.col("spread").alias(f"{c}_spread"))
    zero = F.lit(0.0)
    full = numbered.join(measured.withColumnRenamed("n", "node_id"), ["t", "node_id"], "left").join(
        side("left"), ["t", "left_child"], "left").join(side("right"), ["t", "right_child"], "left")
    lowered = F.coalesce("spread", zero) - F.coalesce("left_spread", zero) - F.coalesce("right_spread", zero)
    gain = F.when((F.col("feature_index") >= 0) & (F.col("rows") > 0), lowered / F.col("rows")).otherwise(zero)
    return full.withColumns({"cover": F.coalesce("rows", zero), "gain": gain}).select(*nodes.columns)


def gain_importance(nodes: DataFrame, features: list[str]) -> DataFrame:
    """Share of each feature in the gains of all splits, weighted by the rows that a split parts.

    Features without a split have 0; a forest without any gives 0 for all.
    """
    gains = nodes.where(F.col("feature_index") >= 0).groupBy("feature_index").agg(F.sum(F.col("gain") * F.col("cover")).alias("gain"))
    names = nodes.sparkSession.createDataFrame(list(enumerate(features)), "feature_index int, feature string")
    gain = F.coalesce("gain", F.lit(0.0))
    total = F.sum(gain).over(W.partitionBy())                             # one row for each feature
    return names.join(F.broadcast(gains), "feature_index", "left").select(
        "feature", F.coalesce(F.try_divide(gain, total), F.lit(0.0)).alias("importance"))


def forest_of(rows) -> list[Nodes]:
    """Trees of collected node rows, values scaled so that leaves add up to the log-odds."""
    trees: dict[int, Nodes] = {}
    for r in rows:
        trees.setdefault(r["tree_id"], {})[r["node_id"]] = (
            r["feature_index"], r["threshold"], r["left_child"], r["right_child"], 2.0 * r["weight"] * r["prediction"], r["cover"])
    return [trees[t] for t in sorted(trees)]
