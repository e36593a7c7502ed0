"""A forest by rule, in the table layout of a fitted one: its scores can be stated in SQL at the published size.

Nodes are numbered as in a heap; five of eight training rows went left at each. All values follow from the numbers of tree and node; leaves are multiples of 0.0001.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: Largest threshold of a numeric feature; indicators part at one half. Fixed values.
BOUNDS = {
    "duration": 2000.0, "src_bytes": 200000.0, "dst_bytes": 5000.0, "count": 400.0, "srv_count": 60.0,
    "serror_rate": 1.0, "num_failed_logins": 8.0, "dst_host_count": 256.0,
}


def frozen_nodes(spark: SparkSession, features: list[str], trees: int, depth: int) -> DataFrame:
    """Node rows of ``trees`` full trees of a depth over these features."""
    per_tree = (1 << depth + 1) - 1
    bounds = ", ".join(f"{BOUNDS.get(f, 1.0)!r}D" for f in features)
    numeric = ", ".join("true" if f in BOUNDS else "false" for f in features)
    rows = spark.range(trees * per_tree).selectExpr(f"CAST(id DIV {per_tree} AS INT) AS tree_id", f"CAST(id % {per_tree} AS INT) AS node_id")
    placed = rows.selectExpr("*", "length(bin(node_id + 1)) - 1 AS level").selectExpr(
        "*", f"level < {depth} AS inner", f"(tree_id + 3 * level) % {len(features)} AS f")
    return placed.selectExpr(
        "tree_id", "node_id", "CASE WHEN inner THEN 2 * node_id + 1 ELSE -1 END AS left_child",
        "CASE WHEN inner THEN 2 * node_id + 2 ELSE -1 END AS right_child", "CASE WHEN inner THEN f ELSE -1 END AS feature_index",
        f"""CASE WHEN inner THEN CASE WHEN array({numeric})[f] THEN array({bounds})[f] * ((tree_id * 13 + node_id * 7) % 32 + 0.5D) / 32
            ELSE 0.5D END END AS threshold""",
        "CASE WHEN inner THEN 0D ELSE ((tree_id * 31 + node_id * 17) % 201 - 100) / 20000D END AS prediction",
        "1000D * pow(0.625D, level + 1 - bit_count(node_id + 1)) * pow(0.375D, bit_count(node_id + 1) - 1) AS cover",
        "0D AS gain", "1D AS weight")
