"""Path-dependent Shapley values for boosted trees.

A leaf is reached through a few features; feature j lets a row through (o_j = 1) or not
(o_j = 0), and lets a share z_j of the training weight through when it is unknown. The
leaf's value function is ``value * prod(o_j in S) * prod(z_j not in S)``. Its Shapley value for feature i is
``value * (o_i - z_i)`` times the integral over t in 0..1 of the product of ``t o_j + (1 - t) z_j`` over the other j,
a polynomial that a few Gauss points integrate exactly.

A tree is cut into subtrees so small that the decisions on the way to one and inside it are at most ``BITS``. All its
leaves share one table over the patterns of these decisions, so a row costs one look-up for each feature of a
subtree, not a sum over leaves. Tables are built for a tree at a time, leaves of equally many features together, and are
paid once for all rows that a worker holds.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, SparkSession, functions as F, types as T

from ..session import ship_functions

ship_functions(__name__)

BITS = 9
#: Rows attributed with the same tables by a worker, and rows of a tree's look-ups that stay in the processor's cache.
ROWS, BLOCK = 80_000, 8192

#: A tree: id -> (feature, threshold, left, right, value, cover); feature < 0 is a leaf, 0 the root.
Nodes = dict[int, tuple]


def _gauss(features: int) -> Iterator[tuple[float, float]]:
    """Points in 0..1 and weights that integrate the product over all but one of the features."""
    points, weights = np.polynomial.legendre.leggauss((features + 1) // 2)
    return zip((points + 1) / 2, weights / 2)


def pattern_values(passed: np.ndarray, shares: np.ndarray) -> np.ndarray:
    """Shapley values (patterns x features) of a leaf of value 1 with these ``shares``; ``passed`` is 0 or 1."""
    z = np.maximum(shares, 1e-200)
    out = np.zeros(passed.shape)
    for t, w in _gauss(len(z)):
        term = t * passed + (1 - t) * z
        out += w * term.prod(1, keepdims=True) / term
    return out * (passed - z)


def leaf_tables(shares: np.ndarray) -> np.ndarray:
    """Shapley values (leaves x features x patterns) of leaves of value 1; bit j of a pattern: feature j let the row through.

    A factor takes two values, so products over all patterns double with each feature.
    """
    z = np.maximum(shares, 1e-200)
    n, d = z.shape
    out = np.zeros((n, d, 1 << d))
    of_bit = lambda values, j: values.reshape(n, -1, 2, 1 << j)
    for t, w in _gauss(d):
        terms = np.stack([(1 - t) * z, (1 - t) * z + t], 2)
        product = np.full((n, 1), w)
        for j in range(d):
            product = (terms[:, j, :, None] * product[:, None, :]).reshape(n, -1)
        for j in range(d):
            out[:, j] += (of_bit(product, j) / terms[:, j][:, None, :, None]).reshape(n, -1)
    for j in range(d):
        out[:, j] *= np.broadcast_to(np.stack([-z[:, j], 1 - z[:, j]], 1)[:, None, :, None], (n, 1 << d - 1 - j, 2, 1 << j)).reshape(n, -1)
    return out


def _leaves(nodes: Nodes, at: int, path: list[tuple]) -> Iterator[tuple]:
    """(value, path) of each leaf below a node; a path is (node, went left) from the root on."""
    feature, _, left, right, value, _ = nodes[at]
    if feature < 0:
        yield value, path
        return
    yield from _leaves(nodes, left, [*path, (at, 1)])
    yield from _leaves(nodes, right, [*path, (at, 0)])


def _by_feature(nodes: Nodes, path: list[tuple]) -> dict[int, list]:
    """feature -> [share of the weight that its decisions let through, its decisions]."""
    found: dict[int, list] = {}
    for at, went_left in path:
        feature, _, left, right, _, cover = nodes[at]
        mine = found.setdefault(feature, [1.0, []])
        mine[0] *= nodes[left if went_left else right][5] / cover
        mine[1].append((at, went_left))
    return found


def expected_value(forest: list[Nodes]) -> float:
    return float(sum(value * np.prod([s for s, _ in _by_feature(nodes, path).values()]) for nodes in forest for value, path in _leaves(nodes, 0, [])))


def _inner(nodes: Nodes) -> dict[int, int]:
    """Decisions below and at each node."""
    count: dict[int, int] = {}

    def walk(at: int) -> int:
        feature, _, left, right, _, _ = nodes[at]
        count[at] = 0 if feature < 0 else 1 + walk(left) + walk(right)
        return count[at]

    walk(0)
    return count


def _subtrees(nodes: Nodes) -> Iterator[tuple[list[int], int, list[tuple]]]:
    """(decisions on the way, root, path) of subtrees that hold all leaves once and need at most ``BITS`` decisions, or are a leaf."""
    inner = _inner(nodes)
    stack: list[tuple[int, list]] = [(0, [])]
    while stack:
        at, path = stack.pop()
        if nodes[at][0] < 0 or len(path) + inner[at] <= BITS:
            yield [n for n, _ in path], at, path
        else:
            stack += [(nodes[at][2], [*path, (at, 1)]), (nodes[at][3], [*path, (at, 0)])]


def _below(nodes: Nodes, at: int) -> list[int]:
    feature, _, left, right, _, _ = nodes[at]
    return [] if feature < 0 else [at, *_below(nodes, left), *_below(nodes, right)]


def _deep_leaf(left: dict, rules: dict, value: float, phi: np.ndarray) -> None:
    """A leaf behind more decisions than a table has bits for: values for the patterns that occur."""
    passed = np.stack([np.logical_and.reduce([left[n] == d for n, d in decisions]) for _, decisions in rules.values()], 1)
    seen, where = np.unique(passed, axis=0, return_inverse=True)
    values = pattern_values(seen.astype(float), np.array([s for s, _ in rules.values()]))
    for j, feature in enumerate(rules):
        phi[feature] += value * values[where.ravel(), j]


@lru_cache(4096)
def _leaf_patterns(bits: int, rules: tuple[tuple[int, int], ...]) -> np.ndarray:
    """For each pattern of ``bits`` decisions that of a leaf's features; a feature lets a row through if its (mask, wanted) bits are so."""
    codes = np.arange(1 << bits)
    return sum(((codes & mask) == want).astype(np.intp) << j for j, (mask, want) in enumerate(rules))


def _tables(nodes: Nodes) -> tuple[list[tuple], list[tuple]]:
    """Subtrees as (decisions on the way, those inside, feature -> value for each pattern), and leaves too deep for that."""
    groups, ways, deep, leaves = [], [], [], {}         # leaves of equally many features are valued together
    for way, root, path in _subtrees(nodes):
        inside = _below(nodes, root)
        bits = {n: i for i, n in enumerate([*way, *inside])}
        if len(bits) > BITS:
            deep.append((_by_feature(nodes, path), nodes[root][4]))
            continue
        groups.append(bits)
        ways.append((tuple(way), inside))
        for value, to in _leaves(nodes, root, path):
            rules = _by_feature(nodes, to)
            leaves.setdefault(len(rules), []).append((len(groups) - 1, value, rules))
    rows: list[dict[int, int]] = [{} for _ in groups]   # feature -> its row in the subtree's table
    for some in leaves.values():
        for g, _, rules in some:
            for feature in rules:
                rows[g].setdefault(feature, len(rows[g]))
    tables = [np.zeros((len(mine), 1 << len(bits))) for mine, bits in zip(rows, groups)]
    for d, some in leaves.items():
        if not d:
            continue
        values = leaf_tables(np.array([[s for s, _ in rules.values()] for _, _, rules in some]))
        values *= np.array([v for _, v, _ in some])[:, None, None]
        for (g, _, rules), of in zip(some, values):
            bits = groups[g]
            wanted = tuple((sum(1 << bits[n] for n, _ in at), sum(went_left << bits[n] for n, went_left in at)) for _, at in rules.values())
            tables[g][[rows[g][f] for f in rules]] += of.take(_leaf_patterns(len(bits), wanted), 1)
    return [(*way, dict(zip(mine, table))) for way, mine, table in zip(ways, rows, tables)], deep


def _add_tree(x: np.ndarray, nodes: Nodes, tables: list[tuple], deep: list[tuple], phi: np.ndarray) -> None:
    """Add a tree's Shapley values (features x rows) for rows given as columns. Missing values go right, as they do in scoring."""
    left = {at: x[node[0]] <= node[1] for at, node in nodes.items() if node[0] >= 0}
    for rules, value in deep:
        _deep_leaf(left, rules, value, phi)
    went = {at: passed.astype(np.uint16) for at, passed in left.items()}
    codes = {(): np.zeros(x.shape[1], np.uint16)}       # of the decisions on the way, which subtrees share

    def code_of(way: tuple) -> np.ndarray:
        if way not in codes:
            codes[way] = code_of(way[:-1]) | went[way[-1]] << np.uint16(len(way) - 1)
        return codes[way]

    for way, inside, table in tables:
        code = code_of(way)
        for i, n in enumerate(inside, len(way)):
            code = code | went[n] << np.uint16(i)
        code = code.astype(np.intp)
        for feature, column in table.items():
            phi[feature] += column.take(code)


def attribute(x: np.ndarray, forest: list[Nodes]) -> np.ndarray:
    """Shapley values of every row (rows x features)."""
    phi = np.zeros(x.shape[::-1])
    columns = np.ascontiguousarray(x.T)
    for nodes in forest:
        tables, deep = _tables(nodes)
        for i in range(0, len(x), BLOCK):
            _add_tree(columns[:, i:i + BLOCK], nodes, tables, deep, phi[:, i:i + BLOCK])
    return phi.T


def shap_column(spark: SparkSession, forest: list[Nodes], x: str = "x") -> Column:
    """Attribution array from a feature array; the trees (bounded by the model) are broadcast."""
    shared = spark.sparkContext.broadcast(forest)

    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def attributions(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        def done(held: list[pd.Series]) -> Iterator[pd.Series]:
            sizes = np.cumsum([len(b) for b in held])
            rows = [row for b in held for row in b]
            phi = attribute(np.array(rows, dtype=float), shared.value) if rows else []
            for begin, end in zip([0, *sizes], sizes):
                yield pd.Series(list(phi[begin:end]), dtype=object)

        held: list[pd.Series] = []
        for batch in batches:
            held.append(batch)
            if sum(map(len, held)) >= ROWS:
                yield from done(held)
                held = []
        if held:
            yield from done(held)

    return attributions(x)
