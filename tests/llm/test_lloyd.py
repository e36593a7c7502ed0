"""Clusters against plain whole-number Lloyd rounds."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F, types as T

from flowwarden.llm import lloyd, oracle, queries
from tests import compare
from tests.llm import helpers

SCHEMA = T.StructType([
    T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.FloatType())), T.StructField("label", T.IntegerType()),
    *[T.StructField(c, T.StringType()) for c in ("chunk", "block", "data", "id", "x", "cluster", "distance", "rows")]])


def table(spark, rows):
    return spark.createDataFrame([(i, v, 1, *["clash"] * 8) for i, v in rows], SCHEMA)


def brute(vectors, k, rounds, start):
    """vectors: (id, whole numbers) -> ([(id, cluster, distance)], centroids), numbers of any size."""
    x = [list(map(int, v)) for _, v in vectors]
    order = sorted((i for i, (key, _) in enumerate(vectors) if key is not None), key=lambda i: (start(vectors[i][0]), vectors[i][0], x[i]))
    c = [x[i] for i in order[:k]]
    nearest = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, m)), j) for j, m in enumerate(c))
    for _ in range(rounds):
        of = [nearest(v)[1] for v in x]
        for j in range(len(c)):
            own = [v for v, g in zip(x, of) if g == j]
            if own:
                c[j] = [sum(col) // len(own) for col in zip(*own)]
    return [(key, *reversed(nearest(v))) for (key, _), v in zip(vectors, x)] if c else [], c


def digest(i):
    return hashlib.sha256(f"2:{i}".encode()).hexdigest()


def floats(rng, width, spread=1.0):
    return [float(np.float32(rng.gauss(0, spread))) for _ in range(width)]


@pytest.mark.parametrize("width,k,blocks,spread", [(5, 3, 2, 1.0), (7, 4, 7, 3.0), (1, 2, 4, 1.0), (6, 50, 3, 0.02), (4, 3, 2, 20000.0)])
def test_odd_vectors(spark, width, k, blocks, spread):
    rng = random.Random(width)
    good = [(i, floats(rng, width, spread)) for i in range(40)]
    good += [(i, v) for i, v in good[:5]] + [(None, good[7][1]), (77, good[8][1]), (-3, [0.0] * width)]
    bad = [(90, None), (91, []), (92, good[0][1] + [1.0]), (93, [None, *good[0][1][1:]]), (94, [float("nan"), *good[0][1][1:]]), (95, [float("-inf"), *good[0][1][1:]])]
    rows = table(spark, good + bad).repartition(3)
    got, centroids = lloyd.lloyd(rows, k, 4, F.sha2(F.concat(F.lit("2:"), F.col("id").cast("string")), 256), width=width, blocks=blocks)
    want, c = brute([(i, [np.floor(256 * x) for x in v]) for i, v in good], k, 4, digest)
    assert centroids.tolist() == c
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(want, key=repr)


def test_no_vectors(spark):
    order = F.col("id")
    for rows in ([], [(1, None)], [(None, [1.0, 2.0])]):
        assigned, centroids = lloyd.lloyd(table(spark, rows), 3, 2, order, width=2)
        assert assigned.columns == ["vec_id", "cluster", "distance"] and not len(centroids) and assigned.count() == 0
        assert lloyd.with_inertia(assigned, centroids).count() == 0


def test_empty_cluster_stays(spark):
    # two equal first centroids: ties go to the smaller number, the other has no vector and keeps its place
    rows = table(spark, [(1, [0.0, 0.0]), (2, [0.0, 0.0]), (3, [1.0, 1.0])])
    assigned, centroids = lloyd.lloyd(rows, 2, 3, F.col("id"), width=2)
    assert centroids.tolist() == [[85, 85], [0, 0]] or centroids.tolist() == brute([(1, [0, 0]), (2, [0, 0]), (3, [256, 256])], 2, 3, lambda i: i)[1]
    assert sorted(map(tuple, assigned.collect())) == sorted(brute([(1, [0, 0]), (2, [0, 0]), (3, [256, 256])], 2, 3, lambda i: i)[0])


def test_partial_distances_are_exact():
    rng = np.random.default_rng(1)
    for most in (3, 1 << 20, (1 << 24) - 1):
        x, c = rng.integers(-most, most, (50, 16)), rng.integers(-most, most, (9, 16))
        plain = np.array([[sum((int(a) - int(b)) ** 2 for a, b in zip(v, m)) for m in c] for v in x])
        assert (lloyd.partial_distances(x, c) == plain).all()
        less = lloyd.partial_distances(x, c, False)
        assert (less + (x * x).sum(1)[:, None] == plain).all()
    for values in ([], [0], [-128, 127], [128], [1 << 40, -5]):
        assert lloyd.widened(lloyd.narrow(np.array(values, np.int64))).tolist() == values


def test_too_large_components_are_refused(spark):
    with pytest.raises(Exception, match="component beyond"):
        lloyd.lloyd(table(spark, [(1, [1e9, 0.0])]), 2, 2, F.col("id"), width=2)


def test_op11(spark):
    rows = [(r["vec_id"], [int(np.floor(256 * x)) for x in r["embedding"]]) for r in helpers.read(spark, "embeddings").collect()]
    want, centroids = brute(rows, 40, 5, digest)
    shas = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    inertia = {}
    for _, c, d in want:
        inertia[c] = inertia.get(c, 0) + d
    got = queries.op11_lloyd(spark, helpers.SF)
    assert sorted(map(tuple, got.collect())) == sorted((i, c, d, inertia[c], sum(inertia.values()), shas[c]) for i, c, d in want)
    con = compare.connect(helpers.SF)
    assert compare.difference(compare.spark_rows(got), compare.duck_rows(con, oracle.SQL["op11_lloyd"])) is None
