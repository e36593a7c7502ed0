"""Lloyd's clustering of integer vectors with the columns dealt out to shards.

A vector is never whole in one task of a round: tasks over a block of columns give each vector's
exact partial distances to that block of the centroids, the partial distances are shuffled
by vector, added and compared, and sums of the slices by cluster give each block's new centroids.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window as W, functions as F, types as T

from ..session import ship_functions
from .common import shuffles_dropped, staged

ship_functions(__name__)

#: Blocks that the columns are dealt out to.
BLOCKS = 4
#: Distances of a chunk of vectors held at once in a task, in numbers.
CHUNK_NUMBERS = 1 << 17

_SLICES = T.StructType([
    T.StructField("chunk", T.LongType()), T.StructField("block", T.IntegerType()), T.StructField("rows", T.IntegerType()),
    T.StructField("data", T.BinaryType()), T.StructField("ids", T.ArrayType(T.LongType()))])
_PARTIAL = T.StructType([
    T.StructField("chunk", T.LongType()), T.StructField("block", T.IntegerType()), T.StructField("rows", T.IntegerType()),
    T.StructField("distances", T.BinaryType()), T.StructField("data", T.BinaryType()), T.StructField("ids", T.ArrayType(T.LongType()))])
_SUMS = T.StructType([
    T.StructField("cluster", T.IntegerType()), T.StructField("component", T.IntegerType()), T.StructField("total", T.LongType()),
    T.StructField("members", T.LongType())])
_ASSIGNED = T.StructType([T.StructField("id", T.LongType()), T.StructField("cluster", T.IntegerType()), T.StructField("distance", T.LongType())])


def columns_of(block: int, width: int, blocks: int) -> slice:
    return slice(block * width // blocks, (block + 1) * width // blocks)


def narrow(values: np.ndarray) -> bytes:
    """Whole numbers in as few bytes each as hold them; the first byte says how many."""
    low, high = int(values.min(initial=0)), int(values.max(initial=0))
    size = next(s for s in (1, 2, 4, 8) if -(1 << 8 * s - 1) <= low and high < 1 << 8 * s - 1)
    return bytes([size]) + values.astype(f"<i{size}").tobytes()


def widened(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, f"<i{raw[0]}", offset=1).astype(np.int64)


def _sliced(batches: Iterator[pa.RecordBatch], width: int, blocks: int, rows: int) -> Iterator[pa.RecordBatch]:
    """Chunks of vectors, cut into blocks of columns; the first block carries the ids."""
    chunk = TaskContext.get().partitionId() << 32
    for batch in batches:
        flat = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
        for i in range(0, len(flat), rows):
            some, ids = flat[i:i + rows], batch.column(0).slice(i, rows)
            yield pa.RecordBatch.from_arrays([
                pa.array([chunk] * blocks, pa.int64()), pa.array(range(blocks), pa.int32()), pa.array([len(some)] * blocks, pa.int32()),
                pa.array([narrow(some[:, columns_of(b, width, blocks)].ravel()) for b in range(blocks)], pa.binary()),
                pa.array([ids.to_pylist(), *[None] * (blocks - 1)], pa.list_(pa.int64()))], names=_SLICES.names)
            chunk += 1


def partial_distances(x: np.ndarray, centroids: np.ndarray, whole: bool = True) -> np.ndarray:
    """Squared distances (rows x centroids), exact: by floating products where those are exact whole numbers.

    Less the vector's own square if not ``whole``: smaller numbers, and the same centroid is nearest.
    """
    most = max(int(np.abs(x).max(initial=0)), int(np.abs(centroids).max(initial=0)))
    kind = np.float64 if 4 * x.shape[1] * most * most < 1 << 53 else np.int64
    a, c = x.astype(kind), centroids.astype(kind)
    found = (c * c).sum(1) - 2 * (a @ c.T)
    return (found + (a * a).sum(1)[:, None] if whole else found).astype(np.int64)


def _block_rows(batches: Iterator[pa.RecordBatch], centroids: np.ndarray, last: bool) -> Iterator[pa.RecordBatch]:
    """Column-block task: partial distances of each chunk to this block of the centroids.

    The last pass needs whole distances and ids, the others the slices, to sum them up.
    """
    for batch in batches:
        rows, data = batch.column("rows").to_pylist(), batch.column("data")
        for i, n in enumerate(rows):
            raw = data[i].as_py()
            distances = partial_distances(widened(raw).reshape(n, -1), centroids, last)
            yield pa.RecordBatch.from_arrays([
                batch.column("chunk").slice(i, 1), batch.column("block").slice(i, 1), batch.column("rows").slice(i, 1),
                pa.array([narrow(distances.ravel())], pa.binary()), pa.array([None if last else raw], pa.binary()),
                batch.column("ids").slice(i, 1)], names=_PARTIAL.names)


def _whole(batches: Iterator[pa.RecordBatch], blocks: int, k: int) -> Iterator[tuple[list, np.ndarray, np.ndarray]]:
    """The blocks of each chunk with their distances added: (rows of the chunk, nearest centroid, distance); ties: the smaller number."""
    held: list = []
    for batch in batches:
        for row in batch.to_pylist():
            held.append(row)
            if len(held) == blocks:
                total = reduce(np.add, (widened(r["distances"]) for r in held)).reshape(held[0]["rows"], k)
                nearest = total.argmin(1)
                yield held, nearest, total[np.arange(len(total)), nearest]
                held = []


def _sum_rows(batches: Iterator[pa.RecordBatch], width: int, blocks: int, k: int) -> Iterator[pa.RecordBatch]:
    """Sums and counts of the clusters over all chunks of a task."""
    totals, members = np.zeros((k, width), np.int64), np.zeros(k, np.int64)
    for held, nearest, _ in _whole(batches, blocks, k):
        members += np.bincount(nearest, minlength=k)
        order = np.argsort(nearest, kind="stable")
        used, first = np.unique(nearest[order], return_index=True)
        for r in held:
            totals[used, columns_of(r["block"], width, blocks)] += np.add.reduceat(widened(r["data"]).reshape(r["rows"], -1)[order], first)
    cluster, component = np.nonzero(np.broadcast_to(members[:, None] > 0, totals.shape))
    yield pa.RecordBatch.from_arrays([
        pa.array(cluster.astype(np.int32)), pa.array(component.astype(np.int32)), pa.array(totals[cluster, component]), pa.array(members[cluster])],
        names=_SUMS.names)


def _assigned_rows(batches: Iterator[pa.RecordBatch], blocks: int, k: int) -> Iterator[pa.RecordBatch]:
    for held, nearest, distance in _whole(batches, blocks, k):
        ids = next(r["ids"] for r in held if r["block"] == 0)
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(nearest.astype(np.int32)), pa.array(distance)], names=_ASSIGNED.names)


def whole_vectors(rows: DataFrame, key: str, vector: str, width: int, scale: int) -> DataFrame:
    """``id, x``: vectors of ``width`` finite components, each as floor(scale * component); all others are left out."""
    bound = 1 << (62 - (width - 1).bit_length()) // 2 - 1                   # squared distances below 2^62
    vec, double = F.col(vector), F.col("v").cast("array<double>")
    fit = rows.select(F.col(key).cast("bigint").alias("id"), vec.alias("v")).where(F.size("v") == width)
    fit = fit.where(F.forall(double, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))))
    whole = F.transform(double, lambda x: F.when(F.abs(x) < bound / scale, F.floor(x * scale)).otherwise(
        F.raise_error(F.lit(f"component beyond {bound} after scaling: squared distances would not fit a long")).cast("bigint")))
    return fit.select("id", whole.alias("x"))


def first_centroids(vectors: DataFrame, k: int, width: int, order: Column) -> np.ndarray:
    """The ``k`` vectors (or all, if fewer) with an id that come first by ``order``; equal ones by id, then components."""
    rows = vectors.where("id is not null").orderBy(order, "id", "x").limit(k).collect()          # k vectors
    return np.array([r["x"] for r in rows], np.int64).reshape(-1, width)


def lloyd(
    rows: DataFrame, k: int, rounds: int, order: Column, key: str = "vec_id", vector: str = "embedding", width: int = 64, scale: int = 256,
    blocks: int = BLOCKS,
) -> tuple[DataFrame, np.ndarray]:
    """Clusters of the vectors of ``rows``: (``key, cluster, distance``, one row for each vector kept), final centroids.

    Vectors of exactly ``width`` components, none null or not finite, take part, as floor(``scale`` * component). Centroids start
    as the first ``k`` by ``order`` (a column over ``id``). Each round assigns every vector to the nearest
    centroid (squared distance, ties: smaller number) and replaces each centroid that has vectors by
    the floor of their exact mean; then vectors are assigned once more. All arithmetic is on whole numbers.

    Vectors are written once as chunks, cut into ``blocks`` of columns, a folder for each block, so that a
    column-block task reads its columns only. A round shuffles, for each vector and block, k partial distances
    in as few bytes as hold them, and the slice; its shuffle files go when it ends. What reaches the driver is the model: k x width sums in a round.

    Rows without an id are assigned but never start a centroid; repeated rows and ids come back as often as they
    came; fewer than k vectors with an id give as many centroids, and none of them no rows. A component so large that
    squared distances could not be longs (2^27 after scaling, at 64 columns) is an error. Other columns are ignored, whatever their names.
    """
    blocks = min(blocks, width)
    vectors = whole_vectors(rows, key, vector, width, scale)
    centroids = first_centroids(vectors, k, width, order)
    k = len(centroids)
    if not k:
        return rows.sparkSession.createDataFrame([], _ASSIGNED).withColumnRenamed("id", key), centroids
    chunk_rows = max(CHUNK_NUMBERS // max(k, width), 1)
    slices = staged(vectors.mapInArrow(lambda b: _sliced(b, width, blocks, chunk_rows), _SLICES), "slices", by="block")

    def distances(now: np.ndarray, last: bool) -> DataFrame:
        def of(block: int) -> DataFrame:
            own = now[:, columns_of(block, width, blocks)]                  # a task gets its slice of the centroids only
            return slices.where(F.col("block") == block).select(
                "chunk", "block", "rows", "data", "ids" if last else F.lit(None).cast("array<bigint>").alias("ids")).mapInArrow(
                lambda b: _block_rows(b, own, last), _PARTIAL)

        return reduce(DataFrame.union, map(of, range(blocks))).repartition("chunk").sortWithinPartitions("chunk")

    with shuffles_dropped(rows.sparkSession):
        for _ in range(rounds):
            sums = distances(centroids, False).mapInArrow(lambda b: _sum_rows(b, width, blocks, k), _SUMS)
            moved = sums.groupBy("cluster", "component").agg(F.sum("total").alias("total"), F.sum("members").alias("members")).collect()
            centroids = centroids.copy()
            for r in moved:                                                 # floor of the exact mean
                centroids[r["cluster"], r["component"]] = r["total"] // r["members"]
        assigned = staged(distances(centroids, True).mapInArrow(lambda b: _assigned_rows(b, blocks, k), _ASSIGNED), "assigned")
    return assigned.withColumnRenamed("id", key), centroids


def with_inertia(assigned: DataFrame, centroids: np.ndarray) -> DataFrame:
    """Add ``cluster_inertia`` and ``inertia`` (distances summed over the cluster and over all) and ``centroid_sha256``.

    Joined are as many rows as there are centroids.
    """
    spark = assigned.sparkSession
    texts = [(i, ",".join(map(str, c))) for i, c in enumerate(centroids.tolist())]
    named = spark.createDataFrame(texts, "cluster int, components string").select("cluster", F.sha2("components", 256).alias("centroid_sha256"))
    of_cluster = assigned.groupBy("cluster").agg(F.sum("distance").alias("cluster_inertia"))
    of_cluster = of_cluster.withColumn("inertia", F.sum("cluster_inertia").over(W.partitionBy()))     # one row for each centroid
    return assigned.join(F.broadcast(of_cluster.join(named, "cluster")), "cluster")
