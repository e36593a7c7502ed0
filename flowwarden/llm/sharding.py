"""Contiguous shards of equal bytes from global prefix sums."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from .common import staged


def byte_shards(rows: DataFrame, key: str, size: Column, n_shards: int, carry: dict[str, Column] | None = None) -> DataFrame:
    """Cut ``rows``, ordered by ``key``, into ``n_shards`` runs of nearly equal bytes.

    Rows are range-partitioned by key and written with their partition's number; a window
    per partition gives running sums, the partitions' totals (one row each) give each
    partition's offset. A row belongs to the shard in which the middle of its bytes
    falls when the total is cut at equal targets, so a shard is off its target by at
    most half of a row at either end.

    Returns ``key``, ``size``, ``start`` (bytes before the row), ``shard``, ``slot`` (gapless
    from 0 within the shard, in key order) and the columns of ``carry``.

    Null keys come first, as one run. Rows with equal keys keep distinct slots; which one
    comes first is settled when they are written. A null size counts as 0. A row larger
    than a target fills its shard, and shards between may stay empty. No rows: no result rows.
    Other columns of ``rows`` are ignored, whatever their names.
    """
    carry = carry or {}
    listed = rows.select(
        F.col(key).alias("_key"), F.coalesce(size.cast("bigint"), F.lit(0)).alias("_size"),
        F.monotonically_increasing_id().alias("_tie"), *[c.alias(f"_c_{n}") for n, c in carry.items()])
    ranged = listed.repartitionByRange("_key", "_tie").sortWithinPartitions("_key", "_tie")
    table = staged(ranged.withColumn("_part", F.spark_partition_id()), "shard_rows")

    totals = table.groupBy("_part").agg(F.sum("_size").alias("_bytes"), F.count(F.lit(1)).alias("_rows"))
    before = W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)      # one row for each partition
    whole = W.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    offsets = totals.select(
        "_part", F.coalesce(F.sum("_bytes").over(before), F.lit(0)).alias("_byte0"),
        F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_row0"),
        F.sum("_bytes").over(whole).alias("_total"))

    within = W.partitionBy("_part").orderBy("_key", "_tie").rowsBetween(W.unboundedPreceding, W.currentRow)
    start = F.col("_byte0") + F.col("_sum") - F.col("_size")
    placed = (
        table.withColumns({"_sum": F.sum("_size").over(within), "_nth": F.count(F.lit(1)).over(within)})
        .join(F.broadcast(offsets), "_part")                              # as many rows as partitions
        .withColumns({"_start": start, "_row": F.col("_row0") + F.col("_nth") - 1})
        .withColumn("_shard", F.least(
            F.call_function("div", (F.col("_start") * 2 + F.col("_size")) * n_shards, F.greatest(F.col("_total") * 2, F.lit(1))),
            F.lit(n_shards - 1)).cast("int")))
    firsts = placed.groupBy("_shard").agg(F.min("_row").alias("_first"))   # at most n_shards rows
    return placed.join(F.broadcast(firsts), "_shard").select(
        F.col("_key").alias(key), F.col("_size").alias("size"), F.col("_start").alias("start"), F.col("_shard").alias("shard"),
        (F.col("_row") - F.col("_first")).alias("slot"), *[F.col(f"_c_{n}").alias(n) for n in carry])
