"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..session import shared_folder

#: Bytes handed to a Python worker at once.
ARROW_BYTES = 4 << 20


def arrow_batches(spark: SparkSession, size: int = ARROW_BYTES) -> None:
    """Lower the bytes of an Arrow batch, so that a batch of long documents fits a worker's memory."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark.conf.get(key).rstrip("b")
    if not now.isdigit() or int(now) > size:
        spark.conf.set(key, str(size))


def staged(df: DataFrame, name: str, by: str | None = None) -> DataFrame:
    """Write ``df`` below the shared checkpoint folder and read it back: later jobs start from the files.

    Lost executors then cost no recomputation of what came before, and what
    depends on partitions or their order is settled once. With ``by``, each value of that
    column has a folder of its own, and readers of one value read no others.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}"
    writer = df.write.option("compression", "zstd")
    (writer.partitionBy(by) if by else writer).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """Jobs inside remove their shuffle files as they end, in place of when the driver next collects garbage."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, before)


#: Bits of a map of hashes: 1 MB, or 131,072 rows, whatever is mapped.
MAP_BITS = 1 << 23


def hash_map(hashes: DataFrame) -> DataFrame:
    """``word, bits``: a map of the bigints in the only column, with a bit set for each.

    A filter ahead of an exact join: it spares the join most rows that have no partner while
    few hashes are mapped, and nothing once the map is full.
    """
    (name,) = hashes.columns
    return hashes.groupBy(F.expr(f"cast(shiftright({name} & {MAP_BITS - 1}, 6) as int)").alias("word")).agg(
        F.expr(f"bit_or(shiftleft(1L, cast({name} & 63 as int)))").alias("bits"))


def maybe_mapped(df: DataFrame, column: str, words: DataFrame) -> DataFrame:
    """Rows of ``df`` whose hash may be in the map: all that are, and few others."""
    named = words.select(F.col("word").alias("_map_word"), F.col("bits").alias("_map_bits"))
    word, bit = (F.expr(x) for x in (f"cast(shiftright({column} & {MAP_BITS - 1}, 6) as int)", f"shiftright(_map_bits, cast({column} & 63 as int)) & 1"))
    return df.join(F.broadcast(named), word == F.col("_map_word")).where(bit != 0).drop("_map_word", "_map_bits")


def text_or_empty(column: str) -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit(""))
