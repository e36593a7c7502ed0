"""Run outputs: writing, listing, picking the newest."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, SparkSession, functions as F

from ..fixed_values import ARTIFACT_KINDS, RUN_STAMP


def run_stamp(ts) -> object:
    """Stamp text of a run time column, as used in output names."""
    return F.date_format(ts, RUN_STAMP)


def write_table(df: DataFrame, path: str, partition_by: list[str] | None = None, fmt: str = "parquet") -> str:
    writer = df.write.mode("errorifexists").format(fmt)
    if fmt == "csv":
        writer = writer.option("header", True)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.save(path)
    return path


MANIFEST_SCHEMA = "prefix string, run string, kind string, format string, path string, n_rows bigint"


def record(df: DataFrame, folder: str, prefix: str, run: str, kind: str, fmt: str = "parquet") -> str:
    """Write a table as an output of a run and add its row to the folder's manifest.

    Rows are counted by the job that writes them. The manifest's row comes last: an output without one is unfinished.
    """
    counted = Observation()
    path = write_table(df.observe(counted, F.count(F.lit(1)).alias("n")), f"{folder}/{prefix}{run}", fmt=fmt)
    row = [(prefix, run, kind, fmt, path, counted.get["n"])]
    df.sparkSession.createDataFrame(row, MANIFEST_SCHEMA).coalesce(1).write.mode("append").parquet(f"{folder}/manifest")
    return path


def manifest(spark: SparkSession, folder: str) -> DataFrame:
    """Finished outputs below a folder, a row each; nothing is listed but the manifest itself."""
    return spark.read.schema(MANIFEST_SCHEMA).parquet(f"{folder}/manifest")


def output_catalog(outputs: DataFrame) -> DataFrame:
    """Outputs, their rows and the newest run by kind."""
    return outputs.groupBy("kind").agg(
        F.count(F.lit(1)).alias("outputs"), F.sum("n_rows").alias("n_rows"), F.max("run").alias("newest_run"))


def newest_output(outputs: DataFrame, prefix: str) -> DataFrame:
    """The output of a prefix's newest run; no row where there is none."""
    return outputs.where(F.col("prefix") == prefix).orderBy(F.desc("run")).limit(1)


def list_artifacts(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """Path, size and time of the files below a folder; contents are not read."""
    return (
        spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", True)
        .load(folder)
        .select("path", F.regexp_extract("path", r"([^/]+)$", 1).alias("name"), "length", "modificationTime")
    )


def artifact_catalog(files: DataFrame) -> DataFrame:
    """Files by kind of suffix (images, data, log); other suffixes are left out."""
    suffix = F.regexp_extract("name", r"(\.[A-Za-z0-9]+)$", 1)
    kind = F.lit(None).cast("string")
    for s, k in ARTIFACT_KINDS.items():
        kind = F.when(suffix == s, k).otherwise(kind)
    return files.withColumn("kind", kind).where(F.col("kind").isNotNull())


def catalog_totals(catalog: DataFrame) -> DataFrame:
    return catalog.groupBy("kind").agg(
        F.count(F.lit(1)).alias("files"), F.sum("length").alias("bytes"), F.max("modificationTime").alias("modified"))


def latest_run(files: DataFrame, prefix: str) -> DataFrame:
    """Newest output of a prefix, by the stamp in its path: copies lose file times."""
    stamp = F.regexp_extract("path", rf"{prefix}(\d{{8}}_\d{{6}})", 1)
    return files.withColumn("run_stamp", stamp).where(F.col("run_stamp") != "").groupBy("run_stamp").agg(
        F.count(F.lit(1)).alias("files"), F.sum("length").alias("bytes"), F.min("path").alias("first_path"),
    ).orderBy(F.desc("run_stamp")).limit(1)
