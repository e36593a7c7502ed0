"""Flow tables: CSV files, and views over the event tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from ..fixed_values import NORMAL_LABEL
from ..schema import FLOW_SCHEMA, OPTIONAL_FIELDS


def read_flow_csv(spark: SparkSession, path: str) -> DataFrame:
    """Read flow CSV with a header, typed by column name.

    Spark binds a given schema by position, so the header line is looked at first;
    columns of unknown name stay text. All files of a folder share one header.
    """
    reader = spark.read.option("pathGlobFilter", "*.csv")
    header = reader.option("header", True).csv(path).columns     # header line only
    known = {f.name: f.dataType for f in FLOW_SCHEMA.fields} | OPTIONAL_FIELDS
    schema = T.StructType([T.StructField(c, known.get(c, T.StringType())) for c in header])
    return (
        spark.read.option("pathGlobFilter", "*.csv").option("header", True)
        .option("enforceSchema", False).schema(schema).csv(path)
    )


def check_input(path: str) -> str:
    """Only ``.csv`` uploads are taken."""
    if not path.lower().endswith(".csv"):
        raise ValueError(f"not a CSV file: {path}")
    return path


def input_profile(df: DataFrame) -> DataFrame:
    """Row and column counts of an input, one row."""
    return df.agg(F.count(F.lit(1)).alias("n_rows")).withColumn(
        "n_columns", F.lit(len(df.columns)).cast("bigint"))


def with_row_position(df: DataFrame) -> DataFrame:
    """Add ``flow_id`` = position of the row in the input, without moving any row.

    Put it right on top of a file scan: partition sizes are counted once (one row per
    partition) and turned into offsets. Files are scanned in Spark's split order.
    """
    tagged = df.withColumn("_part", F.spark_partition_id()).withColumn(
        "_at", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)))
    sizes = {r["_part"]: r["n"] for r in tagged.groupBy("_part").agg(F.count(F.lit(1)).alias("n")).collect()}
    offsets, seen = {}, 0
    for part in sorted(sizes):
        offsets[part] = seen
        seen += sizes[part]
    table = df.sparkSession.createDataFrame(
        sorted(offsets.items()) or [(0, 0)], "_part int, _before bigint")
    return (
        tagged.join(F.broadcast(table), "_part")
        .withColumn("flow_id", F.col("_before") + F.col("_at"))
        .drop("_part", "_at", "_before")
    )


def load_flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ``flows`` view over the events table."""
    return flows_from_events(spread(spark.read.parquet(f"{sf_dir}/events.parquet"), "event_id"))


def spread(df: DataFrame, key: str) -> DataFrame:
    """Use all cores on an input with fewer splits than cores (a single small file).

    An input that already has enough splits, as any large one does, is left where it is.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores, key)


def flows_from_events(events: DataFrame) -> DataFrame:
    """Derive flow records from events; eleven features, a label and a difficulty."""
    # json_tuple parses each text once; an expression would be copied into pushed filters
    events = events.select("*", F.json_tuple("props", "k").alias("_k"))
    k, eid = F.col("_k").cast("bigint"), F.col("event_id")

    def squared(step: int, size: int, div: float):
        a = ((eid * step) % size).cast("double")
        return F.floor(a * a / F.lit(div)).cast("bigint")

    def pick(key, options):
        out = F.when(key == options[0][0], options[0][1])
        for value, name in options[1:]:
            out = out.when(key == value, name)
        return out

    kd = k.cast("double")
    return events.select(
        eid.alias("flow_id"), "ts", F.col("user_id").alias("src_id"),
        (k * 20).alias("duration"),
        pick(eid % 3, [(0, "tcp"), (1, "udp"), (2, "icmp")]).alias("protocol_type"),
        pick(F.col("event_type"), [("view", "http"), ("click", "smtp"), ("signup", "ftp"),
                                   ("purchase", "eco_i"), ("error", "domain_u")]).alias("service"),
        pick(k % 5, [(0, "SF"), (1, "S0"), (2, "REJ"), (3, "RSTO"), (4, "RSTR")]).alias("flag"),
        F.floor(F.col("value") * F.col("value") * F.lit(4.0)).cast("bigint").alias("src_bytes"),
        ((eid * 17) % 5000).alias("dst_bytes"),
        squared(7, 400, 400.0).alias("count"),
        squared(11, 60, 120.0).alias("srv_count"),
        (kd * kd / F.lit(10000.0)).alias("serror_rate"),
        F.when(eid % 9 < 6, F.lit(0).cast("bigint")).otherwise(eid % 8).alias("num_failed_logins"),
        squared(13, 256, 256.0).alias("dst_host_count"),
        F.when(F.col("event_type") == "error", "neptune")
        .when((F.col("event_type") == "signup") & (eid % 10 == 0), "guess_passwd")
        .otherwise(NORMAL_LABEL).alias("class"),
        (eid % 22).alias("difficulty"),
    )


def load_raw_flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flows before cleaning: no id, some rows twice, some values missing."""
    flows = load_flows(spark, sf_dir)
    dirty = flows.withColumn("dst_bytes", F.when(F.col("flow_id") % 50 != 0, F.col("dst_bytes")))
    times = F.when(F.col("flow_id") % 20 == 0, 2).otherwise(1)
    return (
        dirty.withColumn("_copy", F.explode(F.sequence(F.lit(1), times)))
        .drop("_copy", "flow_id", "ts", "src_id")
    )
