"""Structured Streaming forms of detection, logging and counting."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming.query import StreamingQuery

from ..fixed_values import DEFAULT_THRESHOLD
from ..functions.scorecard import DEFAULT_SCORECARD
from ..operators.chain import SEGMENT_SPAN, append_flows, merged_heads, segment_heads
from ..operators.detect import alerts, detect
from ..sources.flows import flows_from_events


def read_event_stream(spark: SparkSession, folder: str, pattern: str = "events.parquet", files_per_batch: int = 64) -> DataFrame:
    """Flows from an append-only folder of event files."""
    schema = spark.read.option("pathGlobFilter", pattern).parquet(folder).schema
    events = (
        spark.readStream.schema(schema).option("pathGlobFilter", pattern)
        .option("maxFilesPerTrigger", files_per_batch).parquet(folder)
    )
    return flows_from_events(events)


def stream_alerts(flows: DataFrame, threshold: float = DEFAULT_THRESHOLD, scorer=DEFAULT_SCORECARD) -> DataFrame:
    """Score every arriving flow and pass alerts on; stateless, same code as the batch."""
    return alerts(detect(flows, threshold, scorer))


def run_chain(flows: DataFrame, log: str, heads: str, checkpoint: str, span: int = SEGMENT_SPAN, threshold: float = DEFAULT_THRESHOLD,
              scorer=DEFAULT_SCORECARD) -> StreamingQuery:
    """Score arriving flows and append their alerts to the chain of their segment, with the batch job's own code.

    Nothing is kept as operator state. Each micro-batch goes on from the table of segment heads that the batch before it
    left (one row for each segment), writes its blocks to ``log/batch_id=<n>`` and the new heads to
    one of two folders in turn. A batch that is done again after a failure reads the same heads and replaces its own
    output, so blocks are written exactly once; a restart goes on where the checkpoint stands. Blocks follow arrival:
    micro-batch first, flow id inside it; for input in id order the result is the batch chain.
    """
    def append(batch: DataFrame, batch_id: int) -> None:
        spark, path = batch.sparkSession, f"{log}/batch_id={batch_id}"
        before = spark.read.parquet(f"{heads}/slot={(batch_id - 1) % 2}") if batch_id else None
        append_flows(batch, span, before).write.mode("overwrite").parquet(path)
        now = segment_heads(spark.read.parquet(path))
        merged_heads(before, now).write.mode("overwrite").parquet(f"{heads}/slot={batch_id % 2}")

    return (
        detect(flows, threshold, scorer).writeStream.foreachBatch(append).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )


def stream_severity(flows: DataFrame, window: str = "1 day", lateness: str = "1 hour",
                    threshold: float = DEFAULT_THRESHOLD, scorer=DEFAULT_SCORECARD) -> DataFrame:
    """Running counts per window and severity level (0 = normal)."""
    timed = flows.withColumn("ts", _utc_instant(flows, "ts")).withWatermark("ts", lateness)
    counts = detect(timed, threshold, scorer).groupBy(F.window("ts", window), "severity_level").agg(
        F.count(F.lit(1)).alias("n"))
    start = F.convert_timezone(F.current_timezone(), F.lit("UTC"), F.col("window.start").cast("timestamp_ntz"))
    return counts.select(start.alias("window_start"), "severity_level", "n")


def _utc_instant(df: DataFrame, name: str):
    """Event time for a watermark; a time without zone is read as UTC, whatever the session's zone."""
    if df.schema[name].dataType.typeName() != "timestamp_ntz":
        return F.col(name)
    return F.convert_timezone(F.lit("UTC"), F.current_timezone(), F.col(name)).cast("timestamp")


def run_append(df: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Exactly-once append into parquet of everything now available."""
    return (
        df.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint)
        .outputMode("append").trigger(availableNow=True).start()
    )


def run_update(df: DataFrame, keys: list[str], path: str, checkpoint: str) -> StreamingQuery:
    """Keep the newest row of each key at ``path``; state behind the watermark is dropped, and rows later than that are not counted.

    A micro-batch hands on changed rows only. They replace those of the table that the batch before left, in one of two
    folders in turn, so a batch done again gives the same table and no folders pile up. How many
    rows came too late stands in the query's progress (``late_rows``).
    """
    def merge(batch: DataFrame, batch_id: int) -> None:
        changed = batch.withColumn("batch_id", F.lit(batch_id).cast("bigint"))
        if batch_id:
            before = batch.sparkSession.read.parquet(f"{path}/slot={(batch_id - 1) % 2}")
            changed = changed.unionByName(before.join(batch.select(*keys), keys, "left_anti").withColumn("batch_id", F.lit(batch_id).cast("bigint")))
        changed.write.mode("overwrite").parquet(f"{path}/slot={batch_id % 2}")

    return (
        df.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint)
        .outputMode("update").trigger(availableNow=True).start()
    )


def late_rows(query: StreamingQuery) -> int:
    """Input rows of the reported batches that came behind the watermark and were left out."""
    return sum(s["numRowsDroppedByWatermark"] for p in query.recentProgress for s in p["stateOperators"])


def newest_result(spark: SparkSession, path: str) -> DataFrame:
    """The table left by the last batch of ``run_update``."""
    table = spark.read.parquet(path)
    last = table.agg(F.max("batch_id")).scalar()
    return table.where(F.col("batch_id") == last).drop("batch_id", "slot")
