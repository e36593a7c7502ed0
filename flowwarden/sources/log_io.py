"""Threat log files: JSON documents and JSON lines."""

from __future__ import annotations

import hashlib
import json
import re

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F, types as T

from ..fixed_values import GENESIS_MESSAGE, GENESIS_SYSTEM, LOG_PREFIX
from ..operators.chain import log_summary, timed, verify_chain
from ..schema import LOG_BLOCK_SCHEMA, LOG_DATA_SCHEMA, LOG_DOCUMENT_SCHEMA
from ..session import ship_functions

ship_functions(__name__)


def log_documents(log: DataFrame, stamp: str) -> DataFrame:
    """One JSON document per segment: info header and ordered blocks.

    A segment has a bounded number of blocks, so a document is bounded too; its blocks are
    in the published layout, with their own times. ``stamp`` is the export time, given by the caller.
    """
    log = timed(log)
    data = F.struct(*[_log_field(f.name) for f in LOG_DATA_SCHEMA.fields])
    block = F.struct(
        F.col("block_index").cast("bigint").alias("index"), "timestamp", data.alias("data"),
        "previous_hash", "hash")
    return log.groupBy("segment").agg(
        F.struct(
            F.count(F.lit(1)).alias("total_blocks"), (F.count(F.lit(1)) - 1).alias("total_intrusions"),
            F.lit(stamp).alias("export_timestamp"), F.lit(True).alias("is_valid")).alias("info"),
        F.sort_array(F.collect_list(block)).alias("blocks"),
    ).select("segment", "info", "blocks")


def _log_field(name: str):
    genesis = F.col("block_index") == 0
    special = {
        "message": F.when(genesis, F.lit(GENESIS_MESSAGE)),
        "system": F.when(genesis, F.lit(GENESIS_SYSTEM)),
        "severity_level": F.col("severity_level").cast("bigint"),
        "blockchain_timestamp": F.when(~genesis, F.col("timestamp")),
        "block_index": F.when(~genesis, F.col("block_index").cast("bigint")),
    }
    return (special.get(name, F.col(name))).alias(name)


def export_log(log: DataFrame, folder: str, run_stamp: str, exported_at: str) -> str:
    """Write the log below ``folder`` as JSON lines, one document per segment and line.

    Validity in the header is that of the segment as verified at export.
    """
    path = f"{folder}/{LOG_PREFIX}{run_stamp}"
    _verified_documents(log, exported_at).write.mode("errorifexists").json(path)
    return path


def _verified_documents(log: DataFrame, exported_at: str) -> DataFrame:
    docs = log_documents(log, exported_at).join(verify_chain(log).select("segment", "is_valid"), "segment")
    info = F.struct(
        "info.total_blocks", "info.total_intrusions", "info.export_timestamp", F.col("is_valid").alias("is_valid"))
    return docs.select("segment", info.alias("blockchain_info"), "blocks")


def export_info(log: DataFrame) -> DataFrame:
    return log_summary(log)


def read_log_documents(spark: SparkSession, path: str) -> DataFrame:
    """Exported documents, one in each line."""
    schema = T.StructType(LOG_DOCUMENT_SCHEMA.fields + [T.StructField("segment", T.LongType())])
    return spark.read.schema(schema).json(path)


def _log_columns() -> list:
    """Columns of the log from a block ``b``."""
    return [
        F.col("b.index").cast("int").alias("block_index"), F.col("b.timestamp").alias("timestamp"),
        "b.data.sample_index", "b.data.intrusion_probability",
        F.col("b.data.severity_level").cast("int").alias("severity_level"), "b.data.severity_name",
        "b.data.priority", "b.data.action_summary", "b.data.immediate_actions", "b.data.monitoring_actions",
        "b.data.network_features", "b.previous_hash", "b.hash"]


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """Exported blocks as a log table again; each document is a segment of its own."""
    return read_log_documents(spark, path).select("segment", F.explode("blocks").alias("b")).select("segment", *_log_columns())


@F.pandas_udf(T.StringType())
def _document_hash(blocks: pd.Series) -> pd.Series:
    """SHA-256 over the sorted-key JSON text of a block's four hashed fields."""
    def one(text):
        b, _ = json.JSONDecoder().raw_decode(text)
        body = {k: b.get(k) for k in ("index", "timestamp", "data", "previous_hash")}
        return hashlib.sha256(json.dumps(body, sort_keys=True).encode()).hexdigest()
    return blocks.map(one)


@F.pandas_udf(T.StringType())
def _indented(texts: pd.Series) -> pd.Series:
    return texts.map(lambda text: json.dumps(json.loads(text), indent=2))


def export_documents(log: DataFrame, folder: str, run_stamp: str, exported_at: str) -> str:
    """Write the log as one indented JSON document per file and segment, as the published export has it.

    A segment's blocks are bounded, so a file is; it is put together in the JVM. Fields that a block does not have are left out.
    """
    docs = _verified_documents(log, exported_at)
    parts = F.concat(F.array(F.to_json("blockchain_info")), F.transform("blocks", lambda b: F.to_json(b)))
    # Python indents a header or a block at a time: batches of whole documents would outgrow a worker
    texts = docs.select("segment", F.posexplode(parts).alias("at", "text")).withColumn("text", _indented("text"))
    inner = F.replace("text", F.lit("\n"), F.when(F.col("at") == 0, "\n  ").otherwise("\n    "))
    done = texts.groupBy("segment").agg(F.sort_array(F.collect_list(F.struct("at", inner.alias("text")))).alias("parts"))
    blocks = F.array_join(F.transform(F.slice("parts", 2, F.size("parts")), lambda p: p["text"]), ",\n    ")
    text = F.concat(
        F.lit('{\n  "blockchain_info": '), F.col("parts")[0]["text"], F.lit(',\n  "blocks": [\n    '), blocks, F.lit("\n  ]\n}"))
    path = f"{folder}/{LOG_PREFIX}{run_stamp}_documents"
    done.select("segment", text.alias("value")).write.mode("errorifexists").partitionBy("segment").text(path)
    return path


def split_documents(spark: SparkSession, path: str) -> DataFrame:
    """The blocks of logs kept as one JSON document per file: ``file``, ``raw`` JSON text.

    A large document is read by many tasks: the text is cut where a block begins, which is told by the line of an opening
    brace at a block's indentation, or in a document without line breaks by a brace and the block's first key. Neither
    can stand inside a text value, where line breaks and quotes are escaped. All files of a folder share one layout; a file of another
    one ends the job. ``raw`` may end in the comma or brackets that follow a block; JSON readers stop before them.
    """
    reader = lambda cut: spark.read.option("recursiveFileLookup", True).option("lineSep", cut).text(path)
    first = reader('"blocks"').first()                                    # the text before the blocks, a few hundred bytes
    indent = re.match(r"\s*\{\r?\n( +)", first["value"]) if first else None
    begin = "\n" + 2 * indent[1] + "{\n" if indent else '{"index":'
    pieces = reader(begin).select(F.input_file_name().alias("file"), "value")
    head = F.col("value").rlike(r'^\s*\{\s*"')                            # a document's own start
    before = F.col("value").rlike(r'"blocks"\s*:\s*\[\s*(\][\s\S]*)?$')  # ends where its blocks begin, or has none
    wrong = F.raise_error(F.concat(F.lit("log documents of another layout: "), "file")).cast("boolean")
    return pieces.where(F.when(head, F.when(before, False).otherwise(wrong)).otherwise(True)).select(
        "file", F.concat(F.lit(begin.strip("\n ") + ("\n" if indent else "")), "value").alias("raw"))


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """Logs of one JSON document per file as a log table; the segment is that of the file's folder, or the file's hash."""
    folder = F.regexp_extract("file", r"/segment=(-?\d+)/", 1)
    blocks = split_documents(spark, path).select("file", F.from_json("raw", LOG_BLOCK_SCHEMA).alias("b"))
    segment = F.when(folder != "", folder.cast("bigint")).otherwise(F.xxhash64("file"))
    return blocks.select(segment.alias("segment"), *_log_columns())


def verify_documents(spark: SparkSession, path: str) -> DataFrame:
    """Check logs kept as one JSON document per file, each block hashed over its JSON text.

    Per file: blocks, alerts and validity. Files are read split between blocks; hashes are recomputed row by row, and
    the link to the predecessor is a window inside the file. The genesis block
    is not rehashed, as those files define it.
    """
    keyed = split_documents(spark, path).withColumn("b", F.from_json("raw", LOG_BLOCK_SCHEMA)).select(
        "file", "b.index", "b.hash", "b.previous_hash", _document_hash("raw").alias("own"))
    prev = F.lag("hash").over(W.partitionBy("file").orderBy("index"))
    ok = (F.col("index") == 0) | ((F.col("own") == F.col("hash")) & (F.col("previous_hash") == prev))
    return keyed.withColumn("ok", F.coalesce(ok, F.lit(False))).groupBy("file").agg(
        F.count(F.lit(1)).alias("blocks"), (F.count(F.lit(1)) - 1).alias("alerts"), F.bool_and("ok").alias("is_valid"))
