"""A corpus pipeline: language ID, line dedup, near-duplicate documents, decontamination, packing.

Each stage reads what its predecessor kept. All but the last return the columns of
``documents``; the last returns token pieces with their ids.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from flowwarden.llm import common, decontam, lines, packing, queries, simhash


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that is told with confidence. Texts without letters (null, empty) go."""
    return queries.identified(docs).where("accepted").select(*docs.columns)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents less the lines that came before, short ones too; ``n_chars`` counted anew; those that lose all go."""
    kept = lines.drop_repeated_lines(docs, exact_chars=1)
    kept = kept.where((F.col("n_removed") == 0) | (F.trim("text") != ""))
    n_chars = F.when(F.col("n_removed") > 0, F.char_length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))
    return kept.withColumn("n_chars", n_chars).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group the document with the smallest id; of several with that id, the one of smallest text hash.

    Documents are named by id and text. Rows without an id name no group: they stay, of equal texts one.
    """
    found = simhash.near_duplicates(docs, queries.SIMHASH_WORDS, queries.SIMHASH_BITS)
    first = found.where("doc_id = component_id").groupBy("doc_id", "component_id").agg(F.min("text_hash").alias("text_hash"))
    stay = first.unionByName(found.where("doc_id IS NULL").select(first.columns)).select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash"))
    rows = docs.select(F.struct("*").alias("_row"), F.col("doc_id").alias("_doc_id"), F.xxhash64(common.text_or_empty("text")).alias("_text_hash"))
    named = rows["_doc_id"].eqNullSafe(stay["_id"]) & (rows["_text_hash"] == stay["_hash"])
    kept = rows.join(stay, named, "left_semi").dropDuplicates(["_doc_id", "_text_hash"])
    return kept.select(*[F.col("_row")[c].alias(c) for c in docs.columns])


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item, in its own or in other words, numbers and units."""
    return decontam.clean(docs, queries.benchmark(spark, sf_dir)).select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces of what is left, in windows of 1024."""
    return packing.pack(docs, public_tokenizers.path(queries.TOKENIZER))


STAGES = [
    ("language_id", language_id), ("line_dedup", line_dedup), ("near_duplicates", near_duplicates),
    ("decontamination", decontamination), ("packing", pack)]
#: SQL has no tokenizer and no XXH64; tests hold the stages against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages; each is written, so none is computed again for those after it."""
    docs = queries.documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = common.staged(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
