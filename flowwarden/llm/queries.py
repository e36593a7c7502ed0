"""One registered query for each operator; each takes (spark, sf_dir) and reads whole tables."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from . import chat, decontam, language, lines, lloyd, packing, periodic, quality, rules, sharding, simhash, suffix, winnow
from .common import text_or_empty

N_SHARDS = 40
QUALITY_THRESHOLD = 0.3
KEEP_POSTERIOR = 0.5
SIMHASH_WORDS, SIMHASH_BITS = 4, 4
N_CLUSTERS, LLOYD_ROUNDS = 40, 5
TOKENIZER = "byte_bpe_50k.json"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def benchmark(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/benchmark.parquet")


def op1_fingerprints(spark, sf_dir):
    return winnow.compared_with_edits(documents(spark, sf_dir), int(spark.conf.get("spark.sql.shuffle.partitions")))


def op2_decontamination(spark, sf_dir):
    return decontam.matches(documents(spark, sf_dir), benchmark(spark, sf_dir))


def op3_chat_format(spark, sf_dir):
    return chat.format_chats(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


def op4_line_dedup(spark, sf_dir):
    kept = lines.drop_repeated_lines(documents(spark, sf_dir))
    return kept.select("doc_id", "n_lines", "n_removed", F.sha2(text_or_empty("text"), 256).alias("kept_sha256"))


def identified(docs: DataFrame) -> DataFrame:
    """Documents declare a language and come from a source, which stands for the host; they have no address."""
    none = F.lit(None).cast("string")
    return language.identify(docs, language.train(docs), F.col("text"), F.col("lang"), F.col("source"), none)


def op5_language_id(spark, sf_dir):
    return identified(documents(spark, sf_dir)).select("doc_id", "lang", "language", "confidence", "text_language", "accepted")


def op6_suffix_dedup(spark, sf_dir):
    return suffix.remove_repeats(documents(spark, sf_dir)).select(
        "doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def page_languages(spark, sf_dir):
    """Pages by the model of the documents: markup, host and address suffix as they are declared."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    found = language.identify(
        pages, language.train(documents(spark, sf_dir)), language.markup_text("html"), language.markup_language("html"),
        language.address_host("url"), language.address_suffix("url"))
    return found.select("page_id", "language", "confidence", "text_language", "accepted")


def op7_sharding(spark, sf_dir):
    text = text_or_empty("text")
    rows = sharding.byte_shards(
        documents(spark, sf_dir), "doc_id", F.octet_length(text) + 16, N_SHARDS, {"text_crc32": F.crc32(F.encode(text, "UTF-8"))})
    return rows.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "start")


def op8_quality(spark, sf_dir):
    docs, labels = documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet")
    held_out = quality.fold() == 0
    model = quality.fit(docs, labels.where(~held_out))
    return quality.score(docs, model).select(
        "doc_id", held_out.alias("held_out"), "score", (F.col("score") >= QUALITY_THRESHOLD).cast("int").alias("predicted"))


def op9_simhash(spark, sf_dir):
    found = simhash.near_duplicates(documents(spark, sf_dir), SIMHASH_WORDS, SIMHASH_BITS)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id")


def op10_packing(spark, sf_dir):
    pieces = packing.pack(documents(spark, sf_dir), public_tokenizers.path(TOKENIZER))
    return pieces.select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "continued", "continues")


def op11_lloyd(spark, sf_dir):
    order = F.sha2(F.concat(F.lit("2:"), F.col("id").cast("string")), 256)
    assigned, centroids = lloyd.lloyd(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), N_CLUSTERS, LLOYD_ROUNDS, order)
    return lloyd.with_inertia(assigned, centroids).select(
        "vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def with_planted_period(docs: DataFrame) -> DataFrame:
    """``doc_id, text``: for one id in ten by CRC-32, words of the text are repeated from some word on."""
    words = F.filter(F.split(text_or_empty("text"), "[ \t-\r]+", -1), lambda w: w != "")
    rows = docs.select("doc_id", "text", F.crc32(F.col("doc_id").cast("string").cast("binary")).alias("_h"))
    rows = rows.withColumn("_words", F.when(F.col("_h") % 10 == 0, words))           # null for all others
    rows = rows.withColumns({"_n": F.size("_words"), "_g": F.expr("_h div 10")})
    rows = rows.withColumn("_a", F.expr("cast(_g % nullif(_n, 0) as int)")).withColumn("_p", F.expr("cast(1 + (_n - _a) div (3 + _g % 8) as int)"))
    repeated = F.expr("array_join(transform(sequence(0, _n - 1), i -> get(_words, if(i < _a, i, _a + (i - _a) % _p))), ' ')")
    return rows.select("doc_id", F.when(F.col("_n") > 0, repeated).otherwise(F.col("text")).alias("text"))


def op12_periodic_runs(spark, sf_dir):
    found = periodic.periodic_runs(with_planted_period(documents(spark, sf_dir)), F.col("text"))
    best = periodic.strongest(F.col("runs"))
    listed = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))), "")
    return found.withColumn("_best", best).select(
        "doc_id", F.size("runs").cast("bigint").alias("n_runs"), "_best.start", "_best.length", "_best.period",
        F.expr("1000 * _best.length div _best.period").alias("exponent_milli"),
        F.sha2(listed, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"), "n_words")


def op13_quality_rules(spark, sf_dir):
    judged, _ = rules.judged(documents(spark, sf_dir))
    failed = F.expr("n_words < 50 OR 100 * n_repeat_words > 50 * n_words")
    return judged.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"),
        (~failed & (F.col("posterior") >= KEEP_POSTERIOR)).alias("kept"))


REGISTRY = {f.__name__: f for f in (
    op1_fingerprints, op2_decontamination, op3_chat_format, op4_line_dedup, op5_language_id, op6_suffix_dedup, op7_sharding, op8_quality, op9_simhash, op10_packing,
    op11_lloyd, op12_periodic_runs, op13_quality_rules, page_languages)}
