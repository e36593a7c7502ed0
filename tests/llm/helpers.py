"""Small documents with everything that can go wrong, and the tables of a test folder."""

from __future__ import annotations

import os
import random

from pyspark.sql import types as T

SF = os.environ.get("FLOWWARDEN_TEST_DIR", "/root/testdata/sf0.001")

#: Documents and, after the dash, columns whose names operators use inside.
SCHEMA = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
    T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()),
    *[T.StructField(c, T.StringType()) for c in (
        "_text", "_key", "_doc", "hash", "gram", "doc", "at", "tie", "u", "v", "language", "size", "shard", "n_lines", "template",
        "_row", "_print", "bucket", "start", "count", "marks", "raw")]])
EXTRA = len(SCHEMA) - 5


def words(rng: random.Random, n: int, vocabulary: int = 400) -> str:
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


def nasty_texts() -> list[tuple[int | None, str | None]]:
    rng = random.Random(3)
    base, passage = words(rng, 120), words(rng, 60)
    long_ = "\n".join(words(rng, 12, 3000) for _ in range(2500))
    near = base.split()
    near[50] = "changed"
    rows: list[tuple[int | None, str | None]] = [
        (5, base), (9, base), (2, " ".join(near)), (7, None), (8, ""), (11, " \n\t "), (12, "x"), (13, "é"), (14, "日本語の文章です。" * 30),
        (15, f"{words(rng, 30)} {passage} {words(rng, 20)}"), (16, f"{words(rng, 10)} {passage}"), (17, "a" * 700), (18, "ab" * 260 + "\n" + "ab" * 200),
        (19, long_), (20, long_[:9000] + words(rng, 50)), (None, base), (None, None), (21, words(rng, 3)), (22, "🙂🙃 " * 80),
        (24, "same line that comes again\nanother line of this one\nsame line that comes again"),
        (23, "same line that comes again\nsame line that cones again\nthe last line is new"), (23, "same line that comes again\nsame line that cones again\nthe last line is new"),
        (25, "tail  \n\n\n"), (26, "\x0b\x0c one two　three\x1cfour"), (27, "<|endoftext|> a <|endoftext|>")]
    return rows


def table(spark, rows, lang="en", source="s"):
    return spark.createDataFrame([(i, t, lang, source, len(t or ""), *["clash"] * EXTRA) for i, t in rows], SCHEMA)


def nasty(spark):
    return table(spark, nasty_texts()).repartition(3)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def read(spark, name):
    return spark.read.parquet(f"{SF}/{name}.parquet")
