"""Line deduplication within one edit by a deletion-neighbourhood join."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..session import ship_functions
from .common import arrow_batches, hash_map, maybe_mapped, staged, text_or_empty

ship_functions(__name__)

_SALTS = (29, 1_000_033)
_BASE = 0x9E3779B97F4A7C15                              # odd, so it has an inverse among 64-bit numbers
_INVERSE = pow(_BASE, -1, 1 << 64)
_VARIANT = T.StructType([
    T.StructField("_h0", T.LongType()), T.StructField("_h1", T.LongType()), T.StructField("_variant", T.LongType()),
    T.StructField("_side", T.IntegerType())])


def _halves(line: Column) -> Column:
    """Hashes of four halves: head and tail of the line's length n, and as they are in a line of n - 1.

    Of two lines one edit apart, the edit lies in the first or second half of the
    shorter, so they share the other half.
    """
    n = F.char_length(line)

    def of(length: Column) -> list[Column]:
        half = F.call_function("div", length, F.lit(2)).cast("int")
        return [F.xxhash64(F.lit(0), length, F.left(line, half)), F.xxhash64(F.lit(1), length, F.right(line, length - half))]

    return F.array(*of(n), *of(n - 1))


def _deletions(line: str, halves: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Hashed variants of a line, for each half (its number in ``_halves``) that another line shares.

    Side 0: one character gone, its place kept: equal variants are a substitution apart.
    Side 1: the whole line, side 2: one character gone: equal variants are an insertion apart.
    Rolling sums give each variant's hash in constant time.
    """
    codes = np.frombuffer(line.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    n = len(codes)
    with np.errstate(over="ignore"):
        powers, sums = np.full(n, _BASE, np.uint64), np.zeros(n + 1, np.uint64)
        powers[:1] = 1
        np.cumsum((codes + np.uint64(7)) * np.cumprod(powers), out=sums[1:])
        gone = sums[:-1] + (sums[-1] - sums[1:]) * np.uint64(_INVERSE)          # without character i
        place = np.arange(n, dtype=np.uint64)
        mix = lambda h, half, length, side, at=np.uint64(0): (
            (h ^ (h >> np.uint64(31))) * np.uint64(0xD6E8FEB86659FD93) + at * np.uint64(0xC2B2AE3D27D4EB4F)
            + np.uint64(length * 16 + half * 4 + side) * np.uint64(0x165667B19E3779F9))
        keys, sides = [], []
        for half in halves:
            length = n if half < 2 else n - 1
            cut = length // 2
            span = slice(cut, n) if half % 2 == 0 else slice(0, cut + (half > 1))
            if half < 2:
                keys += [mix(gone[span], half, length, 0, place[span]), mix(sums[-1:], half, length, 1)]
                sides += [np.zeros(len(keys[-2]), np.int32), np.ones(1, np.int32)]
            else:
                keys.append(mix(gone[span], half - 2, length, 1))
                sides.append(np.full(len(keys[-1]), 2, np.int32))
    return np.concatenate(keys).view(np.int64), np.concatenate(sides)


def _variant_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for h0, h1, line, halves in zip(*[batch.column(c).to_pylist() for c in range(4)]):
            keys, sides = _deletions(line, halves)
            for i in range(0, len(keys), 1 << 16):
                k, s = keys[i:i + (1 << 16)], sides[i:i + (1 << 16)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(k), h0)), pa.array(np.full(len(k), h1)), pa.array(k), pa.array(s)], names=_VARIANT.names)


def _named(docs: DataFrame, key: str, text: str) -> DataFrame:
    """Documents as ``_doc`` (key and hash of the text) with the text."""
    plain = text_or_empty(text)
    return docs.select(F.struct(F.col(key).alias("key"), F.xxhash64(plain).alias("text")).alias("_doc"), plain.alias("_text"))


def _lines(named: DataFrame, min_chars: int) -> DataFrame:
    """``_doc, _no, _line`` and the line's 128-bit hash, of all lines that take part."""
    split = named.select("_doc", F.posexplode(F.split("_text", "\n", -1)).alias("_no", "_line")).where(F.char_length("_line") >= max(min_chars, 1))
    return split.withColumns({f"_h{i}": F.xxhash64(F.lit(s), "_line") for i, s in enumerate(_SALTS)})


def repeated_lines(
    docs: DataFrame, key: str = "doc_id", text: str = "text", min_chars: int = 10, exact_chars: int = 1,
) -> DataFrame:
    """``_doc``, ``_removed``: for each document that loses lines, their numbers from 0.

    A line goes if an earlier line (smaller key, or same document and smaller number) of the
    input is equal or one character edit away, whether or not that earlier line stays. Lines of
    ``exact_chars`` to ``min_chars`` characters go only if an earlier line is equal.
    """
    spark = docs.sparkSession
    arrow_batches(spark)
    lines = _lines(_named(docs, key, text), min(exact_chars, min_chars))
    at = F.struct("_doc", "_no")
    hashed = lines.select("_h0", "_h1", at.alias("_at"), F.when(F.char_length("_line") >= min_chars, _halves(F.col("_line"))).alias("_half"))
    firsts = staged(hashed.groupBy("_h0", "_h1").agg(
        F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_times"), F.min("_half").alias("_half")), "first_lines")

    # lines that share a half with another line; every other line has no neighbour
    halves = firsts.select("_h0", "_h1", F.posexplode("_half").alias("_which", "_half"))
    shared = halves.groupBy("_half").count().where("count > 1").select("_half")
    wanted = halves.join(shared, "_half", "left_semi").groupBy("_h0", "_h1").agg(F.array_sort(F.collect_list("_which")).alias("_which"))
    spots = staged(firsts.select("_h0", "_h1", "_first").join(wanted, ["_h0", "_h1"]), "line_spots")
    there = maybe_mapped(lines.select(at.alias("_first"), "_h0", "_h1", "_line"), "_h0", hash_map(spots.select("_h0")))
    texts = there.join(spots, ["_h0", "_h1", "_first"]).dropDuplicates(["_h0", "_h1"])
    texts = staged(texts.select("_h0", "_h1", "_line", "_which", "_first"), "near_lines")

    # variants that several lines share; all others end here, before anything else joins them
    every = texts.select("_h0", "_h1", "_line", "_which").mapInArrow(_variant_rows, _VARIANT)
    common = every.groupBy("_variant").count().where("count > 1").select("_variant")
    variants = every.join(common, "_variant", "left_semi").join(texts.select("_h0", "_h1", "_first"), ["_h0", "_h1"])
    variants = staged(variants, "line_variants")
    # of equal variants the earliest on either side is enough, so no pairs within a group
    line = F.struct("_first", "_h0", "_h1")
    best = variants.groupBy("_variant").agg(*[F.min(F.when(F.col("_side") == s, line)).alias(f"_best{s}") for s in range(3)])
    other = F.when(F.col("_side") == 0, F.col("_best0")).when(F.col("_side") == 1, F.col("_best2")).otherwise(F.col("_best1"))
    claims = (
        variants.join(best, "_variant").withColumn("_other", other).where(F.col("_other._first") < F.col("_first"))
        .groupBy("_h0", "_h1").agg(F.min("_other").alias("_other")))
    theirs = texts.select(F.col("_h0").alias("_o0"), F.col("_h1").alias("_o1"), F.col("_line").alias("_their_line"))
    near = (
        claims.select("_h0", "_h1", F.col("_other._h0").alias("_o0"), F.col("_other._h1").alias("_o1"))
        .join(theirs, ["_o0", "_o1"]).join(texts.select("_h0", "_h1", "_line"), ["_h0", "_h1"])
        .where(F.levenshtein("_line", "_their_line", 1) >= 0).select("_h0", "_h1", F.lit(True).alias("_near")))

    # written, so that the join below shuffles both sides and Spark can split the places of a common line
    decided = firsts.select("_h0", "_h1", "_first", "_times").join(near, ["_h0", "_h1"], "left").where("_times > 1 or _near")
    decided = staged(decided, "line_decisions")
    places = lines.select("_doc", "_no", "_h0", "_h1").join(decided, ["_h0", "_h1"])
    gone = places.where(F.col("_near") | (F.struct("_doc", "_no") != F.col("_first")))
    return gone.groupBy("_doc").agg(F.collect_set("_no").alias("_removed"))


def drop_repeated_lines(
    docs: DataFrame, key: str = "doc_id", text: str = "text", min_chars: int = 10, exact_chars: int = 1,
) -> DataFrame:
    """All rows and columns of ``docs`` with ``text`` less its repeated lines, and ``n_lines``, ``n_removed``.

    Lines are cut at line feeds; a line shorter than ``min_chars`` characters, one edit in which makes another word, goes
    only if an earlier line is equal (and it has ``exact_chars`` at least: all but empty lines). Empty lines always stay.
    Rows with the same key and the same text are one document and come back as often as
    they came. Null keys come first in the order. Null texts stay null (one line, none
    removed), empty ones empty; a text whose lines all go becomes empty. No rows, no result.
    Columns with clashing names are carried along (``n_lines``, ``n_removed`` are replaced).
    """
    gone = repeated_lines(docs, key, text, min_chars, exact_chars)
    rows = docs.select(F.struct("*").alias("_row"))
    plain = F.coalesce(F.col(f"_row.{text}").cast("string"), F.lit(""))
    rows = rows.withColumn("_name", F.struct(F.col(f"_row.{key}").alias("key"), F.xxhash64(plain).alias("text")))
    joined = rows.join(gone, rows["_name"].eqNullSafe(gone["_doc"]), "left").withColumn("_all", F.split(plain, "\n", -1))
    stays = F.array_except(F.sequence(F.lit(0), F.size("_all") - 1), "_removed")
    kept = F.array_join(F.transform(stays, lambda i: F.get("_all", i)), "\n")
    text_now = F.when(F.col("_removed").isNull(), F.col(f"_row.{text}")).otherwise(kept)
    return joined.select(
        *[(text_now if c == text else F.col("_row")[c]).alias(c) for c in docs.columns if c not in ("n_lines", "n_removed")],
        F.size("_all").alias("n_lines"), F.coalesce(F.size("_removed"), F.lit(0)).alias("n_removed"))
