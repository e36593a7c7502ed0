"""Language identification: text likelihoods fused with declared language, address suffix and host priors."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..session import ship_functions
from .common import arrow_batches, staged, text_or_empty

ship_functions(__name__)

BUCKETS = 1 << 12
#: Languages learnt at most, those that most rows declare: the model is LANGUAGES x BUCKETS numbers. Other declared values, as
#: in a free-text column, are declarations of an unknown language.
LANGUAGES = 256
#: Hosts that are broadcast at most; more are joined by shuffle.
BROADCAST_HOSTS = 200_000

_LETTERS = np.full(256, 32, np.uint8)
_LETTERS[np.arange(65, 91)] = np.arange(97, 123)
_LETTERS[np.arange(97, 123)] = np.arange(97, 123)
_LETTERS[128:] = np.arange(128, 256)


def grams(text: str) -> np.ndarray:
    """Hashed byte trigrams of a text: letters in lower case, all else one blank."""
    b = _LETTERS[np.frombuffer(b" " + text.lower().encode("utf-8", "surrogatepass") + b" ", np.uint8)]
    b = b[np.concatenate([[True], (b[1:] != 32) | (b[:-1] != 32)])].astype(np.uint32)
    if len(b) < 3:
        return np.zeros(0, np.int64)
    code = (b[:-2] << np.uint32(16) | b[1:-1] << np.uint32(8) | b[2:])[b[1:-1] != 32]
    return (code * np.uint32(2654435761) >> np.uint32(20)).astype(np.int64)


_COUNTS = T.StructType([T.StructField("language", T.StringType()), T.StructField("bucket", T.IntegerType()), T.StructField("n", T.LongType())])


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: dict[str, np.ndarray] = {}
    for batch in batches:
        for language, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if language not in counts:
                counts[language] = np.zeros(BUCKETS, np.int64)
            counts[language] += np.bincount(grams(text), minlength=BUCKETS)
    for language, n in counts.items():
        at = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays(
            [pa.array([language] * len(at), pa.string()), pa.array(at.astype(np.int32)), pa.array(n[at])], names=_COUNTS.names)


@dataclass
class Model:
    """``log_p[language, bucket]`` of trigrams, smoothed; ``frequency`` of declared languages among rows."""

    languages: list[str]
    log_p: np.ndarray
    frequency: np.ndarray


def train(docs: DataFrame, text: str = "text", declared: str = "lang", smoothing: float = 0.5) -> Model:
    """Trigram likelihoods of each declared language, counted over all rows that declare one.

    The ``LANGUAGES`` most declared ones are learnt (ties: by name); the driver receives at most ``LANGUAGES`` x ``BUCKETS``
    sums. Rows with null texts or languages are passed over; with no rows there are no languages.
    """
    arrow_batches(docs.sparkSession)
    known = docs.select(F.col(declared).cast("string").alias("language"), F.col(text).cast("string").alias("text")).na.drop()
    most = known.groupBy("language").count().orderBy(F.desc("count"), "language").limit(LANGUAGES)
    rows = {r["language"]: r["count"] for r in most.collect()}
    languages = sorted(rows)
    learnt = known.where(F.col("language").isin(languages))
    sums = learnt.mapInArrow(_count, _COUNTS).groupBy("language", "bucket").agg(F.sum("n").alias("n")).toPandas()
    n = np.full((len(languages), BUCKETS), smoothing)
    if len(sums):
        np.add.at(n, (sums["language"].map(languages.index).to_numpy(), sums["bucket"].to_numpy()), sums["n"].to_numpy())
    total = max(sum(rows.values()), 1)
    return Model(languages, np.log(n / n.sum(1, keepdims=True)), np.array([rows[x] / total for x in languages]))


def _softmax(x: Column) -> Column:
    top = F.array_max(x)
    e = F.transform(x, lambda v: F.exp(v - top))
    return F.transform(e, lambda v: v / F.aggregate(e, F.lit(0.0), lambda a, b: a + b))


def _plus(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x + y)


def identify(
    rows: DataFrame, model: Model, text: Column, declared: Column, host: Column, suffix: Column,
    trust: float = 0.9, strength: float = 20.0, evidence: float = 64.0, min_confidence: float = 0.5, accept: list[str] | None = None,
    unknown: float = 0.01,
) -> DataFrame:
    """Add ``language, confidence, text_language, accepted`` to ``rows`` (columns of these names are replaced).

    For each language l the log posterior is the sum of

    * the text's mean log likelihood per trigram, times n * evidence / (n + evidence) of its n
      trigrams (they are not independent, so long texts must not drown all else);
    * the declaration: ``trust`` for the declared language, the rest shared by the others;
    * the host's prior: soft counts of text and declaration over all rows of the host, without
      the row itself, smoothed with ``strength`` pseudo-counts by those of the address suffix, and
      these likewise by those of all rows.

    ``accepted``: the text has letters, the best language's posterior is at least ``min_confidence``,
    it or an even mixture of all languages (pages quote others) is at least as likely as an unknown
    language and, where ``accept`` lists languages, it is one of them. Of an unknown language all
    trigrams are equally likely, its prior is ``unknown``, and a known declaration speaks against it
    as against any other language. So gibberish and languages that no row declares are rejected,
    unless they share most trigrams with the declared ones, or rows to learn from are very few. The
    unknown language has no part in ``confidence``, which the declared languages share.

    Null or empty texts and texts without letters give no text evidence: ``text_language`` is null
    and they are not accepted. Null or unknown declarations give none, null hosts and suffixes
    are one host or suffix of their own. Ties go to the first language by name. Repeated rows
    are judged one by one. Without languages in the model every language is null. Texts are
    read whole. Host counts are grouped sums; they are broadcast only if at most ``BROADCAST_HOSTS``.
    """
    arrow_batches(rows.sparkSession)
    names, k = model.languages, len(model.languages)
    mixed = np.log(np.exp(model.log_p).mean(0, keepdims=True)) if k else model.log_p
    over_flat = np.vstack([model.log_p, mixed]) + np.log(BUCKETS)                    # against an unknown language, which then has 0
    own = ["language", "confidence", "text_language", "accepted"]
    columns = [c for c in rows.columns if c not in own]
    if not k:
        nothing = [F.lit(None).cast(t).alias(c) for c, t in zip(own[:3], ("string", "double", "string"))]
        return rows.select(*columns, *nothing, F.lit(False).alias("accepted"))

    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def likelihoods(texts: pd.Series) -> pd.Series:
        def one(t: str):
            g = grams(t)
            if not len(g):
                return None
            return (over_flat @ np.bincount(g, minlength=BUCKETS)) * (evidence / (len(g) + evidence))
        return texts.map(one)

    is_known, against = declared.cast("string").isin(names), float(np.log((1 - trust) / max(k - 1, 1)))
    given = F.array(*[
        F.when(is_known, F.when(declared.cast("string") == x, float(np.log(trust))).otherwise(against)).otherwise(0.0) for x in names])
    of_unknown = F.when(is_known, against).otherwise(0.0) + float(np.log(unknown))
    flat = F.array(*[F.lit(0.0)] * k)
    base = F.array(*[F.lit(float(np.log(x))) for x in model.frequency])
    seen = rows.select(
        F.struct(*columns).alias("_row"), likelihoods(F.coalesce(text.cast("string"), F.lit(""))).alias("_text"), given.alias("_given"), of_unknown.alias("_unknown"),
        F.coalesce(host.cast("string"), F.lit("\0")).alias("_host"), F.coalesce(suffix.cast("string"), F.lit("\0")).alias("_suffix"))
    seen = seen.withColumns({"_mixed": F.get("_text", k), "_text": F.slice("_text", 1, k)})
    local = F.coalesce("_text", flat)
    soft = _softmax(_plus(_plus(local, F.col("_given")), base))
    seen = seen.withColumn("_soft", soft)

    sums = [F.sum(F.get("_soft", i)).alias(f"_s{i}") for i in range(k)]
    by_host = staged(seen.select("_suffix", "_host", "_soft").groupBy("_suffix", "_host").agg(*sums), "host_counts")
    totals = lambda cols: F.array(*[F.sum(c) for c in cols])
    cells = [f"_s{i}" for i in range(k)]
    by_suffix = by_host.groupBy("_suffix").agg(totals(cells).alias("_of_suffix"))
    overall = by_host.agg(totals(cells).alias("_of_all"))                            # one row
    priors = by_host.join(by_suffix, "_suffix").crossJoin(F.broadcast(overall)).select(
        "_suffix", "_host", F.array(*cells).alias("_of_host"), "_of_suffix", "_of_all")
    priors = staged(priors, "host_priors")
    if priors.count() <= BROADCAST_HOSTS:
        priors = F.broadcast(priors)

    less = lambda a: F.zip_with(a, F.col("_soft"), lambda x, y: F.greatest(x - y, F.lit(0.0)))  # noqa: E731  without the row itself

    def smoothed(counts: Column, prior: Column) -> Column:
        n = F.aggregate(counts, F.lit(0.0), lambda a, b: a + b)
        return F.zip_with(counts, prior, lambda c, p: (c + strength * p) / (n + strength))

    even = F.array(*[F.lit(1.0 / k)] * k)
    joined = seen.join(priors, ["_suffix", "_host"], "left")
    joined = joined.withColumn("_p0", smoothed(less(F.col("_of_all")), even))
    joined = joined.withColumn("_p1", smoothed(less(F.col("_of_suffix")), F.col("_p0")))
    joined = joined.withColumn("_p2", smoothed(less(F.col("_of_host")), F.col("_p1")))
    joined = joined.withColumn("_log_post", _plus(_plus(local, F.col("_given")), F.transform("_p2", lambda p: F.log(p))))
    judged = joined.withColumn("_post", _softmax(F.col("_log_post")))
    languages = F.array(*[F.lit(x) for x in names])
    best = lambda a: F.get(languages, (F.array_position(a, F.array_max(a)) - 1).cast("int"))
    language, confidence = best(F.col("_post")), F.array_max("_post")
    fine = F.col("_text").isNotNull() & (confidence >= min_confidence)
    fine &= F.greatest(F.array_max("_log_post"), F.col("_mixed") + F.array_max("_given")) >= F.col("_unknown")
    if accept is not None:
        fine &= language.isin(accept)
    return judged.select(
        *[F.col("_row")[c].alias(c) for c in columns], language.alias("language"), confidence.alias("confidence"),
        best(F.col("_text")).alias("text_language"), fine.alias("accepted"))


def address_host(url: str) -> Column:
    """The host of an address, in lower case without port; null where there is none."""
    host = F.regexp_extract(F.lower(F.col(url).cast("string")), r"^[a-z][a-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1)
    return F.when(host != "", host)


def address_suffix(url: str) -> Column:
    """The last label of an address's host."""
    return F.element_at(F.split(address_host(url), r"\."), -1)


def markup_language(html: str) -> Column:
    """The language that a page's ``html`` element declares, without its region."""
    found = F.lower(F.regexp_extract(F.col(html).cast("string"), r"""(?i)<html\b[^>]*?\blang\s*=\s*["']?([a-z]+)""", 1))
    return F.when(found != "", found)


def markup_text(html: str) -> Column:
    """What a page shows: without comments, scripts, styles, tags and references."""
    bare = F.regexp_replace(F.col(html).cast("string"), r"(?is)<!--.*?-->|<(script|style)\b.*?</\1\s*>|<[^>]*>", " ")
    return F.regexp_replace(bare, r"&#?\w+;", " ")
