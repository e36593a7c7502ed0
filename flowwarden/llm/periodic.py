"""Periodic runs of words, found by multi-scale minimizers and collapsed to one period.

A run is a maximal stretch of words with smallest period q, at least ``EXPONENT`` periods and
``LEAST`` words long. Scale K looks for periods in (K/2, K]: it hashes every K consecutive words
and keeps the minimum of each window of K/2 hashes. Inside a run the windows at i and
i + q read the same words, so a minimum comes again q words later; K >= q words can not come
again sooner (else the period were smaller), and four periods hold both windows. So each run of a
scale has two neighbouring equal minima q apart: seeds, which are extended word by word.
Periods of up to ``DIRECT`` words are too short for that and are scanned lag by lag.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..session import ship_functions
from .common import arrow_batches

ship_functions(__name__)

EXPONENT, LEAST = 4, 6
#: Periods scanned directly; a power of two. The scales above it double.
DIRECT = 8
_BASE = 0x9E3779B97F4A7C15
_BACK = pow(_BASE, -1, 1 << 64)

RUN = T.StructType([T.StructField("start", T.LongType()), T.StructField("length", T.LongType()), T.StructField("period", T.LongType())])


def numbered(texts: list[bytes]) -> tuple[list[list[bytes]], np.ndarray, np.ndarray]:
    """Words of each text, numbers of all words (equal words: equal numbers), and where each text begins.

    A number that nothing else has follows each text, so no stretch of equal words crosses texts.
    """
    words = [t.split() for t in texts]                  # bytes: exactly the ASCII blanks part words
    known: dict[bytes, int] = {}
    begins = np.cumsum([0, *(len(w) + 1 for w in words)])
    ids = np.empty(begins[-1], np.int64)
    for at, own in zip(begins.tolist(), words):
        ids[at:at + len(own)] = [known.setdefault(w, len(known)) for w in own]
    ids[begins[1:] - 1] = -1 - np.arange(len(texts))
    return words, ids, begins


def _rolling(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Prefix sums of spread word numbers, and powers that bring a difference of them to the front."""
    n = len(ids)
    with np.errstate(over="ignore"):
        x = ids.view(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
        x = (x ^ (x >> np.uint64(32))) * np.uint64(0xC2B2AE3D27D4EB4F)
        x ^= x >> np.uint64(29)
        up, down = np.full(n, _BASE, np.uint64), np.full(n + 1, _BACK, np.uint64)
        up[:1], down[0] = 1, 1
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(x * np.cumprod(up), out=sums[1:])
        return sums, np.cumprod(down)


def minimizers(grams: np.ndarray, window: int) -> np.ndarray:
    """Places of the smallest of each ``window`` hashes, of equal ones the leftmost, ascending."""
    n = len(grams) - window + 1
    best = np.arange(len(grams))
    width = 1
    while width < window:                               # place of the minimum of a doubling stretch
        step = min(width, window - width)
        a, b = best[:len(best) - step], best[step:]
        best = np.where(grams[b] < grams[a], b, a)
        width += step
    best = best[:n]
    return best[np.concatenate([[True], best[1:] != best[:-1]])] if n > 0 else best[:0]


def seeds(ids: np.ndarray, longest: int) -> Iterator[tuple[int, np.ndarray]]:
    """(lag, places): minima of a scale and the next equal one ``lag`` words on, for every scale and lag."""
    sums, down = _rolling(ids)
    scale = 2 * DIRECT
    while EXPONENT * (scale // 2 + 1) <= longest:
        with np.errstate(over="ignore"):
            grams = (sums[scale:] - sums[:-scale]) * down[:len(ids) - scale + 1]
            grams = (grams ^ (grams >> np.uint64(31))) * np.uint64(0xD6E8FEB86659FD93)
        at = minimizers(grams, scale // 2)
        order = np.lexsort((at, grams[at]))
        at = at[order]
        lag = at[1:] - at[:-1]
        pick = np.flatnonzero((grams[at[1:]] == grams[at[:-1]]) & (lag > scale // 2) & (lag <= scale))
        place, lag = at[pick], lag[pick]
        order = np.lexsort((place, lag))
        place, lag = place[order], lag[order]
        cuts = np.flatnonzero(np.concatenate([[True], lag[1:] != lag[:-1]])) if len(lag) else []
        for a, b in zip(cuts, [*cuts[1:], len(lag)]):
            yield int(lag[a]), place[a:b]
        scale *= 2


def _reach(ids: np.ndarray, at: int, lag: int, way: int) -> int:
    """How many words from ``at`` on (``way`` 1) or before it (-1) equal those ``lag`` words on."""
    n, done, step = len(ids), 0, 32
    while True:
        lo, hi = (at + done, min(at + done + step, n - lag)) if way > 0 else (max(at - done - step, 0), at - done)
        if hi <= lo:
            return done
        differ = np.flatnonzero(ids[lo:hi] != ids[lo + lag:hi + lag])
        if len(differ):
            return done + int(differ[0] if way > 0 else hi - lo - 1 - differ[-1])
        done += hi - lo
        step *= 2


def runs(ids: np.ndarray, longest: int) -> np.ndarray:
    """``start, length, period`` of all runs of the numbered words, by start and period.

    Stretches found at a multiple of their period are the stretch of the period itself, so
    of equal stretches the smallest period stays.
    """
    found: list[np.ndarray] = [np.zeros((0, 3), np.int64)]
    for lag in range(1, min(DIRECT, len(ids) - 1) + 1):
        edges = np.flatnonzero(np.diff(np.concatenate([[False], ids[lag:] == ids[:-lag], [False]]).view(np.int8)))
        start, length = edges[::2], edges[1::2] - edges[::2] + lag
        keep = length >= max(LEAST, EXPONENT * lag)
        found.append(np.stack([start[keep], length[keep], np.full(keep.sum(), lag)], 1))
    for lag, places in seeds(ids, longest):
        reached = -1
        for at in places.tolist():
            if at < reached:                            # inside a stretch already extended
                continue
            stop, start = at + _reach(ids, at, lag, 1), at - _reach(ids, at, lag, -1)
            reached = stop
            if stop + lag - start >= EXPONENT * lag:
                found.append(np.array([[start, stop + lag - start, lag]]))
    all_ = np.concatenate(found)
    all_ = all_[np.lexsort((all_[:, 2], all_[:, 1], all_[:, 0]))]
    new = np.ones(len(all_), bool)
    new[1:] = (all_[1:, :2] != all_[:-1, :2]).any(1)
    all_ = all_[new]
    return all_[np.lexsort((all_[:, 2], all_[:, 0]))]


def _collapsed(n: int, own: np.ndarray) -> np.ndarray:
    """Numbers of the words that stay of ``n``: those that no run holds after its first period."""
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, own[:, 0] + own[:, 2], 1)
    np.add.at(edge, own[:, 0] + own[:, 1], -1)
    return np.flatnonzero(np.cumsum(edge[:n]) == 0)


def _run_rows(batches: Iterator[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        words, ids, begins = numbered(batch.column(1).to_pylist())
        counts = np.array([len(w) for w in words], np.int64)
        all_ = runs(ids, int(counts.max(initial=0)))
        doc = np.searchsorted(begins, all_[:, 0], "right") - 1
        all_[:, 0] -= begins[doc]
        ends = np.searchsorted(doc, np.arange(len(words) + 1))
        texts = []
        for own, a, b in zip(words, ends[:-1].tolist(), ends[1:].tolist()):
            texts.append(b" ".join(own if a == b else [own[i] for i in _collapsed(len(own), all_[a:b]).tolist()]))
        one = pa.StructArray.from_arrays([pa.array(c) for c in all_.T], names=["start", "length", "period"])
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(counts), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), one), pa.array(texts, pa.binary())], schema=schema)


def periodic_runs(docs: DataFrame, text: Column, key: str = "doc_id") -> DataFrame:
    """``key``, ``n_words``, ``runs`` (array of start, length, period, by start and period), ``collapsed`` (text).

    Words are what ASCII blanks part, numbered from 0. ``collapsed`` is the words that no run
    holds after its first period, joined by one space; overlapping runs each keep their
    first period only where no other run drops it.

    One narrow pass: an Arrow batch of texts is laid end to end with a separator and searched at once, in
    time near linear in its words for each scale. Null and empty texts have no word and no run;
    long ones are read whole; repeated rows and null keys come back as they came; no rows, no result. Other
    columns are ignored, whatever their names.
    """
    schema = T.StructType([
        T.StructField("key", docs.schema[key].dataType), T.StructField("n_words", T.LongType()),
        T.StructField("runs", T.ArrayType(RUN)), T.StructField("collapsed", T.BinaryType())])
    run = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = pa.schema([("key", batch.schema.field(0).type), ("n_words", pa.int64()), ("runs", pa.list_(run)), ("collapsed", pa.binary())])
            yield from _run_rows([batch], own)

    arrow_batches(docs.sparkSession)
    plain = docs.select(F.col(key), F.coalesce(text.cast("string"), F.lit("")).cast("binary").alias("text"))
    found = plain.mapInArrow(rows, schema)
    return found.select(F.col("key").alias(key), "n_words", "runs", F.col("collapsed").cast("string").alias("collapsed"))


def strongest(found: Column) -> Column:
    """The run with the greatest length / period, compared as whole numbers; the first of equal ones, null without runs."""
    none = F.lit(None).cast(RUN)
    return F.aggregate(found, none, lambda best, r: F.when(
        best.isNull() | (r["length"] * best["period"] > best["length"] * r["period"]), r).otherwise(best))
