"""SimHash near-duplicates by pigeonring filtering."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from ..session import ship_functions
from .common import arrow_batches, staged, text_or_empty
from .components import components, forest

ship_functions(__name__)

SEED, BITS = 42, 64
#: A bucket with more own or reaching fingerprints is compared in blocks of this size, each pair of blocks a group of its own.
BLOCK = 2048
#: Pairs compared at once.
PAIRS = 1 << 20

_PRINTS = T.StructType([T.StructField("_key", T.LongType()), T.StructField("_print", T.LongType()), T.StructField("_text_hash", T.LongType())])
_BUCKETS = T.StructType([T.StructField("bucket", T.LongType()), T.StructField("print", T.LongType()), T.StructField("own", T.BooleanType())])
_EDGES = T.StructType([T.StructField("u", T.LongType()), T.StructField("v", T.LongType())])


def simhash(text: str, n_words: int) -> int:
    """64 bits: each set if set in over half of the hashes of the text's word shingles."""
    import xxhash

    words = text.encode().lower().split()               # bytes: only A-Z and ASCII white space count
    if not words:
        return 0
    line, ends = b" ".join(words), np.cumsum([len(w) + 1 for w in words])
    starts, stops = np.concatenate([[0], ends[:-1]]), ends - 1
    n = max(len(words) - n_words + 1, 1)
    last = min(n_words, len(words)) - 1
    cuts = map(slice, starts[:n].tolist(), stops[last:last + n].tolist())
    hashes = np.fromiter((xxhash.xxh64_intdigest(line[c], SEED) for c in cuts), "<u8", n)
    ones = np.zeros(BITS, np.int64)
    for i in range(0, n, 1 << 14):
        ones += np.unpackbits(hashes[i:i + (1 << 14)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, n_words: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``_key``, ``_print`` (the 64 bits as a bigint) and ``_text_hash`` (tells rows of one key apart) of every document."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = np.array([simhash(t, n_words) for t in batch.column(1).to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(prints), batch.column(2)], names=_PRINTS.names)

    arrow_batches(docs.sparkSession)
    return docs.select(F.col(key).cast("bigint"), text_or_empty(text), F.xxhash64(text_or_empty(text))).mapInArrow(run, _PRINTS)


class Ring:
    """The segments of a fingerprint in a ring, one more than bits that may differ.

    If two fingerprints differ in at most ``distance`` bits, some chain of consecutive
    segments starting at one of them keeps every prefix of l segments within
    l * distance / segments differing bits. So its first segment is equal, its first two
    differ in at most one bit, and so on.
    """

    def __init__(self, distance: int):
        self.distance, self.n = distance, distance + 1
        edges = [BITS * i // self.n for i in range(self.n + 1)]
        self.segments = [((1 << (b - a)) - 1) << a for a, b in zip(edges, edges[1:])]
        self.chains = [[np.uint64(sum(self.segments[(i + j) % self.n] for j in range(k))) for k in range(1, self.n + 1)] for i in range(self.n)]
        self.budgets = [k * distance // self.n for k in range(1, self.n + 1)]

    def buckets(self, prints: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, bool]]:
        """(bucket, print, own): own bucket of each start, and those reached by setting one clear bit of the second segment."""
        for i in range(self.n):
            key = self.mixed(prints & self.chains[i][min(1, self.n - 1)], i)
            yield key, prints, True
            if self.n > 1:
                second = self.segments[(i + 1) % self.n]
                for bit in (np.uint64(1 << b) for b in range(BITS) if second >> b & 1):
                    clear = prints[(prints & bit) == 0]
                    yield self.mixed((clear | bit) & self.chains[i][1], i), clear, False

    def mixed(self, masked: np.ndarray, i: int) -> np.ndarray:
        """A bucket's number: its two segments, spread over 64 bits, and where the chain starts."""
        return ((masked * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(3)) | np.uint64(i) << np.uint64(61)).view(np.int64)

    def close(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Which pairs pass: every prefix of some chain within budget first, then the full distance."""
        x = a ^ b
        chained = np.zeros(len(x), bool)
        for chain in self.chains:
            passed = np.bitwise_count(x & chain[0]) <= self.budgets[0]
            for mask, budget in zip(chain[1:-1], self.budgets[1:-1]):
                passed &= np.bitwise_count(x & mask) <= budget
            chained |= passed
        chained[chained] = np.bitwise_count(x[chained]) <= self.distance
        return chained


def _bucket_rows(batches: Iterator[pa.RecordBatch], ring: Ring) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        prints = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
        for key, of, own in ring.buckets(prints):
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(of.view(np.int64)), pa.array(np.full(len(key), own))], names=_BUCKETS.names)


def _linked(batches: Iterator[pa.RecordBatch], ring: Ring) -> Iterator[pa.RecordBatch]:
    """Groups of (bucket, cell) arrive in order; what ends a batch waits for the next."""
    rest = None

    def edges(bucket, cell, prints, own):
        starts = np.flatnonzero(np.concatenate([[True], (bucket[1:] != bucket[:-1]) | (cell[1:] != cell[:-1])]))
        sizes = np.diff(np.concatenate([starts, [len(bucket)]]))
        left = np.flatnonzero(own)                      # each own row against all rows of its group
        group = np.searchsorted(starts, left, "right") - 1
        keep = sizes[group] > 1
        left, group = left[keep], group[keep]
        width = sizes[group]
        done = np.concatenate([[0], np.cumsum(width)])
        i = 0
        while i < len(left):
            j = max(int(np.searchsorted(done, done[i] + PAIRS, "right")) - 1, i + 1)
            n = width[i:j]
            a = np.repeat(left[i:j], n)
            b = np.arange(len(a)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(starts[group[i:j]], n)
            pick = (b > a) | ~own[b]                    # two own rows meet once
            pa_, pb_ = prints[a[pick]], prints[b[pick]]
            ok = (pa_ != pb_) & ring.close(pa_, pb_)
            u, v = forest(pa_[ok].view(np.int64), pb_[ok].view(np.int64))
            if len(u):
                yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], names=_EDGES.names)
            i = j

    for batch in batches:
        cols = [batch.column(c).to_numpy(zero_copy_only=False) for c in ("bucket", "cell", "print", "own")]
        cols[2] = cols[2].view(np.uint64)
        if rest is not None:
            cols = [np.concatenate(x) for x in zip(rest, cols)]
        bucket, cell = cols[0], cols[1]
        if not len(bucket):
            continue
        last = int(np.argmax((bucket == bucket[-1]) & (cell == cell[-1])))
        rest = [c[last:] for c in cols]
        if last:
            yield from edges(*[c[:last] for c in cols])
    if rest is not None and len(rest[0]):
        yield from edges(*rest)


def groups(prints: DataFrame, ring: Ring) -> DataFrame:
    """``bucket, cell, print, own``: the fingerprints of a (bucket, cell) are compared, its own ones against all.

    In a bucket of many, its own fingerprints and those that reach it by setting a bit are dealt out in
    blocks of some ``BLOCK``; each pair of own blocks and each pair of an own and a reaching block is a
    cell, so cells stay small whatever the bucket. Large buckets without own fingerprints are left out.
    """
    rows = staged(prints.mapInArrow(lambda b: _bucket_rows(b, ring), _BUCKETS), "buckets")
    counts = rows.groupBy("bucket").agg(F.count_if("own").alias("own"), F.count_if(~F.col("own")).alias("reaching"))
    large = counts.where(F.greatest("own", "reaching") > BLOCK).select("bucket", *[
        F.ceil(F.col(c) / BLOCK).cast("int").alias(f"n_{c}") for c in ("own", "reaching")])
    dealt = rows.join(large, "bucket", "left").withColumns({
        "n_own": F.coalesce("n_own", F.lit(1)), "n_reaching": F.greatest("n_reaching", F.lit(1))}).where("n_own > 0")
    dealt = dealt.withColumn("mine", F.pmod(F.xxhash64("print"), F.when(F.col("own"), F.col("n_own")).otherwise(F.col("n_reaching"))).cast("int"))
    # reaching block 0 joins the cells of own blocks with themselves; number n_own + j - 1 stands for reaching block j
    of_own = F.expr("transform(sequence(0, n_own + n_reaching - 2), o -> struct(least(mine, o) AS low, greatest(mine, o) AS high))")
    of_reaching = F.expr("transform(sequence(0, n_own - 1), o -> struct(o AS low, if(mine = 0, o, n_own + mine - 1) AS high))")
    cells = dealt.withColumn("cell", F.explode(F.when(F.col("own"), of_own).otherwise(of_reaching)))
    return cells.select("bucket", (F.col("cell.low").cast("bigint") * (1 << 31) + F.col("cell.high")).alias("cell"), "print", "own")


def links(prints: DataFrame, distance: int) -> DataFrame:
    """Edges ``u, v`` that connect all of the distinct bigints ``print`` within ``distance`` bits of each other.

    Not all pairs: each compared group gives at most one edge less than it has fingerprints.
    """
    ring = Ring(distance)
    ordered = groups(prints, ring).repartition("bucket", "cell").sortWithinPartitions("bucket", "cell")
    return ordered.mapInArrow(lambda b: _linked(b, ring), _EDGES)


def near_duplicates(docs: DataFrame, n_words: int = 4, distance: int = 4, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key``, ``fingerprint`` (bigint), ``component_id`` and ``text_hash`` (XXH64 of the text, a bigint) of every document.

    Fingerprints of at most ``distance`` differing bits are linked; ``component_id`` is the smallest
    key reachable. Equal fingerprints are compared once, so copies cost nothing more.

    Null or empty text: fingerprint zero, linked like any other. Texts of fewer words than a
    shingle are one shingle. Repeated rows all come back; null keys belong to the component of
    their fingerprint but never name it (null where no other key can). Texts are read
    whole. No rows, no result. Other columns are ignored, whatever their names.
    """
    prints = staged(fingerprints(docs, n_words, key, text), "prints")
    nodes = prints.groupBy("_print").agg(F.min("_key").alias("_least"))
    if distance:
        roots = components(links(nodes.select(F.col("_print").alias("print")), distance))
        nodes = nodes.join(roots, nodes["_print"] == roots["node"], "left").withColumn("_root", F.coalesce("root", "_print"))
    else:
        nodes = nodes.withColumn("_root", F.col("_print"))
    nodes = staged(nodes.select("_print", "_root", "_least"), "nodes")
    named = nodes.groupBy("_root").agg(F.min("_least").alias("component_id"))
    of_print = nodes.join(named, "_root").select("_print", "component_id")
    return prints.join(of_print, "_print").select(F.col("_key").alias(key), F.col("_print").alias("fingerprint"), "component_id", F.col("_text_hash").alias("text_hash"))
