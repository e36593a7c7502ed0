"""Exact removal of repeated byte strings: anchored suffixes, range-partitioned, sorted, compared.

Whether a string of LENGTH bytes starts earlier too is decided for whole groups of such
strings at once. Of the GRAM-byte pieces of a string the one with the smallest hash (the
leftmost of equal ones) is its anchor. Equal strings have their anchors at the same place,
so only suffixes that begin at anchors need comparing, about one in forty; each carries
what lies before it as far as its strings reach.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window as W, functions as F, types as T

from ..session import ship_functions
from .common import arrow_batches, staged, text_or_empty

ship_functions(__name__)

LENGTH, GRAM = 100, 24
REACH = LENGTH - GRAM                                   # bytes before an anchor that its strings may start at
#: Bytes hashed at once; longer inputs are cut, with the overlap that strings need.
SEGMENT = 1 << 21
#: Suffixes with the same leading bytes that are compared in one group; more are compared string by string.
HOT = 20_000
#: Suffixes sorted at once, at least (a group is never cut).
CHUNK = 1 << 15

_BASE = 0x9E3779B97F4A7C15
_BACK = pow(_BASE, -1, 1 << 64)
# a document's name is its key and a 64-bit hash of its text (tie); where an anchor is in it: its position, how far
# before it its last and first strings start
_POS, _NEAR, _FAR = 14, 7, 0


def packed(pos, near, far):
    return (pos << _POS) | (near << _NEAR) | far


def unpacked(at: np.ndarray) -> tuple[np.ndarray, ...]:
    return at >> _POS, (at >> _NEAR) & 127, at & 127


def _spread(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(29))


def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A number for each byte, powers of the base and of its inverse; kept by the worker process."""
    known = vars(sys).setdefault("_flowwarden_powers", {})
    if SEGMENT not in known:
        with np.errstate(over="ignore"):
            steps = np.ones((2, SEGMENT + 1), np.uint64)
            steps[0, 1:], steps[1, 1:] = _BASE, _BACK
            up, down = np.cumprod(steps, axis=1)
        known[SEGMENT] = np.random.default_rng(11).integers(1, 1 << 63, 256, np.uint64), up, down
    return known[SEGMENT]


def anchors(texts: list[bytes]) -> tuple[np.ndarray, ...]:
    """(document, position, near, far, hash of the gram, hash of all its strings) of the anchors of ``texts``.

    An anchor's strings start ``far`` to ``near`` bytes before it. A cut at the end of a segment
    may give an anchor twice, with different strings.
    """
    table, up, down = _tables()
    sizes = np.array([len(t) for t in texts], np.int64)
    ends = np.cumsum(sizes)
    begins = ends - sizes
    whole = np.frombuffer(b"".join(texts), np.uint8)
    found = []
    for lo in range(0, max(len(whole) - LENGTH + 1, 0), SEGMENT - LENGTH + 1):
        b = whole[lo:lo + SEGMENT]
        here = np.clip(ends, lo, lo + len(b))
        doc = np.repeat(np.arange(len(here)), np.diff(np.concatenate([[lo], here])))
        with np.errstate(over="ignore"):
            sums = np.zeros(len(b) + 1, np.uint64)
            np.cumsum(table[b] * up[:len(b)], out=sums[1:])
            n = len(b) - GRAM + 1
            gram = _spread((sums[GRAM:] - sums[:n]) * down[:n])
        # smallest hash in each string, the place in the low bits: the leftmost of equal ones wins
        low = (gram >> np.uint64(21) << np.uint64(21)) | np.arange(n, dtype=np.uint64)
        width = 1
        while width < REACH + 1:
            step = min(width, REACH + 1 - width)
            low = np.minimum(low[:len(low) - step], low[step:])
            width += step
        start = np.flatnonzero(doc[:len(low)] == doc[LENGTH - 1:LENGTH - 1 + len(low)])
        if not len(start):
            continue
        at = (low[start] & np.uint64((1 << 21) - 1)).astype(np.int64)
        new = np.concatenate([[True], (at[1:] != at[:-1]) | (doc[start[1:]] != doc[start[:-1]])])
        first = np.flatnonzero(new)
        last = np.concatenate([first[1:], [len(start)]]) - 1
        s0, s1, p = start[first], start[last], at[first]
        with np.errstate(over="ignore"):
            strings = (sums[s1 + LENGTH] - sums[s0]) * down[s0]
            strings = _spread(strings + ((p - s0) * 128 + (p - s1)).astype(np.uint64) * np.uint64(0x165667B19E3779F9))
        d = doc[p]
        found.append((d, lo + p - begins[d], p - s1, p - s0, gram[p], strings))
    if not found:
        return tuple(np.zeros(0, t) for t in (np.int64,) * 4 + (np.uint64,) * 2)
    return tuple(np.concatenate(x) for x in zip(*found))


# --- which anchors repeat -------------------------------------------------------------------------------------

_ANCHORS = T.StructType([
    T.StructField("gram", T.LongType()), T.StructField("strings", T.LongType()), T.StructField("doc", T.LongType()),
    T.StructField("tie", T.LongType()), T.StructField("at", T.LongType()), T.StructField("known", T.IntegerType())])
_MARKS = T.StructType([
    T.StructField("doc", T.LongType()), T.StructField("tie", T.LongType()), T.StructField("at", T.LongType()), T.StructField("gram", T.LongType())])
_PLAIN, _BEACON, _CROWDED, _REPEAT = range(4)             # kinds of anchor rows
#: A gram with so many different surroundings in one batch is dealt out by surroundings, but for one row
#: that tells the others of it.
CROWD = 8


def _anchor_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Anchors of each batch; of those with the same strings only the earliest is compared further."""
    for batch in batches:
        doc, pos, near, far, gram, strings = anchors([t.encode("utf-8", "surrogatepass") for t in batch.column(2).to_pylist()])
        if not len(doc):
            continue
        keys, ties = (batch.column(c).to_numpy(zero_copy_only=False) for c in (0, 1))
        key, tie, at = keys[doc], ties[doc], packed(pos, near, far)
        order = np.lexsort((at, tie, key, strings, gram))
        key, tie, at, gram, strings = key[order], tie[order], at[order], gram[order], strings[order]
        new_gram = np.concatenate([[True], gram[1:] != gram[:-1]])
        new = new_gram | np.concatenate([[True], strings[1:] != strings[:-1]])
        lead = np.maximum.accumulate(np.where(new, np.arange(len(new)), 0))      # first row with the same strings
        repeat = (key != key[lead]) | (tie != tie[lead]) | (at != at[lead])
        of_gram = np.cumsum(new_gram) - 1
        crowded = (np.bincount(of_gram, weights=new) >= CROWD)[of_gram]
        known = np.where(repeat, _REPEAT, np.where(~crowded, _PLAIN, np.where(new_gram, _BEACON, _CROWDED))).astype(np.int32)
        yield pa.RecordBatch.from_arrays(
            [pa.array(gram.view(np.int64)), pa.array(strings.view(np.int64)), pa.array(key), pa.array(tie), pa.array(at), pa.array(known)], names=_ANCHORS.names)


def _repeats(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by gram, strings, document, place: all but the first of equal strings are repeats (gram null).

    The first ones go on, with their gram, if another anchor has the same gram. One row waits for
    the next batch, so a group of any size passes in constant memory.
    """
    rest = None
    for batch in batches:
        cols = [batch.column(c).to_numpy(zero_copy_only=False) for c in ("gram", "strings", "doc", "tie", "at", "known")]
        if not len(cols[0]):
            continue
        if rest is not None:
            cols = [np.concatenate(x) for x in zip(rest[0], cols)]
        out, rest = _judged(cols, rest[1] if rest is not None else None, False)
        yield out
    if rest is not None:
        yield _judged(rest[0], rest[1], True)[0]


def _judged(cols, before, ended):
    """``before``: gram, strings, document (key, tie) and place of the first row with the strings of the last row judged."""
    gram, strings, doc, tie, at, known = cols
    n = len(gram) if ended else len(gram) - 1
    if before is not None:
        gram, strings, doc, tie, at = (np.concatenate([[x], c]) for x, c in zip(before, (gram, strings, doc, tie, at)))
    near = gram[1:] == gram[:-1]
    new = np.concatenate([[True], ~near | (strings[1:] != strings[:-1])])
    lead = np.maximum.accumulate(np.where(new, np.arange(len(new)), 0))
    other = (doc != doc[lead]) | (tie != tie[lead]) | (at != at[lead])                    # a repeated row is no repeat of itself
    beside = np.concatenate([[False], near]) | np.concatenate([near, [False]])
    skip = before is not None
    repeat = other[skip:] | (known == _REPEAT)
    go_on = ~repeat & (beside[skip:] | (known == _BEACON) | (known == _CROWDED))
    pick = np.flatnonzero((repeat | go_on)[:n])
    gram_, doc_, tie_, at_ = gram[skip:], doc[skip:], tie[skip:], at[skip:]
    out = pa.RecordBatch.from_arrays(
        [pa.array(doc_[pick]), pa.array(tie_[pick]), pa.array(at_[pick]), pa.array(gram_[pick], mask=repeat[pick])], names=_MARKS.names)
    if ended:
        return out, None
    first = lead[n - 1 + skip] if n or skip else None
    return out, ([c[n:] for c in cols], before if first is None else tuple(c[first] for c in (gram, strings, doc, tie, at)))


# --- suffixes of the anchors left -----------------------------------------------------------------------------

_SUFFIXES = T.StructType([
    T.StructField("lead", T.BinaryType()), T.StructField("hot_doc", T.LongType()), T.StructField("hot_tie", T.LongType()),
    T.StructField("hot_at", T.LongType()), T.StructField("doc", T.LongType()), T.StructField("tie", T.LongType()),
    T.StructField("at", T.LongType()), T.StructField("context", T.BinaryType())])
_SPANS = T.StructType([
    T.StructField("doc", T.LongType()), T.StructField("tie", T.LongType()), T.StructField("begin", T.LongType()), T.StructField("stop", T.LongType()),
    T.StructField("part", T.IntegerType()), T.StructField("first", T.BinaryType()), T.StructField("last", T.BinaryType())])


def _deflated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import zstandard

    z = zstandard.ZstdCompressor(level=1)
    for batch in batches:
        raw = [z.compress(t.encode("utf-8", "surrogatepass")) for t in batch.column(2).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(raw, pa.binary())], names=["doc", "tie", "raw"])


def _suffix_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each anchor; for those with a hot gram one for each of its strings."""
    import xxhash
    import zstandard

    z = zstandard.ZstdDecompressor()
    names = _SUFFIXES.names
    types = [pa.binary(), *[pa.int64()] * 6, pa.binary()]
    for batch in batches:
        rows = []
        for doc, tie, raw, marks in zip(*[batch.column(c).to_pylist() for c in ("doc", "tie", "raw", "marks")]):
            text = z.decompress(raw)
            for m in marks:
                at, hot = m["at"], m["hot"]
                pos, near, far = unpacked(at)
                if not hot:
                    rows.append((b"\0" + text[pos:pos + GRAM], None, None, None, doc, tie, at, text[pos - far:pos - near + LENGTH]))
                else:
                    for s in range(pos - far, pos - near + 1):
                        rows.append((b"\1" + xxhash.xxh3_128_digest(text[s:s + LENGTH]), *(doc, tie, packed(s, 0, 0)) * 2, None))
                if len(rows) >= 8192:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)
                    rows = []
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)


def multikey_order(words: np.ndarray) -> np.ndarray:
    """Order of byte strings given as rows of big-endian words: multikey quicksort, all ranges of a depth at once.

    Sorts by the first word, then only rows still equal by the next, and so on.
    """
    n, width = words.shape
    order = np.argsort(words[:, 0], kind="stable")
    equal = np.concatenate([[False], words[order[1:], 0] == words[order[:-1], 0]])
    for w in range(1, width):
        open_ = equal | np.concatenate([equal[1:], [False]])
        at = np.flatnonzero(open_)
        if not len(at):
            break
        group = np.cumsum(~equal[at])
        rows = order[at]
        order[at] = rows[np.lexsort((words[rows, w], group))]
        equal[1:] &= words[order[1:], w] == words[order[:-1], w]
    return order


def _common(strings: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of equally long byte rows, and the bytes each shares with the one before."""
    n, width = strings.shape
    padded = np.zeros((n, -(-width // 8) * 8), np.uint8)
    padded[:, :width] = strings
    order = multikey_order(padded.view(">u8").astype(np.uint64))
    s = padded[order]
    differ = np.concatenate([np.ones((1, padded.shape[1]), bool), s[1:] != s[:-1]])
    common = np.where(differ.any(1), differ.argmax(1), width)
    common[0] = 0
    return order, np.minimum(common, width)


def repeated_starts(doc: np.ndarray, tie: np.ndarray, at: np.ndarray, contexts: list[bytes]) -> Iterator[tuple[np.ndarray, int]]:
    """For each distance before an anchor: rows (in the given order) whose string from there occurs in an earlier row.

    Suffixes and, backwards, what lies before them are sorted;
    classes of equal beginnings of any length follow from the bytes that neighbours share.
    Suffixes are compared over GRAM bytes at least, so those of different grams never agree.
    """
    n = len(contexts)
    _, near, far = unpacked(at)
    right, left = np.zeros((n, LENGTH), np.uint8), np.zeros((n, REACH), np.uint8)
    flat, size = np.frombuffer(b"".join(contexts), np.uint8), np.array([len(c) for c in contexts])
    begin = np.cumsum(size) - size
    row, col = np.repeat(np.arange(n), size), np.arange(len(flat)) - np.repeat(begin, size) - np.repeat(far, size)
    ahead = col >= 0
    right[row[ahead], col[ahead]] = flat[ahead]
    left[row[~ahead], -col[~ahead] - 1] = flat[~ahead]
    classes = []
    for strings in (right, left):
        order, common = _common(strings)
        classes.append((order, common))
    rank = np.lexsort((at, tie, doc))
    for distance in range(REACH + 1):
        mine = rank[(near[rank] <= distance) & (far[rank] >= distance)]
        if len(mine) < 2:
            continue
        key = np.zeros(len(mine), np.int64)
        for (order, common), width in zip(classes, (LENGTH - distance, distance)):
            of = np.empty(n, np.int64)
            of[order] = np.cumsum(common < width) if width else 0
            key = key * (n + 1) + of[mine]
        _, first = np.unique(key, return_index=True)
        again = np.ones(len(mine), bool)
        again[first] = False
        if again.any():
            yield mine[again], distance


def _group_spans(held: list[tuple]) -> pa.RecordBatch:
    _, doc, tie, at, contexts = zip(*held)
    doc, tie, at = np.array(doc), np.array(tie), np.array(at)
    pos, _, _ = unpacked(at)
    rows, distances = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for r, distance in repeated_starts(doc, tie, at, contexts):
        rows.append(r)
        distances.append(np.full(len(r), distance))
    row, start = np.concatenate(rows), pos[np.concatenate(rows)] - np.concatenate(distances)
    order = np.lexsort((start, row))
    row, start = row[order], start[order]
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (start[1:] != start[:-1] + 1)
    first = np.flatnonzero(new)
    last = np.concatenate([first[1:], [len(row)]]) - 1 if len(first) else first
    return _span_batch(doc[row[first]], tie[row[first]], start[first], start[last] + LENGTH)


def _span_batch(doc, tie, begin, stop, part=None, first=None, last=None) -> pa.RecordBatch:
    n = len(doc)
    return pa.RecordBatch.from_arrays([
        pa.array(doc, pa.int64()), pa.array(tie, pa.int64()), pa.array(begin, pa.int64()), pa.array(stop, pa.int64()),
        pa.array([part] * n, pa.int32()), pa.array([first] * n, pa.binary()), pa.array([last] * n, pa.binary())], names=_SPANS.names)


def _bucket_spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Spans of one bucket, sorted by lead: whole groups of suffixes, then single strings of hot grams.

    Equal strings may lie in several buckets. The first of a bucket is left open, with its
    lead, and so is the last lead, to be compared across the boundary.
    """
    part = TaskContext.get().partitionId()
    held: list[tuple] = []
    last, opened = None, None
    for batch in batches:
        leads, doc, tie, at = batch.column("lead").to_pylist(), *(batch.column(c).to_numpy(zero_copy_only=False) for c in ("doc", "tie", "at"))
        single = next((i for i, x in enumerate(leads) if x[0] == 1), len(leads))
        held += zip(leads[:single], doc[:single].tolist(), tie[:single].tolist(), at[:single].tolist(), batch.column("context").slice(0, single).to_pylist())
        if len(held) >= CHUNK and held[-1][0] != held[0][0]:
            cut = len(held) - 1
            while held[cut - 1][0] == held[-1][0]:
                cut -= 1
            yield _group_spans(held[:cut])
            held = held[cut:]
        if single < len(leads):
            now = leads[single:]
            again = np.array([x == y for x, y in zip(now, [last, *now])])
            if opened is None:
                opened = (now[0], int(doc[single]), int(tie[single]), int(at[single]))
            rows = single + np.flatnonzero(again)
            start, _, _ = unpacked(at[rows])
            yield _span_batch(doc[rows], tie[rows], start, start + LENGTH)
            last = now[-1]
    if held:
        yield _group_spans(held)
    if opened is not None:
        start, _, _ = unpacked(np.array([opened[3]]))
        yield _span_batch([opened[1]], [opened[2]], start, start + LENGTH, part, opened[0], last)


# --- the texts less the spans ---------------------------------------------------------------------------------

_KEPT = T.StructType([
    T.StructField("doc", T.LongType()), T.StructField("n_bytes", T.LongType()), T.StructField("n_removed", T.LongType()),
    T.StructField("n_spans", T.LongType()), T.StructField("kept", T.BinaryType())])


def _kept_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import zstandard

    z = zstandard.ZstdDecompressor()
    for batch in batches:
        rows = []
        for doc, raw, spans in zip(batch.column("doc").to_pylist(), batch.column("raw").to_pylist(), batch.column("spans").to_pylist()):
            text, kept, done, spans_seen = z.decompress(raw), [], 0, 0
            end = -1
            for begin, stop in sorted((s["begin"], s["stop"]) for s in spans or ()):
                if begin > end:
                    spans_seen += 1
                    kept.append(text[done:begin])
                end = done = max(end, stop)
            kept.append(text[done:])
            left = b"".join(kept)
            rows.append((doc, len(text), len(text) - len(left), spans_seen, left))
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()))] if rows
            else [pa.array([], t) for t in (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary())], names=_KEPT.names)


def repeated_spans(plain: DataFrame, hot: int = HOT) -> tuple[DataFrame, DataFrame]:
    """Byte ranges to remove, as ``doc, tie, begin, stop`` (they may overlap), and the deflated texts."""
    found = plain.mapInArrow(_anchor_rows, _ANCHORS)
    # rows that are known to be repeats need nobody beside them
    route = (
        F.when(F.col("known") <= _BEACON, F.col("gram")).when(F.col("known") == _CROWDED, F.xxhash64("gram", "strings"))
        .otherwise(F.xxhash64("doc", "tie", "at")))
    ordered = found.repartition(route).sortWithinPartitions("gram", "strings", "doc", "tie", "at")
    marks = staged(ordered.mapInArrow(_repeats, _MARKS), "marks")

    pos, near, far = F.shiftright("at", _POS), F.shiftright("at", _NEAR).bitwiseAND(F.lit(127)), F.shiftright("at", _FAR).bitwiseAND(F.lit(127))
    sure = marks.where("gram is null").select("doc", "tie", (pos - far).alias("begin"), (pos - near + LENGTH).alias("stop"))
    open_ = marks.where("gram is not null")
    crowds = open_.groupBy("gram").count().where(F.col("count") > hot).select("gram", F.lit(True).alias("hot"))
    open_ = open_.join(crowds, "gram", "left")
    by_doc = open_.groupBy("doc", "tie").agg(
        F.collect_set(F.struct("at", F.coalesce("hot", F.lit(False)).alias("hot"))).alias("marks"))
    raw = plain.mapInArrow(_deflated, "doc bigint, tie bigint, raw binary")
    once = raw.join(by_doc, ["doc", "tie"]).dropDuplicates(["doc", "tie"])       # already together: no shuffle
    suffixes = once.select("doc", "tie", "raw", "marks").mapInArrow(_suffix_rows, _SUFFIXES)
    order = ("lead", "hot_doc", "hot_tie", "hot_at")
    bucketed = suffixes.repartitionByRange(*order).sortWithinPartitions(*order)
    spans = staged(bucketed.mapInArrow(_bucket_spans, _SPANS), "spans")

    # one row for each bucket that holds strings of hot grams
    edges = spans.where("part is not null").withColumn("before", F.lag("last").over(W.orderBy("part")))
    closed = edges.where("before = first").select("doc", "tie", "begin", "stop")
    inner = spans.where("part is null").select("doc", "tie", "begin", "stop")
    return sure.unionByName(inner).unionByName(closed), raw


def remove_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", hot: int = HOT) -> DataFrame:
    """``key``, ``n_bytes``, ``n_removed``, ``n_spans``, ``kept`` (bytes): every document less what it repeats.

    A byte goes if a string of LENGTH bytes that covers it also starts earlier: in a document of
    smaller key, or before it in the same one. Strings are judged on the input, never across
    documents; ``n_spans`` counts maximal removed runs. What is kept may begin or end inside a
    character, so it comes as bytes.

    Null texts count as empty, texts shorter than LENGTH lose nothing, null keys come first.
    Rows that share a key, or have none, are documents of their own, in the order of a 64-bit hash of their texts, which is
    part of a document's name; rows that also share the text are one document and come back as often as they came. No rows, no result. Other columns are ignored, whatever their names.
    """
    arrow_batches(docs.sparkSession)
    no_key = -(1 << 63)
    plain = docs.select(
        F.coalesce(F.col(key).cast("bigint"), F.lit(no_key)).alias("doc"),
        F.xxhash64(text_or_empty(text)).alias("tie"), text_or_empty(text).alias("text"))
    spans, raw = repeated_spans(plain, hot)
    of_doc = spans.groupBy("doc", "tie").agg(F.collect_list(F.struct("begin", "stop")).alias("spans"))
    kept = raw.join(of_doc, ["doc", "tie"], "left").select("doc", "raw", "spans").mapInArrow(_kept_rows, _KEPT)
    return kept.select(F.when(F.col("doc") != no_key, F.col("doc")).alias(key), "n_bytes", "n_removed", "n_spans", "kept")
