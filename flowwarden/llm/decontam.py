"""Benchmark decontamination by templates: numbers, names and units become typed placeholders."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from ..session import ship_functions
from .common import MAP_BITS, arrow_batches, hash_map, staged, text_or_empty

ship_functions(__name__)

# fixed values
NUMBER_WORDS = """zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen
eighteen nineteen twenty thirty forty fifty sixty seventy eighty ninety hundred thousand million billion half dozen""".split()
UNITS = """mm cm m km ft yd mi mile miles meter meters metre metres kilometer kilometers kilometre kilometres inch inches foot feet
yard yards mg g kg gram grams kilogram kilograms ton tons tonne tonnes lb lbs oz pound pounds ounce ounces ml cl liter liters litre
litres gallon gallons sec second seconds min minute minutes hr hour hours day days week weeks month months year years hz khz mhz ghz
kw kwh watt watts volt volts amp amps joule joules kb mb gb tb percent dollar dollars euro euros cent cents degree degrees mph kmh""".split()

NUMBER, UNIT, NAME = "<number>", "<unit>", "<name>"
_LITERAL, _NUMBER, _UNIT, _SIGN, _TITLE, _STOP = range(6)
_TOKEN = re.compile(r"\d+(?:[.,]\d+)*|[^\W\d_][^\W_]*(?:['’][^\W\d_]+)*|[.!?:\n%$€£°]")          # "12km" is two tokens, "B12" one
_STOPS, _SIGNS = frozenset(".!?:\n"), frozenset("%$€£°")
#: Readings of a text: words and typed slots; the same without names, whatever the case and line breaks; plain words and numbers.
READINGS = TYPED, FOLDED, WORDS = range(3)
_WINDOW = T.StructType([
    T.StructField("key", T.LongType()), T.StructField("reading", T.IntegerType()), T.StructField("hash", T.LongType()), T.StructField("at", T.LongType()),
    T.StructField("tokens", T.LongType()), T.StructField("template", T.StringType()), T.StructField("slots", T.ArrayType(T.StringType()))])


def fold(token: str) -> str:
    """A token without case and form of apostrophe."""
    return token.casefold().replace("’", "'")


class Vocabulary(dict):
    """Number of a raw token; ``kind`` and ``hash`` hold what is known of each."""

    def __init__(self):
        import xxhash

        self.digest = xxhash.xxh64_intdigest
        self.kind, self.hash = np.zeros(1 << 12, np.int8), np.zeros(1 << 12, np.uint64)
        self.numbers, self.units = frozenset(NUMBER_WORDS), frozenset(UNITS)
        self.line_break = self["\n"]
        self.placeholder = np.array([self.digest(x) for x in (NUMBER, UNIT, NAME)], np.uint64)

    def __missing__(self, token: str) -> int:
        low = fold(token)
        if token in _STOPS:
            kind = _STOP
        elif token in _SIGNS:
            kind = _SIGN
        elif token[0].isdigit() or low in self.numbers:
            kind = _NUMBER
        elif low in self.units:
            kind = _UNIT
        else:
            kind = _TITLE if token[0].isupper() and token[1:].islower() else _LITERAL
        self[token] = n = len(self)
        if n == len(self.kind):
            self.kind, self.hash = (np.concatenate([x, np.zeros_like(x)]) for x in (self.kind, self.hash))
        self.kind[n], self.hash[n] = kind, self.digest(low)
        return n

    def tokens(self, text: str) -> tuple[list[str], np.ndarray]:
        raw = _TOKEN.findall(text)
        return raw, np.fromiter(map(self.__getitem__, raw), np.int64, len(raw))


class Template:
    """A text as literal words and placeholders: ``hash`` of each token, and what a slot held.

    Read as ``FOLDED``, names are literal and line breaks no stops; as ``WORDS``, all is literal.
    """

    def __init__(self, text: str, vocabulary: Vocabulary, reading: int = TYPED, tokens: tuple[list[str], np.ndarray] | None = None):
        self.reading = reading
        self.raw, ids = tokens or vocabulary.tokens(text)
        raw_at = np.arange(len(ids))
        if reading == FOLDED:
            raw_at = np.flatnonzero(ids != vocabulary.line_break)
            ids = ids[raw_at]
        kind = vocabulary.kind[ids]
        none = np.zeros(len(kind), bool)
        number = unit = name = goes_on = none
        if reading != WORDS and len(kind):
            before, after = np.concatenate([[_STOP], kind[:-1]]), np.concatenate([kind[1:], [_STOP]])
            number = kind == _NUMBER
            unit = ((kind == _UNIT) & (before == _NUMBER)) | ((kind == _SIGN) & ((before == _NUMBER) | (after == _NUMBER)))
        if reading == TYPED and len(kind):
            name = (kind == _TITLE) & (before != _STOP)
            goes_on = name & np.concatenate([[False], name[:-1]])                       # "Ada Lovelace" is one name
        role = np.where(number, 1, np.where(unit, 2, np.where(name, 3, 0)))
        keep = np.flatnonzero((kind != _STOP) & ((kind != _SIGN) | unit) & ~goes_on)
        self.at, self.role = raw_at[keep], role[keep]
        self.goes_on = goes_on
        literal = vocabulary.hash[ids][keep]
        self.hash = np.where(self.role > 0, vocabulary.placeholder[self.role - 1], literal)

    def windows(self, width: int, min_literals: int) -> tuple[np.ndarray, np.ndarray]:
        """Starts and hashes of the windows with enough literal words."""
        n = len(self.hash) - width + 1
        if n < 1:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        h = np.full(n, width + (self.reading << 32), np.uint64)
        for j in range(width):
            h = (h ^ self.hash[j:j + n]) * np.uint64(0x9E3779B185EBCA87)
            h ^= h >> np.uint64(29)
        literals = np.concatenate([[0], np.cumsum(self.role == 0)])
        start = np.flatnonzero(literals[width:] - literals[:n] >= min_literals)
        return start, h[start]

    def shown(self, start: int, width: int) -> tuple[str, list[str]]:
        """A window's template and its slots in order, each as type and value."""
        words, slots = [], []
        for i, role in zip(self.at[start:start + width].tolist(), self.role[start:start + width].tolist()):
            value = fold(self.raw[i])
            if role == 3:
                j = i + 1
                while j < len(self.raw) and self.goes_on[j]:
                    value += " " + fold(self.raw[j])
                    j += 1
            words.append((value, NUMBER, UNIT, NAME)[role])
            if role:
                slots.append(f"{words[-1]} {value}")
        return " ".join(words), slots


def _parts(rows: Iterator[tuple[int, str]], least: int = 1 << 16) -> Iterator[tuple[list[int], list[str], list[int]]]:
    """Texts in parts of some 65,536 tokens: keys, tokens with a stop after each text, and where the next text starts."""
    keys, raw, ends = [], [], []
    for key, text in rows:
        raw += _TOKEN.findall(text)
        raw.append(".")
        keys.append(key)
        ends.append(len(raw))
        if len(raw) >= least:
            yield keys, raw, ends
            keys, raw, ends = [], [], []
    if keys:
        yield keys, raw, ends


#: Raw tokens that a task remembers at most; it starts anew beyond that.
REMEMBERED = 300_000


def _window_rows(
    batches: Iterator[pa.RecordBatch], width: int, min_literals: int, widths: dict[int, list[int]] | None, bitmap,
) -> Iterator[pa.RecordBatch]:
    """Windows of each text in each reading. ``widths`` None: one width, or the whole text if shorter (items); else all of the reading's (documents)."""
    vocabulary = Vocabulary()
    for batch in batches:
        rows = []
        for keys, raw, ends in _parts(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())):
            if len(vocabulary) > REMEMBERED:
                vocabulary = Vocabulary()
            tokens = raw, np.fromiter(map(vocabulary.__getitem__, raw), np.int64, len(raw))
            for reading in READINGS if widths is None else widths:
                t = Template("", vocabulary, reading, tokens)
                of = np.searchsorted(ends, t.at, "right")                             # number of each token's text
                n = np.bincount(of, minlength=len(keys))
                first, own = np.cumsum(n) - n, np.minimum(n, width)
                if widths is None and reading == WORDS:                               # no items of mere numbers and units
                    worded = np.isin(vocabulary.kind[tokens[1][t.at]], (_LITERAL, _TITLE))
                    own = np.where(np.bincount(of, worded, len(keys)) > 0, own, 0)
                for w in widths[reading] if widths is not None else np.unique(own[own > 0]).tolist():
                    start, h = t.windows(w, min(min_literals, w))
                    if bitmap is not None:
                        bit = h & np.uint64(MAP_BITS - 1)
                        hit = (bitmap.value[(bit >> np.uint64(6)).astype(np.int64)] >> (bit & np.uint64(63))) & np.uint64(1) > 0
                        start, h = start[hit], h[hit]
                    inside = of[start] == of[start + w - 1]
                    if widths is None:
                        inside &= own[of[start]] == w
                    start, h = start[inside], h[inside]
                    at = of[start]
                    for s, x, a in zip(start.tolist(), h.view(np.int64).tolist(), at.tolist()):
                        rows.append((keys[a], reading, x, s - int(first[a]), int(n[a]), *t.shown(s, w)))
        for i in range(0, len(rows), 4096):
            yield pa.RecordBatch.from_pylist([dict(zip(_WINDOW.names, r)) for r in rows[i:i + 4096]], pa.schema([
                ("key", pa.int64()), ("reading", pa.int32()), ("hash", pa.int64()), ("at", pa.int64()), ("tokens", pa.int64()), ("template", pa.string()),
                ("slots", pa.list_(pa.string()))]))


def _bitmap(spark: SparkSession, windows: DataFrame):
    """The map of the items' windows; it spares the join windows of documents that no item has."""
    found = hash_map(windows.select("hash")).collect()                                # at most MAP_BITS / 64 rows: 1 MB
    bits = np.zeros(MAP_BITS >> 6, np.int64)
    bits[[r["word"] for r in found]] = [r["bits"] for r in found]
    return spark.sparkContext.broadcast(bits.view(np.uint64))


def matches(
    docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text",
    width: int = 8, min_literals: int = 4, min_tokens: int = 13,
) -> DataFrame:
    """Documents that hold a benchmark item, also with other numbers, names or units.

    Texts become templates: a number is ``<number>``, a unit beside a number ``<unit>``, a run of
    capitalised words inside a sentence ``<name>``; case, punctuation and line breaks go. Windows of
    ``width`` template tokens with at least ``min_literals`` literal words are joined by hash and
    template. What is a name depends on case and on what stands before it; so texts are also read with
    names as words, wherever lines break, and joined likewise; and as plain words and numbers, all
    windows of ``width`` joined, so a copy of the whole item is found whatever its length, numbers, names and case. Matched windows of one document, item and shift between them must fill the
    item's slots consistently: the same value wherever the item repeats one, different
    values where it has different ones. What is left must cover ``min_tokens`` tokens of the
    item, or all of a shorter item; in the other two readings it must be all of the item where slots of
    the pair did not agree, since a passage around them may.

    Returns ``key``, ``item``, ``n_windows``, ``covered_tokens``, ``item_tokens``, ``reparameterised`` (some slot
    holds another value than in the item, and no copy is whole and verbatim): one row for each
    contaminated document and item, by the first reading that is enough, in whose tokens it is counted.

    Items of fewer tokens than a window are one window of their own length; items of nothing but
    numbers and units match nothing. Null or empty texts match nothing. Rows without key cannot
    be told apart and count as one document, as do rows that repeat a key. A table of no
    rows on either side gives no rows. Other columns are ignored, whatever their names.
    """
    spark = docs.sparkSession
    arrow_batches(spark)
    plain_items = items.select(F.col(item).cast("bigint"), text_or_empty(item_text))
    of_items = staged(plain_items.mapInArrow(lambda b: _window_rows(b, width, min_literals, None, None), _WINDOW), "item_windows")
    # a width for each reading and length below the full one: at most ``width`` rows for each
    widths: dict[int, list[int]] = {}
    for r in of_items.select("reading", F.least("tokens", F.lit(width)).alias("w")).distinct().orderBy("reading", "w").collect():
        widths.setdefault(r["reading"], []).append(r["w"])
    bitmap = _bitmap(spark, of_items)
    plain = docs.select(F.col(key).cast("bigint"), text_or_empty(text))
    of_docs = plain.mapInArrow(lambda b: _window_rows(b, width, min_literals, widths, bitmap), _WINDOW)

    left = of_docs.select(F.col("key").alias("_doc"), "reading", "hash", "template", F.col("at").alias("_at"), F.col("slots").alias("_theirs"))
    right = of_items.select(
        F.col("key").alias("_item"), "reading", "hash", "template", F.col("at").alias("_from"), "tokens", F.col("slots").alias("_ours"))
    joined = left.join(right, ["reading", "hash", "template"]).withColumns(
        {"_shift": F.col("_at") - F.col("_from"), "_pairs": F.arrays_zip("_ours", "_theirs")})
    shifts = joined.groupBy("_doc", "_item", "reading", "tokens", "_shift").agg(
        F.collect_set("_from").alias("_starts"), F.array_distinct(F.flatten(F.collect_set("_pairs"))).alias("_slots"))
    ours, theirs = F.transform("_slots", lambda p: p["_ours"]), F.transform("_slots", lambda p: p["_theirs"])
    one_to_one = (F.size(F.array_distinct(ours)) == F.size("_slots")) & (F.size(F.array_distinct(theirs)) == F.size("_slots"))
    other = F.exists("_slots", lambda p: p["_ours"] != p["_theirs"])
    shifts = shifts.withColumns({"_fits": one_to_one, "_other": other})
    whole = shifts.groupBy("_doc", "_item", "reading", "tokens").agg(
        F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.when(F.col("_fits"), F.col("_starts")))))).alias("_starts"),
        F.max(F.when(F.col("_fits"), F.col("_other"))).alias("reparameterised"), F.max(~F.col("_fits")).alias("_clash"))
    span = F.least(F.lit(width).cast("bigint"), F.col("tokens"))
    gaps = F.transform("_starts", lambda s, i: F.when(i == 0, span).otherwise(F.least(span, s - F.get("_starts", i - 1))))
    covered = whole.withColumns(
        {"covered_tokens": F.aggregate(gaps, F.lit(0).cast("bigint"), lambda a, x: a + x), "n_windows": F.size("_starts")})
    found = covered.groupBy("_doc", "_item").agg(F.max("_clash").alias("_clash"), F.array_sort(F.collect_list(
        F.struct("reading", "n_windows", "covered_tokens", "tokens", "reparameterised"))).alias("_found"))

    def enough(f):
        most = f["covered_tokens"] >= F.least(F.lit(min_tokens).cast("bigint"), f["tokens"])
        return (f["covered_tokens"] == f["tokens"]) | (most & ((f["reading"] == TYPED) | ~F.col("_clash")))

    fine = F.filter("_found", enough)
    verbatim = F.filter(fine, lambda f: (f["reading"] == WORDS) & (f["covered_tokens"] == f["tokens"]))
    typed = F.get(F.filter(fine, lambda f: f["reading"] == TYPED), 0)
    first = F.coalesce(F.when(~typed["reparameterised"], typed), F.get(verbatim, 0), F.get(fine, 0))
    return found.withColumn("_first", first).where(F.col("_first").isNotNull()).select(
        F.col("_doc").alias(key), F.col("_item").alias(item), "_first.n_windows", "_first.covered_tokens",
        F.col("_first.tokens").alias("item_tokens"), "_first.reparameterised")


def clean(docs: DataFrame, items: DataFrame, key: str = "doc_id", **options) -> DataFrame:
    """The documents that hold no item, with all their columns.

    A document is named by a 64-bit hash of key and text, so rows that share a key, or have none, are judged
    by their own texts.
    """
    text = options.pop("text", "text")
    rows = docs.select(F.struct("*").alias("_row"), F.xxhash64(F.col(key).cast("bigint"), text_or_empty(text)).alias("_name"))
    found = matches(rows.select("_name", F.col(f"_row.{text}").alias("_text")), items, "_name", "_text", **options)
    kept = rows.join(found.select("_name").distinct(), "_name", "left_anti")
    return kept.select(*[F.col("_row")[c].alias(c) for c in docs.columns])
