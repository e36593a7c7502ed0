"""Concatenate and cut: fixed token windows over all documents laid end to end."""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window as W, functions as F, types as T

from ..session import ship_functions
from .common import arrow_batches, staged, text_or_empty

ship_functions(__name__)

def byte_bpe(tokenizer_file: str) -> Callable[[str], np.ndarray]:
    """Encoder for a byte-level BPE file: a text to its ids.

    The ids are those of ``Tokenizer.from_file(tokenizer_file).encode(text, add_special_tokens=False)``.
    That call takes four to five times as long, so the file's vocabulary, whose ids are
    merge ranks, is given to the faster of the two installed libraries for it, and the slower one
    takes the texts that the faster can not split. A worker
    process outlives its tasks and keeps the encoder.
    """
    encoders = vars(sys).setdefault("_flowwarden_encoders", {})
    if tokenizer_file not in encoders:
        import json

        import tiktoken
        from public_tokenizers import PATTERN
        from tokenizers import Tokenizer

        with open(tokenizer_file, encoding="utf-8") as f:
            spec = json.load(f)
        special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]            # bytes written as themselves
        byte_of = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(sorted({*range(256)} - {*shown}))}
        ranks = {bytes(map(byte_of.__getitem__, token)): i for token, i in spec["model"]["vocab"].items() if token not in special}
        bpe = tiktoken.Encoding("bpe", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=special)

        def encode(text: str) -> np.ndarray:
            try:
                return bpe.encode_to_numpy(text, allowed_special="all")
            except ValueError:                          # its matcher has a stack limit, met by some 10^6 blanks in a row
                return np.array(whole().encode(text, add_special_tokens=False).ids, np.uint32)

        @cache
        def whole() -> Tokenizer:
            return Tokenizer.from_file(tokenizer_file)

        encoders[tokenizer_file] = encode
    return encoders[tokenizer_file]


_TOKENS = T.StructType([
    T.StructField("_key", T.LongType()), T.StructField("_ids", T.BinaryType()), T.StructField("_n", T.LongType()),
    T.StructField("_local", T.LongType()), T.StructField("_part", T.IntegerType())])


def _tokenise(batches: Iterator[pa.RecordBatch], tokenizer_file: str, end_id: int) -> Iterator[pa.RecordBatch]:
    encode, end = byte_bpe(tokenizer_file), np.array([end_id], "<u4").tobytes()
    part, total = TaskContext.get().partitionId(), 0
    for batch in batches:
        coded = [encode(text).astype("<u4").tobytes() + end for text in batch.column(1).to_pylist()]
        n = np.array([len(x) // 4 for x in coded], np.int64)
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(coded, pa.binary()), pa.array(n), pa.array(total + np.cumsum(n) - n), pa.array(np.full(len(n), part, np.int32))],
            names=_TOKENS.names)
        total += int(n.sum())


_PIECES = T.StructType([
    T.StructField("_key", T.LongType()), T.StructField("start", T.LongType()), T.StructField("length", T.LongType()),
    T.StructField("doc_tokens", T.LongType()), T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType()),
    T.StructField("continued", T.BooleanType()), T.StructField("continues", T.BooleanType()), T.StructField("ids", T.BinaryType())])


def _cut(batches: Iterator[pa.RecordBatch], window: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        key, n, at = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("_key", "_n", "_at"))
        first, last = at // window, (at + n - 1) // window
        pieces = last - first + 1
        doc = np.repeat(np.arange(len(n)), pieces)
        nth = np.arange(len(doc)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        sequence = first[doc] + nth
        begin, stop = np.maximum(sequence * window, at[doc]), np.minimum((sequence + 1) * window, (at + n)[doc])
        start, length = begin - at[doc], stop - begin
        raw = [x.as_py() for x in batch.column("_ids")]
        ids = [raw[d][4 * s:4 * (s + k)] for d, s, k in zip(doc.tolist(), start.tolist(), length.tolist())]
        # slices keep batches small where one document has very many pieces
        arrays = [batch.column("_key").take(pa.array(doc)), pa.array(start), pa.array(length), pa.array(n[doc]), pa.array(sequence),
                  pa.array(begin - sequence * window), pa.array(nth > 0), pa.array(nth < pieces[doc] - 1), pa.array(ids, pa.binary())]
        out = pa.RecordBatch.from_arrays(arrays, names=_PIECES.names)
        for i in range(0, out.num_rows, 4096):
            yield out.slice(i, 4096)


def pack(docs: DataFrame, tokenizer_file: str, window: int = 1024, end_id: int = 0, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Token windows of ``window`` ids over all documents; one row for each piece of a document.

    Pass one encodes every document (its ids, then ``end_id``) and writes ids, count and
    the tokens before it in its partition. Pass two turns the partitions' totals (one
    row each) into global offsets and cuts every document where a window ends. All
    windows but the last are full, so only the last needs padding.

    Columns: ``key``, ``start`` (ids of its document before the piece), ``length``, ``doc_tokens``,
    ``sequence_id``, ``offset`` (in its window), ``continued`` / ``continues`` (the document began in an
    earlier window / goes on in the next one), ``ids`` (little-endian 32-bit).

    Documents lie in the order of the table's files. Null or empty text: the end id alone.
    Long documents span many windows, repeated rows and null keys are packed like any
    others, no rows give no pieces, other columns are ignored.
    """
    arrow_batches(docs.sparkSession)
    plain = docs.select(F.col(key).cast("bigint").alias("_key"), text_or_empty(text).alias("_text"))
    tokens = staged(plain.mapInArrow(lambda b: _tokenise(b, tokenizer_file, end_id), _TOKENS), "tokens")
    totals = tokens.groupBy("_part").agg(F.sum("_n").alias("_total"))
    before = W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)       # one row for each partition
    offsets = totals.select("_part", F.coalesce(F.sum("_total").over(before), F.lit(0)).alias("_offset"))
    placed = tokens.join(F.broadcast(offsets), "_part").select("_key", "_ids", "_n", (F.col("_offset") + F.col("_local")).alias("_at"))
    return placed.mapInArrow(lambda b: _cut(b, window), _PIECES).withColumnRenamed("_key", key)


def sequences(pieces: DataFrame, window: int = 1024, pad_id: int = 0) -> DataFrame:
    """The padded windows themselves: ``sequence_id``, ``length`` and ``ids`` of exactly ``window`` ids.

    A window gathers at most ``window`` pieces, whatever the documents.
    """
    pad = np.array([pad_id] * window, "<u4").tobytes()
    parts = F.sort_array(F.collect_list(F.struct("offset", "ids")))
    whole = F.aggregate(parts, F.lit(b""), lambda all_, p: F.concat(all_, p["ids"]))
    return pieces.groupBy("sequence_id").agg(F.sum("length").alias("length"), whole.alias("_ids")).select(
        "sequence_id", "length", F.substring(F.concat("_ids", F.lit(pad)), 1, 4 * window).alias("ids"))
