"""Shards against a sort, packing against the tokenizers library and a round trip."""

import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from flowwarden.llm import packing, queries, sharding
from tests.llm import helpers

FILE = public_tokenizers.path("byte_bpe_50k.json")


def check_shards(rows, sizes, n):
    order = sorted(rows, key=lambda r: (r["shard"], r["slot"]))
    assert [r["start"] for r in order] == list(np.cumsum([r["size"] for r in order]) - [r["size"] for r in order])
    keys = [(r["doc_id"] is not None, r["doc_id"] or 0) for r in order]
    assert keys == sorted(keys)
    total = sum(r["size"] for r in rows)
    assert all(r["shard"] == min((2 * r["start"] + r["size"]) * n // (2 * total), n - 1) for r in rows)
    by = defaultdict(list)
    for r in order:
        by[r["shard"]].append(r["slot"])
    assert all(s == list(range(len(s))) for s in by.values())
    assert sorted((r["doc_id"] is not None, r["doc_id"] or 0, r["size"]) for r in rows) == sorted(sizes)


def test_shards_of_odd_documents(spark):
    rows = sharding.byte_shards(helpers.nasty(spark), "doc_id", F.octet_length("text") + 16, 5).collect()
    check_shards(rows, [(i is not None, i or 0, len(t.encode()) + 16 if t is not None else 0) for i, t in helpers.nasty_texts()], 5)


def test_no_rows_no_shards(spark):
    assert sharding.byte_shards(helpers.empty(spark), "doc_id", F.lit(16), 5).count() == 0


def test_op7(spark):
    docs = helpers.read(spark, "documents").collect()
    rows = queries.op7_sharding(spark, helpers.SF).collect()
    check_shards(rows, [(True, d["doc_id"], len((d["text"] or "").encode()) + 16) for d in docs], 40)
    crc = {d["doc_id"]: zlib.crc32((d["text"] or "").encode()) for d in docs}
    assert all(r["text_crc32"] == crc[r["doc_id"]] and r["law"] == "bytes" and r["grown_shard"] is None for r in rows)


def check_pieces(pieces, texts, window):
    """Every id in one piece, windows gapless and full but for the last."""
    tokenizer = Tokenizer.from_file(FILE)
    want = sorted(np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 0], "<u4").tobytes() for t in texts)
    order = sorted(pieces, key=lambda p: (p["sequence_id"], p["offset"]))
    docs, now = [], b""
    for p in order:
        assert p["start"] * 4 == len(now) and p["length"] * 4 == len(p["ids"]) and p["continued"] == (p["start"] > 0)
        now += p["ids"]
        assert p["continues"] == (len(now) < 4 * p["doc_tokens"])
        if not p["continues"]:
            docs.append(bytes(now))
            now = b""
    assert now == b"" and sorted(docs) == want
    at = np.cumsum([p["length"] for p in order]) - [p["length"] for p in order]
    assert all(p["sequence_id"] == a // window and p["offset"] == a % window for p, a in zip(order, at.tolist()))


def test_packing_of_odd_documents(spark):
    pieces = packing.pack(helpers.nasty(spark), FILE, 64).collect()
    check_pieces(pieces, [t for _, t in helpers.nasty_texts()], 64)
    assert packing.pack(helpers.empty(spark), FILE).count() == 0


def test_padded_sequences(spark):
    pieces = packing.pack(helpers.nasty(spark), FILE, 64)
    whole = packing.sequences(pieces, 64, 7).orderBy("sequence_id").collect()
    assert all(len(r["ids"]) == 256 for r in whole) and all(r["length"] == 64 for r in whole[:-1])
    assert np.frombuffer(bytes(whole[-1]["ids"]), "<u4")[whole[-1]["length"]:].tolist() == [7] * (64 - whole[-1]["length"])


def test_op10(spark):
    docs = {d["doc_id"]: d["text"] or "" for d in helpers.read(spark, "documents").collect()}
    tokenizer = Tokenizer.from_file(FILE)
    ids = {k: [*tokenizer.encode(t, add_special_tokens=False).ids, 0] for k, t in docs.items()}
    rows = queries.op10_packing(spark, helpers.SF).collect()
    for r in rows:
        own = ids[r["doc_id"]]
        assert r["doc_tokens"] == len(own)
        assert r["ids_crc32"] == zlib.crc32(np.array(own[r["start"]:r["start"] + r["length"]], "<u4").tobytes())
    assert sum(r["length"] for r in rows) == sum(map(len, ids.values()))


def test_long_runs_of_blanks(spark):
    texts = [c * 1_000_050 + "end" for c in " \t\n"] + ["a" + " " * 1_000_050, "plain"]
    check_pieces(packing.pack(helpers.table(spark, list(enumerate(texts))), FILE).collect(), texts, 1024)
