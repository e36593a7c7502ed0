"""Removed bytes against a search for every string of 100 bytes."""

import hashlib

import numpy as np
import pytest
import xxhash

from flowwarden.llm import queries, suffix
from tests.llm import helpers


def brute(docs, length=suffix.LENGTH):
    """(bytes, kept, spans) of documents in order."""
    seen, out = set(), []
    for text in docs:
        gone, end = bytearray(len(text)), 0
        for i in range(len(text) - length + 1):
            s = text[i:i + length]
            if s in seen:
                gone[max(i, end):i + length] = b"\1" * (i + length - max(i, end))
                end = i + length
            seen.add(s)
        spans = sum(1 for i, g in enumerate(gone) if g and (not i or not gone[i - 1]))
        out.append((len(text), sum(gone), spans, bytes(b for b, g in zip(text, gone) if not g)))
    return out


def want_of(rows):
    """Rows of equal key and text are one document."""
    named = sorted({(k is not None, k or 0, t or "") for k, t in rows})
    kept = dict(zip(named, brute([t.encode() for _, _, t in named])))
    return sorted((k is not None, k or 0, *kept[k is not None, k or 0, t or ""]) for k, t in rows)


def got_of(df):
    return sorted((r["doc_id"] is not None, r["doc_id"] or 0, r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["kept"])) for r in df.collect())


@pytest.mark.parametrize("hot", [suffix.HOT, 1])
def test_odd_documents(spark, hot):
    assert got_of(suffix.remove_repeats(helpers.nasty(spark), hot=hot)) == want_of(helpers.nasty_texts())


def test_no_rows(spark):
    assert suffix.remove_repeats(helpers.empty(spark)).count() == 0


@pytest.mark.parametrize("crowd", [suffix.CROWD, 2])
def test_a_line_in_every_document(spark, monkeypatch, crowd):
    monkeypatch.setattr(suffix, "CROWD", crowd)
    rng = np.random.default_rng(2)
    word = lambda n: " ".join(f"{x:04x}" for x in rng.integers(0, 65536, n))
    short, long_ = word(15), word(40)                             # 74 and 199 bytes
    rows = [(i, f"{word(int(rng.integers(0, 30)))}\n{(short, long_)[i % 2]}\n{word(int(rng.integers(0, 30)))}") for i in range(300)]
    rows += [(1000 + i, rows[7][1][:150 + i] + word(9)) for i in range(40)]
    want = want_of(rows)
    for hot in (suffix.HOT, 20):
        assert got_of(suffix.remove_repeats(helpers.table(spark, rows).repartition(5), hot=hot)) == want


def test_op6(spark):
    docs = sorted((d["doc_id"], (d["text"] or "").encode()) for d in helpers.read(spark, "documents").collect())
    want = [(k, n, r, s, hashlib.sha256(kept).hexdigest()) for (k, _), (n, r, s, kept) in zip(docs, brute([t for _, t in docs]))]
    assert sorted(tuple(r) for r in queries.op6_suffix_dedup(spark, helpers.SF).collect()) == want


def test_segments_keep_every_string(monkeypatch):
    rng = np.random.default_rng(1)
    texts = [bytes(rng.integers(97, 100, int(n), dtype=np.uint8)) for n in (5, 0, 3000, 99, 100, 101, 7000, 0)]
    whole = suffix.anchors(texts)
    monkeypatch.setattr(suffix, "SEGMENT", 512)
    cut = suffix.anchors(texts)
    starts = lambda a: sorted((d, p - f + i, p) for d, p, n, f in zip(*[x.tolist() for x in a[:4]]) for i in range(f - n + 1))
    assert [x[:2] for x in starts(cut)] == [(d, s) for d, t in enumerate(texts) for s in range(len(t) - 99)]
    assert starts(whole) == starts(cut)


def test_multikey_order():
    rng = np.random.default_rng(3)
    words = rng.integers(0, 3, (500, 4)).astype(np.uint64)
    order = suffix.multikey_order(words)
    assert [tuple(words[i]) for i in order] == sorted(map(tuple, words))


def test_rows_of_one_key_whose_hashes_agree_in_part(spark):
    rng = np.random.default_rng(6)
    word = lambda n: bytes(rng.integers(97, 123, n, dtype=np.uint8)).decode()
    hashed = lambda t: xxhash.xxh64_intdigest(t.encode(), seed=42) & ((1 << 18) - 1)
    shared, other = word(200), word(250)
    copy = next(t for t in (f"{shared}{i}" for i in range(1 << 22)) if hashed(t) == hashed(other))
    for key in (5, None):
        rows = [(1 if key else None, shared), (key, copy), (key, other), (key, word(300))]
        rows = rows if key else [r for r in rows if r[1] != shared]
        assert got_of(suffix.remove_repeats(helpers.table(spark, rows))) == want_of(rows)
