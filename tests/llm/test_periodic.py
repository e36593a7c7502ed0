"""Runs against a plain search over all starts and periods."""

import hashlib
import random
import zlib
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from flowwarden.llm import periodic, queries
from tests.llm import helpers


def brute(words):
    """All runs: every period, every maximal stretch of words equal that far on; of equal stretches the smallest period."""
    n, found = len(words), {}
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j + q - i >= max(6, 4 * q):
                found.setdefault((i, j + q - i), q)
            i = j
    return sorted(((s, length, q) for (s, length), q in found.items()), key=lambda r: (r[0], r[2]))


def collapsed(words, found):
    gone = {i for s, length, q in found for i in range(s + q, s + length)}
    return b" ".join(w for i, w in enumerate(words) if i not in gone)


def planted(doc_id, words):
    h = zlib.crc32(str(doc_id).encode())
    if h % 10 or not words:
        return words
    g, n = h // 10, len(words)
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + (i - a) % p] for i in range(a, n)]


def periodic_words(rng, n):
    """Words from a small alphabet with repeated blocks of many lengths, some nested or adjoining."""
    out = []
    while len(out) < n:
        block = [rng.choice("abcdefgh"[:rng.randint(1, 8)]) for _ in range(int(2 ** rng.uniform(0, 7)))]
        out += block * rng.choice([1, 1, 2, 4, 5, 9]) + block[:rng.randrange(len(block))]
    return [w.encode() for w in out[:n]]


@pytest.mark.parametrize("seed", range(12))
def test_runs_of_words(seed):
    rng = random.Random(seed)
    texts = [periodic_words(rng, rng.choice([0, 3, 6, 30, 400, 1500])) for _ in range(12)]
    words, ids, begins = periodic.numbered([b" ".join(t) for t in texts])
    assert words == texts
    found = periodic.runs(ids, max(map(len, texts)))
    want = [(s + int(b), length, q) for t, b in zip(texts, begins) for s, length, q in brute(t)]
    assert [tuple(r) for r in found.tolist()] == want


@pytest.mark.parametrize("q", [1, 2, 7, 8, 9, 15, 16, 17, 31, 32, 33, 100, 127, 128, 129, 500])
def test_exactly_four_periods(q):
    block = [f"w{i}".encode() for i in range(q)]
    for extra in (0, 1, q - 1, -1):
        text = [b"x", b"y", *(block * 5)[:4 * q + extra], b"z"]
        _, ids, _ = periodic.numbered([b" ".join(text)])
        want = [(2, 4 * q + extra, q)] if extra >= 0 and 4 * q + extra >= 6 else []
        assert [tuple(r) for r in periodic.runs(ids, len(text)).tolist()] == want, (q, extra)


def test_leftmost_minima():
    grams = np.array([5, 3, 3, 9, 1, 1, 7], np.uint64)
    assert periodic.minimizers(grams, 2).tolist() == [1, 2, 4, 5]
    assert periodic.minimizers(grams, 7).tolist() == [4] and periodic.minimizers(grams, 8).tolist() == []


def test_odd_documents(spark):
    rows = periodic.periodic_runs(helpers.nasty(spark), F.col("text")).collect()
    want = []
    for i, t in helpers.nasty_texts():
        words = (t or "").encode().split()
        found = brute(words)
        want.append((i, len(words), found, collapsed(words, found).decode()))
    got = [(r["doc_id"], r["n_words"], [tuple(x) for x in r["runs"]], r["collapsed"]) for r in rows]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    assert periodic.periodic_runs(helpers.empty(spark), F.col("text")).count() == 0


def test_strongest_run(spark):
    rows = [([(0, 8, 2), (9, 40, 10), (60, 13, 3)],), ([],), ([(5, 1 << 40, (1 << 38) - 1), (6, 4, 1)],)]
    best = spark.createDataFrame(rows, "runs array<struct<start:bigint,length:bigint,period:bigint>>").select(
        periodic.strongest(F.col("runs")).alias("b")).collect()
    assert [tuple(r["b"]) if r["b"] else None for r in best] == [(60, 13, 3), None, (5, 1 << 40, (1 << 38) - 1)]


def test_op12(spark):
    docs = helpers.read(spark, "documents").collect()
    got = {r["doc_id"]: r for r in queries.op12_periodic_runs(spark, helpers.SF).collect()}
    assert len(got) == len(docs)
    some = 0
    for d in docs:
        words = planted(d["doc_id"], (d["text"] or "").encode().split())
        found, r = brute(words), got[d["doc_id"]]
        some += bool(found)
        best = max(found, key=lambda x: (Fraction(x[1], x[2]), -x[0], -x[2]), default=None)
        assert (r["start"], r["length"], r["period"]) == (best or (None,) * 3), d["doc_id"]
        assert r["exponent_milli"] == (best and 1000 * best[1] // best[2]) and r["n_runs"] == len(found) and r["n_words"] == len(words)
        assert r["runs_sha256"] == hashlib.sha256("".join(f"{s},{length},{q}\n" for s, length, q in found).encode()).hexdigest()
        assert r["collapsed_sha256"] == hashlib.sha256(collapsed(words, found)).hexdigest()
    assert some > 5


def test_planted_period_of_odd_documents(spark):
    rows = [(i, t) for i, (_, t) in enumerate(helpers.nasty_texts())] + [(None, "a b"), (33, None), (3, "a b c"), (7, "")]
    got = queries.with_planted_period(helpers.table(spark, rows)).collect()
    chosen = lambda i: i is not None and zlib.crc32(str(i).encode()) % 10 == 0
    assert any(chosen(i) for i, _ in rows)
    want = [(i, b" ".join(planted(i, t.encode().split())).decode() if chosen(i) and (t or "").split() else t) for i, t in rows]
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)
