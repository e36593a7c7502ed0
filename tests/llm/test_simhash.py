"""Fingerprints bit by bit, groups against all pairs."""

import random
import re

import numpy as np
import xxhash

from flowwarden.llm import components, queries, simhash
from tests.llm import helpers


def brute_print(text, n=4):
    words = re.findall(rb"[^\x20\x09-\x0d]+", (text or "").encode().translate(bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))))
    if not words:
        return 0
    hashes = [xxhash.xxh64(b" ".join(words[i:i + n]), seed=42).intdigest() for i in range(max(1, len(words) - n + 1))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_groups(prints, distance):
    """print -> smallest print reachable."""
    todo, of = set(prints), {}
    for p in sorted(todo):
        if p in of:
            continue
        stack = [p]
        while stack:
            x = stack.pop()
            if x not in of:
                of[x] = p
                stack += [y for y in todo if (x ^ y).bit_count() <= distance]
    return of


def check(rows, docs, distance=4):
    prints = [(k, brute_print(t)) for k, t in docs]
    of = brute_groups({p for _, p in prints}, distance)
    least = {}
    for k, p in prints:
        if k is not None:
            least[of[p]] = min(k, least.get(of[p], k))
    key = lambda r: tuple((x is not None, x or 0) for x in r)
    assert sorted(((r[0], r[1], r[2]) for r in rows), key=key) == sorted(((k, p, least.get(of[p])) for k, p in prints), key=key)


def test_odd_documents(spark):
    rows = simhash.near_duplicates(helpers.nasty(spark)).collect()
    check([(r["doc_id"], r["fingerprint"] % (1 << 64), r["component_id"]) for r in rows], helpers.nasty_texts())
    assert simhash.near_duplicates(helpers.empty(spark)).count() == 0


def test_op9(spark):
    rows = queries.op9_simhash(spark, helpers.SF).collect()
    docs = [(d["doc_id"], d["text"]) for d in helpers.read(spark, "documents").collect()]
    check([(r["doc_id"], int(r["fingerprint"], 16), r["component_id"]) for r in rows], docs)


def linked(spark, prints, distance):
    df = spark.createDataFrame([(int(np.uint64(p).view(np.int64)),) for p in prints], "print bigint")
    edges = simhash.links(df, distance)
    found = {r["node"]: r["root"] for r in components.components(edges).collect()}
    groups = {}
    for p in prints:
        k = int(np.uint64(p).view(np.int64))
        groups.setdefault(found.get(k, k), set()).add(p)
    return sorted(map(sorted, groups.values()))


def clusters(seed, n, flips):
    rng = random.Random(seed)
    out = set()
    while len(out) < n:
        p = rng.getrandbits(64)
        for _ in range(rng.randint(1, 12)):
            out.add(p)
            for b in rng.sample(range(64), rng.randint(0, flips)):
                p ^= 1 << b
    return out


def test_links_lose_nothing(spark):
    for distance in (1, 3, 4, 6):
        prints = clusters(distance, 600, distance + 2)
        of = brute_groups(prints, distance)
        want = {}
        for p, r in of.items():
            want.setdefault(r, []).append(p)
        assert linked(spark, prints, distance) == sorted(map(sorted, want.values()))


def test_hot_buckets_are_cut_in_blocks(spark, monkeypatch):
    rng = random.Random(4)
    centre = rng.getrandbits(64)
    prints = {centre ^ sum(1 << b for b in rng.sample(range(30), rng.randint(0, 9))) for _ in range(500)} | clusters(9, 100, 3)
    want = linked(spark, prints, 4)
    monkeypatch.setattr(simhash, "BLOCK", 16)
    assert linked(spark, prints, 4) == want
    of = brute_groups(prints, 4)
    assert len(want) == len(set(of.values()))


def test_few_fingerprints_beside_a_hot_bucket(spark, monkeypatch):
    """Many fingerprints lack one bit of the only fingerprint of a bucket, and so all reach it."""
    rng = random.Random(6)
    ring = simhash.Ring(4)
    first, second = ring.segments[:2]
    bit = second & -second
    centre = (rng.getrandbits(64) & ~(first | second)) | first | bit
    loose = [b for b in range(64) if not (first | second) >> b & 1]
    far = {(centre ^ bit) ^ sum(1 << b for b in rng.sample(loose, rng.randint(6, 20))) for _ in range(400)}
    near = {(centre ^ bit) ^ sum(1 << b for b in rng.sample(loose, 3)) for _ in range(40)}
    prints = {centre} | far | near
    want = linked(spark, prints, 4)
    monkeypatch.setattr(simhash, "BLOCK", 16)
    assert linked(spark, prints, 4) == want and len(want) == len(set(brute_groups(prints, 4).values()))
    df = spark.createDataFrame([(int(np.uint64(p).view(np.int64)),) for p in prints], "print bigint")
    cells = simhash.groups(df, ring).groupBy("bucket", "cell").count().collect()
    assert max(r["count"] for r in cells) < 5 * 16
    of_centre = int(next(ring.buckets(np.array([centre], np.uint64)))[0][0])
    assert sum(r["count"] for r in cells if r["bucket"] == of_centre) < 2 * len(prints)      # dealt out, not multiplied


def test_components_of_a_long_path(spark):
    edges = [(i, i + 1) for i in range(300)] + [(1000, 1001), (1003, 1001), (7, 7)]
    got = {r["node"]: r["root"] for r in components.components(spark.createDataFrame(edges, "u bigint, v bigint")).collect()}
    assert got == {i: 0 for i in range(1, 301)} | {1001: 1000, 1003: 1000}
