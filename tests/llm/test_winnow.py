"""Marks, digests and likeness against a plain winnowing."""

import hashlib
import re
from collections import Counter

import xxhash
from pyspark.sql import functions as F

from flowwarden.llm import winnow
from tests.llm import helpers


def brute_marks(text, gram=winnow.GRAM, window=winnow.WINDOW):
    """(hash, place) of the smallest hash of each window, of equal ones the rightmost."""
    if not text:
        return []
    words = re.split(r"[ \t\n\x0b\f\r]+|(?<=[぀-ヿ㐀-鿿가-힯])", text)
    hashes = []
    for i in range(max(1, len(words) - gram + 1)):
        h = 42
        for w in words[i:i + gram]:
            h = xxhash.xxh64_intdigest(w.encode(), seed=h)
        hashes.append((h & 0xFFFFFFFF, i))
    out = []
    for i in range(max(1, len(hashes) - window + 1)):
        best = min(hashes[i:i + window], key=lambda x: (x[0], -x[1]))
        if not out or out[-1] != best:
            out.append(best)
    return out


def like(a, b):
    a, b = ({h for h, _ in brute_marks(t)} for t in (a, b))
    return len(a & b) / len(a | b) if a | b else 1.0


def test_marks_of_odd_documents(spark):
    rows = helpers.table(spark, [(i, t) for i, (_, t) in enumerate(helpers.nasty_texts())])
    got = {}
    for r in winnow.fingerprints(rows).collect():
        got.setdefault(r["doc_id"], []).append((r["hash"], r["place"]))
    for i, (_, t) in enumerate(helpers.nasty_texts()):
        assert got.get(i, []) == brute_marks(t), i
    assert winnow.fingerprints(helpers.empty(spark)).count() == 0


def test_other_widths(spark):
    text = dict(helpers.nasty_texts())[5]
    for gram, window in ((1, 1), (3, 7), (2, 5), (4, 100)):
        rows = winnow.fingerprints(helpers.table(spark, [(1, text)]), gram=gram, window=window).collect()
        assert [(r["hash"], r["place"]) for r in rows] == brute_marks(text, gram, window)


def test_rightmost_of_equal_hashes(spark):
    rows = winnow.fingerprints(helpers.table(spark, [(1, "a " * 20 + "a")]), gram=2, window=4).collect()
    assert [r["place"] for r in rows] == list(range(3, 20))


def test_long_matches_are_found(spark):
    shared = "one two three four five six seven eight"            # GRAM + WINDOW - 1 words
    a, b = (winnow.fingerprints(helpers.table(spark, [(1, t)])).select("hash") for t in (f"x y z {shared} p", f"{shared} q r s"))
    assert a.join(b, "hash").count() > 0


def check(spark, docs, blocks):
    rows = winnow.compared_with_edits(docs, blocks).collect()
    plain = [(r["doc_id"], r["text"] or "", r["_t"]) for r in docs.withColumn("_t", F.xxhash64(F.coalesce("text", F.lit("")))).collect()]
    order = sorted(plain, key=lambda r: (r[0] is not None, r[0] or 0, r[2]), reverse=True)
    want = []
    for (key, text, _), (_, following, _) in zip(order, order[1:] + order[:1]):
        half = len(text) // 2
        edited = text[:len(text) - half] + following[:half]
        want.append((key, len(text), hashlib.sha256(edited.encode()).hexdigest(), like(text, edited), like(text, following)))
    got = [(r["doc_id"], r["n_chars"], r["edited_sha256"], r["near_edited"], r["near_next"]) for r in rows]
    key = lambda r: str(r)
    assert sorted(got, key=key) == sorted(want, key=key)
    several = {k for k, n in Counter(k for k, _ in {(k, t) for k, t, _ in plain}).items() if n > 1}
    texts = {k: t for k, t, _ in plain if k is not None and k not in several}
    of = {}
    for r in rows:
        if r["doc_id"] in texts:
            of.setdefault(texts[r["doc_id"]], set()).add(r["fingerprint"])
    assert all(len(x) == 1 for x in of.values()) and len(of) == len(set(texts.values()))


def test_edits_of_odd_documents(spark):
    for blocks in (1, 4):
        check(spark, helpers.nasty(spark), blocks)
    check(spark, helpers.table(spark, [(3, "only one document here it is its own next")]), 4)
    assert winnow.compared_with_edits(helpers.empty(spark), 4).count() == 0


def test_op1(spark):
    check(spark, helpers.read(spark, "documents"), 7)


def test_native(spark):
    plan = winnow.compared_with_edits(helpers.nasty(spark), 4)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_rows_of_one_key_and_copies_spread_over_blocks(spark):
    rows = [(7, f"text {i} of the same key as all of the others") for i in range(300)]
    rows += [(None, f"text {i} without any key") for i in range(300)] + [(9, "the very same row of the table again")] * 300
    docs = helpers.table(spark, rows).repartition(5)
    check(spark, docs, 9)
    keyed = docs.select("doc_id", F.xxhash64("text").alias("tie"), F.monotonically_increasing_id().alias("copy"))
    keyed = spark.createDataFrame(keyed.collect(), keyed.schema)                      # the same each time it is read
    order = ["doc_id", "tie", "copy"]
    got = winnow.with_next(keyed, order, order, 9)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Window") == 1 and "RepartitionByExpression" in plan
    down = sorted((tuple(r) for r in keyed.collect()), key=lambda r: (r[0] is not None, r[0] or 0, *r[1:]), reverse=True)
    want = [(*a, *b) for a, b in zip(down, down[1:] + down[:1])]
    assert sorted(map(str, want)) == sorted(str(tuple(r)) for r in got.collect())
    firsts = keyed.repartitionByRange(9, *[F.desc_nulls_last(c) for c in order]).groupBy(F.spark_partition_id()).count().collect()
    assert len(firsts) > 6 and max(r["count"] for r in firsts) < 250
