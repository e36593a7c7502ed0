"""Gradients, accuracy on held-out rows and odd documents."""

import zlib

import numpy as np
from pyspark.sql import functions as F

from flowwarden.llm import quality, queries
from tests.llm import helpers


def test_gradients():
    rng = np.random.default_rng(0)
    p = {"W": rng.normal(size=(5, 4)), "b": rng.normal(size=4), "V": rng.normal(size=(4, 3)), "U": rng.normal(size=(4, 3)), "w": rng.normal(size=3),
         "c": rng.normal(size=4), "d": rng.normal(size=1)}
    x, starts, y = rng.normal(size=(9, 5)), np.array([0, 2, 6]), np.array([1.0, 0.0, 1.0])

    def loss(q):
        z = quality._forward(q, x, starts)[5]
        return np.mean(np.log1p(np.exp(z)) - y * z)

    g = quality._gradients(p, x, starts, y, 1.0)
    for k in p:
        for i in np.ndindex(p[k].shape):
            up, down = ({**p, k: p[k].copy()} for _ in range(2))
            up[k][i] += 1e-6
            down[k][i] -= 1e-6
            assert abs((loss(up) - loss(down)) / 2e-6 - g[k][i]) < 1e-6


def test_attention_finds_the_passage_that_counts():
    rng = np.random.default_rng(1)
    labels = rng.integers(0, 2, 1500)
    bags = [rng.normal(size=(rng.integers(3, 20), quality.N_FEATURES)).astype(np.float32) for _ in labels]
    for bag, y in zip(bags, labels):
        bag[rng.integers(len(bag)), 0] = 8.0 if y else -8.0
    model = quality.fit_bags(bags[:1200], labels[:1200])
    assert np.mean((quality.score_bags(model, bags[1200:]) > 0.5) == labels[1200:]) > 0.9


def test_passages_cover_the_whole_text():
    for t in ("", "x", "a b " * 5000, "y" * 100_000, "日本語" * 2000, "\n" * 3000):
        bag = quality.encode(t)
        assert 1 <= len(bag) <= quality.PASSAGES + 1 and np.isfinite(bag).all()
    a, b = quality.encode("good words here " * 4000), quality.encode("good words here " * 3999 + "BAD!!! " * 3)
    assert not np.array_equal(a[-1], b[-1])


def test_odd_documents(spark):
    docs = helpers.nasty(spark)
    labels = spark.createDataFrame([(5, 1, 0), (9, 1, 0), (2, 0, 0), (12, 0, 1), (12, 0, 1), (13, None, 0), (None, 1, 0), (14, 7, 0)], "doc_id bigint, quality int, toxic int")
    for fitted in (labels, labels.where("quality = 1"), labels.limit(0)):
        rows = quality.score(docs, quality.fit(docs, fitted)).collect()
        assert len(rows) == len(helpers.nasty_texts()) and all(0 <= r["score"] <= 1 for r in rows)
        by = {}
        for r in rows:
            by.setdefault(r["doc_id"], set()).add(r["score"])
        assert by[5] == by[9] and by[7] == by[8] and len(by[23]) == 1
    assert quality.score(helpers.empty(spark), quality.Model(0.5)).count() == 0


def test_folds(spark):
    rows = helpers.nasty(spark).select("doc_id", quality.fold().alias("fold")).collect()
    assert all(r["fold"] == (zlib.crc32(str(r["doc_id"]).encode()) if r["doc_id"] is not None else 0) % 5 for r in rows)


def test_op8_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.01"
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    rows = queries.op8_quality(spark, sf)
    assert rows.count() == queries.documents(spark, sf).count()
    held = [(r["predicted"], labels[r["doc_id"]]) for r in rows.where(F.col("held_out")).collect() if r["doc_id"] in labels]
    assert len(held) > 50 and np.mean([p == y for p, y in held]) > 0.95
