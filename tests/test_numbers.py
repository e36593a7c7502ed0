import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from flowwarden.operators import evaluate as E
from flowwarden.operators import prepare as P
from flowwarden.operators.ranking import exact_quantiles, running_totals


@pytest.mark.parametrize("levels,fanout", [(1, 1024), (1, 7), (3, 4)])
def test_running_totals(spark, levels, fanout):
    rng = random.Random(1)
    rows = [(k, g, rng.randrange(9)) for g in "ab" for k in rng.sample(range(500), 120)]
    got = running_totals(spark.createDataFrame(rows, "k long, g string, n long"), "k", ["n"], ["g"], fanout, levels).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r["n_before"] == sum(n for k, g, n in rows if g == r["g"] and k < r["k"])
        assert r["n_upto"] == r["n_before"] + r["n"]


@pytest.mark.parametrize("accuracy, limit", [(20, 1 << 16), (20, 300), (100, 500), (10000, 100)])
def test_exact_quantiles(spark, accuracy, limit):
    rng = np.random.default_rng(3)
    groups = {
        "one": [4.0], "two": [1.0, 2.0], "few": list(map(float, range(7))), "odd": rng.normal(size=151).tolist(),
        "hot": [5.0] * 900 + rng.normal(size=450).tolist(), "big": np.floor(rng.exponential(1000, 3000)).tolist(),
    }
    rows = [(g, v) for g, vs in groups.items() for v in vs] + [("few", None)]
    df = spark.createDataFrame(rows, "g string, v double").repartition(7)
    wanted = {"q50": 0.5, "q99": 0.99, "q0": 0.0, "q100": 1.0, "q33": 0.33}
    got = {r["g"]: r for r in exact_quantiles(df, ["g"], "v", wanted, accuracy, limit).collect()}
    for g, vs in groups.items():
        for name, q in wanted.items():
            assert got[g][name] == pytest.approx(np.quantile(vs, q), abs=1e-9), (g, name)


def _scores(spark, rows):
    return spark.createDataFrame(rows, "intrusion_probability double, y int")


def test_auc_with_ties(spark):
    rows = [(0.1, 0), (0.1, 1), (0.1, 0), (0.5, 1), (0.5, 0), (0.5, 1), (0.9, 1), (0.9, 1), (0.9, 0), (0.5, 0)]
    pos, neg = [p for p, y in rows if y], [p for p, y in rows if not y]
    want = sum((a > b) + 0.5 * (a == b) for a in pos for b in neg) / (len(pos) * len(neg))
    df = _scores(spark, rows)
    assert E.roc_auc(df).first()[0] == pytest.approx(want, abs=1e-6)


def test_auc_full_precision_scores(spark):
    rng = np.random.default_rng(5)
    p = (rng.beta(0.1, 5, 2000) ** 3)                       # crowded near 0
    y = (rng.random(2000) < p ** 0.3).astype(int)
    df = _scores(spark, [(float(a), int(b)) for a, b in zip(p, y)])
    order = np.argsort(p)
    rank = np.empty(2000)
    rank[order] = np.arange(1, 2001)
    n1 = y.sum()
    want = (rank[y == 1].sum() - n1 * (n1 + 1) / 2) / (n1 * (2000 - n1))
    assert E.roc_auc(df).first()[0] == pytest.approx(want, abs=1e-6)
    coalesce = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(coalesce, "false")                       # as with many scores: several ranges
    try:
        totals = E.score_totals(df).collect()
        assert E.roc_auc(df).first()[0] == pytest.approx(want, abs=1e-6)
    finally:
        spark.conf.unset(coalesce)
    for r in totals[::50]:
        assert (r["pos_above"], r["neg_above"]) == (int((p[y == 1] > r["score"]).sum()), int((p[y == 0] > r["score"]).sum()))


def test_one_class(spark):
    df = _scores(spark, [(0.2, 1), (0.7, 1)])
    assert E.roc_auc(df).first()[0] is None
    assert [r["n"] for r in E.confusion_matrix(df, 0.5).orderBy("actual", "predicted").collect()] == [0, 0, 1, 1]
    m = E.eval_metrics(_scores(spark, [(0.0, 0)]), 0.5).first()
    assert (m["precision"], m["recall"], m["f1"], m["false_alarm_rate"]) == (0.0, 0.0, 0.0, 0.0)


def test_sweep_at_exact_steps(spark):
    rows = [(k / 100, k % 2) for k in range(1, 60)] + [(0.29, 1), (0.57, 0), (0.0, 1), (1.0, 1), (0.009999999, 0)]
    got = {round(r["threshold"], 2): (r["fn"], r["fp"]) for r in E.threshold_sweep(_scores(spark, rows)).collect()}
    for k in range(1, 51):
        t = k / 100
        assert got[t] == (sum(y == 1 and p < t for p, y in rows), sum(y == 0 and p >= t for p, y in rows)), t


def test_zero_miss_policies(spark):
    df = _scores(spark, [(0.35, 1), (0.8, 1), (0.2, 0), (0.4, 0)])
    assert E.zero_fn_threshold(df, "first").first()["threshold"] == 0.01
    best = E.zero_fn_threshold(df, "max").first()
    assert (best["threshold"], best["fn"], best["fp"]) == (0.35, 0, 1)
    missed = _scores(spark, [(0.001, 1), (0.5, 0)])
    assert E.zero_fn_threshold(missed, "max").first()["threshold"] == 0.01


def test_dashboard_defaults(spark):
    r = E.dashboard(spark.range(1)).first()
    assert (r["recall"], r["threshold"], r["accuracy"], r["status"]) == (1.0, 0.12, 0.0, "online")


@pytest.mark.parametrize("n_pos,n_neg", [(37, 63), (1, 99), (5, 6), (0, 10), (333, 667)])
def test_split_is_exact_and_stable(spark, n_pos, n_neg):
    rows = [(i, int(i < n_pos)) for i in range(n_pos + n_neg)]
    df = spark.createDataFrame(rows, "flow_id long, y int")
    assert "Exchange" not in P.stratified_split(df)._jdf.queryExecution().executedPlan().toString()
    first = {r["flow_id"]: r["is_test"] for r in P.stratified_split(df.repartition(3)).collect()}
    again = {r["flow_id"]: r["is_test"] for r in P.stratified_split(df.coalesce(1)).collect()}
    assert first == again and len(first) == len(rows)
    n_test = -(-len(rows) // 5)
    assert sum(first.values()) == n_test
    pos = sum(first[i] for i in range(n_pos))
    assert abs(pos - n_test * n_pos / len(rows)) < 1


@pytest.mark.parametrize("sorted_hashes", [1, 40, 1 << 16])
def test_split_selects_digit_by_digit(spark, sorted_hashes):
    rows = [(i, i % 3) for i in range(9000)]
    keyed = spark.createDataFrame(rows, "flow_id long, y int").withColumn("_h", P.split_hash()).select("y", "_h")
    cuts = P.split_cuts(keyed, 0.3, "y", sorted_hashes)
    hashes = [(y, hashlib.md5(f"42:{i}".encode()).hexdigest()) for i, y in rows]
    assert cuts == {c: sorted(h for y, h in hashes if y == c)[899] for c in range(3)}


def test_split_of_odd_tables(spark):
    schema = "flow_id long, y int"
    assert P.stratified_split(spark.createDataFrame([], schema)).count() == 0
    copies = P.stratified_split(spark.createDataFrame([(7, 1)] * 50 + [(i, 0) for i in range(50)], schema), 0.2).collect()
    assert len({r["is_test"] for r in copies if r["flow_id"] == 7 and r["y"] == 1}) == 1
    nulls = P.stratified_split(spark.createDataFrame([(None, 1)] * 10 + [(i, None) for i in range(10)] + [(99, 1)], schema), 0.5).collect()
    assert [r["flow_id"] for r in nulls if r["is_test"]] == [99]


def test_scaler_constant_column(spark):
    df = spark.createDataFrame([(1, 3.0, 1.0), (2, 3.0, 2.0), (3, 3.0, 6.0)], "flow_id long, a double, b double")
    scaler = P.collect_scaler(df, ["a", "b"])
    assert scaler["b"] == (3.0, pytest.approx(np.std([1, 2, 6])))
    rows = P.scale_flows(df, scaler).orderBy("flow_id").collect()
    assert [r["a"] for r in rows] == [0.0, 0.0, 0.0]
    assert rows[2]["b"] == pytest.approx(3 / np.std([1, 2, 6]))


def test_clean_order(spark):
    rows = [(1, "a", 5), (1, "a", 5), (1, "a", 6), (None, "b", 1)]
    out = P.clean_flows(spark.createDataFrame(rows, "x int, class string, difficulty int"))
    assert out.columns == ["x", "class"] and out.count() == 2      # rows apart in difficulty only both stay


def test_conform_and_encode(spark):
    df = spark.createDataFrame([(1, 7, "zzz", "extra")], "flow_id long, src_bytes long, service string, other string")
    c = P.conform_flows(df)
    assert c.columns == ["flow_id", *P.NUMERIC_FEATURES, *P.CATEGORICAL_FEATURES]
    row = c.first()
    assert row["src_bytes"] == 7.0 and row["duration"] == 0.0 and row["flag"] == ""
    hot = P.one_hot(c, {"protocol_type": ["tcp"], "service": ["ftp", "http"], "flag": ["SF"]}, ["src_bytes"])
    assert hot.columns == ["flow_id", "src_bytes", "protocol_type_tcp", "service_ftp", "service_http", "flag_SF"]
    assert list(hot.first())[2:] == [0.0, 0.0, 0.0, 0.0]


def test_vocabulary_limit_is_an_error(spark):
    df = spark.range(50).select(F.col("id").cast("string").alias("service"))
    with pytest.raises(ValueError):
        P.collect_vocab(df, ["service"], limit=20)


def test_sparse_encoding_of_any_number_of_values(spark):
    """100,000 values of one column, a value that a third of the rows hold, nulls and values unseen in training."""
    rows = spark.range(150_000).selectExpr(
        "id AS flow_id", "double(id) AS n", "CASE WHEN id % 3 = 0 THEN 'hot' WHEN id % 1000 = 1 THEN NULL ELSE concat('v', id) END AS service",
        "CASE WHEN id % 2 = 0 THEN 'a' ELSE 'b' END AS flag")
    index = P.vocab_index(rows, ["service", "flag"], first=1)
    values = index.orderBy("index").collect()
    assert [r["index"] for r in values] == list(range(1, len(values) + 1)) and len(values) > 99_000
    assert [(r["column"], r["value"]) for r in values][-2:] == [("flag", "a"), ("flag", "b")]
    names = [r["value"] for r in values[:-2]]
    assert names == sorted(names)
    place = {(r["column"], r["value"]): r["index"] for r in values}
    other = rows.union(spark.createDataFrame([(-1, None, "never", None)], "flow_id long, n double, service string, flag string"))
    previous = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")            # as where the vocabulary is large
    try:
        got = {r["flow_id"]: (r["indices"], r["values"]) for r in P.one_hot_sparse(other, index, ["n"]).collect()}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", previous)
    assert len(got) == 150_001 and got[-1] == ([0], [None])
    assert got[1] == ([0, place["flag", "b"]], [1.0, 1.0])                  # null service
    for i in (0, 2, 3, 77_777):
        service = "hot" if i % 3 == 0 else f"v{i}"
        assert got[i] == ([0, place["service", service], place["flag", "ab"[i % 2]]], [float(i), 1.0, 1.0])


def test_sparse_encoding_is_one_hot(spark):
    df = spark.createDataFrame([(1, 2.0, "x", "q"), (2, 3.0, "y", "p"), (3, 0.0, None, "q")], "flow_id long, n double, service string, flag string")
    vocab = P.collect_vocab(df, ["service", "flag"])
    wide = {r["flow_id"]: list(r)[1:] for r in P.one_hot(df, vocab, ["n"]).collect()}
    for r in P.one_hot_sparse(df, P.vocab_index(df, ["service", "flag"], first=1), ["n"]).collect():
        dense = [0.0] * len(wide[1])
        for i, v in zip(r["indices"], r["values"]):
            dense[i] = v
        assert dense == wide[r["flow_id"]]
    none = df.where("false")
    assert P.one_hot_sparse(none, P.vocab_index(none, ["service", "flag"], first=1), ["n"]).count() == 0


def test_scaler_does_not_depend_on_the_order_of_sums(spark):
    values = [0.1 * i for i in range(400)] + [1e9, 3e-7, 259.2396] * 50
    expect = None
    for parts in (1, 3, 7):
        df = spark.createDataFrame([(v,) for v in (values if parts != 3 else values[::-1])], "x double").repartition(parts)
        row = P.scaler_stats(df, ["x"]).first()
        expect = expect or row
        assert (row["mean"], row["std"]) == (expect["mean"], expect["std"])
    assert row["mean"] == pytest.approx(sum(values) / len(values)) and row["std"] == pytest.approx(np.std(values))
    huge = spark.createDataFrame([(1e25,), (3e25,)], "x double")
    assert P.scaler_stats(huge, ["x"]).first()["mean"] == pytest.approx(2e25)
    assert P.scaler_stats(huge.where("false"), ["x"]).first()["mean"] is None
