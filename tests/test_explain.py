from itertools import combinations
from math import factorial

import numpy as np
import pytest
from pyspark.sql import functions as F

from flowwarden.functions.category import category_of, feature_category
from flowwarden.functions.scorecard import DEFAULT_SCORECARD as CARD
from flowwarden.operators import detect as D
from flowwarden.operators import explain as X
from flowwarden.operators import model as M
from flowwarden.operators import tree_shap as S
from flowwarden.plans import queries as Q
from flowwarden.session import shared_folder

SF = "/root/testdata/sf0.001"


def test_scorecard_is_additive(spark):
    df = Q.explained(spark, SF).select(X.total_shap(CARD.features).alias("t"), CARD.margin().alias("m"))
    worst = df.agg(F.max(F.abs(F.col("t") + CARD.base_value - F.col("m")))).first()[0]
    assert worst < 1e-9


def test_native_importance_sums_to_one():
    assert sum(CARD.native_importance().values()) == pytest.approx(1.0)


@pytest.mark.parametrize("name,group", [
    ("dst_host_count", "Time-based Features"), ("dst_host_srv_serror_rate", "Time-based Features"),
    ("dst_host_same_srv_rate", "Host-based Features"), ("service_http", "Basic Flow Features"), ("hot", "Connection Metrics"),
    ("land", "Traffic Volume"), ("is_guest_login", "Content Features"), ("logged_in", "Other/Encoded"),
    ("same_srv_rate", "Other/Encoded"), ("num_failed_logins", "Connection Metrics")])
def test_category(spark, name, group):
    assert category_of(name) == group
    assert spark.range(1).select(feature_category(F.lit(name)).alias("c")).first()["c"] == group


def _value(nodes, at, x, known):
    feature, threshold, left, right, value, cover = nodes[at]
    if feature < 0:
        return value
    if feature in known:
        return _value(nodes, left if x[feature] <= threshold else right, x, known)
    return (nodes[left][5] * _value(nodes, left, x, known) + nodes[right][5] * _value(nodes, right, x, known)) / cover


def _brute_force(nodes, x, n):
    phi = np.zeros(n)
    for i in range(n):
        others = [j for j in range(n) if j != i]
        for k in range(n):
            for s in combinations(others, k):
                w = factorial(k) * factorial(n - 1 - k) / factorial(n)
                phi[i] += w * (_value(nodes, 0, x, set(s) | {i}) - _value(nodes, 0, x, set(s)))
    return phi


def _random_tree(rng, depth, n):
    nodes = {}

    def grow(at, level, cover):
        if level == depth or cover < 2 or rng.random() < 0.1:
            nodes[at] = (-1, 0.0, -1, -1, float(rng.normal()), float(cover))
            return
        left = int(rng.integers(1, cover))
        nodes[at] = (int(rng.integers(0, n)), float(rng.normal()), 2 * at + 1, 2 * at + 2, 0.0, float(cover))
        grow(2 * at + 1, level + 1, left)
        grow(2 * at + 2, level + 1, cover - left)

    grow(0, 0, 500)
    return nodes


@pytest.mark.parametrize("bits,depth", [(9, 4), (3, 4), (1, 3), (0, 3), (5, 7)])
def test_tree_attribution_equals_brute_force(monkeypatch, bits, depth):
    monkeypatch.setattr(S, "BITS", bits)         # fewer bits: more subtrees, and leaves deeper than a table
    monkeypatch.setattr(S, "BLOCK", 7)
    rng = np.random.default_rng(11)
    for _ in range(4):
        n = 5
        nodes = _random_tree(rng, depth, n)      # features repeat along paths
        x = rng.normal(size=(20, n))
        x[0, 1] = np.nan
        got = S.attribute(x, [nodes])
        for row, phi in zip(x, got):
            assert phi == pytest.approx(_brute_force(nodes, row, n), abs=1e-9)
            assert phi.sum() + S.expected_value([nodes]) == pytest.approx(_value(nodes, 0, row, set(range(n))), abs=1e-9)


def test_forest_attribution_is_the_sum_over_trees():
    rng = np.random.default_rng(5)
    forest, x = [_random_tree(rng, 8, 12) for _ in range(6)], rng.normal(size=(300, 12))
    got = S.attribute(x, forest)
    assert got == pytest.approx(sum(S.attribute(x, [nodes]) for nodes in forest), abs=1e-9)
    for row, phi in zip(x[:40], got):
        assert phi.sum() + S.expected_value(forest) == pytest.approx(sum(_value(nodes, 0, row, set(range(12))) for nodes in forest), abs=1e-9)
    assert S.attribute(x[:0], forest).shape == (0, 12)


@pytest.fixture(scope="module")
def fitted(spark):
    return Q.package(spark, SF)


def test_model_attributions_add_up(spark, fitted):
    m, _ = fitted
    out = m.explain(m.score(Q.labelled(spark, SF)))
    total = F.aggregate("shap", F.lit(0.0), lambda a, v: a + v) + m.base_value
    worst = out.select(F.max(F.abs(1 / (1 + F.exp(-total)) - F.col(D.PROB)))).first()[0]
    assert worst < 1e-9


def test_package_survives_saving(spark, fitted):
    m, path = fitted
    again = M.load_package(spark, path)
    assert (again.features, again.threshold, again.scaler) == (m.features, m.threshold, m.scaler)
    a = m.score(Q.labelled(spark, SF)).orderBy("flow_id").select(D.PROB).collect()
    b = again.score(Q.labelled(spark, SF)).orderBy("flow_id").select(D.PROB).collect()
    assert a == b
    assert set(m.performance) == {"threshold", "false_negatives", "false_positives", "accuracy", "precision", "recall",
                                  "f1_score", "roc_auc"}
    assert m.performance["roc_auc"] > 0.8


def test_model_takes_incomplete_and_unseen_input(spark, fitted):
    m, _ = fitted
    df = spark.createDataFrame([(1, "zzz", None), (2, "http", 5)], "flow_id long, service string, src_bytes long")
    rows = m.score(df).collect()
    assert len(rows) == 2 and all(0 < r[D.PROB] < 1 for r in rows)


def test_unused_feature_gets_nothing(spark, fitted):
    m, _ = fitted
    used = {n[0] for nodes in m.forest() for n in nodes.values() if n[0] >= 0}
    unused = [i for i in range(len(m.features)) if i not in used]
    out = m.explain(Q.labelled(spark, SF)).select(*[F.max(F.abs(F.col("shap")[i])) for i in unused]).first()
    assert unused and all(v == 0.0 for v in out)


def test_comparisons_need_both_classes(spark):
    one = Q.explained(spark, SF).where("predicted_class = 'intrusion'")
    assert X.class_compare_shap(one, CARD.features).count() == 0
    assert X.class_compare_raw(one, CARD.features).count() == 0
    none = Q.explained(spark, SF).where("false")
    assert X.intrusion_importance(none, CARD.features).count() == 0
    assert X.find_anomalies(none).count() == 0


def test_out_of_range_flow(spark):
    df = Q.explained(spark, SF)
    assert X.explain_flow(df.where("flow_id = -1"), CARD.features).count() == 0
    assert X.compare_two(df, 0, -1).count() == 0
    assert X.search_range(df, "src_bytes", -5, -1).count() == 0
