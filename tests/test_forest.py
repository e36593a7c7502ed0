"""Forests as node tables against the fitted model they come from, and by hand."""

import math

import pytest
from pyspark.sql import functions as F

from flowwarden.operators import forest as FO
from flowwarden.operators import model as M
from flowwarden.operators import prepare as P

NODE = ("tree_id int, node_id int, left_child int, right_child int, feature_index int, threshold double, "
        "prediction double, cover double, gain double, weight double")
#: One split at 0 on feature 0 with a second split at 5 on feature 1 to its right; leaves -1, 1, 3 after scaling by 2.
TREE = [(4, 0, 1, 2, 0, 0.0, 0.0, 0.0, 0.0, 1.0), (4, 1, -1, -1, -1, None, -0.5, 0.0, 0.0, 1.0),
        (4, 2, 3, 4, 1, 5.0, 0.0, 0.0, 0.0, 1.0), (4, 3, -1, -1, -1, None, 0.5, 0.0, 0.0, 1.0), (4, 4, -1, -1, -1, None, 1.5, 0.0, 0.0, 1.0)]
ROWS = "x array<double>, y int"


@pytest.fixture(scope="module")
def fitted(spark, tmp_path_factory):
    rows = [(i, int(i % 7 < 2 or i > 260), float(i % 50), float(i * i % 97), "abc"[i % 3]) for i in range(300)]
    df = spark.createDataFrame(rows, "flow_id int, y int, duration double, src_bytes double, flag string").withColumn("flow_id", F.col("flow_id").cast("bigint"))
    path = str(tmp_path_factory.mktemp("model"))
    return df, M.train_package(df, ["duration", "src_bytes"], ["flag"], trees=4, depth=3).save(spark, path), path


def test_margin_is_that_of_the_fitted_model(spark, fitted):
    df, package, _ = fitted
    both = package.with_features(package.score(df)).withColumn("p", FO.probability(FO.margin_column(spark, package.forest())))
    assert both.select(F.max(F.abs(F.col("p") - F.col("intrusion_probability")))).first()[0] < 1e-12


def test_loss_is_half_of_the_librarys_after_each_round(fitted):
    df, package, _ = fitted
    theirs = [r["loss"] / 2 for r in M.loss_curve(package, df).orderBy("iteration").collect()]
    ours = [r["loss"] for r in FO.loss_by_round(package.with_features(df), package.forest()).orderBy("iteration").collect()]
    assert ours == pytest.approx(theirs, abs=1e-12)


def test_importance_is_that_of_the_fitted_model(spark, fitted):
    _, package, path = fitted
    ours = {r["feature"]: r["importance"] for r in FO.gain_importance(M.model_trees(spark, path), package.features).collect()}
    assert ours == pytest.approx(package.native_importance(), abs=1e-9)


def test_a_task_of_the_fit_holds_a_bounded_number_of_values(spark, monkeypatch):
    """The encoded rows are cached in more and smaller partitions where files pack too many rows, equal keys and nulls too."""
    monkeypatch.setattr(M, "TASK_VALUES", 40 * (3 + 16))
    seen, fit = [], M.GBTClassifier.fit
    monkeypatch.setattr(M.GBTClassifier, "fit", lambda self, df: seen.append(
        [r["n"] for r in df.groupBy(F.spark_partition_id()).agg(F.count(F.lit(1)).alias("n")).collect()]) or fit(self, df))
    rows = spark.range(400).coalesce(1).selectExpr(
        "CASE WHEN id % 4 > 0 THEN id DIV 100 END AS flow_id", "int(id % 3 = 0) AS y", "double(id % 50) AS duration",
        "double(id * id % 97) AS src_bytes", "'a' AS flag")
    package = M.train_package(rows, ["duration", "src_bytes"], ["flag"], trees=1, depth=2)
    assert package.model.getNumTrees == 1
    assert max(seen[0]) <= 44 and sum(seen[0]) <= 400 and len(seen[0]) >= 8


def test_small_partitions_stay_where_they_are(spark):
    df = spark.range(0, 100, 1, 4)
    assert P.bounded_parts(df, 25) is df
    out = P.bounded_parts(df, 24)
    assert out.rdd.getNumPartitions() == 5 and sorted(r["id"] for r in out.collect()) == list(range(100))
    none = df.where("false")
    assert P.bounded_parts(none, 1) is none


def test_missing_values_go_right(spark):
    rows = spark.createDataFrame([([0.0, 9.0], 1), ([1.0, 5.0], 0), ([math.nan, 6.0], 0), ([math.nan, math.nan], 1)], ROWS)
    forest = FO.forest_of(spark.createDataFrame(TREE, NODE).collect())
    assert [r[0] for r in rows.select(FO.margin_column(spark, forest)).collect()] == [-1.0, 1.0, 3.0, 3.0]


def test_statistics_of_nodes(spark):
    """Covers are rows; a gain is the variance that a split takes away; rows without a label do not count."""
    rows = spark.createDataFrame([([0.0, 9.0], 1), ([1.0, 5.0], 0), ([2.0, 5.0], 0), ([2.0, 6.0], 1), ([2.0, 6.0], None)], ROWS).repartition(3)
    got = {r["node_id"]: (r["cover"], round(r["gain"], 9)) for r in FO.with_statistics(spark.createDataFrame(TREE, NODE), rows).collect()}
    # four rows with two ones: spread 1; right of the root three rows with a single one: spread 2/3
    assert got == {0: (4.0, round((1 - 2 / 3) / 4, 9)), 1: (1.0, 0.0), 2: (3.0, round(2 / 9, 9)), 3: (2.0, 0.0), 4: (1.0, 0.0)}


def test_empty_tables(spark):
    none = spark.createDataFrame([], ROWS)
    nodes = spark.createDataFrame(TREE, NODE)
    forest = FO.forest_of(nodes.collect())
    assert none.select(FO.margin_column(spark, forest)).collect() == []
    assert FO.loss_by_round(none, forest).collect() == []
    measured = FO.with_statistics(nodes, none)
    assert {(r["cover"], r["gain"]) for r in measured.collect()} == {(0.0, 0.0)}
    assert {r["importance"] for r in FO.gain_importance(measured, ["a", "b", "c"]).collect()} == {0.0}


def test_more_rows_than_a_block(spark):
    rows = spark.range(5000).selectExpr("array(double(id % 3) - 1, double(id % 11)) AS x", "int(id % 2) AS y").coalesce(1)
    forest = FO.forest_of(spark.createDataFrame(TREE, NODE).collect())
    expected = "CASE WHEN x[0] <= 0 THEN -1D WHEN x[1] <= 5 THEN 1D ELSE 3D END"
    assert rows.withColumn("m", FO.margin_column(spark, forest)).where(f"m <> {expected}").count() == 0


def test_encoded_names_follow_the_features(fitted):
    _, package, _ = fitted
    assert package.features == P.encoded_names(package.vocab, package.numeric)
