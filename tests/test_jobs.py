import pytest

from flowwarden import jobs
from flowwarden.plans import queries as Q
from flowwarden.session import shared_folder
from flowwarden.sources import artifacts as A

SF = "/root/testdata/sf0.001"


def test_train_detect_explain_verify(spark):
    work = shared_folder(spark)
    flows = Q.flows(spark, SF).drop("flow_id", "ts")
    source = A.write_table(flows, f"{work}/flows.csv", fmt="csv")
    package = jobs.train(spark, source, f"{work}/model", trees=3, depth=3)
    assert not {"difficulty", "src_id"} & set(package.numeric) and package.threshold == 0.01
    reports = jobs.detect(spark, source, f"{work}/model", f"{work}/out", "20240101_000000", "2024-01-01 00:00:00")
    total = reports["summary"].first()
    assert total["total_samples"] == 1000 and total["intrusions"] + total["normals"] == 1000
    result = spark.read.option("header", True).csv(f"{work}/out/predictions_with_actions_20240101_000000")
    assert result.count() == 1000
    assert [c for c in result.columns if c != "flow_id"] == [
        *flows.columns, "intrusion_probability", "predicted_class", "severity_level", "severity_name", "action_summary"]
    newest = A.latest_run(A.list_artifacts(spark, f"{work}/out", "*.csv"), "predictions_with_actions_").first()
    assert newest["run_stamp"] == "20240101_000000"
    log = reports["log"].first()
    assert log["total_intrusions"] == total["intrusions"] and log["is_valid"]
    assert 0 <= reports["metrics"].first()["accuracy"] <= 1
    checks = jobs.verify(spark, f"{work}/out", "20240101_000000")
    assert checks["broken"].count() == 0 and checks["unsealed"].count() == 0
    # a second run goes on from the stored log
    again = jobs.detect(spark, source, f"{work}/model", f"{work}/out", "20240102_000000", "2024-01-02 00:00:00")["log"].first()
    assert again["is_valid"] and again["total_intrusions"] == 2 * total["intrusions"] and again["segments"] == log["segments"]
    for stamp in ("20240101_000000", "20240102_000000"):
        checks = jobs.verify(spark, f"{work}/out", stamp)
        assert checks["broken"].count() == 0 and checks["unsealed"].count() == 0
    explained = jobs.explain(spark, source, f"{work}/model", f"{work}/out", "20240101_000000")
    assert explained["feature_importance_complete"].count() == len(package.features)
    wide = spark.read.parquet(f"{work}/out/xai_predictions_20240101_000000")
    assert wide.count() == 1000 and len([c for c in wide.columns if c.startswith("shap_")]) == 15
    names = {r["name"] for r in A.list_artifacts(spark, f"{work}/out", "*.json").collect()}
    assert names


def test_clean_keeps_the_first_position(spark):
    rows = [(5, 1, "a"), (3, 1, "a"), (4, 2, None), (9, 2, "b")]
    out = jobs.P.clean_flows(spark.createDataFrame(rows, "flow_id long, x int, class string"), key="flow_id")
    assert sorted((r["flow_id"], r["x"]) for r in out.collect()) == [(3, 1), (9, 2)]


def test_only_csv_uploads_are_taken(spark):
    with pytest.raises(ValueError):
        jobs.read_input(spark, "/tmp/flows.csv.exe")


def test_a_cluster_needs_a_shared_folder():
    class Conf(dict):
        def get(self, key, default=None):
            return {"spark.master": "yarn"}.get(key, default)

    class Session:
        conf = Conf()

    with pytest.raises(ValueError):
        shared_folder(Session())
