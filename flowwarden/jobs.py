"""Whole runs: train, detect, explain, verify. ``python -m flowwarden.jobs --help``.

Each stage writes its table once and the next one reads it back: a lost executor repeats
part of one stage only, and later reports scan stored columns with pushed filters.
"""

from __future__ import annotations

import argparse

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F

from .fixed_values import (
    BOOSTING, EXPLANATION_PREFIX, LABEL_COLUMN, PREDICTIONS_PREFIX,
)
from .operators import chain as C
from .operators import detect as D
from .operators import evaluate as E
from .operators import explain as X
from .operators import model as M
from .operators import prepare as P
from .schema import CATEGORICAL_FEATURES, NUMERIC_FEATURES
from .session import shared_folder
from .sources import artifacts as A
from .sources import flows as S
from .sources import log_io as L


def read_input(spark: SparkSession, path: str) -> DataFrame:
    """Flows from a stored Parquet table or a CSV upload; without a ``flow_id`` the row position becomes one."""
    path = path.rstrip("/")
    df = spark.read.parquet(path) if path.lower().endswith(".parquet") else S.read_flow_csv(spark, S.check_input(path))
    return df if "flow_id" in df.columns else S.with_row_position(df)


def train(spark, source: str, model_path: str, trees=BOOSTING["n_estimators"], depth=BOOSTING["max_depth"],
          policy="first") -> M.ModelPackage:
    """Clean, label, split, fit, choose the threshold, save."""
    staged = A.write_table(P.label_flows(P.clean_flows(read_input(spark, source), key="flow_id")), shared_folder(spark))
    flows = spark.read.parquet(staged)
    numeric, categorical = ([c for c in names if c in flows.columns] for names in (NUMERIC_FEATURES, CATEGORICAL_FEATURES))
    package = M.train_package(flows, numeric, categorical, trees, depth, policy)
    return package.save(spark, model_path)


def last_heads(spark, out: str) -> DataFrame | None:
    """Last block of each segment of the log stored below ``out``, as its last run left them; None where there is no log."""
    try:
        heads = spark.read.parquet(f"{out}/threat_log_segments").withColumn("run", F.col("run").cast("string"))
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return None
    return heads.where(F.col("run") == heads.agg(F.max("run")).first()[0]).drop("run")


def read_log(spark, out: str, upto: str | None = None) -> DataFrame:
    """The stored log of all runs, or of those up to one."""
    log = spark.read.parquet(f"{out}/threat_log")
    return (log if upto is None else log.where(F.col("run").cast("string") <= upto)).drop("run")


def detect(spark, source: str, model_path: str, out: str, run_stamp: str, exported_at: str) -> dict[str, DataFrame]:
    """Score, grade, log and summarise a file of flows; the log below ``out`` is continued. Run stamps must ascend."""
    package = M.load_package(spark, model_path)
    flows = read_input(spark, source)
    labelled = LABEL_COLUMN in flows.columns
    given = flows.columns
    if labelled:
        flows = P.label_flows(flows)
    scored = spark.read.parquet(A.write_table(D.detect(flows, package.threshold, package), shared_folder(spark)))
    # the published result: the columns of the input and five more
    A.record(D.scored_output(scored).drop(*{"y"}.difference(given)), out, PREDICTIONS_PREFIX, run_stamp, "data", "csv")
    # the log goes on from the runs before: a small table keeps the last block of each segment after every run
    before = last_heads(spark, out)
    log_path, segments_path = f"{out}/threat_log/run={run_stamp}", f"{out}/threat_log_segments/run={run_stamp}"
    A.write_table(C.append_flows(scored, heads=before, at=exported_at), log_path)
    A.write_table(C.merged_heads(before, C.segment_heads(spark.read.parquet(log_path))), segments_path)
    A.write_table(C.chain_heads(spark.read.parquet(segments_path)), f"{out}/threat_log_heads/run={run_stamp}")
    log = read_log(spark, out)
    L.export_log(log, out, run_stamp, exported_at)
    reports = {
        "summary": D.detection_summary(scored), "severity": D.severity_breakdown(scored), "log": C.log_summary(log)}
    if labelled:
        reports["metrics"] = E.eval_metrics(scored, package.threshold)
    return reports


def explain(spark, source: str, model_path: str, out: str, run_stamp: str) -> dict[str, DataFrame]:
    """Attribute every flow once, then derive the four exports and the group reports."""
    package = M.load_package(spark, model_path)
    flows = read_input(spark, source)
    columns = flows.columns
    base = D.predict_class(package.score(flows), package.threshold)
    stage = f"{out}/attributions_{run_stamp}"
    A.write_table(package.explain(base), stage)
    df, features = spark.read.parquet(stage), package.features
    importance = X.feature_importance(df, features, package.native_importance())
    top = X.top_features(importance, 15)
    numeric = [c for c in package.numeric if c in columns]
    A.record(X.xai_export(df, features, package.threshold, columns, top), out, EXPLANATION_PREFIX, run_stamp, "data")
    analysis = X.network_feature_analysis(df, numeric)
    exports = {
        "feature_importance_complete": X.importance_rank(importance),
        "network_feature_analysis": analysis, "category_importance_summary": X.category_summary(importance)}
    for name, table in exports.items():
        A.record(table, out, f"{name}_", run_stamp, "data", "csv")
    return {
        **exports, "intrusion_importance": X.intrusion_importance(df, features),
        "intrusion_stats": X.intrusion_feature_stats(df, features), "top_alerts": X.top_alerts(df, features),
        "class_compare": X.class_compare_shap(df, features)}


def verify(spark, out: str, run_stamp: str) -> dict[str, DataFrame]:
    """Check the log as it was after a run, block by block and against the heads stored then."""
    log = read_log(spark, out, run_stamp)
    heads = spark.read.parquet(f"{out}/threat_log_heads/run={run_stamp}")
    return {"log": C.log_summary(log), "broken": C.verify_chain(log).where(~F.col("is_valid")),
            "unsealed": C.verify_sealed(log, heads)}


def main() -> None:
    parser = argparse.ArgumentParser(prog="flowwarden.jobs")
    jobs = parser.add_subparsers(dest="job", required=True)
    t = jobs.add_parser("train")
    t.add_argument("source"), t.add_argument("model")
    t.add_argument("--trees", type=int, default=BOOSTING["n_estimators"])
    t.add_argument("--depth", type=int, default=BOOSTING["max_depth"])
    t.add_argument("--policy", choices=["first", "max"], default="first")
    d = jobs.add_parser("detect")
    for name in ("source", "model", "out", "run_stamp", "exported_at"):
        d.add_argument(name)
    e = jobs.add_parser("explain")
    for name in ("source", "model", "out", "run_stamp"):
        e.add_argument(name)
    v = jobs.add_parser("verify")
    for name in ("out", "run_stamp"):
        v.add_argument(name)
    a = parser.parse_args()
    spark = SparkSession.builder.appName(f"flowwarden-{a.job}").getOrCreate()
    if a.job == "train":
        train(spark, a.source, a.model, a.trees, a.depth, a.policy).metadata(spark).show(truncate=False)
        return
    reports = {
        "detect": lambda: detect(spark, a.source, a.model, a.out, a.run_stamp, a.exported_at),
        "explain": lambda: explain(spark, a.source, a.model, a.out, a.run_stamp),
        "verify": lambda: verify(spark, a.out, a.run_stamp),
    }[a.job]()
    for name, table in reports.items():
        print(name)
        table.show(30, truncate=False)


if __name__ == "__main__":
    main()
