"""Registered queries: every operator over the event and document tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..fixed_values import BOOSTING, DEFAULT_THRESHOLD
from ..functions.category import feature_category
from ..functions.frozen_forest import frozen_nodes
from ..functions.scorecard import DEFAULT_SCORECARD as CARD
from ..functions.severity import severity_table
from ..functions.text import safe_name, short_hash, strip_emoji
from ..functions.values import rounded
from ..operators import chain as C
from ..operators import detect as D
from ..operators import evaluate as E
from ..operators import explain as X
from ..operators import forest as FO
from ..operators import model as M
from ..operators import prepare as P
from ..operators.tree_shap import expected_value, shap_column
from ..session import shared_folder
from ..sources import artifacts as A
from ..sources import flows as S
from ..sources import log_io as L
from ..streaming import jobs as T

THR = DEFAULT_THRESHOLD
FEATURES = CARD.features
RUN = "20240201_000000"
EXPORTED_AT = "2024-02-01 00:00:00"
# text columns and the values a trained encoder knows; ecr_i never occurs, eco_i is unseen by it
FROZEN_VOCAB = {
    "protocol_type": ["icmp", "tcp", "udp"],
    "service": ["domain_u", "ecr_i", "ftp", "http", "smtp"],
    "flag": ["REJ", "RSTO", "RSTR", "S0", "SF"],
}
NUMERIC = ["duration", "src_bytes", "dst_bytes", "count", "srv_count", "serror_rate",
           "num_failed_logins", "dst_host_count"]
REGISTRY: dict = {}


def query(fn):
    REGISTRY[fn.__name__] = fn
    return fn


def joined(c, sep=" ; "):
    return F.array_join(c, sep)


# --- shared inputs ----------------------------------------------------------

def flows(spark: SparkSession, sf: str) -> DataFrame:
    return S.load_flows(spark, sf)


def labelled(spark, sf) -> DataFrame:
    return P.label_flows(flows(spark, sf))


def scored(spark, sf) -> DataFrame:
    return D.score_flows(labelled(spark, sf))


def graded(spark, sf) -> DataFrame:
    return D.detect(labelled(spark, sf), THR)


def explained(spark, sf) -> DataFrame:
    return CARD.explain(D.predict_class(scored(spark, sf), THR))


def importance(spark, sf) -> DataFrame:
    return X.feature_importance(explained(spark, sf), FEATURES, CARD.native_importance())


def alert_log(spark, sf) -> DataFrame:
    return C.append_flows(graded(spark, sf))


_LOGS: dict = {}


def stored_log(spark, sf) -> DataFrame:
    """The alert log as a stored table, as its readers meet it; written once per session and table."""
    key = (spark.sparkContext.applicationId, sf)
    if key not in _LOGS:
        _LOGS[key] = A.write_table(alert_log(spark, sf), shared_folder(spark))
    return spark.read.parquet(_LOGS[key])


# --- sources and sinks ------------------------------------------------------

@query
def scan_flows(spark, sf):
    return flows(spark, sf).withColumn("ts", F.date_format("ts", "yyyy-MM-dd HH:mm:ss"))


@query
def input_profile(spark, sf):
    return S.input_profile(flows(spark, sf))


@query
def csv_round_trip(spark, sf):
    """Flows written as CSV and read back by column name."""
    path = A.write_table(flows(spark, sf).drop("ts"), shared_folder(spark), fmt="csv")
    return S.read_flow_csv(spark, path)


@query
def scored_flows(spark, sf):
    """Scored result table, partitioned by run date, read back."""
    out = D.scored_output(graded(spark, sf)).drop("y").withColumn("run_date", F.date_format("ts", "yyyy-MM-dd")).drop("ts")
    path = A.write_table(out, shared_folder(spark), ["run_date"])
    return spark.read.parquet(path).withColumn("run_date", F.col("run_date").cast("string"))


@query
def log_export_info(spark, sf):
    return L.export_info(stored_log(spark, sf))


@query
def log_read(spark, sf):
    """The log exported as JSON documents, read back and flattened."""
    path = L.export_log(stored_log(spark, sf), shared_folder(spark), RUN, EXPORTED_AT)
    return L.read_log(spark, path).select(
        "segment", "block_index", "timestamp", "sample_index", "severity_level", "severity_name", "action_summary",
        joined("immediate_actions").alias("immediate_actions"),
        F.col("network_features.src_bytes").alias("src_bytes"), "previous_hash", "hash")


@query
def log_read_documents(spark, sf):
    """The log kept as one JSON document per file, its files split between blocks, read back and flattened."""
    path = L.export_documents(stored_log(spark, sf), shared_folder(spark), RUN, EXPORTED_AT)
    return L.read_documents(spark, path).select(
        "segment", "block_index", "timestamp", "sample_index", "severity_level", "severity_name", "action_summary",
        joined("immediate_actions").alias("immediate_actions"),
        F.col("network_features.src_bytes").alias("src_bytes"), "previous_hash", "hash")


@query
def log_documents_info(spark, sf):
    """Header of every exported log document."""
    path = L.export_log(stored_log(spark, sf), shared_folder(spark), RUN, EXPORTED_AT)
    return L.read_log_documents(spark, path).select("segment", "blockchain_info.*")


def _two_runs(spark, sf) -> str:
    folder = shared_folder(spark)
    out = D.scored_output(graded(spark, sf)).drop("ts", "y")
    for stamp in ("20240131_235959", RUN):
        A.write_table(out, f"{folder}/predictions_with_actions_{stamp}", fmt="csv")
    L.export_log(stored_log(spark, sf), folder, RUN, EXPORTED_AT)
    return folder


@query
def artifact_catalog(spark, sf):
    return A.catalog_totals(A.artifact_catalog(A.list_artifacts(spark, _two_runs(spark, sf)))).select(
        "kind", "files", "bytes")


@query
def latest_run(spark, sf):
    files = A.list_artifacts(spark, _two_runs(spark, sf), "*.csv")
    return A.latest_run(files, "predictions_with_actions_").select("run_stamp", "files", "bytes")


def _recorded_runs(spark, sf) -> str:
    """Two runs' outputs with their manifest: all predictions, then those of intrusions and the log."""
    folder = shared_folder(spark)
    out = D.scored_output(graded(spark, sf)).drop("ts", "y")
    A.record(out, folder, "predictions_with_actions_", "20240131_235959", "data", "csv")
    A.record(out.where(F.col("predicted_class") == "intrusion"), folder, "predictions_with_actions_", RUN, "data", "csv")
    A.record(stored_log(spark, sf), folder, "threat_log_", RUN, "blockchain")
    return folder


@query
def output_catalog(spark, sf):
    """Outputs and their rows by kind, from the manifest alone."""
    return A.output_catalog(A.manifest(spark, _recorded_runs(spark, sf)))


@query
def newest_output(spark, sf):
    return A.newest_output(A.manifest(spark, _recorded_runs(spark, sf)), "predictions_with_actions_").select("prefix", "run", "n_rows")


# --- cleaning, encoding, scaling, splitting ---------------------------------

@query
def clean_flows(spark, sf):
    return P.clean_flows(S.load_raw_flows(spark, sf))


@query
def label_flows(spark, sf):
    return labelled(spark, sf).select("flow_id", "class", "y")


@query
def label_distribution(spark, sf):
    return E.label_distribution(labelled(spark, sf))


@query
def conform_flows(spark, sf):
    return P.conform_flows(flows(spark, sf))


@query
def category_vocab(spark, sf):
    return P.category_vocab(flows(spark, sf))


@query
def one_hot(spark, sf):
    f = flows(spark, sf)
    return P.one_hot(f, P.collect_vocab(f), NUMERIC)


@query
def one_hot_aligned(spark, sf):
    return P.one_hot(flows(spark, sf), FROZEN_VOCAB, NUMERIC)


@query
def one_hot_sparse(spark, sf):
    """Encoded vectors as places and values; the vocabulary stays a table."""
    f = flows(spark, sf)
    return P.one_hot_sparse(f, P.vocab_index(f, first=len(NUMERIC)), NUMERIC).select(
        "flow_id", joined(F.col("indices").cast("array<string>"), ",").alias("indices"),
        *[F.col("values")[i].alias(c) for i, c in enumerate(NUMERIC)], F.aggregate("values", F.lit(0.0), lambda a, v: a + v).alias("total"))


@query
def vocab_index(spark, sf):
    return P.vocab_index(flows(spark, sf), first=len(NUMERIC))


@query
def stratified_split(spark, sf):
    return P.stratified_split(labelled(spark, sf)).select("flow_id", "y", "is_test")


def _train(spark, sf):
    return P.stratified_split(labelled(spark, sf)).where(~F.col("is_test"))


@query
def scaler_stats(spark, sf):
    # by floor: a mean of a few decimals may lie on the edge between two roundings
    six = lambda c: F.floor(F.col(c) * 1e6 + 0.5) / 1e6
    return P.scaler_stats(_train(spark, sf), NUMERIC).withColumns({"mean": six("mean"), "std": six("std")})


@query
def scaled_flows(spark, sf):
    scaler = P.collect_scaler(_train(spark, sf), NUMERIC)
    return rounded(P.scale_flows(flows(spark, sf).select("flow_id", *NUMERIC), scaler))


@query
def class_weights(spark, sf):
    return P.class_weights(labelled(spark, sf)).select("flow_id", "y", "w")


# --- detection --------------------------------------------------------------

@query
def predict_class(spark, sf):
    return D.predict_class(scored(spark, sf), THR).select("flow_id", D.PROB, "predicted_class")


@query
def intrusions_only(spark, sf):
    return D.only(D.predict_class(scored(spark, sf), THR), D.INTRUSION).select("flow_id", D.PROB)


@query
def confidence_band(spark, sf):
    return scored(spark, sf).select("flow_id", D.confidence_band(F.col(D.PROB), THR).alias("confidence"))


@query
def prediction_correctness(spark, sf):
    return D.prediction_correctness(D.predict_class(scored(spark, sf), THR)).select(
        "flow_id", "y", "predicted_class", "correct")


@query
def severity_score(spark, sf):
    return graded(spark, sf).select("flow_id", "severity_score", "severity_level")


@query
def severity_dim_join(spark, sf):
    return graded(spark, sf).select("flow_id", "severity_level").join(
        F.broadcast(severity_table(spark)), "severity_level")


@query
def playbook(spark, sf):
    return D.respond(D.only(graded(spark, sf), D.INTRUSION)).select(
        "flow_id", "severity_level", joined("immediate_actions").alias("immediate_actions"),
        joined("monitoring_actions").alias("monitoring_actions"), joined("logging_actions").alias("logging_actions"),
        "explanation", "action_summary")


@query
def indicators(spark, sf):
    return D.with_indicators(flows(spark, sf)).select(
        "flow_id", joined("indicators").alias("indicators"), joined("shown_indicators").alias("shown_indicators"),
        F.size("indicators").alias("n_indicators"))


@query
def alerts(spark, sf):
    nf = "network_features"
    return D.alerts(graded(spark, sf)).select(
        "sample_index", D.PROB, "severity_level", "severity_name", "priority", "action_summary",
        joined("immediate_actions").alias("immediate_actions"), joined("monitoring_actions").alias("monitoring_actions"),
        *[F.col(f"{nf}.{c}").alias(f"nf_{c}") for c in ("duration", "protocol_type", "service", "flag", "src_bytes",
          "dst_bytes", "count", "srv_count", "serror_rate", "num_failed_logins", "dst_host_count", "src_ip")])


@query
def intrusion_details(spark, sf):
    nf = "network_features"
    return D.intrusion_details(graded(spark, sf)).select(
        "sample_index", D.PROB, "severity_name", "severity_level", "explanation", "action",
        joined("immediate_actions").alias("immediate_actions"), joined("monitoring_actions").alias("monitoring_actions"),
        *[F.col(f"{nf}.{c}").alias(c) for c in ("src_bytes", "dst_bytes", "count", "srv_count", "serror_rate", "duration")])


@query
def detection_summary(spark, sf):
    return D.detection_summary(graded(spark, sf))


@query
def severity_breakdown(spark, sf):
    return D.severity_breakdown(graded(spark, sf))


@query
def normal_sample(spark, sf):
    return D.normal_sample(D.predict_class(scored(spark, sf), THR))


# --- evaluation -------------------------------------------------------------

@query
def score_stats(spark, sf):
    return E.score_stats(scored(spark, sf))


@query
def confusion_matrix(spark, sf):
    return E.confusion_matrix(scored(spark, sf), THR)


@query
def threshold_sweep(spark, sf):
    return E.threshold_sweep(scored(spark, sf))


@query
def zero_fn_threshold(spark, sf):
    return E.zero_fn_threshold(scored(spark, sf), "first").unionByName(E.zero_fn_threshold(scored(spark, sf), "max"))


@query
def zero_fn_threshold_of_floods(spark, sf):
    """With half-open icmp floods as the only attacks none is scored low: the two policies choose different thresholds."""
    flood = (F.col("class") == "neptune") & (F.col("flag") == "S0") & (F.col("protocol_type") == "icmp")
    floods = scored(spark, sf).withColumn("y", flood.cast("int"))
    return E.zero_fn_threshold(floods, "first").unionByName(E.zero_fn_threshold(floods, "max"))


@query
def threshold_sensitivity(spark, sf):
    return E.threshold_sensitivity(scored(spark, sf), THR)


@query
def eval_metrics(spark, sf):
    return E.eval_metrics(scored(spark, sf), THR)


@query
def classification_report(spark, sf):
    return E.classification_report(scored(spark, sf), THR)


@query
def roc_auc(spark, sf):
    return E.roc_auc(scored(spark, sf))


@query
def roc_curve(spark, sf):
    return E.roc_curve(scored(spark, sf))


@query
def dashboard(spark, sf):
    s = scored(spark, sf)
    metrics = E.eval_metrics(s, THR).withColumn("threshold", F.lit(THR)).withColumn(
        "roc_auc", E.roc_auc(s).scalar())
    return E.dashboard(metrics)


# --- threat log -------------------------------------------------------------

@query
def chain_append(spark, sf):
    return alert_log(spark, sf).select(
        "segment", "block_index", "timestamp", "sample_index", "severity_level", "action_summary", "previous_hash", "hash")


@query
def chain_heads(spark, sf):
    return C.chain_heads(stored_log(spark, sf), levels=2)


@query
def chain_verify(spark, sf):
    return C.verify_chain(stored_log(spark, sf))


@query
def chain_verify_tampered(spark, sf):
    """Verification of a log in which one amount per segment was altered after hashing."""
    log = stored_log(spark, sf)
    hit = (F.col("block_index") == 3)
    forged = log.withColumn("network_features", F.when(hit, F.col("network_features").withField(
        "src_bytes", F.col("network_features.src_bytes") + 1.0)).otherwise(F.col("network_features")))
    return C.verify_chain(forged)


@query
def chain_continued(spark, sf):
    """The log of two runs, the second on top of the stored heads of the first: one valid chain for each segment."""
    flows, folder = graded(spark, sf), shared_folder(spark)
    first = spark.read.parquet(A.write_table(C.append_flows(flows.where("flow_id % 1000 < 600")), f"{folder}/run=1"))
    heads = spark.read.parquet(A.write_table(C.segment_heads(first), f"{folder}_heads"))
    second = C.append_flows(flows.where("flow_id % 1000 >= 600"), heads=heads)
    return first.unionByName(second).select("segment", "block_index", "timestamp", "sample_index", "previous_hash", "hash")


@query
def chain_sealed(spark, sf):
    """Groups whose sealed head no longer follows from a log that lost the last block of every seventh segment."""
    log = stored_log(spark, sf)
    heads = C.chain_heads(log, levels=2)
    last = C.segment_heads(log).where("segment % 7 = 0").select("segment", F.col("last_index").alias("block_index"))
    return C.verify_sealed(log.join(last, ["segment", "block_index"], "left_anti"), heads).select("level", "group")


@query
def log_validity(spark, sf):
    """Totals of the log and of one in which an amount of every block 3 was altered."""
    log = stored_log(spark, sf)
    forged = log.withColumn("network_features", F.when(F.col("block_index") == 3, F.col("network_features").withField(
        "src_bytes", F.col("network_features.src_bytes") + 1.0)).otherwise(F.col("network_features")))
    return C.log_summary(log).withColumn("state", F.lit("stored")).unionByName(C.log_summary(forged).withColumn("state", F.lit("forged")))


@query
def log_severity(spark, sf):
    return C.log_severity(stored_log(spark, sf))


@query
def log_view(spark, sf):
    return C.log_view(stored_log(spark, sf)).withColumn("immediate_actions", joined("immediate_actions"))


@query
def log_search(spark, sf):
    return C.log_search(C.log_view(stored_log(spark, sf)), "12").select(
        "segment", "id", "source_ip", "dest_ip", "type", "hash")


@query
def log_page(spark, sf):
    return C.log_page(C.log_view(stored_log(spark, sf)), page=120).select(
        "position", "segment", "id", "sample_index", "type", "hash", "total_entries", "total_pages")


@query
def log_page_after(spark, sf):
    return C.log_page_after(C.log_view(stored_log(spark, sf)), 2, 100).select("segment", "id", "sample_index", "hash")


# --- explanation ------------------------------------------------------------

def raw_values() -> dict:
    return {f: f"`{f}`" for f in NUMERIC}


@query
def shap_scorecard(spark, sf):
    return rounded(X.beeswarm_data(explained(spark, sf), FEATURES))


@query
def beeswarm_data(spark, sf):
    df = explained(spark, sf)
    top = X.top_features(importance(spark, sf), 25)
    return rounded(X.beeswarm_data(df, FEATURES, top))


@query
def explain_flow(spark, sf):
    return rounded(X.explain_flow(explained(spark, sf), FEATURES, 15, raw_values()))


@query
def explain_flow_top3(spark, sf):
    return rounded(X.explain_flow(explained(spark, sf), FEATURES, 3, raw_values()))


@query
def explain_header(spark, sf):
    return X.explain_header(explained(spark, sf), FEATURES, CARD.base_value, THR)


@query
def category_contrib(spark, sf):
    return X.category_contrib(explained(spark, sf), FEATURES)


@query
def contrib_share(spark, sf):
    return X.contrib_share(explained(spark, sf), FEATURES)


@query
def waterfall_data(spark, sf):
    return X.waterfall_data(explained(spark, sf), FEATURES, CARD.base_value)


@query
def waterfall_folded(spark, sf):
    return X.waterfall_data(explained(spark, sf), FEATURES, CARD.base_value, max_display=6)


@query
def feature_category_map(spark, sf):
    """Category of every feature name, encoded columns included."""
    f = flows(spark, sf)
    numeric, _ = P.split_by_type(P.conform_flows(f, keep=()))
    plain = spark.createDataFrame([(c,) for c in numeric], "feature string")
    encoded = P.category_vocab(f).select(F.concat_ws("_", "column", "value").alias("feature"))
    return plain.unionByName(encoded).withColumn("category", feature_category(F.col("feature")))


@query
def global_importance(spark, sf):
    return rounded(X.top_of(importance(spark, sf), "mean_abs_shap", 30))


@query
def importance_combined(spark, sf):
    return rounded(importance(spark, sf).select("feature", "native_importance", "mean_abs_shap"))


@query
def importance_rank(spark, sf):
    return rounded(X.importance_rank(importance(spark, sf)))


@query
def category_importance(spark, sf):
    return rounded(X.category_importance(importance(spark, sf)))


@query
def category_summary(spark, sf):
    return X.category_summary(importance(spark, sf))


@query
def intrusion_importance(spark, sf):
    return rounded(X.intrusion_importance(explained(spark, sf), FEATURES))


@query
def intrusion_category(spark, sf):
    return rounded(X.intrusion_category(explained(spark, sf), FEATURES))


@query
def intrusion_feature_stats(spark, sf):
    return rounded(X.intrusion_feature_stats(explained(spark, sf), FEATURES))


@query
def class_compare_shap(spark, sf):
    return rounded(X.class_compare_shap(explained(spark, sf), FEATURES))


@query
def class_compare_raw(spark, sf):
    return rounded(X.class_compare_raw(explained(spark, sf), FEATURES))


@query
def network_feature_analysis(spark, sf):
    return rounded(X.network_feature_analysis(explained(spark, sf), NUMERIC))


@query
def top_alerts(spark, sf):
    return X.top_alerts(explained(spark, sf), FEATURES)


@query
def top_by_feature(spark, sf):
    return rounded(X.top_by_feature(explained(spark, sf), FEATURES, "src_bytes"))


@query
def search_range(spark, sf):
    return X.search_range(explained(spark, sf), "src_bytes", 10000, 50000)


@query
def compare_extremes(spark, sf):
    return X.compare_extremes(explained(spark, sf))


@query
def compare_two(spark, sf):
    """The first and the last flow of the table side by side."""
    df = explained(spark, sf)
    ends = df.agg(F.min("flow_id").alias("a"), F.max("flow_id").alias("b")).first()
    return X.compare_two(df, ends["a"], ends["b"])


@query
def anomaly_q99(spark, sf):
    return X.find_anomalies(explained(spark, sf))


@query
def xai_export(spark, sf):
    df = explained(spark, sf)
    top = X.top_features(importance(spark, sf), 15)
    out = X.xai_export(df, FEATURES, THR, ["flow_id", "src_bytes", "dst_bytes", "service", "flag"], top)
    return spark.read.parquet(A.write_table(out, shared_folder(spark)))


@query
def xai_export_top5(spark, sf):
    """The export with the five features of most weight, where the limit leaves seven out."""
    df = explained(spark, sf)
    top = X.top_features(importance(spark, sf), 5)
    out = X.xai_export(df, FEATURES, THR, ["flow_id", "service"], top)
    shown = [c for c in out.columns if c.startswith("shap_")]
    return out.select("flow_id", F.round("total_shap", 6).alias("total_shap"), F.lit(len(shown)).cast("bigint").alias("n_shap"),
                      F.round(sum(F.col(c) for c in shown), 5).alias("top_shap"))


@query
def run_report(spark, sf):
    g = graded(spark, sf)
    return rounded(X.run_report(
        D.detection_summary(g), D.severity_breakdown(g), importance(spark, sf), THR))


# --- documents --------------------------------------------------------------

@query
def strip_emoji_text(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    clean = strip_emoji(F.col("text"))
    return docs.select("doc_id", clean.alias("text"), (F.length("text") - F.length(clean)).alias("removed"))


@query
def run_stamps(spark, sf):
    """A run for each day of flows, with its stamp as output names carry it."""
    days = flows(spark, sf).groupBy(F.to_date("ts").alias("day")).agg(F.max("ts").alias("ts"), F.count(F.lit(1)).alias("n"))
    return days.select(A.run_stamp(F.col("ts")).alias("run_stamp"), "n")


@query
def log_hash_prefix(spark, sf):
    """Blocks as they are shown: hashes cut to a prefix."""
    return C.log_view(stored_log(spark, sf)).select(
        "segment", "id", short_hash(F.col("hash")).alias("shown_hash"), short_hash(F.col("previous_hash"), 16).alias("shown_previous"))


@query
def explain_one_flow(spark, sf):
    """One flow by its id; an id that no flow has gives no rows."""
    return rounded(X.explain_flow(X.one_flow(explained(spark, sf), 42), FEATURES, 15, raw_values()))


@query
def explain_missing_flow(spark, sf):
    return X.explain_header(X.one_flow(explained(spark, sf), -1), FEATURES, CARD.base_value, THR)


@query
def global_importance_top5(spark, sf):
    return rounded(X.top_of(importance(spark, sf), "mean_abs_shap", 5))


@query
def class_compare_shap_top5(spark, sf):
    return rounded(X.class_compare_shap(explained(spark, sf), FEATURES, 5))


@query
def beeswarm_top5(spark, sf):
    return rounded(X.beeswarm_data(explained(spark, sf), FEATURES, X.top_features(importance(spark, sf), 5)))


# --- learning (no SQL: fitted models) ---------------------------------------

_PACKAGES: dict = {}


def package(spark, sf):
    """A small model fitted on the whole table, saved, loaded again; once per session and table."""
    key = (spark.sparkContext.applicationId, sf)
    if key not in _PACKAGES:
        path = shared_folder(spark)
        M.train_package(labelled(spark, sf), NUMERIC, trees=5, depth=4).save(spark, path)
        _PACKAGES[key] = (M.load_package(spark, path), path)
    return _PACKAGES[key]


@query
def gbt_scores(spark, sf):
    m, _ = package(spark, sf)
    return m.score(labelled(spark, sf)).select("flow_id", "y", D.PROB)


@query
def gbt_detection(spark, sf):
    """Severity counts under the fitted model and its own threshold."""
    m, _ = package(spark, sf)
    return D.severity_breakdown(D.detect(labelled(spark, sf), m.threshold, m))


@query
def gbt_loss_curve(spark, sf):
    m, _ = package(spark, sf)
    return M.loss_curve(m, P.stratified_split(labelled(spark, sf)).where("is_test"))


@query
def top_features(spark, sf):
    return M.native_importance(package(spark, sf)[0], spark, 15)


@query
def model_metadata(spark, sf):
    return spark.read.parquet(f"{package(spark, sf)[1]}/metadata").select(
        joined("feature_names", ",").alias("feature_names"), "threshold", F.size("feature_names").alias("n_features"),
        F.explode("performance").alias("metric", "value"))


@query
def model_status(spark, sf):
    return M.model_status(spark.read.parquet(f"{package(spark, sf)[1]}/metadata"))


@query
def model_trees(spark, sf):
    return M.model_trees(spark, package(spark, sf)[1])


@query
def shap_trees(spark, sf):
    """Attributions of the fitted trees and the margin they add up to."""
    m, _ = package(spark, sf)
    out = m.explain(m.score(labelled(spark, sf)))
    total = F.aggregate("shap", F.lit(0.0), lambda a, v: a + v)
    return out.select("flow_id", D.PROB, F.lit(m.base_value).alias("base_value"), total.alias("total_shap"),
                      *[F.col("shap")[i].alias(f"shap_{safe_name(f)}") for i, f in enumerate(m.features)])


@query
def shap_trees_importance(spark, sf):
    m, _ = package(spark, sf)
    return X.feature_importance(m.explain(labelled(spark, sf)), m.features, m.native_importance())


# --- a frozen forest of the published size, which SQL can state ---------------

#: Features in model order, unscaled.
ENCODER = M.ModelPackage(None, NUMERIC, FROZEN_VOCAB, {c: (0.0, 1.0) for c in NUMERIC})


def forest_table(spark, trees=BOOSTING["n_estimators"], depth=BOOSTING["max_depth"]) -> DataFrame:
    return frozen_nodes(spark, ENCODER.features, trees, depth)


@query
def forest_scores(spark, sf):
    """Every flow scored by 500 trees of depth 8."""
    df = ENCODER.with_features(labelled(spark, sf))
    p = FO.probability(FO.margin_column(spark, FO.forest_of(forest_table(spark).collect())))
    return df.select("flow_id", "y", F.round(p, 6).alias(D.PROB))


@query
def forest_loss_curve(spark, sf):
    """Log loss over all flows after each of 500 rounds."""
    df = ENCODER.with_features(labelled(spark, sf))
    return FO.loss_by_round(df, FO.forest_of(forest_table(spark).collect())).withColumn("loss", F.round("loss", 6))


def _forest_importance(spark, sf) -> DataFrame:
    measured = FO.with_statistics(forest_table(spark), ENCODER.with_features(labelled(spark, sf)))
    return FO.gain_importance(measured, ENCODER.features)


@query
def forest_importance(spark, sf):
    """Features by gain, with rows and gains of all nodes of 500 trees measured on the flows."""
    return rounded(_forest_importance(spark, sf))


@query
def forest_top_features(spark, sf):
    return rounded(X.top_of(_forest_importance(spark, sf), "importance", 15))


@query
def forest_shap(spark, sf):
    """Attributions of 40 trees of depth 3, the depth whose closed form SQL can state; one row for each flow and feature."""
    forest = FO.forest_of(forest_table(spark, 40, 3).collect())
    df = ENCODER.with_features(labelled(spark, sf)).withColumn("shap", shap_column(spark, forest))
    pairs = F.arrays_zip(F.array(*[F.lit(f) for f in ENCODER.features]).alias("feature"), F.col("shap"))
    # values are multiples of about 3e-8 and may lie on the edge of a rounding: the edge is moved off them
    return df.select("flow_id", F.lit(expected_value(forest)).alias("base"), F.explode(pairs).alias("p")).select(
        "flow_id", F.col("p.feature").alias("feature"), (F.floor(F.col("p.shap") * 1e6 + 0.51) / 1e6).alias("shap_value"),
        F.round("base", 6).alias("base_value"))


# --- streaming --------------------------------------------------------------

def _finished(run):
    run.awaitTermination()
    if run.exception():
        raise run.exception()


@query
def stream_alerts(spark, sf):
    out = shared_folder(spark)
    _finished(T.run_append(T.stream_alerts(T.read_event_stream(spark, sf)), f"{out}/alerts", f"{out}/state"))
    return spark.read.parquet(f"{out}/alerts").select(
        "sample_index", D.PROB, "severity_level", "severity_name", "action_summary",
        joined("immediate_actions").alias("immediate_actions"))


@query
def stream_chain(spark, sf):
    out = shared_folder(spark)
    _finished(T.run_chain(T.read_event_stream(spark, sf), f"{out}/log", f"{out}/heads", f"{out}/state"))
    return spark.read.parquet(f"{out}/log").select(
        "segment", "block_index", "timestamp", "sample_index", "severity_level", "action_summary", "previous_hash", "hash")


@query
def stream_severity(spark, sf):
    out = shared_folder(spark)
    _finished(T.run_update(T.stream_severity(T.read_event_stream(spark, sf)), ["window_start", "severity_level"], f"{out}/counts", f"{out}/state"))
    return T.newest_result(spark, f"{out}/counts").select(
        F.date_format("window_start", "yyyy-MM-dd").alias("day"), "severity_level", "n")
