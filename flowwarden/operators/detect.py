"""Scored flows -> classes, severity, response, alerts and their summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..fixed_values import (
    DEFAULT_THRESHOLD, DETAIL_FEATURES, DETAIL_LIMIT, HIGH_CONFIDENCE, KEY_FEATURES,
    NORMAL_SUMMARY, SHOWN_INDICATORS,
)
from ..functions import playbook as P
from ..functions import severity as S
from ..functions.scorecard import DEFAULT_SCORECARD
from ..functions.values import not_nan, ratio
from ..schema import CATEGORICAL_FEATURES

PROB = "intrusion_probability"
INTRUSION, NORMAL = "intrusion", "normal"


def score_flows(df: DataFrame, scorer=DEFAULT_SCORECARD) -> DataFrame:
    """Add the probability of an intrusion."""
    return scorer.score(df)


def predict_class(df: DataFrame, threshold: float = DEFAULT_THRESHOLD) -> DataFrame:
    """Threshold is inclusive."""
    return df.withColumn(
        "predicted_class", F.when(F.col(PROB) >= threshold, INTRUSION).otherwise(NORMAL))


def only(df: DataFrame, predicted: str) -> DataFrame:
    return df.where(F.col("predicted_class") == predicted)


def confidence_band(p: Column, threshold: float = DEFAULT_THRESHOLD) -> Column:
    return F.when(p >= HIGH_CONFIDENCE, "high").when(p >= threshold, "medium").otherwise("low")


def prediction_correctness(df: DataFrame) -> DataFrame:
    """Compare prediction and label ``y``."""
    return df.withColumn("correct", (F.col("predicted_class") == INTRUSION).cast("int") == F.col("y"))


def grade(df: DataFrame) -> DataFrame:
    """Add severity score, level, name and priority to classified flows."""
    flagged = f"predicted_class = '{INTRUSION}'"
    return (
        df.withColumn("severity_score", F.when(F.expr(flagged), S.severity_score(df, PROB)).otherwise(0))
        .withColumn("severity_level", S.severity_level(flagged, "severity_score"))
        .withColumns({"severity_name": S.severity_name(F.col("severity_level")),
                      "priority": S.severity_priority(F.col("severity_level")),
                      "response": P.response_number(df)})
    )


def summarise_action(df: DataFrame) -> DataFrame:
    text = P.action_summary(F.col("response"), F.col(PROB))
    return df.withColumn(
        "action_summary",
        F.when(F.col("predicted_class") == INTRUSION, text).otherwise(NORMAL_SUMMARY))


def detect(df: DataFrame, threshold: float = DEFAULT_THRESHOLD, scorer=DEFAULT_SCORECARD) -> DataFrame:
    """Input columns + probability, class, severity and summary: one projection, no shuffle."""
    out = score_flows(df, scorer)
    return summarise_action(grade(predict_class(out, threshold)))


def scored_output(df: DataFrame) -> DataFrame:
    """The columns of the published result file: the input plus five."""
    return df.drop("severity_score", "priority", "response")


def respond(df: DataFrame) -> DataFrame:
    """Add the full response record of every flow."""
    number, level = F.col("response"), F.col("severity_level")
    return df.withColumns({
        "immediate_actions": P.immediate_actions(number),
        "monitoring_actions": P.monitoring_actions(number),
        "logging_actions": P.logging_actions(level),
        "explanation": P.explanation(level, F.col(PROB)),
    })


def with_indicators(df: DataFrame) -> DataFrame:
    out = df.withColumn("indicators", P.indicators(df))
    return out.withColumn("shown_indicators", F.slice("indicators", 1, SHOWN_INDICATORS))


def network_features(df: DataFrame) -> Column:
    """Nested key features: numbers as double, the rest as text, absent columns null."""
    fields = []
    for name in KEY_FEATURES:
        kind = "string" if name in CATEGORICAL_FEATURES else "double"
        value = F.col(f"`{name}`") if name in df.columns else F.lit(None)
        fields.append(value.cast(kind).alias(name))
    src = F.col("src_id") if "src_id" in df.columns else F.lit(None)
    fields += [src.cast("string").alias("src_ip"), F.lit(None).cast("string").alias("dst_ip")]
    return F.struct(*fields)


def alerts(graded: DataFrame, keep: tuple = ()) -> DataFrame:
    """One log entry per flagged flow; all immediate but only the first monitoring actions."""
    found = only(graded, INTRUSION).where(F.col("severity_level") > 0)
    number = F.col("response")
    return found.select(
        F.col("flow_id").alias("sample_index"), PROB, "severity_level", "severity_name", "priority",
        "action_summary",
        P.immediate_actions(number).alias("immediate_actions"),
        P.logged_monitoring_actions(number).alias("monitoring_actions"),
        network_features(found).alias("network_features"), *keep,
    )


def intrusion_details(graded: DataFrame, limit: int = DETAIL_LIMIT) -> DataFrame:
    """Detail report of the first flagged flows: lists by level alone, six features."""
    found = only(graded, INTRUSION)
    level = F.col("severity_level")
    now, watch = P.plain_actions(level)
    features = {
        c: (F.coalesce(not_nan(F.col(f"`{c}`")), F.lit(0.0)) if c in found.columns else F.lit(0.0))
        for c in DETAIL_FEATURES
    }
    return found.orderBy("flow_id").limit(limit).select(
        F.col("flow_id").alias("sample_index"), PROB, "severity_name", "severity_level",
        P.detail_explanation(level, F.col(PROB)).alias("explanation"),
        F.col("action_summary").alias("action"),
        now.alias("immediate_actions"), watch.alias("monitoring_actions"),
        F.struct(*[v.alias(c) for c, v in features.items()]).alias("network_features"),
    )


def detection_summary(df: DataFrame) -> DataFrame:
    """Totals and shares of a run; an empty run gives zeros."""
    n = F.count(F.lit(1))
    hits = F.count_if(F.col("predicted_class") == INTRUSION)
    return df.agg(n.alias("total_samples"), hits.alias("intrusions")).select(
        "total_samples", "intrusions",
        (F.col("total_samples") - F.col("intrusions")).alias("normals"),
        F.round(100 * ratio(F.col("intrusions"), F.col("total_samples")), 4).alias("intrusion_pct"),
        F.round(100 * ratio(F.col("total_samples") - F.col("intrusions"), F.col("total_samples")), 4)
        .alias("normal_pct"),
    )


def severity_breakdown(df: DataFrame) -> DataFrame:
    """Count and share of all four levels, zeros included."""
    counts = df.groupBy("severity_level").agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0))).scalar()
    return (
        S.severity_table(df.sparkSession).select("severity_level", "severity_name")
        .join(counts, "severity_level", "left")
        .withColumn("n", F.coalesce("n", F.lit(0).cast("bigint")))
        .withColumn("pct", F.round(100 * ratio(F.col("n"), total), 4))
    )


def normal_sample(df: DataFrame, step: int = 100) -> DataFrame:
    """Progress view: every ``step``-th position that is normal, with its confidence."""
    return only(df, NORMAL).where(F.col("flow_id") % step == 0).select(
        "flow_id", F.round(1 - F.col(PROB), 6).alias("confidence"))
