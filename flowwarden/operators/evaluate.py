"""Evaluation of scores against labels. Input: a 0/1 label ``y`` and a probability column."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..fixed_values import DASHBOARD_DEFAULTS, DEFAULT_THRESHOLD, SENSITIVITY_THRESHOLDS, SWEEP_STEPS
from ..functions.values import ratio
from ..session import stored
from .detect import PROB

MICRO = 1_000_000


def label_distribution(df: DataFrame) -> DataFrame:
    return df.groupBy("y").agg(F.count(F.lit(1)).alias("n"))


def score_stats(df: DataFrame, score: str = PROB) -> DataFrame:
    p = F.col(score)
    return df.agg(F.round(F.avg(p), 6).alias("mean_p"), F.min(p).alias("min_p"), F.max(p).alias("max_p"))


def _cells(score: str, threshold) -> dict[str, Column]:
    hit, y = F.col(score) >= threshold, F.col("y")
    return {
        "tn": F.count_if(~hit & (y == 0)), "fp": F.count_if(hit & (y == 0)),
        "fn": F.count_if(~hit & (y == 1)), "tp": F.count_if(hit & (y == 1)),
    }


def confusion_counts(df: DataFrame, threshold: float = DEFAULT_THRESHOLD, score: str = PROB) -> DataFrame:
    """One row with the four cells, also when only one class occurs."""
    return df.agg(*[c.alias(n) for n, c in _cells(score, F.lit(threshold)).items()])


def confusion_matrix(df: DataFrame, threshold: float = DEFAULT_THRESHOLD, score: str = PROB) -> DataFrame:
    cells = [(0, 0, "tn"), (0, 1, "fp"), (1, 0, "fn"), (1, 1, "tp")]
    return confusion_counts(df, threshold, score).select(F.inline(F.array(*[
        F.struct(F.lit(a).alias("actual"), F.lit(p).alias("predicted"), F.col(c).alias("n")) for a, p, c in cells
    ])))


def rates(tp: Column, fp: Column, fn: Column) -> tuple[Column, Column, Column]:
    """Precision, recall and F1; each 0 when undefined."""
    return ratio(tp, tp + fp), ratio(tp, tp + fn), ratio(2 * tp, 2 * tp + fp + fn)


def _rounded(tp, fp, fn):
    return [F.round(c, 6).alias(n) for c, n in zip(rates(tp, fp, fn), ("precision", "recall", "f1"))]


def threshold_sweep(df: DataFrame, steps: int = SWEEP_STEPS, score: str = PROB) -> DataFrame:
    """Errors at thresholds 0.01, 0.02, ... in one pass: count per step, then add up the steps.

    A flow belongs to the largest k with p >= k/100. ``floor(100*p)`` can be one off in
    binary, so it is corrected by comparing with the thresholds themselves.
    """
    p = F.col(score)
    k = F.floor(p * 100)
    k = F.when(p >= (k + 1) / F.lit(100.0), k + 1).when(p < k / F.lit(100.0), k - 1).otherwise(k)
    hits = df.groupBy(F.least(k, F.lit(steps)).cast("int").alias("step")).agg(
        F.count_if(F.col("y") == 1).alias("pos"), F.count_if(F.col("y") == 0).alias("neg"))
    every = df.sparkSession.range(steps + 1).select(F.col("id").cast("int").alias("step"))
    dense = every.join(hits, "step", "left").na.fill(0, ["pos", "neg"])
    lower = W.orderBy("step").rowsBetween(W.unboundedPreceding, -1)      # steps + 1 rows
    upper = W.orderBy("step").rowsBetween(0, W.unboundedFollowing)
    out = dense.select(
        "step", F.coalesce(F.sum("pos").over(lower), F.lit(0)).alias("fn"),
        F.sum("pos").over(upper).alias("tp"), F.sum("neg").over(upper).alias("fp"))
    return out.where("step > 0").select(
        (F.col("step") / F.lit(100.0)).alias("threshold"), "fn", "fp",
        *_rounded(F.col("tp"), F.col("fp"), F.col("fn")))


def zero_fn_threshold(df: DataFrame, policy: str = "first", score: str = PROB) -> DataFrame:
    """The threshold of the sweep that misses no attack, else 0.01, with its errors.

    ``first`` takes the lowest such step: since misses never fall as the threshold rises,
    that is always 0.01. ``max`` takes the highest, the one with the fewest false alarms.
    """
    sweep = threshold_sweep(df, score=score)
    clean = F.when(F.col("fn") == 0, F.col("threshold"))
    choice = {"first": F.min(clean), "max": F.max(clean)}[policy]
    chosen = sweep.agg(F.coalesce(choice, F.lit(DEFAULT_THRESHOLD)).alias("threshold"))
    return sweep.join(F.broadcast(chosen), "threshold").select(F.lit(policy).alias("policy"), *sweep.columns)


def threshold_sensitivity(df: DataFrame, chosen: float = DEFAULT_THRESHOLD, score: str = PROB) -> DataFrame:
    """Errors at the fixed list of thresholds and the chosen one, in one aggregate."""
    values = [round(t, 3) for t in SENSITIVITY_THRESHOLDS + [chosen]]
    wide = df.agg(*[
        c.alias(f"{n}_{i}") for i, t in enumerate(values) for n, c in _cells(score, F.lit(t)).items() if n != "tn"])
    rows = wide.select(F.inline(F.array(*[
        F.struct(F.lit(t).alias("threshold"), F.col(f"fn_{i}").alias("fn"), F.col(f"fp_{i}").alias("fp"),
                 F.col(f"tp_{i}").alias("tp")) for i, t in enumerate(values)])))
    return rows.select(
        "threshold", "fn", "fp", *_rounded(F.col("tp"), F.col("fp"), F.col("fn")),
        (F.abs(F.col("threshold") - chosen) < 0.001).alias("is_chosen"))


def eval_metrics(df: DataFrame, threshold: float = DEFAULT_THRESHOLD, score: str = PROB) -> DataFrame:
    c = confusion_counts(df, threshold, score)
    tn, fp, fn, tp = (F.col(n) for n in ("tn", "fp", "fn", "tp"))
    return c.select(
        F.round(ratio(tn + tp, tn + fp + fn + tp), 6).alias("accuracy"), *_rounded(tp, fp, fn),
        F.round(100 * ratio(fp, tn + fp), 6).alias("false_alarm_rate"),
        fn.alias("false_negatives"), fp.alias("false_positives"))


def classification_report(df: DataFrame, threshold: float = DEFAULT_THRESHOLD, score: str = PROB) -> DataFrame:
    c = confusion_counts(df, threshold, score)
    tn, fp, fn, tp = (F.col(n) for n in ("tn", "fp", "fn", "tp"))
    n0, n1 = tn + fp, tp + fn
    normal, attack = rates(tn, fn, fp), rates(tp, fp, fn)
    none = F.lit(None).cast("double")

    def row(name, values, support):
        p, r, f = values
        return F.struct(
            F.lit(name).alias("label"), F.round(p, 6).alias("precision"), F.round(r, 6).alias("recall"),
            F.round(f, 6).alias("f1"), support.alias("support"))

    rows = [
        row("Normal", normal, n0), row("Intrusion", attack, n1),
        row("accuracy", (none, none, ratio(tn + tp, n0 + n1)), n0 + n1),
        row("macro avg", [(a + b) / 2 for a, b in zip(normal, attack)], n0 + n1),
        row("weighted avg", [ratio(a * n0 + b * n1, n0 + n1) for a, b in zip(normal, attack)], n0 + n1),
    ]
    return c.select(F.inline(F.array(*rows)))


def score_totals(df: DataFrame, score: str = PROB) -> DataFrame:
    """Per distinct score: positives and negatives there (``pos``/``neg``) and above it.

    A range-partitioned prefix sum: distinct scores with their counts are dealt out in ranges and
    written, a window works on one range at a time, and range totals give the offsets.
    """
    counts = df.groupBy(F.col(score).alias("score")).agg(
        F.count_if(F.col("y") == 1).alias("pos"), F.count_if(F.col("y") == 0).alias("neg"))
    cut = stored(counts.repartitionByRange("score").withColumn("_part", F.spark_partition_id()))
    sums = cut.groupBy("_part").agg(F.sum("pos").alias("_p"), F.sum("neg").alias("_n"))
    above = W.orderBy(F.desc("_part")).rowsBetween(W.unboundedPreceding, -1)   # one row per range
    offsets = sums.select("_part", *[
        F.coalesce(F.sum(c).over(above), F.lit(0)).alias(f"_off{c}") for c in ("_p", "_n")])
    inner = W.partitionBy("_part").orderBy(F.desc("score")).rowsBetween(W.unboundedPreceding, -1)
    return cut.join(F.broadcast(offsets), "_part").select(
        "score", "pos", "neg",
        (F.col("_off_p") + F.coalesce(F.sum("pos").over(inner), F.lit(0))).alias("pos_above"),
        (F.col("_off_n") + F.coalesce(F.sum("neg").over(inner), F.lit(0))).alias("neg_above"))


def roc_curve(df: DataFrame, score: str = PROB) -> DataFrame:
    """(threshold, fpr, tpr) at every distinct score, and the origin with a null threshold."""
    totals = df.agg(F.count_if(F.col("y") == 1).alias("_pos"), F.count_if(F.col("y") == 0).alias("_neg"))
    points = score_totals(df, score).join(F.broadcast(totals), F.lit(True)).select(
        F.col("score").alias("threshold"),
        F.round(ratio(F.col("neg_above") + F.col("neg"), F.col("_neg")), 6).alias("fpr"),
        F.round(ratio(F.col("pos_above") + F.col("pos"), F.col("_pos")), 6).alias("tpr"))
    origin = df.sparkSession.range(1).select(
        F.lit(None).cast("double").alias("threshold"), F.lit(0.0).alias("fpr"), F.lit(0.0).alias("tpr"))
    return points.unionByName(origin)


def roc_auc(df: DataFrame, score: str = PROB) -> DataFrame:
    """Probability that an attack outscores a normal flow, ties counted half; null for one class.

    Sums of products of counts are kept as decimals: they outgrow 64 bits on large runs.
    """
    wide = "decimal(38,1)"
    pairs = F.col("neg").cast("decimal(19,0)") * F.col("pos_above") + (
        F.col("neg").cast("decimal(19,0)") * F.col("pos") * F.lit(0.5).cast("decimal(2,1)"))
    return score_totals(df, score).agg(
        F.sum(pairs.cast(wide)).alias("_w"), F.sum("pos").alias("_p"), F.sum("neg").alias("_n"),
    ).select(F.round(F.when(
        (F.col("_p") > 0) & (F.col("_n") > 0),
        F.col("_w").cast("double") / (F.col("_p").cast("double") * F.col("_n").cast("double"))), 6).alias("roc_auc"))


def dashboard(metrics: DataFrame) -> DataFrame:
    """Metric record with the published defaults for whatever is absent."""
    cols = []
    for name, default in DASHBOARD_DEFAULTS.items():
        kind = "bigint" if isinstance(default, int) else "double"
        value = F.col(name) if name in metrics.columns else F.lit(None)
        cols.append(F.coalesce(value.cast(kind), F.lit(default).cast(kind)).alias(name))
    return metrics.select(*cols, F.lit("online").alias("status"))
